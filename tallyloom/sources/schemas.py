"""Explicit schemas of the survey tables; answers are text codes."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tallyloom.sources.derive import HOUSEHOLD_CODES, PERSON_CODES, code_lists

_WEIGHTS = ["wgh_samp_pop_restr", "wgh_strata_spec"]
_ADULT_WEIGHTS = ["wgh_strata_spec_resp", "wgh_samp_pop_restr_resp"]


def _schema(ids: list[str], weights: list[str], codes: str, bands: list[str]) -> StructType:
    fields = [StructField(c, LongType()) for c in ids]
    fields += [StructField(c, StringType()) for c in ["pop_groups", "samp_strat"]]
    fields += [StructField(c, DoubleType()) for c in weights]
    answers = ["citizenship", *[name for _, name, _ in code_lists(codes)], *bands]
    return StructType(fields + [StructField(c, StringType()) for c in answers])


HOUSEHOLDS = _schema(["hh_id"], _WEIGHTS + _ADULT_WEIGHTS, HOUSEHOLD_CODES, ["HH07_cat"])
PERSONS = _schema(["person_id", "hh_id"], _WEIGHTS, PERSON_CODES, ["HH07_cat", "HH07_cat2"])
