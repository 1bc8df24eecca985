"""The combined indicator table and what is derived from it."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.design import SurveyDesign
from tallyloom.operators.estimate import indicator_tables, union_tables
from tallyloom.operators.profile import headline_counts
from tallyloom.plans.catalogue import CORE, HOUSEHOLD, PERSON, Estimate, Spec
from tallyloom.plans.rules import deferred

REPORT_NAMES = {
    "var_name": "Core Indicator",
    "num_obs_uw": "Unweighted Count",
    "denominator": "Weighted Total",
    "mean_value": "Indicator Value",
}


def estimates(
    specs: Mapping[str, Spec], frames: Mapping[str, DataFrame], names: list[str]
) -> DataFrame:
    """Several tables of means and ratios stacked, with one pass per table and sampling.

    ``frames`` are whole recoded tables; a part of the sample is a table's ``where``.
    """
    chosen = [specs[n] for n in names if n in specs]
    passes: dict[tuple[str, str | None], list] = {}
    for spec in chosen:
        if not isinstance(spec, Estimate):
            raise TypeError("only tables of means and ratios can be stacked")
        passes.setdefault((spec.grain, spec.strata), []).append(spec.table)
    parts = [
        indicator_tables(SurveyDesign(frames[grain], strata=strata, deferred=deferred(frames[grain])), tables)
        for (grain, strata), tables in passes.items()
    ]
    return union_tables(parts)


def combined_indicators(
    specs: Mapping[str, Spec], frames: Mapping[str, DataFrame]
) -> DataFrame:
    """All core indicators by population group in one table."""
    return estimates(specs, frames, CORE)


def columns_taken(specs: Mapping[str, Spec], grain: str) -> set[str]:
    """Every name in the combined table's specifications of one base table, its columns among them."""
    texts = []
    for spec in (specs[n] for n in CORE if n in specs and specs[n].grain == grain):
        for value in (spec.strata, *vars(spec.table).values()):
            texts += [value] if isinstance(value, str) else filter(None, value if isinstance(value, (list, tuple)) else ())
    return set(re.findall(r"\w+", " ".join(texts)))


def indicators_by_stratum(
    specs: Mapping[str, Spec], frames: Mapping[str, DataFrame]
) -> DataFrame:
    """All core indicators by stratum in one table."""
    return estimates(specs, frames, [f"{c}_strata" for c in CORE])


def report_table(combined: DataFrame) -> DataFrame:
    """Reported columns of the combined table under their display names."""
    kept = combined.select("pop_groups", *REPORT_NAMES)
    return kept.withColumnsRenamed(REPORT_NAMES)


def for_group(combined: DataFrame, group: str) -> DataFrame:
    """Rows of one population group."""
    return combined.where(F.col("pop_groups") == group)


def headline(
    frames: Mapping[str, DataFrame],
    household_groups: Mapping[str, str],
    genders: Mapping[str, str],
    age_bands: Mapping[str, str],
) -> DataFrame:
    """Households in all and by group, persons in all, by gender and by age band."""

    def conditions(column: str, values: Mapping[str, str]) -> dict[str, str]:
        return {name: f"{column} = '{value}'" for name, value in values.items()}

    return union_tables(
        [
            headline_counts(
                frames[HOUSEHOLD], "households", conditions("pop_groups", household_groups)
            ),
            headline_counts(
                frames[PERSON],
                "persons",
                conditions("HH04", genders) | conditions("HH07_cat2", age_bands),
            ),
        ]
    )
