"""The standard summary tables, as specifications.

``PLAIN`` holds the tables of a survey without weights and strata, ``REPORT`` the
tables its report adds or changes, ``STRATIFIED`` those of a stratified and
weighted survey.  Every specification runs on the recoded household table or the
recoded person table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tallyloom.operators.design import SurveyDesign
from tallyloom.operators.estimate import (
    ALL,
    ANSWERED,
    MeanTable,
    RatioTable,
    mean_tables,
    ratio_table,
)
from tallyloom.operators.profile import component_shares, distribution
from tallyloom.plans import codebook as book
from tallyloom.plans.rules import deferred

HOUSEHOLD = "household"
PERSON = "person"

STRATUM = "samp_strat"
POPULATION = "wgh_samp_pop_restr"
STRATA = "wgh_strata_spec"
ADULT_POPULATION = "wgh_samp_pop_restr_resp"
ADULT_STRATA = "wgh_strata_spec_resp"


@dataclass(frozen=True)
class Estimate:
    """A table of means or ratios under a survey design."""

    grain: str
    table: MeanTable | RatioTable
    strata: str | None = None


@dataclass(frozen=True)
class Shares:
    """A table of component shares, see ``component_shares``."""

    grain: str
    columns: Sequence[str]
    by: Sequence[str] = ()
    names_to: str = "facility"
    values_to: str = "percentage"
    labels: Mapping[str, str] | None = None
    equals: float | None = None
    weight: str | None = None
    where: str | None = None
    keep: Sequence[str] = ()
    unlisted: str = "missing"


@dataclass(frozen=True)
class Distribution:
    """A table of answer shares, see ``distribution``."""

    grain: str
    column: str
    by: Sequence[str] = ()
    labels: Mapping[str, str] | None = None
    label_first: bool = False
    skip_missing: bool = True
    count_name: str = "n"
    share_name: str = "Percentage"


Spec = Estimate | Shares | Distribution


def present(*columns: str) -> str:
    """Predicate: none of the columns is missing."""
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


_GROUP = ["pop_groups"]
_IN_GROUP = present("pop_groups")
_IN_STRATUM = present(STRATUM)
_ADULT = "HH07 > 18"

# Core indicators of each grain; those marked adult are answered by one adult per household.
HOUSEHOLD_INDICATORS = [
    "impact2_2",
    "outcome8_2",
    "outcome9_1",
    "outcome9_2",
    "outcome10_2",
    "outcome12_1",
    "outcome12_2",
    "outcome16_1",
    "outcome16_2",
]
ADULT_INDICATORS = [
    "impact3_3",
    "outcome4_1",
    "outcome4_2",
    "outcome13_1",
    "outcome13_2",
    "outcome13_3",
]
PERSON_INDICATORS = ["impact2_3", "outcome1_2", "outcome1_3", "outcome5_2", "outcome10_1"]

# Order of the combined table.
CORE = [
    "impact2_2",
    "impact2_3",
    "impact3_2a",
    "impact3_2b",
    "impact3_3",
    "outcome1_2",
    "outcome1_3",
    "outcome4_1",
    "outcome4_2",
    "outcome5_2",
    "outcome8_2",
    "outcome9_1",
    "outcome9_2",
    "outcome10_1",
    "outcome10_2",
    "outcome12_1",
    "outcome12_2",
    "outcome13_1",
    "outcome13_2",
    "outcome13_3",
    "outcome14_1",
    "outcome16_1",
    "outcome16_2",
]

RATIOS = {
    "impact3_2a": ("edu_primary", "age_primary"),
    "impact3_2b": ("edu_secondary", "age_secondary"),
}


def _mean(grain, column, by, where=None, strata=None, **options) -> Estimate:
    return Estimate(grain, MeanTable(column, column, tuple(by), where, binary=True, **options), strata)


def _ratio(column, by, where, strata=None, weight=None, base_denominator=False) -> Estimate:
    top, base = RATIOS[column]
    denominator = base if base_denominator else top
    table = RatioTable(column, top, base, tuple(by), where, denominator, weight, binary=True)
    return Estimate(PERSON, table, strata)


def _plain() -> dict[str, Spec]:
    out: dict[str, Spec] = {}
    for c in HOUSEHOLD_INDICATORS + ADULT_INDICATORS:
        out[c] = _mean(HOUSEHOLD, c, _GROUP, _IN_GROUP)
    out["outcome4_1"] = _mean(HOUSEHOLD, "outcome4_1", _GROUP, _IN_GROUP, denominator=ANSWERED)
    for c in PERSON_INDICATORS:
        out[c] = _mean(PERSON, c, _GROUP, _IN_GROUP)
    out["outcome14_1"] = _mean(
        PERSON, "outcome14_1", _GROUP, "pop_groups = 'Refugee returnees'"
    )
    for c in RATIOS:
        out[c] = _ratio(c, _GROUP, _IN_GROUP)
        keys = ["pop_groups", "disability", "HH04"]
        out[f"{c}_agd"] = _ratio(c, keys, present(*keys))
    profile = ["HH07_cat", "HH04", "disability"]
    known = present("HH04", "disability", "HH07_cat")
    for c in ["impact2_3", "outcome1_3"]:
        out[f"{c}_agd"] = _mean(PERSON, c, profile, known)
    for c in ["impact3_3", "outcome4_1", "outcome4_2", "outcome13_1", "outcome13_2"]:
        out[f"{c}_agd"] = _mean(HOUSEHOLD, c, profile, f"{known} AND {_ADULT}", count=ANSWERED)
    out["outcome13_3_agd"] = _mean(
        HOUSEHOLD,
        "outcome13_3",
        ["HH07_cat", "disability", "pop_groups"],
        f"{present('disability', 'HH07_cat')} AND {_ADULT}",
        count=ANSWERED,
    )
    in_profile = present("HH04", "disability", "pop_groups")
    for c in ["outcome1_2", "outcome10_1"]:
        out[f"{c}_agd"] = _mean(
            PERSON,
            c,
            ["HH07_cat", "HH04", "pop_groups"],
            f"{in_profile} AND HH07 < 5",
            count=ANSWERED,
        )
    out["outcome5_2_agd"] = _mean(
        PERSON, "outcome5_2", ["HH04", "pop_groups", "disability"], in_profile, count=ANSWERED
    )
    out["impact3_3_edu"] = _mean(
        HOUSEHOLD,
        "impact3_3",
        ["EDU01_random"],
        f"{present('EDU01_random')} AND {_ADULT}",
        count=ANSWERED,
    )
    out["outcome4_1_edu"] = _mean(
        HOUSEHOLD, "outcome4_1", ["EDU01_random"], present("EDU01_random"), count=ALL
    )
    out["composite_impact2_2"] = Shares(HOUSEHOLD, list(book.BASIC_FACILITIES), _GROUP)
    out["composite_outcome9_1"] = Shares(HOUSEHOLD, list(book.HOUSING_CONDITIONS), _GROUP)
    out["composite_outcome12_1"] = Shares(HOUSEHOLD, list(book.WATER_CONDITIONS), _GROUP)
    out["composite_outcome12_2"] = Shares(HOUSEHOLD, list(book.TOILET_CONDITIONS), _GROUP)
    out["composite_outcome13_1"] = Shares(
        HOUSEHOLD, list(book.BANK_ACCESS), _GROUP, names_to="access"
    )
    out["hacc_percentages"] = _options(PERSON, book.HEALTH_REASONS, "Reason")
    out["identity_document_percentages"] = _options(PERSON, book.IDENTITY_DOCUMENTS, "Document")
    out["gbv01_percentages"] = _options(HOUSEHOLD, book.GBV_SERVICES, "Services")
    out["vaw01_percentages"] = _options(HOUSEHOLD, book.VIOLENCE_QUESTIONS, "Question")
    out["spf01_percentages"] = _options(HOUSEHOLD, book.SOCIAL_PROTECTION, "Service")
    out["cook02_percentages"] = Distribution(HOUSEHOLD, "COOK02", labels=book.STOVES)
    out["light02_percentages"] = Distribution(HOUSEHOLD, "LIGHT02", labels=book.LIGHTING)
    out["inc01_percentages"] = Distribution(HOUSEHOLD, "INC01", labels=book.INCOME_CHANGE)
    out["inc02_percentages"] = Distribution(HOUSEHOLD, "INC02", labels=book.GOODS_AFFORDED)
    out["dwe10_percentages"] = Distribution(
        HOUSEHOLD, "DWE10", labels=book.TENURE_RISK, label_first=True
    )
    return out


def _options(grain, labels, names_to, by=(), **options) -> Shares:
    """Shares of "yes" in a multiple-choice question."""
    columns = options.pop("columns", list(labels))
    return Shares(grain, columns, by, names_to, "Percentage", labels, equals=1, **options)


def _report() -> dict[str, Spec]:
    plain = _plain()
    with_cv = plain["impact2_3_agd"]
    return {
        "impact2_3_agd": replace(with_cv, table=replace(with_cv.table, cv=True)),
        "availability_summary": Distribution(
            HOUSEHOLD,
            "electricity_availability",
            _GROUP,
            skip_missing=False,
            count_name="count",
            share_name="percentage",
        ),
        "spf01_percentages": _options(
            HOUSEHOLD, book.SOCIAL_PROTECTION, "Service", columns=["SPF01b", "SPF01c", "SPF01g"]
        ),
    }


def _stratified() -> dict[str, Spec]:
    out: dict[str, Spec] = {}
    by_stratum = [STRATUM]

    def mean(grain, column, by, where=None, weight=POPULATION, **options):
        return _mean(grain, column, by, where, strata=STRATUM, weight=weight, **options)

    # These by-stratum tables use the population weight.
    population_weighted = {"impact2_2", "outcome10_2", "outcome12_1"}
    for c in HOUSEHOLD_INDICATORS:
        out[c] = mean(HOUSEHOLD, c, _GROUP, _IN_GROUP)
        weight = POPULATION if c in population_weighted else STRATA
        out[f"{c}_strata"] = mean(HOUSEHOLD, c, by_stratum, _IN_STRATUM, weight)
    for c in ADULT_INDICATORS:
        out[c] = mean(HOUSEHOLD, c, _GROUP, _IN_GROUP, ADULT_POPULATION)
        out[f"{c}_strata"] = mean(HOUSEHOLD, c, by_stratum, _IN_STRATUM, ADULT_STRATA)
    for c in PERSON_INDICATORS:
        out[c] = mean(PERSON, c, _GROUP, _IN_GROUP)
        out[f"{c}_strata"] = mean(PERSON, c, by_stratum, _IN_STRATUM, STRATA)
    for c in RATIOS:
        over_age = c == "impact3_2a"
        out[c] = _ratio(c, _GROUP, _IN_GROUP, STRATUM, POPULATION, over_age)
        out[f"{c}_strata"] = _ratio(c, by_stratum, _IN_STRATUM, STRATUM, STRATA, over_age)
        out[f"{c}_agd"] = _ratio(c, ["pop_groups", "HH04"], present("HH04"), STRATUM, POPULATION)
    profile = ["pop_groups", "HH07_cat", "HH04", "disability"]
    known = present("disability", "HH07_cat")
    out["impact2_3_agd"] = mean(
        PERSON, "impact2_3", profile, f"NOT coalesce(HH04 IN ('3', '99'), false) AND {known}"
    )
    out["outcome1_3_agd"] = mean(
        PERSON, "outcome1_3", profile, f"{present('HH04')} AND {known} AND HH04 <> '99'"
    )
    adult = {"weight": ADULT_POPULATION, "count": ANSWERED}
    for c in ADULT_INDICATORS:
        where = f"{known} AND {_ADULT}"
        if c == "outcome4_2":
            where = f"{present('HH04')} AND {where}"
        out[f"{c}_agd"] = mean(HOUSEHOLD, c, profile, where, **adult)
    out["outcome1_2_agd"] = mean(
        PERSON, "outcome1_2", ["pop_groups", "HH04"], f"{_IN_GROUP} AND HH07 < 5"
    )
    out["outcome5_2_agd"] = mean(
        PERSON,
        "outcome5_2",
        ["pop_groups", "HH04", "disability"],
        f"{present('HH04', 'disability', 'pop_groups')} AND HH04 <> '99'",
        count=ANSWERED,
    )
    out["outcome10_1_agd"] = mean(
        PERSON,
        "outcome10_1",
        ["HH07_cat", "HH04", "pop_groups"],
        f"disability IS NULL AND {_IN_GROUP} AND HH07 < 5",
        count=ANSWERED,
    )
    out["outcome4_1_edu"] = mean(
        HOUSEHOLD,
        "outcome4_1",
        ["pop_groups", "EDU01_random"],
        present("EDU01_random"),
        ADULT_POPULATION,
        count=ALL,
    )
    facilities = {"labels": book.BASIC_FACILITIES, "unlisted": "keep"}
    columns = list(book.BASIC_FACILITIES)
    out["composite_impact2_2_pop"] = Shares(
        HOUSEHOLD, columns, _GROUP, weight=POPULATION, **facilities
    )
    out["composite_impact2_2_strata"] = Shares(
        HOUSEHOLD, columns, by_stratum, weight=STRATA, **facilities
    )
    out["hacc_percentages"] = _options(
        PERSON, book.HEALTH_REASONS, "Reason", _GROUP, weight=POPULATION
    )
    # The last document stays beside the rows of the others.
    asked = [c for c in book.IDENTITY_DOCUMENTS if c.startswith("REG01")]
    out["identity_document_percentages"] = _options(
        PERSON,
        book.IDENTITY_DOCUMENTS_STRATIFIED,
        "Document",
        _GROUP,
        columns=asked,
        keep=["REG02"],
        where=_IN_GROUP,
    )
    out["gbv01_percentages"] = _options(
        HOUSEHOLD, book.GBV_SERVICES_STRATIFIED, "Services", _GROUP, where=_IN_GROUP
    )
    out["vaw01_percentages"] = _options(
        HOUSEHOLD, book.VIOLENCE_QUESTIONS, "Question", _GROUP, where=_IN_GROUP
    )
    out["spf01_percentages"] = _options(
        HOUSEHOLD, book.SOCIAL_PROTECTION_STRATIFIED, "Service", _GROUP
    )
    for name in ["outcome9_1", "outcome12_1", "outcome12_2", "outcome13_1"]:
        out[f"composite_{name}"] = _plain()[f"composite_{name}"]
    for name, column, labels in [
        ("cook02", "COOK02", book.STOVES),
        ("light02", "LIGHT02", book.LIGHTING),
        ("inc01", "INC01", book.INCOME_CHANGE),
        ("inc02", "INC02", book.GOODS_AFFORDED),
        ("dwe10", "DWE10", None),
    ]:
        out[f"{name}_percentages"] = Distribution(HOUSEHOLD, column, _GROUP, labels)
    return out


PLAIN = _plain()
REPORT = _report()
STRATIFIED = _stratified()


def run(spec: Spec, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Result of one table; ``frames`` holds the recoded table of each grain."""
    frame = frames[spec.grain]
    if isinstance(spec, Estimate):
        t = spec.table
        design = SurveyDesign(frame, t.weight, spec.strata, deferred=deferred(frame))
        if isinstance(t, MeanTable):
            return mean_tables(design, [t]).drop("table")
        return ratio_table(
            design, t.numerator, t.base, t.by, t.name, t.where, t.denominator, t.digits, t.binary
        )
    options = {k: v for k, v in vars(spec).items() if k != "grain"}
    if isinstance(spec, Shares):
        return component_shares(frame, **options)
    return distribution(frame, **options)
