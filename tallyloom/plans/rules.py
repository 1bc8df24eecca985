"""Recodes from raw answers to 0/1 indicators.

A table is recoded in a few wide projections: answers are read as numbers once,
helper conditions follow, then the indicators that combine them.  Each pass is
one projection, so the plan stays shallow and unused columns are pruned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyloom.functions.codes import (
    all_match,
    all_of,
    any_flag,
    any_of,
    any_one,
    is_in,
    listed,
    name,
    quoted,
    scored,
    two_way,
)
from tallyloom.functions.labels import attach_labels, number_label
from tallyloom.operators.profile import numeric_columns
from tallyloom.plans.codebook import DISABILITY, EDUCATION, INDICATORS, YES_NO
from tallyloom.sources.schemas import HOUSEHOLDS, PERSONS

# Lettered and numbered item groups of the questionnaire.
SHELTER_ITEMS = [f"SHEL0{i}" for i in range(1, 7)]
GBV_ITEMS = ["GBV01a", "GBV01b", "GBV01c", "GBV01d"]
VIOLENCE_ITEMS = ["VAW01a", "VAW01b", "VAW01c", "VAW01d", "VAW01e"]
BANK_ITEMS = ["BANK01", "BANK02", "BANK03", "BANK05"]
PROTECTION_ITEMS = [f"SPF01{x}" for x in "abcdefghjklmnop"]
UNDER5_DOCUMENTS = [f"REG05{x}" for x in "abcdef"] + ["REG06", "REG03"]
ABOVE5_DOCUMENTS = [f"REG01{x}" for x in "abcdefg"] + ["REG02"]
# Reasons for not reaching health care that count as no access / as access.
HEALTH_BARRIERS = [f"HACC04_{i}" for i in (1, 2, 4, 7, 10, 11, 12, 13)]
HEALTH_CHOICES = [f"HACC04_{i}" for i in (3, 5, 6, 8, 9, 96)]

FACILITY_FLAGS = ["shelter", "electricity", "drinkingwater", "healthcare", "secure"]

# Columns of the survey that are text and stay so; its other text columns are coded answers.
_TEXT = {"pop_groups", "samp_strat", "citizenship", "HH04", "HH07_cat", "HH07_cat2"}
ANSWERS = [
    f.name
    for f in {f.name: f for f in [*HOUSEHOLDS, *PERSONS]}.values()
    if f.dataType == StringType() and f.name not in _TEXT
]


@dataclass(frozen=True)
class RuleOptions:
    """Choices left open by the indicator definitions.

    ``gbv_row_wise``: read "all services unknown" per respondent instead of over
    the whole table.  ``strict_water``: exclude unimproved water sources by code.
    ``strict_toilet``: require all three toilet conditions.  Age bounds are
    inclusive.  Citizenship is ``foreign_code`` or else ``own_code``.
    """

    gbv_row_wise: bool = False
    strict_water: bool = False
    strict_toilet: bool = False
    primary_age: tuple[int, int] = (6, 13)
    secondary_age: tuple[int, int] = (11, 18)
    registration_age: int = 5
    working_age: int = 18
    max_crowding: float = 3
    max_water_minutes: float = 30
    max_health_minutes: float = 60
    foreign_code: str = "SDN"
    own_code: str = "SSD"


DEFAULTS = RuleOptions()

Rules = dict[str, str]


def _project(frame: DataFrame, rules: Rules) -> DataFrame:
    """All columns, with the given ones replaced or added."""
    kept = [F.col(name(c)) for c in frame.columns if c not in rules]
    return frame.select(*kept, *[F.expr(text).alias(c) for c, text in rules.items()])


def numeric_answers(frame: DataFrame, answers: Sequence[str] = ANSWERS) -> DataFrame:
    """Read the named answer columns as numbers, with their labels.

    Names count in any case; every other column stays as it is.
    """
    return numeric_columns(frame, answers)


def respondent_rules(columns: list[str], o: RuleOptions = DEFAULTS) -> Rules:
    """Disaggregation columns: citizenship, disability and education labels."""
    foreign, own = quoted(o.foreign_code), quoted(o.own_code)
    out = {"citizenship": two_way(f"citizenship = {foreign}", foreign, own)}
    if "disability_code" in columns:
        out["disability"] = number_label("disability_code", DISABILITY)
    if "EDU01_random_code" in columns:
        out["EDU01_random"] = number_label("EDU01_random_code", EDUCATION)
    return out


def _sound_shelter() -> str:
    """All construction answers good, any bad, or undecided; 98 is a missing answer."""
    good = {"SHEL01": 1, "SHEL02": 1, "SHEL05": 1, "SHEL03": 0, "SHEL04": 0, "SHEL06": 0}
    return scored(
        yes=all_of(f"nullif({c}, 98) = {v}" for c, v in good.items()),
        no=any_of(f"nullif({c}, 98) = {1 - v}" for c, v in good.items()),
    )


def _employed(o: RuleOptions) -> str:
    sells = is_in("UNEM08", [1, 2])
    work = any_of(
        [
            any_one(["UNEM01", "UNEM04"]),
            f"{any_one(['UNEM02', 'UNEM03'])} AND UNEM07 = 3",
            "UNEM05 = 1 AND UNEM06 = 3",
            f"UNEM02 = 1 AND {is_in('UNEM07', [1, 2])} AND {sells}",
            f"UNEM05 = 1 AND {is_in('UNEM06', [1, 2])} AND {sells}",
        ]
    )
    of_age = f"HH07 >= {o.working_age}"
    return scored(yes=f"{of_age} AND {work}", no=of_age)


def household_conditions(o: RuleOptions) -> Rules:
    """Helper conditions and indicators that need the household's answers only."""
    improved = "DWA01 IS NOT NULL"
    if o.strict_water:
        improved = f"NOT {is_in('DWA01', [7, 9, 13, 96, 98])}"
    attended = any_one(["BIR01", "BIR02"])
    return {
        "electricity": two_way("LIGHT01 = 1 AND LIGHT02 = 1 AND LIGHT03 <> 0"),
        "healthcare": two_way(
            f"HEA01 <> 96 AND HEA01 <> 98 AND HEA03 <= {o.max_health_minutes}"
        ),
        "time_DWA": "CASE DWA03a WHEN 1 THEN 1D WHEN 2 THEN 60D END",
        "dwa_cond2": scored(yes=improved, default=0),
        "dwa_cond3": scored(no="DWA02 = 3", default=1),
        "housing": _sound_shelter(),
        "crowding": "try_divide(hh_size_001, DWE05)",
        "secure": scored(no=any_one(["RISK01", "RISK02"]), default=1),
        "dwe09_cat": scored(
            yes=f"(DWE08 = 1 AND {is_in('DWE09', [1, 2])}) OR DWE08 = 0",
            no=f"DWE08 = 1 AND {is_in('DWE09', [3, 4])}",
        ),
        "toi_cond1": scored(
            yes=is_in("TOI01", [1, 2, 3, 4, 5, 6, 7, 9]), no=is_in("TOI01", [8, 10, 11, 12, 96])
        ),
        "toi_cond2": scored(
            yes=f"TOI02 = 1 AND {is_in('TOI03', [1, 2, 3, 4])}",
            no=f"(TOI02 = 1 AND {is_in('TOI03', [5, 96, 98])}) OR {is_in('TOI02', [2, 98])}",
        ),
        "toi_cond3": scored(yes="TOI05 = 0", no="TOI05 = 1"),
        "working_age": scored(yes=f"HH07 >= {o.working_age}"),
        "employed": _employed(o),
        "electricity_availability": "CASE WHEN LIGHT05 = 1 THEN '24 hours'"
        " WHEN LIGHT05_11 < 4 THEN 'Less than 4 hours'"
        " WHEN LIGHT05_22 < 60 THEN 'Less than 1 hour' ELSE 'No electricity' END",
        "impact3_3": scored(yes=is_in("SAF01", [1, 2]), no=is_in("SAF01", [3, 4])),
        "outcome4_2": scored(yes=all_match(VIOLENCE_ITEMS, 0), no=any_one(VIOLENCE_ITEMS)),
        "outcome8_2": scored(
            yes=f"(COOK01 = 1 AND {listed('COOK02', [1, 2, 3, 4, 5])})"
            f" OR ({listed('COOK02', [10])} AND {listed('COOK03', [1])})",
            no=f"(COOK01 = 1 AND {listed('COOK02', [7, 8, 9, 10, 96])})"
            f" OR ({listed('COOK02', [10])} AND NOT {listed('COOK03', [1])}) OR COOK01 = 0",
        ),
        "outcome9_2": scored(
            yes=f"LIGHT01 = 1 AND {is_in('LIGHT02', [1, 2, 3, 4, 5, 6, 7])}", default=0
        ),
        "outcome10_2": scored(
            yes=f"{attended} AND {is_in('BIR03', [1, 2, 3])}",
            no=f"{attended} AND {is_in('BIR03', [4, 5, 6])}",
        ),
        "outcome13_1": scored(yes=any_one(BANK_ITEMS), default=0),
        "outcome13_2": scored(yes=f"{is_in('INC01', [1, 2, 3])} AND INC02 = 1", default=0),
        "outcome16_1": scored(
            yes=f"{is_in('DWE10', [1, 2])} AND DWE06a_land = 1 AND DWE06a_housing = 1",
            no=f"DWE06a_land = 0 OR DWE06a_housing = 0 OR {is_in('DWE10', [3, 4])}",
        ),
        "outcome16_2": scored(yes=any_flag(PROTECTION_ITEMS), default=0),
    }


def household_composites(o: RuleOptions) -> list[Rules]:
    """Indicators over other indicators, one pass per level of dependency."""
    toilet = [f"toi_cond{i} = 1" for i in (1, 2, 3)]
    looking = all_match(["UNEM09", "UNEM10"], 1)
    return [
        {
            "time_tot": "time_DWA * DWA03b",
            "dwe05_cat": scored(yes=f"crowding <= {o.max_crowding}", default=0),
            "habitablehousing": "housing",
            "outcome12_2": scored(
                yes=all_of(toilet) if o.strict_toilet else any_of(toilet), default=0
            ),
            "unemployed": scored(
                yes=f"working_age = 1 AND employed = 0 AND {looking}", no="working_age = 1"
            ),
        },
        {
            "dwa_cond1": scored(no=f"time_tot > {o.max_water_minutes}", default=1),
            "shelter": scored(yes=all_match(["dwe05_cat", "housing"], 1), default=0),
            "outcome9_1": scored(
                yes=all_match(["dwe05_cat", "habitablehousing", "dwe09_cat"], 1), default=0
            ),
            "labour_force": scored(
                yes=f"working_age = 1 AND {any_one(['employed', 'unemployed'])}",
                no="working_age = 1",
            ),
        },
        {
            "drinkingwater": scored(
                yes=f"{any_one(['dwa_cond1', 'dwa_cond3'])} AND dwa_cond2 = 1", default=0
            ),
            "outcome13_3": scored(
                yes=all_match(["unemployed", "labour_force"], 1),
                no=all_match(["employed", "labour_force"], 1),
            ),
        },
        {
            "impact2_2": scored(
                yes=all_match(FACILITY_FLAGS, 1), no=any_of(f"{f} = 0" for f in FACILITY_FLAGS)
            ),
            "outcome12_1": "drinkingwater",
        },
    ]


#: Columns missing everywhere unless a row of the table meets a condition: their values row by
#: row and that condition.  Estimates over the whole table take both from their own pass.
WHOLE_TABLE = {"outcome4_1": ("outcome4_1_row", "gbv_other_answer")}


def with_gbv_knowledge(frame: DataFrame, o: RuleOptions = DEFAULTS) -> DataFrame:
    """Add outcome4_1: missing only if every service is unknown.

    By default that is asked of the whole table, so it can only be missing for
    everybody; the check is an EXISTS that stops at the first other answer.  The two columns of
    ``WHOLE_TABLE`` let an estimate do without it.
    """
    unknown = all_match(GBV_ITEMS, 98)
    knows = any_one(["GBV01a", "GBV01b"])
    if o.gbv_row_wise:
        rule = f"CASE WHEN {knows} THEN 1D WHEN {unknown} THEN NULL ELSE 0D END"
        return _project(frame, {"outcome4_1": rule})
    other = f"NOT coalesce({unknown}, false)"
    rule = F.when(F.expr(knows), 1.0).when(frame.selectExpr(*GBV_ITEMS).where(other).exists(), 0.0)
    row, flag = WHOLE_TABLE["outcome4_1"]
    return _project(frame, {row: f"CASE WHEN {knows} THEN 1D ELSE 0D END", flag: other}).withColumn("outcome4_1", rule)


def deferred(frame: DataFrame) -> dict[str, tuple[str, str]]:
    """The entries of ``WHOLE_TABLE`` whose columns a whole recoded table has."""
    return {c: parts for c, parts in WHOLE_TABLE.items() if {c, *parts} <= set(frame.columns)}


def household_indicators(frame: DataFrame, options: RuleOptions = DEFAULTS) -> DataFrame:
    """Household table with numeric answers, helper conditions and household indicators."""
    answers = numeric_answers(frame)
    rules = {**respondent_rules(frame.columns, options), **household_conditions(options)}
    out = with_gbv_knowledge(_project(answers, rules), options)
    for step in household_composites(options):
        out = _project(out, step)
    return out


def _documents(items: list[str], strict: bool) -> str:
    none = all_match(items, 0) if strict else all_of(f"{x} <> 1" for x in items)
    return scored(yes=any_one(items), no=none)


def _either(first: str, second: str) -> str:
    """1 if either is 1, else 0 if either is 0, else missing."""
    return scored(yes=any_one([first, second]), no=f"{first} = 0 OR {second} = 0")


def person_conditions(o: RuleOptions) -> Rules:
    """Helper conditions and indicators that need the person's answers only."""
    turned_away = "HACC01 = 1 AND HACC03 = 0"
    barrier = any_one(HEALTH_BARRIERS)
    enrolled = "EDU01 = 1 AND EDU02 = 1"
    programme = ["COMM02", "COMM03", "COMM04"]
    return {
        "impact2_3": f"CASE WHEN HACC01 = 1 AND HACC03 = 1 THEN 1D"
        f" WHEN {turned_away} AND {barrier} THEN 0D"
        f" WHEN {turned_away} AND {any_one(HEALTH_CHOICES)} THEN 1D END",
        "edu_primary": scored(yes=f"{enrolled} AND EDU03 = 2", default=0),
        "age_primary": scored(
            yes=f"HH07 BETWEEN {o.primary_age[0]} AND {o.primary_age[1]}", default=0
        ),
        "edu_secondary": scored(yes=f"{enrolled} AND {is_in('EDU03', [3, 4])}", default=0),
        "age_secondary": scored(
            yes=f"HH07 BETWEEN {o.secondary_age[0]} AND {o.secondary_age[1]}"
        ),
        "birthCertificate": scored(yes="REG03 = 1", no=is_in("REG03", [0, 98])),
        "birthRegistered": scored(yes="REG04 = 1", no=is_in("REG04", [0, 98])),
        "document_under5": _documents(UNDER5_DOCUMENTS, strict=False),
        "document_above5": _documents(ABOVE5_DOCUMENTS, strict=False),
        "document_under5_strict": _documents(UNDER5_DOCUMENTS, strict=True),
        "document_above5_strict": _documents(ABOVE5_DOCUMENTS, strict=True),
        "outcome5_2": scored(
            yes="COMM01 = 1 AND COMM02 >= 1 AND COMM02 <> 98 AND COMM03 = 1 AND COMM04 = 1",
            no=any_of(["COMM01 = 0"] + [is_in(p, [0, 98]) for p in programme]),
        ),
        "outcome10_1": scored(yes="MMR03 = 1", no=is_in("MMR03", [0, 98])),
    }


def person_composites(o: RuleOptions) -> Rules:
    """Person indicators over other person indicators."""
    young = f"HH07 < {o.registration_age}"
    proofs = ["birthRegistered", "birthCertificate"]
    return {
        "outcome1_2": scored(
            yes=f"{young} AND {any_one(proofs)}", no=f"{young} AND {all_match(proofs, 0)}"
        ),
        "outcome1_3": _either("document_above5", "document_under5"),
        "outcome14_1": _either("document_above5_strict", "document_under5_strict"),
    }


def person_indicators(frame: DataFrame, options: RuleOptions = DEFAULTS) -> DataFrame:
    """Person table with numeric answers, helper conditions and person indicators."""
    answers = numeric_answers(frame)
    rules = {**respondent_rules(frame.columns, options), **person_conditions(options)}
    return _project(_project(answers, rules), person_composites(options))


def with_indicator_labels(frame: DataFrame) -> DataFrame:
    """Attach variable and value labels to the core indicators present."""
    return attach_labels(frame, INDICATORS, YES_NO)
