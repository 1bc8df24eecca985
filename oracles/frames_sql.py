"""SQL text of the survey tables and of every recode, as common table expressions."""

from __future__ import annotations

import re

from tallyloom.plans.codebook import DISABILITY, EDUCATION
from tallyloom.sources.derive import HOUSEHOLD_CODES, PERSON_CODES, code_lists


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _codes(key: str, lists: str) -> dict[str, str]:
    out = {}
    for i, name, values in code_lists(lists):
        pos = f"(({key} * {7919 + 1994 * i} + {104729 + 31 * i}) % 1000003) % {len(values)}"
        out[name] = f"([{', '.join(text(v) for v in values)}])[CAST({pos} AS INTEGER) + 1]"
    return out


_GROUP = """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'IDPs' WHEN 'MACHINERY' THEN 'IDPs'
 WHEN 'HOUSEHOLD' THEN 'IDPs' WHEN 'FURNITURE' THEN 'Refugee returnees' ELSE NULL END"""

_AGE_BAND = """CASE WHEN CAST(HH07 AS INTEGER) >= 60 THEN '60+'
 WHEN CAST(HH07 AS INTEGER) >= 18 THEN '18-59' WHEN CAST(HH07 AS INTEGER) >= 5 THEN '5-17'
 WHEN CAST(HH07 AS INTEGER) >= 0 THEN 'Under 5' END"""

_SAMPLING = {
    "pop_groups": _GROUP,
    "samp_strat": "'S' || CAST(c_nationkey % 5 AS VARCHAR)",
    "wgh_samp_pop_restr": "CAST(0.5 + (c_custkey % 7) * 0.25 AS DOUBLE)",
    "wgh_strata_spec": "CAST(1.0 + (c_nationkey % 5) * 0.5 AS DOUBLE)",
}

_RAW = {
    "household": {
        "hh_id": "c_custkey",
        **_SAMPLING,
        "wgh_strata_spec_resp": "CAST(1.0 + (c_custkey % 3) * 0.5 AS DOUBLE)",
        "wgh_samp_pop_restr_resp": "CAST(0.25 + (c_custkey % 11) * 0.125 AS DOUBLE)",
        "raw_citizenship": "(['SDN', 'XXX', 'SSD', NULL])[c_custkey % 4 + 1]",
        **_codes("c_custkey", HOUSEHOLD_CODES),
    },
    "person": {
        "person_id": "o_orderkey",
        "hh_id": "o_custkey",
        **_SAMPLING,
        "raw_citizenship": "(['SDN', 'XXX', 'SSD', NULL])[o_orderkey % 4 + 1]",
        **_codes("o_orderkey", PERSON_CODES),
    },
}

_SOURCE = {
    "household": "customer",
    "person": "orders JOIN customer ON o_custkey = c_custkey",
}


def _mapped(column: str, labels: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {code} THEN {text(label)}" for code, label in labels.items())
    return f"CASE {column} {cases} END"


# Text columns of the first stage that later stages keep as they are.
_PLAIN = {"HH04", "pop_groups", "samp_strat", "raw_citizenship", "hh_id", "person_id"}


def _numeric(grain: str) -> dict[str, str]:
    out = {}
    for name in _RAW[grain]:
        kept = name in _PLAIN or name.startswith("wgh_")
        out[name] = name if kept else f"TRY_CAST({name} AS DOUBLE)"
    out["HH07_cat"] = _AGE_BAND
    if grain == "person":
        out["HH07_cat2"] = (
            "CASE WHEN CAST(HH07 AS INTEGER) >= 18 THEN '18+'"
            " WHEN CAST(HH07 AS INTEGER) < 18 THEN '0-17' END"
        )
        out["disability_code"] = (
            "CASE WHEN coalesce(CAST(HH07 AS INTEGER), 99) >= 5 OR person_id % 3 = 0"
            " THEN TRY_CAST(disability_code AS DOUBLE) END"
        )
    return out


_CITIZENSHIP = (
    "CASE WHEN raw_citizenship IS NULL THEN NULL"
    " WHEN raw_citizenship = 'SDN' THEN 'SDN' ELSE 'SSD' END"
)

_HOUSEHOLD_1 = {
    "citizenship": _CITIZENSHIP,
    "disability": _mapped("disability_code", DISABILITY),
    "EDU01_random": _mapped("EDU01_random_code", EDUCATION),
    "electricity": """CASE WHEN LIGHT01 <> 1 OR LIGHT02 <> 1 OR LIGHT03 = 0 THEN 0.0
        WHEN LIGHT01 IS NULL OR LIGHT02 IS NULL OR LIGHT03 IS NULL THEN NULL ELSE 1.0 END""",
    "healthcare": """CASE WHEN HEA01 IN (96, 98) OR HEA03 > 60 THEN 0.0
        WHEN HEA01 IS NULL OR HEA03 IS NULL THEN NULL ELSE 1.0 END""",
    "time_DWA": "CASE WHEN DWA03a = 1 THEN 1.0 WHEN DWA03a = 2 THEN 60.0 END",
    "dwa_cond2": "CASE WHEN DWA01 IS NULL THEN 0.0 ELSE 1.0 END",
    "strict_dwa_cond2": """CASE WHEN DWA01 IS NULL OR DWA01 IN (7, 9, 13, 96, 98)
        THEN 0.0 ELSE 1.0 END""",
    "dwa_cond3": "CASE WHEN DWA02 = 3 THEN 0.0 ELSE 1.0 END",
    "housing": """CASE WHEN SHEL01 = 1 AND SHEL02 = 1 AND SHEL03 = 0 AND SHEL04 = 0
         AND SHEL05 = 1 AND SHEL06 = 0 THEN 1.0
        WHEN SHEL01 = 0 OR SHEL02 = 0 OR SHEL03 = 1 OR SHEL04 = 1 OR SHEL05 = 0
         OR SHEL06 = 1 THEN 0.0 END""",
    "crowding": "hh_size_001 / nullif(DWE05, 0)",
    "secure": "CASE WHEN RISK01 = 1 OR RISK02 = 1 THEN 0.0 ELSE 1.0 END",
    "dwe09_cat": """CASE WHEN DWE08 = 1 AND (DWE09 = 1 OR DWE09 = 2) THEN 1.0
        WHEN DWE08 = 1 AND (DWE09 = 3 OR DWE09 = 4) THEN 0.0 WHEN DWE08 = 0 THEN 1.0 END""",
    "toi_cond1": """CASE WHEN TOI01 BETWEEN 1 AND 7 OR TOI01 = 9 THEN 1.0
        WHEN TOI01 = 8 OR TOI01 BETWEEN 10 AND 12 OR TOI01 = 96 THEN 0.0 END""",
    "toi_cond2": """CASE WHEN TOI02 = 1 AND TOI03 IN (5, 96, 98) THEN 0.0
        WHEN TOI02 = 1 AND TOI03 BETWEEN 1 AND 4 THEN 1.0
        WHEN TOI02 = 2 THEN 0.0 WHEN TOI02 = 98 THEN 0.0 END""",
    "toi_cond3": "CASE WHEN TOI05 = 1 THEN 0.0 WHEN TOI05 = 0 THEN 1.0 END",
    "working_age": "CASE WHEN HH07 >= 18 THEN 1.0 END",
    "employed": """CASE WHEN HH07 IS NULL OR HH07 < 18 THEN NULL
        WHEN UNEM01 = 1 THEN 1.0
        WHEN UNEM02 = 1 AND UNEM07 = 3 THEN 1.0
        WHEN UNEM03 = 1 AND UNEM07 = 3 THEN 1.0
        WHEN UNEM04 = 1 THEN 1.0
        WHEN UNEM05 = 1 AND UNEM06 = 3 THEN 1.0
        WHEN UNEM02 = 1 AND UNEM07 IN (1, 2) AND UNEM08 IN (1, 2) THEN 1.0
        WHEN UNEM05 = 1 AND UNEM06 IN (1, 2) AND UNEM08 IN (1, 2) THEN 1.0 ELSE 0.0 END""",
    "electricity_availability": """CASE WHEN LIGHT05 = 1 THEN '24 hours'
        WHEN LIGHT05_11 < 4 THEN 'Less than 4 hours'
        WHEN LIGHT05_22 < 60 THEN 'Less than 1 hour' ELSE 'No electricity' END""",
    "impact3_3": """CASE WHEN SAF01 = 1 OR SAF01 = 2 THEN 1.0
        WHEN SAF01 = 3 OR SAF01 = 4 THEN 0.0 END""",
    "outcome4_1": """CASE WHEN GBV01a = 1 OR GBV01b = 1 THEN 1.0
        WHEN (SELECT bool_and(coalesce(GBV01a = 98 AND GBV01b = 98 AND GBV01c = 98
              AND GBV01d = 98, FALSE)) FROM numeric_frame) THEN NULL ELSE 0.0 END""",
    "row_outcome4_1": """CASE WHEN GBV01a = 1 OR GBV01b = 1 THEN 1.0
        WHEN GBV01a = 98 AND GBV01b = 98 AND GBV01c = 98 AND GBV01d = 98 THEN NULL
        ELSE 0.0 END""",
    "outcome4_2": """CASE WHEN VAW01a = 1 OR VAW01b = 1 OR VAW01c = 1 OR VAW01d = 1
         OR VAW01e = 1 THEN 0.0
        WHEN VAW01a = 0 AND VAW01b = 0 AND VAW01c = 0 AND VAW01d = 0 AND VAW01e = 0
         THEN 1.0 END""",
    "outcome8_2": """CASE WHEN COOK01 = 1 AND coalesce(COOK02, 0) BETWEEN 1 AND 5 THEN 1.0
        WHEN coalesce(COOK02, 0) = 10 AND coalesce(COOK03, 0) = 1 THEN 1.0
        WHEN COOK01 = 1 AND coalesce(COOK02, 0) IN (7, 8, 9, 10, 96) THEN 0.0
        WHEN coalesce(COOK02, 0) = 10 AND coalesce(COOK03, 0) <> 1 THEN 0.0
        WHEN COOK01 = 0 THEN 0.0 END""",
    "outcome9_2": """CASE WHEN LIGHT01 = 1 AND LIGHT02 BETWEEN 1 AND 7 THEN 1.0
        ELSE 0.0 END""",
    "outcome10_2": """CASE WHEN BIR01 = 1 OR BIR02 = 1 THEN
        CASE WHEN BIR03 BETWEEN 1 AND 3 THEN 1.0 WHEN BIR03 BETWEEN 4 AND 6 THEN 0.0 END END""",
    "outcome13_1": """CASE WHEN BANK01 = 1 OR BANK02 = 1 OR BANK03 = 1 OR BANK05 = 1 THEN 1.0
        ELSE 0.0 END""",
    "outcome13_2": """CASE WHEN INC02 = 1 AND (INC01 = 1 OR INC01 = 2 OR INC01 = 3) THEN 1.0
        ELSE 0.0 END""",
    "outcome16_1": """CASE WHEN DWE10 IN (1, 2) AND DWE06a_land = 1 AND DWE06a_housing = 1 THEN 1.0
        WHEN DWE06a_land = 0 OR DWE06a_housing = 0 OR DWE10 = 3 OR DWE10 = 4 THEN 0.0 END""",
    "outcome16_2": "CASE WHEN "
    + " OR ".join(f"SPF01{x} = 1" for x in "abcdefghjklmnop")
    + " THEN 1.0 ELSE 0.0 END",
}

_HOUSEHOLD_2 = {
    "time_tot": "time_DWA * DWA03b",
    "dwa_cond1": "CASE WHEN time_DWA * DWA03b > 30 THEN 0.0 ELSE 1.0 END",
    "dwe05_cat": "CASE WHEN crowding <= 3 THEN 1.0 ELSE 0.0 END",
    "habitablehousing": "housing",
    "shelter": "CASE WHEN crowding <= 3 AND housing = 1 THEN 1.0 ELSE 0.0 END",
    "outcome9_1": """CASE WHEN crowding <= 3 AND housing = 1 AND dwe09_cat = 1 THEN 1.0
        ELSE 0.0 END""",
    "drinkingwater": """CASE WHEN dwa_cond2 = 1
         AND (dwa_cond3 = 1 OR coalesce(time_DWA * DWA03b, 0) <= 30) THEN 1.0 ELSE 0.0 END""",
    "strict_drinkingwater": """CASE WHEN strict_dwa_cond2 = 1
         AND (dwa_cond3 = 1 OR coalesce(time_DWA * DWA03b, 0) <= 30) THEN 1.0 ELSE 0.0 END""",
    "outcome12_2": """CASE WHEN toi_cond1 = 1 OR toi_cond2 = 1 OR toi_cond3 = 1 THEN 1.0
        ELSE 0.0 END""",
    "strict_outcome12_2": """CASE WHEN toi_cond1 = 1 AND toi_cond2 = 1 AND toi_cond3 = 1
        THEN 1.0 ELSE 0.0 END""",
    "unemployed": """CASE WHEN working_age IS NULL THEN NULL
        WHEN employed = 0 AND UNEM09 = 1 AND UNEM10 = 1 THEN 1.0 ELSE 0.0 END""",
}

_HOUSEHOLD_3 = {
    "outcome12_1": "drinkingwater",
    "labour_force": """CASE WHEN working_age IS NULL THEN NULL
        WHEN employed = 1 OR unemployed = 1 THEN 1.0 ELSE 0.0 END""",
    "outcome13_3": "CASE WHEN employed = 1 THEN 0.0 WHEN unemployed = 1 THEN 1.0 END",
    "impact2_2": """CASE WHEN shelter = 0 OR electricity = 0 OR drinkingwater = 0
         OR healthcare = 0 OR secure = 0 THEN 0.0
        WHEN shelter + electricity + drinkingwater + healthcare + secure = 5 THEN 1.0 END""",
}


def _any(items: list[str], test: str = "= 1") -> str:
    return " OR ".join(f"{x} {test}" for x in items)


def _all(items: list[str], test: str) -> str:
    return " AND ".join(f"{x} {test}" for x in items)


_YOUNG = ["REG03", "REG05a", "REG05b", "REG05c", "REG05d", "REG05e", "REG05f", "REG06"]
_OLD = ["REG01a", "REG01b", "REG01c", "REG01d", "REG01e", "REG01f", "REG01g", "REG02"]
_FAR = [f"HACC04_{i}" for i in (1, 2, 4, 7, 10, 11, 12, 13)]
_OWN = [f"HACC04_{i}" for i in (3, 5, 6, 8, 9, 96)]

_PERSON_1 = {
    "citizenship": _CITIZENSHIP,
    "disability": _mapped("disability_code", DISABILITY),
    "impact2_3": f"""CASE WHEN HACC01 = 1 THEN CASE WHEN HACC03 = 1 THEN 1.0
        WHEN HACC03 = 0 AND ({_any(_FAR)}) THEN 0.0
        WHEN HACC03 = 0 AND ({_any(_OWN)}) THEN 1.0 END END""",
    "edu_primary": "CASE WHEN EDU01 = 1 AND EDU02 = 1 AND EDU03 = 2 THEN 1.0 ELSE 0.0 END",
    "age_primary": "CASE WHEN HH07 >= 6 AND HH07 <= 13 THEN 1.0 ELSE 0.0 END",
    "edu_secondary": """CASE WHEN EDU01 = 1 AND EDU02 = 1 AND (EDU03 = 3 OR EDU03 = 4)
        THEN 1.0 ELSE 0.0 END""",
    "age_secondary": "CASE WHEN HH07 >= 11 AND HH07 <= 18 THEN 1.0 END",
    "birthCertificate": "CASE WHEN REG03 = 0 OR REG03 = 98 THEN 0.0 WHEN REG03 = 1 THEN 1.0 END",
    "birthRegistered": "CASE WHEN REG04 = 0 OR REG04 = 98 THEN 0.0 WHEN REG04 = 1 THEN 1.0 END",
    "document_under5": f"CASE WHEN {_any(_YOUNG)} THEN 1.0"
    f" WHEN {_all(_YOUNG, '<> 1')} THEN 0.0 END",
    "document_above5": f"CASE WHEN {_any(_OLD)} THEN 1.0 WHEN {_all(_OLD, '<> 1')} THEN 0.0 END",
    "document_under5_strict": f"CASE WHEN {_any(_YOUNG)} THEN 1.0"
    f" WHEN {_all(_YOUNG, '= 0')} THEN 0.0 END",
    "document_above5_strict": f"CASE WHEN {_any(_OLD)} THEN 1.0"
    f" WHEN {_all(_OLD, '= 0')} THEN 0.0 END",
    "outcome5_2": """CASE WHEN COMM01 = 1 AND COMM02 >= 1 AND COMM02 <> 98 AND COMM03 = 1
         AND COMM04 = 1 THEN 1.0
        WHEN COMM01 = 0 OR COMM02 IN (0, 98) OR COMM03 IN (0, 98) OR COMM04 IN (0, 98)
         THEN 0.0 END""",
    "outcome10_1": "CASE MMR03 WHEN 1 THEN 1.0 WHEN 0 THEN 0.0 WHEN 98 THEN 0.0 END",
}

_PERSON_2 = {
    "outcome1_2": """CASE WHEN HH07 < 5 THEN CASE
        WHEN birthRegistered = 1 OR birthCertificate = 1 THEN 1.0
        WHEN birthRegistered = 0 AND birthCertificate = 0 THEN 0.0 END END""",
    "outcome1_3": "greatest(document_above5, document_under5)",
    "outcome14_1": "greatest(document_above5_strict, document_under5_strict)",
}

_STAGES = {
    "household": [_HOUSEHOLD_1, _HOUSEHOLD_2, _HOUSEHOLD_3],
    "person": [_PERSON_1, _PERSON_2],
}

FINAL = {"household": "main", "person": "ind"}


def _text_bands(grain: str) -> dict[str, str]:
    """The stored table: answers as text, with its age bands."""
    numeric = _numeric(grain)
    out = {name: name for name in _RAW[grain]}
    out |= {name: numeric[name] for name in ("HH07_cat", "HH07_cat2") if name in numeric}
    out["citizenship"] = "raw_citizenship"
    if grain == "person":
        out["disability_code"] = numeric["disability_code"].replace(
            "TRY_CAST(disability_code AS DOUBLE)", "disability_code"
        )
    return out


def _names(sql: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))


# Columns that are text or numbers of their own; the rest of a stage is made DOUBLE.
_LABELS = {"citizenship", "disability", "EDU01_random", "electricity_availability"}


def _column(name: str, sql: str, depth: int) -> str:
    if depth > 1 and name not in _LABELS:
        return f"CAST({sql} AS DOUBLE) AS {name}"
    return f"{sql} AS {name}"


def frame_ctes(grain: str, needed: set[str], recoded: bool = True) -> list[str]:
    """CTEs that end in ``main`` or ``ind``, holding just the columns needed."""
    stages = [_RAW[grain], _numeric(grain), *_STAGES[grain]]
    if not recoded:
        stages = [_RAW[grain], _text_bands(grain)]
    ctes: list[str] = []
    for depth in range(len(stages) - 1, -1, -1):
        own = {n: sql for n, sql in stages[depth].items() if n in needed}
        below = set().union(*stages[:depth])
        passed = sorted(n for n in needed if n not in own and n in below)
        columns = passed + [_column(n, sql, depth) for n, sql in own.items()]
        source = _SOURCE[grain] if depth == 0 else f"{grain}_{depth - 1}"
        name = FINAL[grain] if depth == len(stages) - 1 else f"{grain}_{depth}"
        body = ", ".join(columns or ["1 AS one"]).replace("numeric_frame", f"{grain}_1")
        ctes.insert(0, f"{name} AS (SELECT {body} FROM {source})")
        needed = set(passed).union(*[_names(sql) for sql in own.values()])
    return ctes


def with_frames(sql: str, recoded: bool = True) -> str:
    """The statement with the CTEs of the frames it mentions in front of it."""
    used = _names(sql)
    ctes: list[str] = []
    for grain, final in FINAL.items():
        if final in used:
            ctes += frame_ctes(grain, used, recoded)
    head = "WITH " + ",\n".join(ctes)
    if sql.lstrip().upper().startswith("WITH "):
        return head + ",\n" + sql.lstrip()[5:]
    return head + "\n" + sql
