"""Oracle SQL of every registered query."""

from __future__ import annotations

from dataclasses import replace

from oracles.frames_sql import text, with_frames
from oracles.tables_sql import (
    distribution_sql,
    mean_sql,
    rounded,
    shares_sql,
    t_quantile,
    table_sql,
)
from tallyloom.operators.estimate import MeanTable, RatioTable
from tallyloom.plans import codebook as book
from tallyloom.plans.catalogue import (
    CORE,
    HOUSEHOLD,
    PERSON,
    PLAIN,
    REPORT,
    STRATIFIED,
    Estimate,
)
from tallyloom.registry import AGE_BANDS, GENDERS, GROUPS, ID, RECODES, TABLED
from tallyloom.sources.schemas import HOUSEHOLDS, PERSONS

TABLE = {HOUSEHOLD: "main", PERSON: "ind"}
NONE = "CAST(NULL AS DOUBLE)"


def _recode(grain: str, column: str) -> str:
    text_columns = {"citizenship", "disability", "EDU01_random", "electricity_availability"}
    shown = column if column in text_columns else rounded(column, column)
    return f"SELECT {ID[grain]}, {shown} FROM {TABLE[grain]}"


def _recodes() -> dict[str, str]:
    out = {}
    for grain, columns in RECODES.items():
        for column in columns:
            out[f"recode_{column.lower()}"] = _recode(grain, column)
    out["recode_person_disability"] = _recode(PERSON, "disability")
    out["recode_person_citizenship"] = _recode(PERSON, "citizenship")
    strict = "SELECT hh_id, {0} AS {1} FROM main"
    out["recode_outcome4_1_row_wise"] = strict.format("row_outcome4_1", "outcome4_1")
    out["recode_drinkingwater_strict"] = strict.format("strict_drinkingwater", "drinkingwater")
    out["recode_outcome12_2_strict"] = strict.format("strict_outcome12_2", "outcome12_2")
    return out


def _mean(column: str, by: list[str], where=None, weight=None, strata=None, grain=HOUSEHOLD) -> str:
    table = MeanTable(column, column, by, where, weight=weight)
    return mean_sql(Estimate(grain, table, strata))


_S1 = [
    "denominator_se",
    "mean_value",
    "mean_value_low",
    "mean_value_upp",
    "mean_value_se",
]


def _stacked(specs, names: list[str], keys: list[str]) -> str:
    """Tables under each other; columns a table lacks are missing."""
    chosen = [specs[n] for n in names if n in specs]
    ratios = [c.table for c in chosen if isinstance(c.table, RatioTable)]
    extra = ["num_obs_uw_se"] if ratios else []
    for t in ratios:
        for c in (t.numerator, t.base):
            extra += [f"{c}_total", f"{c}_total_se"]
    parts = []
    for spec in chosen:
        t = spec.table
        if isinstance(t, MeanTable):
            own = {"num_obs_uw", "denominator", *_S1}
            if t.denominator != "all":
                own.discard("denominator_se")
        else:
            own = {"num_obs_uw", "num_obs_uw_se", "denominator", "denominator_se", "mean_value"}
            for c in (t.numerator, t.base):
                own |= {f"{c}_total", f"{c}_total_se"}
        columns = [k if k in t.by else f"CAST(NULL AS VARCHAR) AS {k}" for k in keys]
        columns.append("var_name")
        for c in ["num_obs_uw", "denominator", *_S1, *extra]:
            columns.append(f"CAST({c} AS DOUBLE) AS {c}" if c in own else f"{NONE} AS {c}")
        parts.append(f"SELECT {', '.join(columns)} FROM ({table_sql(spec)})")
    return "\nUNION ALL\n".join(parts)


_REPORT = """SELECT pop_groups, var_name AS "Core Indicator", num_obs_uw AS "Unweighted Count",
    denominator AS "Weighted Total", mean_value AS "Indicator Value" FROM ({})"""

_COMBINED = _stacked(PLAIN, CORE, ["pop_groups"])
_COMBINED_STRATIFIED = _stacked(STRATIFIED, CORE, ["pop_groups"])


def _agd() -> str:
    names = [n for n in PLAIN if n.endswith(("_agd", "_edu")) and not n.startswith("impact3_2")]
    names.remove("outcome4_1_edu")
    keys = ["HH07_cat", "HH04", "disability", "pop_groups", "EDU01_random"]
    return _stacked(PLAIN, names, keys)


def _headline() -> str:
    parts = ["SELECT 'households' AS name, count(*) AS n FROM main"]
    parts.append("SELECT 'persons', count(*) FROM ind")
    asked = [
        ("main", "pop_groups", GROUPS),
        ("ind", "HH04", GENDERS),
        ("ind", "HH07_cat2", AGE_BANDS),
    ]
    for table, column, values in asked:
        for name, value in values.items():
            where = f"{column} = {text(value)}"
            parts.append(f"SELECT {text(name)}, count(*) FROM {table} WHERE {where}")
    return "\nUNION ALL\n".join(parts)


def _tabled(grain: str) -> str:
    parts = [
        f"SELECT {text(c)} AS variable, CAST({c} AS VARCHAR) AS level, count(*) AS n"
        f" FROM {TABLE[grain]} WHERE {c} IS NOT NULL GROUP BY 2"
        for c in TABLED[grain]
    ]
    return "\nUNION ALL\n".join(parts)


def _description(table: str, numeric: list[str], categorical: list[str]) -> str:
    parts = []
    for c in numeric:
        parts.append(
            f"SELECT {text(c)} AS variable, CAST(NULL AS VARCHAR) AS level, count({c}) AS n,"
            f" count(*) - count({c}) AS missing, {rounded(f'avg({c})', 'mean')},"
            f" {rounded(f'stddev_samp({c})', 'sd')}, {NONE} AS percent FROM {table}"
        )
    for c in categorical:
        share = f"CAST(count(*) AS DOUBLE) / (SELECT count({c}) FROM {table}) * 100"
        parts.append(
            f"SELECT {text(c)}, {c}, count(*), (SELECT count(*) - count({c}) FROM {table}),"
            f" {NONE}, {NONE}, {rounded(share, 'percent')}"
            f" FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}"
        )
    return "\nUNION ALL\n".join(parts)


def _label_case(column: str, labels) -> str:
    cases = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in labels.items())
    return f"CASE CAST(CAST({column} AS INTEGER) AS VARCHAR) {cases} END"


def _mean_number() -> str:
    return _mean("HH07", ["pop_groups"], None, "wgh_samp_pop_restr", "samp_strat", PERSON)


_CLUSTERED = f"""WITH base AS (SELECT pop_groups, outcome5_2 AS y, wgh_samp_pop_restr AS w,
    samp_strat AS h, hh_id AS u, pop_groups IS NOT NULL AS inside FROM ind),
sizes AS (SELECT h, CAST(count(DISTINCT u) AS DOUBLE) AS nh FROM base GROUP BY h),
dom AS (SELECT * FROM base WHERE inside),
free AS (SELECT count(DISTINCT h || '/' || u) - count(DISTINCT h) AS df FROM dom),
est AS (SELECT pop_groups, count(*) AS n, sum(w) AS sw,
    sum(CASE WHEN y IS NOT NULL THEN w END) AS wy,
    sum(w * y) / sum(CASE WHEN y IS NOT NULL THEN w END) AS m FROM dom GROUP BY pop_groups),
units AS (SELECT pop_groups, h, u, sum(w) AS w,
    sum(CASE WHEN y IS NULL THEN 0.0 ELSE w * (y - m) / wy END) AS z
    FROM dom JOIN est USING (pop_groups) GROUP BY pop_groups, h, u),
parts AS (SELECT pop_groups, nh / (nh - 1) * (sum(z * z) - sum(z) * sum(z) / nh) AS vz,
    nh / (nh - 1) * (sum(w * w) - sum(w) * sum(w) / nh) AS vw
    FROM units JOIN sizes USING (h) GROUP BY pop_groups, h, nh),
var AS (SELECT pop_groups, sum(vz) AS vm, sum(vw) AS vw FROM parts GROUP BY pop_groups)
SELECT pop_groups, 'outcome5_2' AS var_name, n AS num_obs_uw, sw AS denominator,
    {rounded('sqrt(vw)', 'denominator_se')}, {rounded('m', 'mean_value')},
    {rounded('m - q * sqrt(vm)', 'mean_value_low')},
    {rounded('m + q * sqrt(vm)', 'mean_value_upp')}, {rounded('sqrt(vm)', 'mean_value_se')}
FROM est JOIN var USING (pop_groups) CROSS JOIN (SELECT QUANTILE AS q FROM free)"""


def _clustered() -> str:
    return _CLUSTERED.replace("QUANTILE", t_quantile("df"))


def _total(by: str, value: str, known: str, weight: str, name: str, answered: str) -> str:
    return f"""WITH base AS (SELECT {by}, samp_strat AS h, {weight} AS w, {value} AS y,
    {known} AS ok FROM main),
sizes AS (SELECT h, CAST(count(*) AS DOUBLE) AS nh FROM base GROUP BY h),
parts AS (SELECT {by}, count(*) AS n, sum(w * y) AS t, sum(CASE WHEN ok THEN w END) AS a,
    nh / (nh - 1) * (sum(pow(w * coalesce(y, 0), 2))
    - pow(sum(w * coalesce(y, 0)), 2) / nh) AS v
    FROM base JOIN sizes USING (h) GROUP BY {by}, h, nh)
SELECT {by}, {text(name)} AS var_name, CAST(sum(n) AS BIGINT) AS num_obs_uw,
    {rounded('sum(t)', 'total')}, {rounded('sqrt(sum(v))', 'total_se')},
    {rounded('sum(a)', answered)} FROM parts GROUP BY {by}"""


def _ratio_number() -> str:
    """People to a room, by the direct formulas."""

    def se(z: str) -> str:
        return f"nh / (nh - 1) * (sum(pow({z}, 2)) - pow(sum({z}), 2) / nh)"

    z = {
        "hh_size_001": "w * coalesce(hh_size_001, 0)",
        "DWE05": "w * coalesce(DWE05, 0)",
        "known": "CASE WHEN DWE05 IS NULL THEN 0 ELSE w END",
    }
    sums = ", ".join(f"sum({v}) AS t_{k}, {se(v)} AS v_{k}" for k, v in z.items())
    both = ", ".join(f"sum(t_{k}) AS t_{k}, sqrt(sum(v_{k})) AS s_{k}" for k in z)
    return f"""WITH base AS (SELECT pop_groups, samp_strat AS h, wgh_samp_pop_restr AS w,
    hh_size_001, DWE05 FROM main),
sizes AS (SELECT h, CAST(count(*) AS DOUBLE) AS nh FROM base GROUP BY h),
parts AS (SELECT pop_groups, {sums} FROM base JOIN sizes USING (h) GROUP BY pop_groups, h, nh),
est AS (SELECT pop_groups, {both} FROM parts GROUP BY pop_groups)
SELECT pop_groups, 'people_per_room' AS var_name, t_known AS num_obs_uw,
    {rounded('s_known', 'num_obs_uw_se')}, t_hh_size_001 AS denominator,
    {rounded('s_hh_size_001', 'denominator_se')}, t_hh_size_001 AS hh_size_001_total,
    {rounded('s_hh_size_001', 'hh_size_001_total_se')}, t_DWE05 AS DWE05_total,
    {rounded('s_DWE05', 'DWE05_total_se')},
    round(t_hh_size_001 / nullif(t_DWE05, 0), 4) AS mean_value FROM est"""


def _sorted_shares(shares: str, name: str, value: str, by: list[str], digits: int, where="") -> str:
    keys = "".join(f"{k}, " for k in by)
    return f"""WITH shares AS (SELECT * FROM ({shares}){where}),
placed AS (SELECT *, avg({value}) OVER (PARTITION BY {name}) AS mean_share FROM shares)
SELECT {keys}{name}, {value}, dense_rank() OVER (ORDER BY mean_share, {name}) AS position,
    printf('%.{digits}f%%', round({value}, {digits})) AS label FROM placed"""


def _percent(value: str) -> str:
    return f"regexp_replace(CAST(round({value}, 1) AS VARCHAR), '[.]0$', '') || '%'"


# Component names broken at 20 characters, by hand.
_WRAPPED = {
    "Habitable Shelter": "Habitable Shelter",
    "Access to Electricity": "Access to\nElectricity",
    "Access to Drinking Water": "Access to Drinking\nWater",
    "Feeling of Security": "Feeling of Security",
    "Access to Healthcare": "Access to Healthcare",
    "Not overcrowded": "Not overcrowded",
    "Habitable Housing": "Habitable Housing",
    "Affordable": "Affordable",
    "Reachable under 30 minutes": "Reachable under 30\nminutes",
    "From an improved source": "From an improved\nsource",
    "In the dwelling/yard/plot": "In the\ndwelling/yard/plot",
    "Improved sanitation facility": "Improved sanitation\nfacility",
    "Safe disposal in situ of excreta": "Safe disposal in\nsitu of excreta",
    "Toilet is not shared with other households": (
        "Toilet is not\nshared with other\nhouseholds"
    ),
    "Health facility too far": "Health facility too\nfar",
    "Medicine or health facility too expensive": "Medicine or health\nfacility too\nexpensive",
    "No treatment exists/Not necessary": "No treatment\nexists/Not necessary",
    "Don't know where to go": "Don't know where to\ngo",
    "No time for it": "No time for it",
    "Prefer other options": "Prefer other options",
    "Health facility does not accept new patients": "Health facility\ndoes not accept new\npatients",
    "Don't trust modern medicine": "Don't trust modern\nmedicine",
    "Don't trust doctors": "Don't trust doctors",
    "Administrative/documentation issues (certificates, service cards, etc.)": (
        "Administrative/documentation\nissues\n(certificates,\nservice cards, etc.)"
    ),
    "Long waiting times": "Long waiting times",
    "Lack of medical supplies": "Lack of medical\nsupplies",
    "Health facility damaged/destroyed": "Health facility\ndamaged/destroyed",
    "Account in financial institution": "Account in financial\ninstitution",
    "Have a ATM/debit card": "Have a ATM/debit\ncard",
    "Used mobile money in the last 12 months": "Used mobile money in\nthe last 12 months",
    "Personally used mobile money in the last 12 months": (
        "Personally used\nmobile money in the\nlast 12 months"
    ),
}


def _value_case(column: str, pairs) -> str:
    cases = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in pairs.items())
    return f"CASE {column} {cases} END"


def _component_bars(shares: str, labels, name: str = "facility") -> str:
    shown = f"coalesce({_value_case(name, labels)}, {name})"
    return f"""SELECT pop_groups, {shown} AS {name},
    {_value_case(shown, _WRAPPED)} AS axis_label, percentage,
    printf('%.1f%%', round(percentage, 1)) AS label FROM ({shares})"""


def _relabel_wrap() -> str:
    names = list(book.HEALTH_REASONS.values())
    shown = {n: "No time for it" if n == "No time" else n for n in names}
    rows = ", ".join(f"({text(n)}, {text(_WRAPPED[s])})" for n, s in shown.items())
    return f"""SELECT Reason, axis_label FROM (VALUES {rows}) AS t(Reason, axis_label)
WHERE (SELECT count(*) FROM ind) > 0"""


def _value_labels() -> str:
    parts = [
        f"SELECT {text(c)} AS variable, CASE {c} WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS level,"
        f" count(*) AS n FROM main WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ["impact2_2", "outcome4_1", "outcome16_2"]
    ]
    return "\nUNION ALL\n".join(parts)


def _error_bars(means: str, by: str) -> str:
    # Bars are taken from the unrounded estimate.
    exact = means.replace("round(", "(").replace(", 6) + 0.0", ")")
    return f"""SELECT {by}, var_name, {rounded('mean_value', 'mean_value')},
    {rounded('mean_value - mean_value_se', 'bar_low')},
    {rounded('mean_value + mean_value_se', 'bar_upp')}, round(mean_value, 2) AS label
FROM ({exact})"""


def _facets(means: str, facet: list[str]) -> str:
    keys = ", ".join(f"{c} AS facet_{i}" for i, c in enumerate(facet, start=1))
    return f"""SELECT {keys}, HH04 AS x, disability AS fill, mean_value AS y,
    printf('%.2f', round(mean_value, 2)) AS label FROM ({means})"""


def _raw(schema, table: str) -> str:
    return f"SELECT {', '.join(schema.names)} FROM {table}"


def _plain_sql() -> dict[str, str]:
    out = _recodes()
    for profile, specs in {"plain": PLAIN, "report": REPORT, "stratified": STRATIFIED}.items():
        for name, spec in specs.items():
            out[f"{profile}_{name}"] = table_sql(spec)
    facilities = shares_sql(PLAIN["composite_impact2_2"])
    hacc = shares_sql(PLAIN["hacc_percentages"])
    gbv = shares_sql(STRATIFIED["gbv01_percentages"])
    light = distribution_sql(PLAIN["light02_percentages"])
    out |= {
        "report_outcome13_3": table_sql(PLAIN["outcome13_3"]),
        "report_outcome13_3_agd": table_sql(PLAIN["outcome13_3_agd"]),
        "factor_recode": f"""SELECT hh_id, {_label_case('DWE10', book.TENURE_RISK)} AS risk,
            CASE DWE10 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 99 THEN 5
            END AS ord FROM main""",
        "relabel_wrap": _relabel_wrap(),
        "value_labels": _value_labels(),
        "column_types": """SELECT 'outcome13_3' AS variable, 'double' AS type,
            count(outcome13_3) AS n FROM main
            UNION ALL SELECT 'pop_groups', 'string', count(pop_groups) FROM ind""",
        "mean_in_domain": _mean(
            "outcome9_2", ["pop_groups"], "HH04 = 'Female'", "wgh_samp_pop_restr", "samp_strat"
        ),
        "mean_number": _mean_number(),
        "mean_clustered": _clustered(),
        "mean_precomputed": table_sql(PLAIN["impact2_2"]),
        "total_rows": _total("pop_groups", "1.0", "TRUE", "wgh_samp_pop_restr", "rows", "answered"),
        "total_answers": _total(
            "samp_strat",
            "impact3_3",
            "impact3_3 IS NOT NULL",
            "wgh_strata_spec",
            "impact3_3",
            "answered",
        ),
        "total_number": _total(
            "pop_groups",
            "hh_size_001",
            "hh_size_001 IS NOT NULL",
            "wgh_samp_pop_restr",
            "hh_size_001",
            "answered",
        ),
        "ratio_number": _ratio_number(),
        "strata_sizes": """SELECT samp_strat AS stratum, count(DISTINCT hh_id) AS n_h
            FROM ind GROUP BY samp_strat""",
        "combined_indicators": _COMBINED,
        "report_precomputed": _COMBINED,
        "report_precomputed_for_group": _REPORT.format(_COMBINED) + " WHERE pop_groups = 'IDPs'",
        "combined_indicators_stratified": _COMBINED_STRATIFIED,
        "combined_for_group": _REPORT.format(_COMBINED) + " WHERE pop_groups = 'IDPs'",
        "combined_for_returnees": _REPORT.format(_COMBINED)
        + " WHERE pop_groups = 'Refugee returnees'",
        "report_table_stratified": _REPORT.format(_COMBINED_STRATIFIED),
        "stratified_for_group": _REPORT.format(_COMBINED_STRATIFIED) + " WHERE pop_groups = 'IDPs'",
        "stratified_for_returnees": _REPORT.format(_COMBINED_STRATIFIED)
        + " WHERE pop_groups = 'Refugee returnees'",
        "combined_by_stratum": _stacked(STRATIFIED, [f"{c}_strata" for c in CORE], ["samp_strat"]),
        "combined_disaggregated": _agd(),
        "headline_counts": _headline(),
        "headline_counts_second": """SELECT 'households' AS name, count(*) AS n FROM main
            UNION ALL SELECT 'refugee_households', count(*) FROM main WHERE pop_groups = 'IDPs'
            UNION ALL SELECT 'host_households', count(*) FROM main
                WHERE pop_groups = 'Refugee returnees'
            UNION ALL SELECT 'persons', count(*) FROM ind
            UNION ALL SELECT 'female', count(*) FROM ind WHERE HH04 = 'Female'
            UNION ALL SELECT 'male', count(*) FROM ind WHERE HH04 = 'Male'
            UNION ALL SELECT 'below_18', count(*) FROM ind WHERE HH07 < 18
            UNION ALL SELECT 'above_18', count(*) FROM ind WHERE HH07 >= 18""",
        "freq_household": _tabled(HOUSEHOLD),
        "freq_person": _tabled(PERSON),
        "freq_oneway": """SELECT HH07_cat, count(*) AS n FROM ind
            WHERE HH07_cat IS NOT NULL GROUP BY HH07_cat""",
        "freq_twoway": """SELECT outcome8_2,
            count(*) FILTER (pop_groups = 'Refugee returnees') AS returnee_households,
            count(*) FILTER (pop_groups = 'IDPs') AS idp_households FROM main
            WHERE outcome8_2 IS NOT NULL AND pop_groups IS NOT NULL GROUP BY outcome8_2""",
        "sample_description": _description(
            "main",
            ["HH07", "hh_size_001", "wgh_samp_pop_restr"],
            ["pop_groups", "samp_strat", "HH04", "HH07_cat", "disability", "EDU01_random"],
        ),
        "sample_description_person": _description(
            "ind",
            ["HH07", "wgh_samp_pop_restr", "wgh_strata_spec"],
            ["pop_groups", "samp_strat", "HH04", "HH07_cat", "HH07_cat2", "disability", "citizenship"],
        ),
        "composite_column_range": facilities,
        "plot_errorbars": _error_bars(table_sql(PLAIN["impact2_2"]), "pop_groups"),
        "plot_errorbars_by_stratum": _error_bars(
            table_sql(STRATIFIED["impact2_2_strata"]), "samp_strat"
        ),
        "plot_facets": _facets(table_sql(PLAIN["impact2_3_agd"]), ["HH07_cat"]),
        "plot_facets_two_way": _facets(
            table_sql(STRATIFIED["outcome13_2_agd"]), ["pop_groups", "HH07_cat"]
        ),
        "plot_facets_ratio": _facets(table_sql(PLAIN["impact3_2a_agd"]), ["pop_groups"]),
        "plot_sorted_shares": _sorted_shares(hacc, "Reason", "Percentage", [], 1),
        "plot_sorted_shares_by_group": _sorted_shares(
            gbv, "Services", "Percentage", ["pop_groups"], 1
        ),
        "plot_sorted_distribution": _sorted_shares(
            light, "LIGHT02", "Percentage", [], 1, " WHERE LIGHT02 IS NOT NULL"
        ),
        "plot_composite_housing": _component_bars(
            shares_sql(PLAIN["composite_outcome9_1"]), book.HOUSING_CONDITIONS
        ),
        "plot_composite_water": _component_bars(
            shares_sql(PLAIN["composite_outcome12_1"]), book.WATER_CONDITIONS
        ),
        "plot_composite_toilet": _component_bars(
            shares_sql(PLAIN["composite_outcome12_2"]), book.TOILET_CONDITIONS
        ),
        "plot_composite_facilities": _component_bars(
            shares_sql(STRATIFIED["composite_impact2_2_pop"]), {}
        )
        .replace("coalesce(CASE facility  END, facility)", "facility")
        .replace("printf('%.1f%%', round(percentage, 1))", _percent("percentage")),
        "plot_composite_bank": _component_bars(
            shares_sql(PLAIN["composite_outcome13_1"]), book.BANK_ACCESS, "access"
        ),
        "plot_contrast": f"""SELECT *, {_percent('percentage')} AS label,
            CASE WHEN percentage > 15 THEN 'white' ELSE 'black' END AS label_color
            FROM ({distribution_sql(REPORT['availability_summary'])})""",
        "plot_axis_limits": """SELECT HH04, row_number() OVER (ORDER BY HH04) AS position
            FROM (SELECT DISTINCT HH04 FROM ind WHERE HH04 IS NOT NULL)""",
        "export_combined": _COMBINED,
        "export_by_group": f"""SELECT pop_groups, var_name, num_obs_uw, denominator, mean_value
            FROM ({_COMBINED_STRATIFIED})""",
    }
    return out


def _raw_sql() -> dict[str, str]:
    answers = [f"SPF01{x}" for x in "abcdefghjklmnop"]
    numbers = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in answers)
    stove = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in book.STOVES.items())
    light = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in book.LIGHTING.items())
    return {
        "numeric_coercion": """SELECT hh_id, TRY_CAST(HH07 AS DOUBLE) AS age,
            TRY_CAST(citizenship AS DOUBLE) AS no_number FROM main""",
        "coercion_in_place": f"SELECT hh_id, {numbers} FROM main",
        "label_lookup": f"""SELECT hh_id, CASE COOK02 {stove} END AS stove,
            CASE LIGHT02 {light} END AS lighting FROM main""",
        "csv_scan": _raw(HOUSEHOLDS, "main"),
        "labels_with_files": """SELECT variable, level, count(*) AS n FROM (
            SELECT 'SPF01b' AS variable, CASE SPF01b WHEN '1' THEN 'Yes' WHEN '0' THEN 'No' WHEN '98' THEN 'Not known' END AS level FROM main
            UNION ALL SELECT 'GBV01a', CASE GBV01a WHEN '1' THEN 'Knows' WHEN '0' THEN 'Does not know' END FROM main)
            WHERE level IS NOT NULL GROUP BY variable, level""",
        "csv_scan_reordered": _raw(HOUSEHOLDS, "main"),
        "labels_after_coercion": """SELECT 'SPF01b' AS variable,
            CASE SPF01b WHEN '1' THEN 'Yes' WHEN '0' THEN 'No' WHEN '98' THEN 'Don''t know' END AS level,
            count(*) AS n FROM main WHERE SPF01b IN ('0', '1', '98') GROUP BY SPF01b
            UNION ALL SELECT 'GBV01a',
            CASE GBV01a WHEN '1' THEN 'Yes' WHEN '0' THEN 'No' WHEN '98' THEN 'Don''t know' END,
            count(*) FROM main WHERE GBV01a IN ('0', '1', '98') GROUP BY GBV01a""",
        "parquet_scan": _raw(PERSONS, "ind"),
    }


_QUOTED = """SELECT c_custkey AS number, CAST(c_custkey AS DOUBLE) / 4 AS share,
            CASE WHEN c_custkey % 7 = 0 THEN NULL
            ELSE 'line one of ' || c_name || chr(10) || 'says "yes, no", ok' END AS remark,
            CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nation FROM customer"""

ORACLES: dict[str, str] = {
    "csv_scan_quoted": _QUOTED,
    **{name: with_frames(sql) for name, sql in _plain_sql().items()},
    **{name: with_frames(sql, recoded=False) for name, sql in _raw_sql().items()},
}
