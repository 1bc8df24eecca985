"""Named queries over the derived survey tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tallyloom.functions.codes import num
from tallyloom.functions.labels import (
    attach_labels,
    code_label,
    label_columns,
    number_label,
    number_order,
    relabel,
    value_label,
)
from tallyloom.functions.text import wrap_evenly
from tallyloom.operators import charts
from tallyloom.operators.design import SurveyDesign
from tallyloom.operators.estimate import mean_table, ratio_table, total_table
from tallyloom.operators.profile import (
    column_types,
    columns_between,
    columns_starting_with,
    component_shares,
    frequencies,
    frequency,
    numeric_columns,
    sample_description,
    two_way_frequency,
)
from tallyloom.plans import codebook as book
from tallyloom.plans import report
from tallyloom.plans.catalogue import (
    HOUSEHOLD,
    PERSON,
    PLAIN,
    POPULATION,
    REPORT,
    STRATA,
    STRATIFIED,
    STRATUM,
    run,
)
from tallyloom.plans.rules import (
    RuleOptions,
    household_indicators,
    numeric_answers,
    person_indicators,
    with_indicator_labels,
)
from tallyloom.session import shared_folder
from tallyloom.sources import files
from tallyloom.sources.derive import households, persons
from tallyloom.sources.schemas import HOUSEHOLDS, PERSONS

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 6

GROUPS = {"returnee_households": "Refugee returnees", "idp_households": "IDPs"}
GENDERS = {"female": "Female", "male": "Male"}
AGE_BANDS = {"below_18": "0-17", "above_18": "18+"}
SECOND_GROUPS = {
    "refugee_households": "Refugees and Asylum-seekers",
    "host_households": "Host communities",
}
SECOND_BANDS = {"below_18": "0-17", "above_18": "18-60+"}

# Recoded columns that are registered one by one.
RECODES = {
    HOUSEHOLD: [
        "citizenship",
        "disability",
        "EDU01_random",
        "electricity",
        "healthcare",
        "time_DWA",
        "time_tot",
        "dwa_cond1",
        "dwa_cond2",
        "dwa_cond3",
        "drinkingwater",
        "housing",
        "crowding",
        "dwe05_cat",
        "shelter",
        "secure",
        "impact2_2",
        "impact3_3",
        "outcome4_1",
        "outcome4_2",
        "outcome8_2",
        "habitablehousing",
        "dwe09_cat",
        "outcome9_1",
        "outcome9_2",
        "electricity_availability",
        "outcome10_2",
        "outcome12_1",
        "toi_cond1",
        "toi_cond2",
        "toi_cond3",
        "outcome12_2",
        "outcome13_1",
        "outcome13_2",
        "working_age",
        "employed",
        "unemployed",
        "labour_force",
        "outcome13_3",
        "outcome16_1",
        "outcome16_2",
    ],
    PERSON: [
        "impact2_3",
        "edu_primary",
        "age_primary",
        "edu_secondary",
        "age_secondary",
        "birthCertificate",
        "birthRegistered",
        "outcome1_2",
        "document_under5",
        "document_above5",
        "outcome1_3",
        "outcome5_2",
        "outcome10_1",
        "document_under5_strict",
        "document_above5_strict",
        "outcome14_1",
    ],
}

ID = {HOUSEHOLD: "hh_id", PERSON: "person_id"}

# Columns whose one-way frequencies are looked at before and after recoding.
TABLED = {
    HOUSEHOLD: [
        "disability",
        "EDU01_random",
        "LIGHT01",
        "LIGHT02",
        "electricity",
        "healthcare",
        "time_DWA",
        "drinkingwater",
        "SHEL01",
        "SHEL02",
        "SHEL03",
        "SHEL04",
        "SHEL05",
        "SHEL06",
        "housing",
        "hh_size_001",
        "DWE05",
        "dwe05_cat",
        "shelter",
        "RISK01",
        "RISK02",
        "secure",
        "impact2_2",
        "COOK02",
        "habitablehousing",
        "DWE08",
        "DWE09",
        "dwe09_cat",
        "outcome9_1",
        "outcome9_2",
        "outcome13_3",
        "DWE10",
    ],
    PERSON: ["HH07_cat", "HH07_cat2", "disability", "HH04", "pop_groups", "HH07", "age_primary"],
}


@lru_cache(maxsize=8)
def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Recoded tables; the plans are kept, no data is."""
    return {
        HOUSEHOLD: household_indicators(households(spark, sf_dir)),
        PERSON: person_indicators(persons(spark, sf_dir)),
    }


def rounded(frame: DataFrame) -> DataFrame:
    """Fractions rounded, so that engines which add in another order agree."""
    return frame.selectExpr(
        *[
            f"round(`{c}`, {DIGITS}) AS `{c}`" if t == "double" else f"`{c}`"
            for c, t in frame.dtypes
        ]
    )


def _recode(grain: str, column: str) -> Query:
    return lambda spark, sf: frames(spark, sf)[grain].select(ID[grain], column)


def _optional(column: str, **options) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        recoded = household_indicators(households(spark, sf), RuleOptions(**options))
        return recoded.select("hh_id", column)

    return query


def _table(spec) -> Query:
    return lambda spark, sf: run(spec, frames(spark, sf))


def _numeric_coercion(spark: SparkSession, sf: str) -> DataFrame:
    raw = households(spark, sf)
    return raw.selectExpr("hh_id", f"{num('HH07')} AS age", f"{num('citizenship')} AS no_number")


def _coercion_in_place(spark: SparkSession, sf: str) -> DataFrame:
    raw = households(spark, sf)
    answers = columns_starting_with(raw, "spf01")
    return numeric_columns(raw, answers).select("hh_id", *answers)


def _label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return households(spark, sf).selectExpr(
        "hh_id",
        f"{code_label('COOK02', book.STOVES)} AS stove",
        f"{code_label('LIGHT02', book.LIGHTING)} AS lighting",
    )


def _factor_recode(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf)[HOUSEHOLD].selectExpr(
        "hh_id",
        f"{number_label('DWE10', book.TENURE_RISK)} AS risk",
        f"{number_order('DWE10', book.TENURE_RISK)} AS ord",
    )


def _relabel_wrap(spark: SparkSession, sf: str) -> DataFrame:
    shares = run(STRATIFIED["hacc_percentages"], frames(spark, sf)).select("Reason")
    shown = relabel("Reason", {"No time": "No time for it"})
    return shares.distinct().selectExpr("Reason", f"{wrap_evenly(shown, 20)} AS axis_label")


def _value_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Answers counted under the value labels kept with their column."""
    labelled = with_indicator_labels(frames(spark, sf)[HOUSEHOLD])
    names = ["impact2_2", "outcome4_1", "outcome16_2"]
    shown = labelled.selectExpr(*[f"{value_label(labelled, n)} AS {n}" for n in names])
    return frequencies(shown, names)


def _labels_after_coercion(spark: SparkSession, sf: str) -> DataFrame:
    """Labels given to text answers still decode them once they are numbers."""
    names = ["SPF01b", "GBV01a"]
    labelled = attach_labels(
        households(spark, sf), {n: n for n in names}, {"Yes": 1.0, "No": 0.0, "Don't know": 98.0}
    )
    coerced = numeric_answers(labelled)
    shown = coerced.selectExpr(*[f"{value_label(coerced, n)} AS {n}" for n in names])
    return frequencies(shown, names)


def _design(spark: SparkSession, sf: str, grain: str, **options) -> SurveyDesign:
    return SurveyDesign(frames(spark, sf)[grain], **options)


def _mean_in_domain(spark: SparkSession, sf: str) -> DataFrame:
    design = _design(spark, sf, HOUSEHOLD, weight=POPULATION, strata=STRATUM)
    return mean_table(design, "outcome9_2", ["pop_groups"], "HH04 = 'Female'")


def _mean_number(spark: SparkSession, sf: str) -> DataFrame:
    design = _design(spark, sf, PERSON, weight=POPULATION, strata=STRATUM)
    return mean_table(design, "HH07", ["pop_groups"])


def _mean_clustered(spark: SparkSession, sf: str) -> DataFrame:
    design = _design(spark, sf, PERSON, weight=POPULATION, strata=STRATUM, psu="hh_id")
    return mean_table(design, "outcome5_2", ["pop_groups"], "pop_groups IS NOT NULL")


def _total_rows(spark: SparkSession, sf: str) -> DataFrame:
    design = _design(spark, sf, HOUSEHOLD, weight=POPULATION, strata=STRATUM)
    return total_table(design, ["pop_groups"])


def _total_answers(spark: SparkSession, sf: str) -> DataFrame:
    design = _design(spark, sf, HOUSEHOLD, weight=STRATA, strata=STRATUM)
    return total_table(design, ["samp_strat"], "impact3_3", binary=True)


def _total_number(spark: SparkSession, sf: str) -> DataFrame:
    design = _design(spark, sf, HOUSEHOLD, weight=POPULATION, strata=STRATUM)
    return total_table(design, ["pop_groups"], "hh_size_001")


def _ratio_number(spark: SparkSession, sf: str) -> DataFrame:
    """People to a room."""
    design = _design(spark, sf, HOUSEHOLD, weight=POPULATION, strata=STRATUM)
    return ratio_table(design, "hh_size_001", "DWE05", ["pop_groups"], "people_per_room")


def _strata_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _design(spark, sf, PERSON, strata=STRATUM, psu="hh_id").strata_sizes()


def _derived_mean(name: str) -> Query:
    """A numeric cast inside the design, which keeps the sample as it is."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        design = _design(spark, sf, HOUSEHOLD).derive(outcome13_3="CAST(outcome13_3 AS DOUBLE)")
        return run(PLAIN[name], {HOUSEHOLD: design.frame})

    return query


def _precomputed(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators that are already in the file: saved once, then estimated as read."""
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    indicators = frames(spark, sf)[HOUSEHOLD].select("hh_id", "pop_groups", "impact2_2")
    files.write_parquet(indicators, path)
    design = SurveyDesign(spark.read.schema(indicators.schema).parquet(path))
    return mean_table(design, "impact2_2", ["pop_groups"], "pop_groups IS NOT NULL")


def _ready(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Files of the report's ready indicators, read with a check that each column is there."""
    out = {}
    for grain, frame in frames(spark, sf).items():
        taken = report.columns_taken(PLAIN, grain)
        indicators = frame.select(*[c for c in frame.columns if c in taken])
        path = f"{shared_folder(spark)}/{uuid4().hex}"
        files.write_parquet(indicators, path)
        out[grain] = files.read_parquet(spark, path, indicators.schema)
    return out


def _report_precomputed(spark: SparkSession, sf: str) -> DataFrame:
    return report.combined_indicators(PLAIN, _ready(spark, sf))


def _precomputed_for_group(group: str) -> Query:
    return lambda spark, sf: report.for_group(report.report_table(_report_precomputed(spark, sf)), group)


def _combined(specs) -> Query:
    return lambda spark, sf: report.combined_indicators(specs, frames(spark, sf))


def _combined_for_group(group: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        combined = report.combined_indicators(PLAIN, frames(spark, sf))
        return report.for_group(report.report_table(combined), group)

    return query


def _report_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return report.report_table(report.combined_indicators(STRATIFIED, frames(spark, sf)))


def _stratified_for_group(group: str) -> Query:
    return lambda spark, sf: report.for_group(_report_stratified(spark, sf), group)


def _by_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return report.indicators_by_stratum(STRATIFIED, frames(spark, sf))


def _agd(spark: SparkSession, sf: str) -> DataFrame:
    names = [n for n in PLAIN if n.endswith(("_agd", "_edu")) and not n.startswith("impact3_2")]
    names.remove("outcome4_1_edu")
    return report.estimates(PLAIN, frames(spark, sf), names)


def _headline(spark: SparkSession, sf: str) -> DataFrame:
    return report.headline(frames(spark, sf), GROUPS, GENDERS, AGE_BANDS)


def _headline_second(spark: SparkSession, sf: str) -> DataFrame:
    """The other country's survey: its own groups and its own name for adults."""
    named = frames(spark, sf)[HOUSEHOLD].replace(
        {"IDPs": "Refugees and Asylum-seekers", "Refugee returnees": "Host communities"},
        subset=["pop_groups"],
    )
    people = frames(spark, sf)[PERSON].replace({"18+": "18-60+"}, subset=["HH07_cat2"])
    return report.headline({HOUSEHOLD: named, PERSON: people}, SECOND_GROUPS, GENDERS, SECOND_BANDS)


def _tabled(grain: str) -> Query:
    return lambda spark, sf: frequencies(frames(spark, sf)[grain], TABLED[grain])


def _two_way(spark: SparkSession, sf: str) -> DataFrame:
    counts = two_way_frequency(
        frames(spark, sf)[HOUSEHOLD], "outcome8_2", "pop_groups", list(GROUPS.values())
    )
    return counts.withColumnsRenamed({v: k for k, v in GROUPS.items()})


def _types(spark: SparkSession, sf: str) -> DataFrame:
    household, person = frames(spark, sf)[HOUSEHOLD], frames(spark, sf)[PERSON]
    return column_types(household, ["outcome13_3"]).union(column_types(person, ["pop_groups"]))


def _description(spark: SparkSession, sf: str) -> DataFrame:
    return sample_description(
        frames(spark, sf)[HOUSEHOLD],
        ["HH07", "hh_size_001", "wgh_samp_pop_restr"],
        ["pop_groups", "samp_strat", "HH04", "HH07_cat", "disability", "EDU01_random"],
    )


def _person_description(spark: SparkSession, sf: str) -> DataFrame:
    return sample_description(
        frames(spark, sf)[PERSON],
        ["HH07", "wgh_samp_pop_restr", "wgh_strata_spec"],
        ["pop_groups", "samp_strat", "HH04", "HH07_cat", "HH07_cat2", "disability", "citizenship"],
    )


def _column_range(spark: SparkSession, sf: str) -> DataFrame:
    """A composite over the columns from one name to another."""
    chosen = ["pop_groups", "shelter", "electricity", "drinkingwater", "secure", "healthcare"]
    frame = frames(spark, sf)[HOUSEHOLD].select(*chosen, "impact2_2")
    columns = columns_between(frame, "shelter", "healthcare")
    return component_shares(frame, columns, ["pop_groups"], "facility")


def _error_bars(spark: SparkSession, sf: str) -> DataFrame:
    return charts.error_bars(run(PLAIN["impact2_2"], frames(spark, sf)), ["pop_groups"])


def _error_bars_by_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return charts.error_bars(run(STRATIFIED["impact2_2_strata"], frames(spark, sf)), [STRATUM])


def _facets(spark: SparkSession, sf: str) -> DataFrame:
    means = run(PLAIN["impact2_3_agd"], frames(spark, sf))
    return charts.facets(means, "HH04", "disability", ["HH07_cat"])


def _facets_two_way(spark: SparkSession, sf: str) -> DataFrame:
    means = run(STRATIFIED["outcome13_2_agd"], frames(spark, sf))
    return charts.facets(means, "HH04", "disability", ["pop_groups", "HH07_cat"])


def _ratio_facets(spark: SparkSession, sf: str) -> DataFrame:
    ratios = run(PLAIN["impact3_2a_agd"], frames(spark, sf))
    return charts.facets(ratios, "HH04", "disability", ["pop_groups"])


def _sorted_shares(spark: SparkSession, sf: str) -> DataFrame:
    shares = run(PLAIN["hacc_percentages"], frames(spark, sf))
    return charts.sorted_shares(shares, "Reason", "Percentage")


def _sorted_shares_by_group(spark: SparkSession, sf: str) -> DataFrame:
    shares = run(STRATIFIED["gbv01_percentages"], frames(spark, sf))
    return charts.sorted_shares(shares, "Services", "Percentage", ["pop_groups"])


def _sorted_distribution(spark: SparkSession, sf: str) -> DataFrame:
    shares = run(PLAIN["light02_percentages"], frames(spark, sf)).where("LIGHT02 IS NOT NULL")
    return charts.sorted_shares(shares, "LIGHT02", "Percentage")


def _component_bars(
    spec_name: str, labels: Mapping[str, str], specs=PLAIN, name="facility", shortest=False
) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        shares = run(specs[spec_name], frames(spark, sf))
        return charts.component_bars(
            shares, name, "percentage", ["pop_groups"], labels, shortest=shortest
        )

    return query


def _contrast(spark: SparkSession, sf: str) -> DataFrame:
    shares = run(REPORT["availability_summary"], frames(spark, sf))
    return charts.contrast_labels(shares, "percentage")


def _axis(spark: SparkSession, sf: str) -> DataFrame:
    return charts.axis_limits(frames(spark, sf)[PERSON], "HH04")


def _csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    files.write_csv(households(spark, sf), path)
    return files.read_csv(spark, path, HOUSEHOLDS)


def _csv_scan_reordered(spark: SparkSession, sf: str) -> DataFrame:
    """Columns in the file's own order, with one more than asked for."""
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    table = households(spark, sf)
    files.write_csv(table.selectExpr("'x' AS extra", *[f"`{c}`" for c in reversed(table.columns)]), path)
    return files.read_csv(spark, path, HOUSEHOLDS)


QUOTED = StructType(
    [
        StructField("number", LongType()),
        StructField("share", DoubleType()),
        StructField("remark", StringType()),
        StructField("nation", LongType()),
    ]
)


def _csv_scan_quoted(spark: SparkSession, sf: str) -> DataFrame:
    """Remarks of several lines with quotes and commas, both signs of a missing cell, whole numbers with a point."""
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    raw = customers.selectExpr(
        "concat(CAST(c_custkey AS STRING), CASE WHEN c_custkey % 3 = 0 THEN '.0' ELSE '' END) AS number",
        "CASE WHEN c_custkey % 7 = 0 THEN 'NA' ELSE concat('line one of ', c_name, '\\nsays \"yes, no\", ok') END AS remark",
        "CASE c_custkey % 5 WHEN 0 THEN if(c_custkey % 2 = 0, 'NA', NULL) ELSE CAST(c_nationkey AS STRING) END AS nation",
        "CAST(c_custkey / 4 AS STRING) AS share",
    )
    files.write_csv(raw, path)
    return files.read_csv(spark, path, QUOTED)


def _labels_with_files(spark: SparkSession, sf: str) -> DataFrame:
    """Labels written beside CSV, read with it, kept by coercion, and used to decode."""
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    labels = {
        "SPF01b": ("Receives cash", {"Yes": 1.0, "No": 0.0, "Not known": 98.0}),
        "GBV01a": ("Knows a health service", {"Knows": 1.0, "Does not know": 0.0}),
    }
    files.write_csv(label_columns(households(spark, sf), labels), path, labels=True)
    read = numeric_answers(files.read_csv(spark, path, HOUSEHOLDS, labels=True))
    return frequencies(read.selectExpr(*[f"{value_label(read, c)} AS {c}" for c in labels]), list(labels))


def _parquet_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    files.write_parquet(persons(spark, sf), path)
    return files.read_parquet(spark, path, PERSONS)


def _export_combined(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    table = rounded(report.combined_indicators(PLAIN, frames(spark, sf)))
    files.export_table(table, path)
    return files.read_csv(spark, path, table.schema)


def _export_by_group(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    combined = report.combined_indicators(STRATIFIED, frames(spark, sf))
    table = rounded(combined.select("pop_groups", *report.REPORT_NAMES))
    files.export_by_group(table, path, ["pop_groups"])
    return files.read_parquet(spark, path, table.schema)


def _named() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for grain, columns in RECODES.items():
        for column in columns:
            out[f"recode_{column.lower()}"] = _recode(grain, column)
    out["recode_person_disability"] = _recode(PERSON, "disability")
    out["recode_person_citizenship"] = _recode(PERSON, "citizenship")
    out["recode_outcome4_1_row_wise"] = _optional("outcome4_1", gbv_row_wise=True)
    out["recode_drinkingwater_strict"] = _optional("drinkingwater", strict_water=True)
    out["recode_outcome12_2_strict"] = _optional("outcome12_2", strict_toilet=True)
    for profile, specs in {"plain": PLAIN, "report": REPORT, "stratified": STRATIFIED}.items():
        for name, spec in specs.items():
            out[f"{profile}_{name}"] = _table(spec)
    out |= {
        "report_outcome13_3": _derived_mean("outcome13_3"),
        "report_outcome13_3_agd": _derived_mean("outcome13_3_agd"),
        "numeric_coercion": _numeric_coercion,
        "coercion_in_place": _coercion_in_place,
        "label_lookup": _label_lookup,
        "factor_recode": _factor_recode,
        "relabel_wrap": _relabel_wrap,
        "value_labels": _value_labels,
        "labels_after_coercion": _labels_after_coercion,
        "mean_in_domain": _mean_in_domain,
        "mean_number": _mean_number,
        "mean_clustered": _mean_clustered,
        "mean_precomputed": _precomputed,
        "report_precomputed": _report_precomputed,
        "report_precomputed_for_group": _precomputed_for_group("IDPs"),
        "total_rows": _total_rows,
        "total_answers": _total_answers,
        "total_number": _total_number,
        "ratio_number": _ratio_number,
        "strata_sizes": _strata_sizes,
        "combined_indicators": _combined(PLAIN),
        "combined_indicators_stratified": _combined(STRATIFIED),
        "combined_for_group": _combined_for_group("IDPs"),
        "combined_for_returnees": _combined_for_group("Refugee returnees"),
        "report_table_stratified": _report_stratified,
        "stratified_for_group": _stratified_for_group("IDPs"),
        "stratified_for_returnees": _stratified_for_group("Refugee returnees"),
        "combined_by_stratum": _by_stratum,
        "combined_disaggregated": _agd,
        "headline_counts": _headline,
        "headline_counts_second": _headline_second,
        "freq_household": _tabled(HOUSEHOLD),
        "freq_person": _tabled(PERSON),
        "freq_oneway": lambda spark, sf: frequency(frames(spark, sf)[PERSON], "HH07_cat"),
        "freq_twoway": _two_way,
        "column_types": _types,
        "sample_description": _description,
        "sample_description_person": _person_description,
        "composite_column_range": _column_range,
        "plot_errorbars": _error_bars,
        "plot_errorbars_by_stratum": _error_bars_by_stratum,
        "plot_facets": _facets,
        "plot_facets_two_way": _facets_two_way,
        "plot_facets_ratio": _ratio_facets,
        "plot_sorted_shares": _sorted_shares,
        "plot_sorted_shares_by_group": _sorted_shares_by_group,
        "plot_sorted_distribution": _sorted_distribution,
        "plot_composite_housing": _component_bars("composite_outcome9_1", book.HOUSING_CONDITIONS),
        "plot_composite_water": _component_bars("composite_outcome12_1", book.WATER_CONDITIONS),
        "plot_composite_toilet": _component_bars("composite_outcome12_2", book.TOILET_CONDITIONS),
        "plot_composite_facilities": _component_bars(
            "composite_impact2_2_pop", book.BASIC_FACILITIES, STRATIFIED, shortest=True
        ),
        "plot_composite_bank": _component_bars(
            "composite_outcome13_1", book.BANK_ACCESS, name="access"
        ),
        "plot_contrast": _contrast,
        "plot_axis_limits": _axis,
        "csv_scan": _csv_scan,
        "csv_scan_reordered": _csv_scan_reordered,
        "csv_scan_quoted": _csv_scan_quoted,
        "labels_with_files": _labels_with_files,
        "parquet_scan": _parquet_scan,
        "export_combined": _export_combined,
        "export_by_group": _export_by_group,
    }
    return out


def _finished(query: Query) -> Query:
    def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(query(spark, sf_dir))

    return finished


QUERIES: dict[str, Query] = {name: _finished(query) for name, query in _named().items()}
