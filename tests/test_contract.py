"""Registered queries: oracles, plans, files."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from oracles.registry import ORACLES
from check_oracles import compare, connect
from tallyloom.plans.catalogue import PLAIN, REPORT, STRATIFIED
from tallyloom.registry import QUERIES, frames
from tallyloom.sources import files
from tallyloom.sources.derive import households, persons
from tallyloom.sources.schemas import HOUSEHOLDS, PERSONS

SAMPLE = [
    "plain_impact2_2",
    "plain_outcome4_1",
    "plain_outcome14_1",
    "plain_impact3_2a_agd",
    "plain_outcome4_1_edu",
    "report_impact2_3_agd",
    "report_availability_summary",
    "stratified_impact3_2a",
    "stratified_outcome13_3_strata",
    "stratified_outcome10_1_agd",
    "stratified_composite_impact2_2_pop",
    "stratified_identity_document_percentages",
    "stratified_dwe10_percentages",
    "plain_dwe10_percentages",
    "mean_clustered",
    "total_answers",
    "combined_for_group",
    "combined_indicators_stratified",
    "headline_counts",
    "sample_description",
    "freq_twoway",
    "plot_sorted_shares_by_group",
    "plot_composite_toilet",
    "csv_scan",
    "export_by_group",
]


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, sf_dir, name):
    result = contract.queries()[name](spark, sf_dir)
    assert compare(result, connect(sf_dir), contract.oracle_sql()[name]) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r.pop_groups for r in rows} == {"IDPs", "Refugee returnees"}


def test_derived_tables_have_the_declared_schema(spark, sf_dir):
    for frame, schema in [
        (households(spark, sf_dir), HOUSEHOLDS),
        (persons(spark, sf_dir), PERSONS),
    ]:
        assert dict(frame.dtypes) == {f.name: f.dataType.simpleString() for f in schema}


def test_number_of_standard_tables():
    assert len(PLAIN) == 53
    assert set(REPORT) == {"impact2_3_agd", "availability_summary", "spf01_percentages"}
    means = [n for n in STRATIFIED if n.endswith("_strata") and n.startswith(("im", "ou"))]
    assert len(means) == 22


def test_report_has_every_indicator_once_per_group(spark, sf_dir):
    rows = contract.queries()["combined_indicators"](spark, sf_dir).collect()
    assert len(rows) == 45
    assert len({(r.pop_groups, r.var_name) for r in rows}) == 45
    assert len({r.var_name for r in rows}) == 23


def test_composite_is_at_most_each_component(spark, sf_dir):
    parts = ["shelter", "electricity", "drinkingwater", "secure", "healthcare"]
    above = " OR ".join(f"impact2_2 > {c}" for c in parts)
    assert frames(spark, sf_dir)["household"].where(above).count() == 0


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_one_scan_per_base_table_and_no_python(spark, sf_dir):
    plan = _plan(contract.queries()["combined_by_stratum"](spark, sf_dir))
    # households, plus the EXISTS check of one rule; persons and their households
    assert plan.count("FileScan parquet") <= 4
    for bad in ["CartesianProduct", "NestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"]:
        assert bad not in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = _plan(contract.queries()["plain_outcome9_2"](spark, sf_dir))
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_rows_are_summed_before_the_first_shuffle(spark, sf_dir):
    plan = _plan(contract.queries()["stratified_outcome9_2"](spark, sf_dir))
    exchange = plan.rindex("Exchange hashpartitioning")
    assert "partial_sum" in plan[exchange:], "the lowest shuffle carries partial sums"


def test_csv_and_parquet_round_trip(spark, sf_dir, tmp_path):
    table = households(spark, sf_dir)
    files.write_csv(table, str(tmp_path / "csv"))
    files.write_parquet(table, str(tmp_path / "parquet"))
    csv = files.read_csv(spark, str(tmp_path / "csv"), HOUSEHOLDS)
    parquet = files.read_parquet(spark, str(tmp_path / "parquet"), HOUSEHOLDS)
    assert table.exceptAll(csv).isEmpty() and csv.exceptAll(table).isEmpty()
    assert table.exceptAll(parquet).isEmpty()


def test_export_is_one_file_with_header(spark, sf_dir, tmp_path):
    table = contract.queries()["plain_impact2_2"](spark, sf_dir)
    files.export_table(table, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text().splitlines()[0] == ",".join(table.columns)
