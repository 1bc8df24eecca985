"""Reading files, coercing answers, labels, settings, and sampling errors of any number."""

from __future__ import annotations

import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tallyloom import session
from tallyloom.functions.labels import attach_labels, read_labels
from tallyloom.operators import SurveyDesign, mean_table
from tallyloom.operators.estimate import ratio_table, total_table
from tallyloom.operators.profile import component_shares, distribution
from tallyloom.plans.rules import RuleOptions, household_indicators, numeric_answers
from tallyloom.sources import files
from tallyloom.sources.derive import households

SCHEMA = StructType(
    [StructField("a", StringType()), StructField("b", LongType()), StructField("w", DoubleType())]
)


def write(path, text):
    path.mkdir()
    (path / "part.csv").write_text(text)
    return str(path)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = write(tmp_path / "c", "extra,w,b,a\nx,0.5,3,one\ny,,,\n")
    rows = [tuple(r) for r in files.read_csv(spark, path, SCHEMA).collect()]
    assert rows == [("one", 3, 0.5), (None, None, None)]


def test_csv_faults_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="no column w"):
        files.read_csv(spark, write(tmp_path / "m", "a,b\nx,1\n"), SCHEMA)
    bad = files.read_csv(spark, write(tmp_path / "b", "a,b,w\nx,1,oops\n"), SCHEMA)
    with pytest.raises(Exception, match="column w is no double: oops"):
        bad.collect()


def test_parquet_without_a_column_is_an_error(spark, tmp_path):
    spark.range(1).toDF("b").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="no column a, w"):
        files.read_parquet(spark, str(tmp_path / "p"), SCHEMA)


def test_only_answers_become_numbers(spark, sf_dir):
    raw = households(spark, sf_dir).selectExpr(
        "* EXCEPT (pop_groups, COOK02)", "pop_groups AS POP_GROUPS", "COOK02 AS cook02",
        "'Juba' AS county", "DATE'2023-05-01' AS day", "'free text' AS `age band`",
    )
    out = numeric_answers(raw)
    types = dict(out.dtypes)
    assert types["cook02"] == "double" and types["day"] == "date" and types["HH07"] == "double"
    row = out.where("POP_GROUPS IS NOT NULL").first()
    assert row.county == "Juba" and row["age band"] == "free text" and row.POP_GROUPS
    full = household_indicators(households(spark, sf_dir).selectExpr("*", "'Juba' AS county"))
    assert full.where("county = 'Juba'").count() == full.count()


def test_labels_survive_coercion(spark, sf_dir):
    labelled = attach_labels(households(spark, sf_dir), {"SHEL01": "Roof"}, {"Yes": 1, "No": 0})
    assert read_labels(numeric_answers(labelled), "SHEL01") == read_labels(labelled, "SHEL01")


def test_country_codes_are_parameters(spark, sf_dir):
    options = RuleOptions(foreign_code="XXX", own_code="UGA")
    got = household_indicators(households(spark, sf_dir), options)
    values = {r.citizenship for r in got.select("citizenship").distinct().collect()}
    assert values == {"XXX", "UGA", None}


@pytest.fixture
def ages(spark):
    rows = [(("a", "b")[i % 2], float(20 + i % 50), float(1 + i % 3)) for i in range(100)]
    return spark.createDataFrame(rows, "g string, age double, size double")


def test_numbers_have_sampling_errors_by_default(ages):
    """Against the textbook formulas for a simple random sample of 100."""
    values = [r.age for r in ages.where("g = 'a'").collect()]
    n, mean = len(values), sum(values) / len(values)
    z = [(v - mean) / n for v in values]
    expected = (100 / 99 * (sum(x * x for x in z) - sum(z) ** 2 / 100)) ** 0.5
    design = SurveyDesign(ages)
    got = {r.g: r for r in mean_table(design, "age", ["g"]).collect()}["a"]
    assert got.mean_value == pytest.approx(mean) and got.mean_value_se == pytest.approx(expected)
    t = [*values, *[0.0] * (100 - n)]
    se = (100 / 99 * (sum(x * x for x in t) - sum(t) ** 2 / 100)) ** 0.5
    total = {r.g: r for r in total_table(design, ["g"], "age").collect()}["a"]
    assert total.total == pytest.approx(sum(values)) and total.total_se == pytest.approx(se)
    ratio = {r.g: r for r in ratio_table(design, "age", "size", ["g"], "x").collect()}["a"]
    assert ratio.age_total_se == pytest.approx(se) and ratio.size_total_se > 0


def test_a_false_claim_of_binary_stops_the_query(ages):
    with pytest.raises(Exception, match="a negative variance"):
        mean_table(SurveyDesign(ages), "age", ["g"], binary=True).collect()


def test_settings_of_the_user_stay(spark):
    key = "spark.sql.adaptive.skewJoin.skewedPartitionFactor"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    session.tune(spark)
    assert spark.conf.get(key) == "7"
    spark.conf.set(key, old)


def test_files_need_a_shared_folder_on_a_cluster(spark):
    class Context:
        master = "yarn"

    class Cluster:
        conf, sparkContext = spark.conf, Context

    unset = spark.conf.get("spark.checkpoint.dir", None)
    if unset is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_folder(Cluster)


def test_any_name_can_be_a_key_or_a_measure(spark):
    rows = [(("x", "y")[i % 2], ("p", "q")[i % 3 % 2], float(i % 2), float(i), 1.5, f"s{i % 2}") for i in range(40)]
    names = ["age band", "request", "n", "total value", "the weight", "stratum"]
    frame = spark.createDataFrame(rows, names)
    design = SurveyDesign(frame, weight="the weight", strata="stratum")
    means = mean_table(design, "n", ["age band", "request"]).collect()
    assert len(means) == 4 and {r["age band"] for r in means} == {"x", "y"}
    totals = {r["request"]: r.total for r in total_table(design, ["request"], "total value").collect()}
    expected = {k: 1.5 * sum(r[3] for r in rows if r[1] == k) for k in "pq"}
    assert totals == pytest.approx(expected)
    ratio = ratio_table(design, "n", "total value", ["age band"], "r").collect()
    assert {r["age band"]: r["total value_total"] for r in ratio} == pytest.approx(
        {k: 1.5 * sum(r[3] for r in rows if r[0] == k) for k in "xy"}
    )
    shares = component_shares(frame, ["n", "total value"], ["age band"], equals=1, weight="the weight")
    assert shares.count() == 4
    assert {r["age band"]: r["n"] for r in distribution(frame, "age band").collect()} == {"x": 20, "y": 20}
    shown = distribution(frame, "n", ["request"], count_name="times")
    assert shown.where("n IS NOT NULL").count() == 4


def test_report_over_files_of_ready_indicators(spark, sf_dir):
    from tallyloom.registry import QUERIES

    for ready, direct in (
        ("report_precomputed", "combined_indicators"),
        ("report_precomputed_for_group", "combined_for_group"),
    ):
        got, expected = QUERIES[ready](spark, sf_dir), QUERIES[direct](spark, sf_dir)
        assert got.columns == expected.columns
        rows = sorted(map(repr, got.collect()))
        assert rows and rows == sorted(map(repr, expected.collect()))


def test_ready_indicators_are_saved_without_the_columns_no_report_takes(spark, sf_dir):
    from tallyloom import registry

    for grain, frame in registry._ready(spark, sf_dir).items():
        whole = registry.frames(spark, sf_dir)[grain]
        assert "pop_groups" in frame.columns and len(frame.columns) < len(whole.columns) / 3
