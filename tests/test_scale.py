"""Plans without a task for all rows, reading and writing of files, and even line breaks."""

from __future__ import annotations

import itertools
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

import __spark_entry__ as contract
from check_oracles import compare, connect
from tallyloom.functions.labels import label_columns, read_labels, value_label
from tallyloom.functions.text import wrap_evenly
from tallyloom.operators import SurveyDesign, charts, mean_table
from tallyloom.operators.profile import column_types, distribution, headline_counts, sample_description, two_way_frequency
from tallyloom.plans import report
from tallyloom.plans.catalogue import PLAIN
from tallyloom.plans.rules import GBV_ITEMS, household_indicators
from tallyloom.registry import QUERIES, frames
from tallyloom.sources import files
from tallyloom.sources.derive import households

SCHEMA = StructType(
    [StructField("a", StringType()), StructField("b", LongType()), StructField("w", DoubleType())]
)


def planned(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def single_windows(text: str) -> list[str]:
    """Windows of a plan that read from a single partition."""
    found, lines = [], text.splitlines()
    depths = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    for i, line in enumerate(lines):
        if "SinglePartition" not in line:
            continue
        depth = depths[i]
        for j in range(i - 1, -1, -1):
            if depths[j] < depth:
                depth = depths[j]
                operator = lines[j].lstrip(" :+-*()0123456789")
                if operator.startswith("Window"):
                    found.append(operator)
                if "Exchange" in operator:
                    break
    return found


def test_no_window_takes_all_rows(spark, sf_dir):
    """No window reads what a single partition holds, in any query of the package's own."""
    writing = {n for n in QUERIES if re.search("csv|parquet|export|precomputed|files", n)}
    for name in sorted(set(QUERIES) - writing - {n for n in QUERIES if n.startswith("recode_")}):
        assert not single_windows(planned(QUERIES[name](spark, sf_dir))), name


def test_a_million_groups(spark):
    rows = spark.range(2_000_000).selectExpr("id % 1000000 AS g", "CAST(id % 2 AS DOUBLE) AS y", "1.5D AS w")
    means = mean_table(SurveyDesign(rows, "w"), "y", ["g"], "g % 2 = 0")
    found = means.agg(F.count("*"), F.sum("num_obs_uw"), F.max("denominator"), F.max("mean_value_se")).first()
    assert tuple(found)[:3] == (500_000, 1_000_000, 3.0) and found[3] == 0.0


def test_whole_table_condition_needs_no_scan_of_its_own(spark, sf_dir):
    text = planned(QUERIES["combined_indicators"](spark, sf_dir))
    assert text.count("customer.parquet") == 2  # households, and persons joined with theirs
    assert planned(QUERIES["plain_outcome4_1"](spark, sf_dir)).count("customer.parquet") == 1


def test_whole_table_condition(spark, sf_dir):
    """All unknown: missing for everybody; one other answer outside the domain: 0."""
    raw = households(spark, sf_dir).where("hh_id < 60")
    silent = raw.select(*[F.lit("98").alias(c) if c in GBV_ITEMS else F.col(f"`{c}`") for c in raw.columns])
    one = silent.withColumn(GBV_ITEMS[3], F.when(F.col("hh_id") == 7, "0").otherwise("98"))
    for table, value in ((silent, None), (one, 0.0)):
        recoded = household_indicators(table)
        frame = {"household": recoded, "person": frames(spark, sf_dir)["person"]}
        means = {r.mean_value for r in report.estimates(PLAIN, frame, ["outcome4_1"]).where("pop_groups = 'IDPs'").collect()}
        assert means == {value}
        assert {r.outcome4_1 for r in recoded.select("outcome4_1").collect()} == {value}


def test_positions_of_many_categories(spark):
    rows = spark.range(100_000).selectExpr("CAST(id AS STRING) AS `the name`", "CAST(pmod(hash(id), 50000) AS DOUBLE) AS `v 1`", "'g' AS `age band`")
    got = charts.sorted_shares(rows, "the name", "v 1", ["age band"]).toPandas()
    want = rows.toPandas().sort_values(["v 1", "the name"])
    assert got.sort_values("position")["the name"].tolist() == want["the name"].tolist()
    assert sorted(got["position"]) == list(range(1, 100_001))
    axis = charts.axis_limits(rows, "the name").toPandas().sort_values("position")
    assert axis["the name"].tolist() == sorted(want["the name"]) and axis["position"].is_monotonic_increasing
    assert not single_windows(planned(charts.axis_limits(rows, "the name")))
    assert single_windows(planned(rows.selectExpr("row_number() OVER (ORDER BY `v 1`) AS n")))


def test_positions_with_ties_and_missing_names(spark):
    rows = spark.createDataFrame(
        [("b", 1.0, 1), ("a", 1.0, 1), (None, 5.0, 1), ("b", 3.0, 2), ("a", 3.0, 2), ("c", None, 1)], "n string, v double, g int"
    )
    got = {(r.n, r.g): r.position for r in charts.sorted_shares(rows, "n", "v", ["g"]).collect()}
    assert got == {("c", 1): 1, ("a", 1): 2, ("a", 2): 2, ("b", 1): 3, ("b", 2): 3, (None, 1): 4}


def test_any_name_in_profiles_and_charts(spark):
    rows = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("x", None)], "`a b` string, `m.v` double")
    described = {(r.variable, r.level): (r.n, r.missing, r.percent) for r in sample_description(rows, ["m.v"], ["a b"]).collect()}
    assert described[("m.v", None)] == (2, 1, None)
    assert described[("a b", "x")][:2] == (2, 0) and round(described[("a b", "x")][2], 3) == 66.667
    assert planned(sample_description(rows.repartition(2), ["m.v"], ["a b"])).count("Scan ExistingRDD") <= 3
    assert {r["a b"]: r.n for r in distribution(rows, "a b").collect()} == {"x": 2, "y": 1}
    assert column_types(rows, ["m.v"]).first().n == 2
    assert {r.name: r.n for r in headline_counts(rows, "all rows", {"the x": "`a b` = 'x'"}).collect()} == {"all rows": 3, "the x": 2}
    assert two_way_frequency(rows.selectExpr("`a b`", "`a b` AS `c d`"), "a b", "c d", ["x", "y"]).count() == 2
    bars = charts.component_bars(rows, "a b", "m.v", [], {"x": "long label of an answer"})
    assert {r.axis_label for r in bars.collect()} == {"long label of an\nanswer", "y"}
    assert charts.contrast_labels(rows, "m.v").count() == 3


def write(path, text):
    path.mkdir()
    (path / "part.csv").write_text(text)
    return str(path)


def test_csv_records_as_written_by_others(spark, tmp_path):
    """Line breaks and doubled quotes inside quotes, both signs of a missing cell, 1.0 for a whole number."""
    path = write(
        tmp_path / "c", 'a,b,w\n"two\nlines",1,2.0\nNA,NA,NA\n"say ""hi"", ok",1.0,3\n"NA","",0.5\n plain , 4 ,1e3\n'
    )
    rows = sorted((tuple(r) for r in files.read_csv(spark, path, SCHEMA).collect()), key=str)
    want = [("two\nlines", 1, 2.0), (None, None, None), ('say "hi", ok', 1, 3.0), (None, None, 0.5), ("plain", 4, 1000.0)]
    assert rows == sorted(want, key=str)
    assert files.read_csv(spark, path, SCHEMA).count() == 5


@pytest.mark.parametrize("line", ["x,1", "x,1,2.0,3", "x,1.5,2.0", "x,one,2.0", "x,1e30,2.0"])
def test_csv_faults_stop_the_query(spark, tmp_path, line):
    frame = files.read_csv(spark, write(tmp_path / "f", f"a,b,w\ny,2,3.0\n{line}\n"), SCHEMA)
    with pytest.raises(Exception, match="cells as columns|is no bigint"):
        frame.collect()


def test_csv_cells_survive_writing(spark, tmp_path):
    cells = ['plain', 'a "b" c', "x,y", "two\nlines", "'", '"', "back\\slash", "tail\\", "\\\"", "é漢"]
    frame = spark.createDataFrame([(c, i, i / 4) for i, c in enumerate(cells)] + [(None, None, None)], SCHEMA)
    files.write_csv(frame, str(tmp_path / "w"))
    back = files.read_csv(spark, str(tmp_path / "w"), SCHEMA)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_labels_travel_with_files(spark, tmp_path, kind):
    frame = spark.createDataFrame([("1", 5, 1.0), ("0", 6, 0.0)], SCHEMA)
    labels = {"a": ("Question a", {"Yes": 1.0, "No": 0.0}), "w": (None, {"Low": 0.0}), "b": ("Only a label", {})}
    path = str(tmp_path / "l")
    getattr(files, f"write_{kind}")(label_columns(frame, labels), path, labels=True)
    back = getattr(files, f"read_{kind}")(spark, path, SCHEMA, labels=True)
    assert {c: read_labels(back, c) for c in back.columns} == labels
    assert back.count() == 2 and read_labels(getattr(files, f"read_{kind}")(spark, path, SCHEMA), "a") == (None, {})
    some = getattr(files, f"read_{kind}")(spark, path, StructType([SCHEMA["w"]]), labels=True)
    assert {r[0] for r in some.selectExpr(value_label(some, "w")).collect()} == {"Low", None}


def test_labels_that_contradict_are_an_error(spark, tmp_path):
    path = str(tmp_path / "l")
    frame = spark.createDataFrame([("1", 5, 1.0)], SCHEMA)
    files.write_csv(label_columns(frame, {"a": ("q", {"Yes": 1.0, "Also": 1.0})}), path, labels=True)
    with pytest.raises(ValueError, match="twice"):
        files.read_csv(spark, path, SCHEMA, labels=True)


def test_group_files_are_bounded(spark, tmp_path):
    """A group of a third of all rows is split, 200 small ones have one file each."""
    key = "CASE WHEN id % 3 = 0 THEN 'large' ELSE concat('g', id % 200) END"
    rows = spark.range(0, 240_000, 1, 12).selectExpr(f"{key} AS `the group`", "id", "sha2(CAST(id AS STRING), 256) AS text")
    files.export_by_group(rows, str(tmp_path / "g"), ["the group"], rows_per_file=20_000)
    written = {}
    for f in (tmp_path / "g").rglob("*.parquet"):
        written.setdefault(f.parent.name, []).append(pq.ParquetFile(f).metadata.num_rows)
    sizes = {k.split("=")[1]: v for k, v in written.items()}
    large = sizes.pop("large")
    assert sum(large) == 80_000 and len(large) == 5 and max(large) <= 20_000
    assert len(sizes) == 200 and all(len(v) == 1 for v in sizes.values())


def exhaustive(text, width):
    words, best = text.split(), None
    for cuts in itertools.product([False, True], repeat=max(0, len(words) - 1)):
        lines = [words[:1]]
        for cut, word in zip(cuts, words[1:]):
            lines.append([word]) if cut else lines[-1].append(word)
        sizes = [len(" ".join(x)) for x in lines]
        if any(s > width and len(x) > 1 for s, x in zip(sizes, lines)):
            continue
        cost = sum((width - s) ** 2 for s in sizes[:-1] if s <= width)
        start = sum(map(len, lines[:-1]))
        if best is None or (cost, start) < best[:2]:
            best = (cost, start, "\n".join(" ".join(x) for x in lines))
    return best[2]


def test_lines_are_broken_evenly(spark):
    r = random.Random(4)
    texts = [" ".join("x" * r.randint(1, 12) for _ in range(r.randint(1, 8))) for _ in range(60)]
    texts += ["Toilet is not shared with other households", "a", "  two   blanks ", "unbreakable-word-beyond-width b c d e"]
    frame = spark.createDataFrame([(t,) for t in [*texts, "", "  ", None]], "t string")
    got = {x.t: x.w for x in frame.selectExpr("t", f"{wrap_evenly('t', 20)} AS w").collect()}
    assert got[""] == got["  "] == "" and got[None] is None
    for t in texts:
        assert got[t] == exhaustive(t, 20), t


@pytest.mark.parametrize("name", ["csv_scan_quoted", "labels_with_files", "plot_sorted_shares", "plot_axis_limits", "relabel_wrap", "report_availability_summary"])
def test_new_forms_match_sql(spark, sf_dir, name):
    assert compare(contract.queries()[name](spark, sf_dir), connect(sf_dir), contract.oracle_sql()[name]) is None
