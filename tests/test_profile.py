"""Breakdowns, labels and chart frames."""

from __future__ import annotations

import pytest

from tallyloom.functions.labels import (
    attach_labels,
    code_label,
    read_labels,
    relabel,
    value_label,
)
from tallyloom.functions.text import percent_label, rounded_percent_label, wrap_words
from tallyloom.operators import charts
from tallyloom.operators.profile import (
    column_types,
    columns_between,
    columns_starting_with,
    component_shares,
    distribution,
    frequencies,
    frequency,
    headline_counts,
    sample_description,
    two_way_frequency,
)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        ("a", 1.0, 0.0, 1.0, 2.0),
        ("a", 0.0, None, 2.0, 1.0),
        ("a", 98.0, 1.0, 7.0, None),
        (None, 1.0, 1.0, None, 1.0),
        ("b", None, None, 1.0, 1.0),
    ]
    return spark.createDataFrame(rows, "g string, x double, y double, code double, w double")


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


def test_shares_skip_missing_answers_and_keep_the_missing_group(frame):
    shares = component_shares(frame, ["x", "y"], ["g"]).collect()
    got = {(r.g, r.component): r.percentage for r in shares}
    assert got[("a", "x")] == pytest.approx(99 / 3 * 100)
    assert got[("a", "y")] == 50 and got[(None, "x")] == 100 and got[("b", "x")] is None
    assert len(got) == 6


def test_shares_of_one_code(frame):
    shares = rows_of(component_shares(frame, ["x", "y"], equals=1), "component")
    assert shares["x"].percentage == 50
    assert shares["y"].percentage == pytest.approx(200 / 3)


def test_weighted_shares(frame):
    shares = component_shares(frame, ["x", "y"], ["g"], weight="w").collect()
    got = {(r.g, r.component): r.percentage for r in shares}
    assert got[("a", "x")] is None, "a known answer without a weight"
    assert got[(None, "y")] == 100 and got[("b", "y")] is None


def test_labels_and_columns_kept_aside(frame):
    labels = {"x": "First"}
    gone = component_shares(frame, ["x", "y"], labels=labels).collect()
    assert sorted(str(r.component) for r in gone) == ["First", "None"]
    kept = component_shares(frame, ["x", "y"], labels=labels, unlisted="keep").collect()
    assert sorted(r.component for r in kept) == ["First", "y"]
    beside = component_shares(frame, ["x"], keep=["y"]).collect()
    assert len(beside) == 1 and beside[0].y == pytest.approx(200 / 3)


def test_distribution_sums_to_100_in_every_group(frame):
    rows = distribution(frame, "code", ["g"]).collect()
    total = {}
    for r in rows:
        total[r.g] = total.get(r.g, 0) + r.Percentage
    assert all(v == pytest.approx(100) for v in total.values()) and set(total) == {"a", "b"}


def test_unknown_codes_before_and_after_labelling(frame):
    labels = {"1": "one", "2": "two"}
    after = rows_of(distribution(frame, "code", labels=labels), "code")
    assert after[None].n == 1 and after["one"].Percentage == 50
    before = rows_of(distribution(frame, "code", labels=labels, label_first=True), "code")
    assert set(before) == {"one", "two"} and before["one"].Percentage == pytest.approx(200 / 3)


def test_missing_answers_can_be_a_category(frame):
    rows = rows_of(distribution(frame, "code", skip_missing=False), "code")
    assert rows[None].n == 1 and rows[1.0].Percentage == 40


def test_counts(frame):
    assert rows_of(frequency(frame, "g"), "g")["a"].n == 3
    both = {(r.variable, r.level): r.n for r in frequencies(frame, ["g", "code"]).collect()}
    assert both == {
        ("g", "a"): 3,
        ("g", "b"): 1,
        ("code", "1.0"): 2,
        ("code", "2.0"): 1,
        ("code", "7.0"): 1,
    }
    two = rows_of(two_way_frequency(frame, "code", "g", ["a", "b"]), "code")
    assert (two[1.0].a, two[1.0].b) == (1, 1) and (two[7.0].a, two[7.0].b) == (1, 0)
    head = rows_of(headline_counts(frame, "rows", {"in_a": "g = 'a'"}), "name")
    assert head["rows"].n == 5 and head["in_a"].n == 3


def test_sample_description(frame):
    rows = {(r.variable, r.level): r for r in sample_description(frame, ["w"], ["g"]).collect()}
    w = rows[("w", None)]
    assert (w.n, w.missing, w["mean"]) == (4, 1, 1.25) and w.sd == pytest.approx(0.5)
    assert rows[("g", "a")].percent == 75 and rows[("g", "a")].missing == 1
    assert len(rows) == 3


def test_column_choice(frame):
    assert columns_starting_with(frame, "C") == ["code"]
    assert columns_between(frame, "x", "code") == ["x", "y", "code"]


def test_label_text(spark):
    one = spark.range(1)

    def text(expr):
        return one.selectExpr(f"{expr} AS t").first().t

    assert text(percent_label("12.04D")) == "12.0%"
    assert text(rounded_percent_label("12.04D")) == "12%"
    assert text(rounded_percent_label("12.35D")) == "12.4%"
    assert text(wrap_words("'Toilet is not shared with other households'")) == (
        "Toilet is not shared\nwith other\nhouseholds"
    )
    assert text(wrap_words("'  a  '")) == "a"
    assert text(wrap_words("'unbreakable-word-beyond-width b'")) == (
        "unbreakable-word-beyond-width\nb"
    )
    quote = {"98": "Don't know", "1": "back\\slash"}
    assert text(code_label("'98'", quote)) == "Don't know"
    assert text(code_label("'1'", quote)) == "back\\slash"
    assert text(code_label("'5'", quote)) is None
    assert text(relabel("'5'", quote)) == "5"


def test_labels_stay_with_their_column(frame):
    labelled = attach_labels(frame, {"x": "An answer"}, {"Yes": 1.0})
    kept = labelled.where("x = 1").selectExpr("x")
    assert read_labels(kept, "x") == ("An answer", {"Yes": 1.0})
    assert read_labels(frame, "x") == (None, {})
    shown = labelled.selectExpr(f"{value_label(labelled, 'x')} AS v").collect()
    assert [r.v for r in shown] == ["Yes", None, None, "Yes", None]


def test_column_types(frame):
    rows = rows_of(column_types(frame, ["g", "code"]), "variable")
    assert (rows["g"].type, rows["g"].n) == ("string", 4)
    assert (rows["code"].type, rows["code"].n) == ("double", 4)


def test_chart_frames(spark):
    shares = spark.createDataFrame(
        [("a", "p", 10.0), ("a", "q", 30.0), ("b", "p", 50.0), ("b", "q", 20.0)],
        "g string, name string, v double",
    )
    rows = charts.sorted_shares(shares, "name", "v", ["g"], 0).collect()
    assert {(r.name, r.position) for r in rows} == {("q", 1), ("p", 2)}
    assert {r.label for r in rows} == {"10%", "30%", "50%", "20%"}
    colours = charts.contrast_labels(shares, "v", above=15).collect()
    assert {r.v: r.label_color for r in colours}[10.0] == "black"
    assert [r.position for r in charts.axis_limits(shares, "name").orderBy("name").collect()] == [
        1,
        2,
    ]
