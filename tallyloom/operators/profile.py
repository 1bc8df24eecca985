"""Breakdowns without a variance: component shares, distributions, counts.

Shares of many columns are aggregated side by side in one pass and turned into
rows afterwards, when one record per group is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.codes import name, num, quoted
from tallyloom.functions.labels import code_label, number_label, relabel
from tallyloom.operators.once import over_records


def _share(value: str, weight: str | None) -> str:
    """Mean of a value over the rows where it is known, in percent."""
    if weight is None:
        return f"avg({value}) * 100"
    unweighted = f"count_if({value} IS NOT NULL AND {weight} IS NULL)"
    known = f"sum(CASE WHEN {value} IS NOT NULL THEN {weight} END)"
    ratio = f"try_divide(sum({weight} * {value}), {known}) * 100"
    return f"CASE WHEN {unweighted} = 0 THEN {ratio} END"


def component_shares(
    frame: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    names_to: str = "component",
    values_to: str = "percentage",
    labels: Mapping[str, str] | None = None,
    equals: float | None = None,
    weight: str | None = None,
    where: str | None = None,
    keep: Sequence[str] = (),
    unlisted: str = "missing",
) -> DataFrame:
    """Mean × 100 of several columns by group, one row per group and column.

    ``equals`` averages "the answer is this code" instead of the value itself.
    A missing weight on a known answer makes the share missing.  ``labels`` names
    the columns; columns it does not list become NULL, or keep their own name
    with ``unlisted="keep"``.  Columns in ``keep`` are averaged too but stay beside
    the rows instead of becoming rows.
    """
    def value(column: str) -> str:
        return name(column) if equals is None else f"CAST({name(column)} = {equals} AS DOUBLE)"

    rows = frame if where is None else frame.where(where)
    weight = weight and name(weight)
    # names of its own beside the keys, so any name can be a key
    places = {c: f"__share{i}" for i, c in enumerate([*columns, *keep])}
    shares = [F.expr(f"{_share(value(c), weight)} AS {p}") for c, p in places.items()]
    keys = [name(c) for c in by]
    wide = rows.groupBy(*keys).agg(*shares)
    pairs = ", ".join(f"struct({quoted(c)} AS __name, {places[c]} AS __share)" for c in columns)
    kept = [f"{places[c]} AS {name(c)}" for c in keep]
    tall = wide.selectExpr(*keys, *kept, f"inline(array({pairs}))")
    shown = "__name"
    if labels is not None:
        shown = relabel(shown, labels) if unlisted == "keep" else code_label(shown, labels)
    return tall.selectExpr(
        *keys,
        *map(name, keep),
        f"{shown} AS {name(names_to)}",
        f"__share AS {name(values_to)}",
    )


def distribution(
    frame: DataFrame,
    column: str,
    by: Sequence[str] = (),
    labels: Mapping[str, str] | None = None,
    label_first: bool = False,
    skip_missing: bool = True,
    count_name: str = "n",
    share_name: str = "Percentage",
) -> DataFrame:
    """Count and percentage of every answer, within each group where ``by`` is given.

    With ``label_first`` codes without a label are dropped before counting;
    otherwise they are counted and end up with a missing label.
    """
    keys = [f"k{i}" for i in range(len(by))]
    code = number_label(name(column), labels) if label_first else name(column)
    rows = frame.selectExpr(*[f"{name(c)} AS {k}" for c, k in zip(by, keys)], f"{code} AS code")
    if skip_missing:
        rows = rows.where("code IS NOT NULL")
    counts = rows.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))
    if by:
        # totals of groups lie where their records do
        counts = counts.selectExpr("*", f"sum(n) OVER (PARTITION BY {', '.join(keys)}) AS total")
    else:
        counts = over_records(counts, "SELECT code, n, (SELECT sum(n) FROM s) AS total FROM s")
    shown = "code"
    if labels is not None and not label_first:
        shown = number_label(shown, labels)
    return counts.selectExpr(
        *[f"{k} AS {name(c)}" for c, k in zip(by, keys)],
        f"{shown} AS {name(column)}",
        f"n AS {name(count_name)}",
        f"n / total * 100 AS {name(share_name)}",
    )


def frequency(frame: DataFrame, column: str) -> DataFrame:
    """Number of rows per value, missing values left out."""
    rows = frame.where(F.col(name(column)).isNotNull())
    return rows.groupBy(name(column)).agg(F.count(F.lit(1)).alias("n"))


def frequencies(
    frame: DataFrame, columns: Sequence[str], skip_missing: bool = True
) -> DataFrame:
    """Number of rows per value of several columns, as ``(variable, level, n)``.

    One pass: each task keeps one counter per variable and level, and only those
    counters are shuffled.  Numbers are counted as numbers and become text at the end.
    """
    types = dict(frame.dtypes)
    cells, texts = [], []
    for i, c in enumerate(columns):
        number, text = ("CAST(NULL AS DOUBLE)", f"CAST({name(c)} AS STRING)")
        if types[c] == "double":
            number, text = (name(c), "CAST(NULL AS STRING)")
        cells.append(f"struct({i} AS place, {number} AS number, {text} AS text)")
        texts.append(quoted(c))
    answers = frame.selectExpr(f"inline(array({', '.join(cells)}))")
    if skip_missing:
        answers = answers.where("number IS NOT NULL OR text IS NOT NULL")
    counts = answers.groupBy("place", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    return counts.selectExpr(
        f"get(array({', '.join(texts)}), place) AS variable",
        "coalesce(text, CAST(number AS STRING)) AS level",
        "n",
    )


def two_way_frequency(
    frame: DataFrame, row: str, column: str, values: Sequence[str]
) -> DataFrame:
    """Counts of two columns against each other, one output column per listed value."""
    counts = (
        frame.where(F.col(name(row)).isNotNull() & F.col(name(column)).isNotNull())
        .groupBy(name(row))
        .pivot(name(column), list(values))
        .agg(F.count(F.lit(1)))
    )
    return counts.na.fill(0, list(values))


def column_types(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spark type of columns and how many rows have a value, one row per column."""
    types = dict(frame.dtypes)
    counts = frame.agg(*[F.count(name(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    cells = ", ".join(
        f"struct({quoted(c)} AS variable, {quoted(types[c])} AS type, n{i} AS n)" for i, c in enumerate(columns)
    )
    return counts.selectExpr(f"inline(array({cells}))")


def sample_description(
    frame: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Overview of a sample: mean and spread of numbers, count and share of categories.

    One row per numeric column and one per level of a categorical column;
    missing answers are counted beside it and left out of the shares.
    """
    columns = [*numeric, *categorical]
    known = [f"struct({i} AS place, CAST({name(c)} AS DOUBLE) AS number, CAST(NULL AS STRING) AS text)" for i, c in enumerate(numeric)]
    known += [
        f"struct({i} AS place, CAST(NULL AS DOUBLE) AS number, CAST({name(c)} AS STRING) AS text)"
        for i, c in enumerate(categorical, start=len(numeric))
    ]
    answers = frame.selectExpr(f"inline(array({', '.join(known)}))")
    # one record per column and level, and one with the moments of each numeric column
    records = answers.groupBy("place", "text").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("number").alias("n"),
        F.avg("number").alias("mean"),
        F.stddev_samp("number").alias("sd"),
    )
    whole = over_records(
        records,
        """, known AS (SELECT place, sum(CASE WHEN text IS NULL THEN rows ELSE 0 END) AS missing,
    sum(CASE WHEN text IS NOT NULL THEN rows END) AS answered FROM s GROUP BY place)
SELECT s.*, known.missing AS missing, known.answered FROM s JOIN known ON s.place = known.place""",
    )
    last = len(numeric)
    return whole.where(f"place < {last} OR text IS NOT NULL").selectExpr(
        f"get(array({', '.join(quoted(c) for c in columns)}), place) AS variable",
        "text AS level",
        f"CASE WHEN place < {last} THEN n ELSE rows END AS n",
        f"CASE WHEN place < {last} THEN rows - n ELSE missing END AS missing",
        "mean",
        "sd",
        f"CASE WHEN place >= {last} THEN rows / answered * 100 END AS percent",
    )


def headline_counts(frame: DataFrame, total: str, conditions: Mapping[str, str]) -> DataFrame:
    """Number of rows, and of rows meeting each condition, as ``(name, n)``."""
    sums = [F.expr("count(1) AS n0")]
    sums += [F.expr(f"count_if({text}) AS n{i}") for i, text in enumerate(conditions.values(), start=1)]
    pairs = ", ".join(f"struct({quoted(x)} AS name, n{i} AS n)" for i, x in enumerate([total, *conditions]))
    return frame.agg(*sums).selectExpr(f"inline(array({pairs}))")


def numeric_columns(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coerce text codes of the named columns to numbers in place.

    Names count in any case.  All other columns, and the labels of the coerced ones, stay.
    """
    wanted = {c.lower() for c in columns}

    def coerced(c: str):
        if c.lower() not in wanted:
            return F.col(name(c))
        return F.expr(num(name(c))).alias(c, metadata=frame.schema[c].metadata)

    return frame.select(*[coerced(c) for c in frame.columns])


def columns_starting_with(frame: DataFrame, prefix: str) -> list[str]:
    """Columns whose name starts with a prefix, whatever the case."""
    return [c for c in frame.columns if c.lower().startswith(prefix.lower())]


def columns_between(frame: DataFrame, first: str, last: str) -> list[str]:
    """Columns from one to another, in the order of the frame."""
    names = frame.columns
    return names[names.index(first) : names.index(last) + 1]
