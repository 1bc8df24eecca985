"""Chart-ready frames: error bars, sorted shares, facets, labels and contrast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tallyloom.functions.codes import name as column_name
from tallyloom.functions.labels import relabel
from tallyloom.functions.text import percent_label, rounded_percent_label, wrap_evenly
from tallyloom.operators.once import over_records, positions


def error_bars(means: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bars of means with one standard error to each side and a rounded label."""
    return means.selectExpr(
        *map(column_name, by),
        "var_name",
        "mean_value",
        "mean_value - mean_value_se AS bar_low",
        "mean_value + mean_value_se AS bar_upp",
        "round(mean_value, 2) AS label",
    )


def facets(means: DataFrame, x: str, fill: str, facet: Sequence[str]) -> DataFrame:
    """Bars of means laid out by facet, x position and fill."""
    return means.selectExpr(
        *[f"{column_name(c)} AS facet_{i}" for i, c in enumerate(facet, start=1)],
        f"{column_name(x)} AS x",
        f"{column_name(fill)} AS fill",
        "mean_value AS y",
        "CASE WHEN mean_value IS NOT NULL THEN format_string('%.2f', round(mean_value, 2)) END AS label",
    )


def sorted_shares(
    shares: DataFrame, name: str, value: str, by: Sequence[str] = (), digits: int = 1
) -> DataFrame:
    """Shares with their display position and a percent label.

    Categories are placed by their mean share over all groups, smallest first; equal means by
    name, missing ones first.
    """
    keys = [f"k{i}" for i in range(len(by))]
    inner = [f"{column_name(c)} AS {k}" for c, k in zip(by, keys)]
    rows = shares.selectExpr(*inner, f"{column_name(name)} AS category", f"{column_name(value)} AS share")
    placed = positions("categories", ["mean_share", "category"], "position")
    kept = "".join(f"s.{k}, " for k in keys)
    out = over_records(
        rows,
        f""", categories AS (SELECT avg(share) AS mean_share, category FROM s GROUP BY category){placed}
SELECT {kept}s.category, s.share, p.position FROM s JOIN placed p ON s.category <=> p.category""",
    )
    return out.selectExpr(
        *[f"{k} AS {column_name(c)}" for c, k in zip(by, keys)],
        f"category AS {column_name(name)}",
        f"share AS {column_name(value)}",
        "position",
        f"{percent_label('share', digits)} AS label",
    )


def axis_limits(frame: DataFrame, column: str) -> DataFrame:
    """Distinct values of a category axis with their position."""
    values = frame.selectExpr(f"{column_name(column)} AS category").where("category IS NOT NULL").distinct()
    placed = positions("s", ["category"], "position")
    out = over_records(values, f"{placed} SELECT category, position FROM placed")
    return out.withColumnRenamed("category", column)


def component_bars(
    shares: DataFrame,
    name: str,
    value: str,
    by: Sequence[str],
    labels: Mapping[str, str],
    width: int = 20,
    digits: int = 1,
    shortest: bool = False,
) -> DataFrame:
    """Composite shares with readable component names, wrapped to a width.

    Labels have a fixed number of digits (``33.0%``), or the fewest (``33%``) with ``shortest``.
    """
    shown = relabel(column_name(name), labels)
    percent = rounded_percent_label if shortest else percent_label
    return shares.selectExpr(
        *map(column_name, by),
        f"{shown} AS {column_name(name)}",
        f"{wrap_evenly(shown, width)} AS axis_label",
        column_name(value),
        f"{percent(column_name(value), digits)} AS label",
    )


def contrast_labels(shares: DataFrame, value: str, above: float = 15) -> DataFrame:
    """Percent labels with a text colour that stays readable on the bar."""
    return shares.selectExpr(
        "*",
        f"{rounded_percent_label(column_name(value))} AS label",
        f"CASE WHEN {column_name(value)} > {above} THEN 'white' ELSE 'black' END AS label_color",
    )
