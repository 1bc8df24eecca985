"""Code lists: label lookup, display order, and labels kept in column metadata."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.codes import name, quoted


def _lookup(pairs: Iterable[tuple[str, str]], key: str) -> str:
    cells = ", ".join(f"{k}, {v}" for k, v in pairs)
    return f"try_element_at(map({cells}), {key})"


def code_label(code: str, labels: Mapping[str, str]) -> str:
    """Label of a text code; unlisted and missing codes give NULL."""
    return _lookup(((quoted(k), quoted(v)) for k, v in labels.items()), code)


def number_label(code: str, labels: Mapping[str, str]) -> str:
    """Label of a code read as a number; unlisted and missing codes give NULL."""
    return _lookup(((f"{float(k)}D", quoted(v)) for k, v in labels.items()), code)


def number_order(code: str, labels: Mapping[str, str]) -> str:
    """Position of a numeric code in its list, counted from 1; NULL if unlisted."""
    return _lookup(((f"{float(k)}D", str(i)) for i, k in enumerate(labels, start=1)), code)


def relabel(value: str, labels: Mapping[str, str]) -> str:
    """Label where one is listed, the value itself otherwise."""
    return f"coalesce({code_label(value, labels)}, {value})"


def attach_labels(
    frame: DataFrame, names: Mapping[str, str], values: Mapping[str, float]
) -> DataFrame:
    """Attach a variable label and common value labels to columns, as metadata."""
    return label_columns(frame, {c: (names[c], dict(values)) for c in frame.columns if c in names})


def label_columns(
    frame: DataFrame, labels: Mapping[str, tuple[str | None, Mapping[str, float]]]
) -> DataFrame:
    """Attach to each named column its variable label and its own value labels, as metadata."""

    def labelled(column: str):
        if column not in labels:
            return F.col(name(column))
        label, values = labels[column]
        meta = {"label": label} if label is not None else {}
        meta |= {"labels": {text: float(code) for text, code in values.items()}}
        return F.col(name(column)).alias(column, metadata=meta)

    return frame.select(*map(labelled, frame.columns))


def read_labels(frame: DataFrame, column: str) -> tuple[str | None, dict[str, float]]:
    """Variable label and value labels of a column, from its metadata."""
    meta = frame.schema[column].metadata or {}
    return meta.get("label"), dict(meta.get("labels", {}))


def value_label(frame: DataFrame, column: str) -> str:
    """Label of a labelled column's value, from its metadata; NULL where it has none."""
    _, values = read_labels(frame, column)
    return _lookup(((f"{float(v)}D", quoted(text)) for text, v in values.items()), name(column))
