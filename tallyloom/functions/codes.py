"""Missing-aware building blocks for recoding survey answers.

Answers arrive as text codes, so they are read as numbers with ``num`` first.
Two families of conditionals exist and must not be mixed:

* ``two_way``: a missing condition gives a missing result;
* ``scored``: the first true condition wins and a missing condition counts as
  "not matched", so the default applies.
"""

from __future__ import annotations

from collections.abc import Iterable


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def num(column: str) -> str:
    """Numeric reading of a text code; text that is no number becomes NULL."""
    return f"try_cast({column} AS DOUBLE)"


def name(column: str) -> str:
    """A column name as SQL, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def any_of(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def all_of(conditions: Iterable[str]) -> str:
    return "(" + " AND ".join(conditions) + ")"


def any_one(columns: Iterable[str]) -> str:
    """True if any column is 1, NULL if none is but some are missing."""
    return any_of(f"{c} = 1" for c in columns)


def all_match(columns: Iterable[str], value: float) -> str:
    """Three-valued "every column equals value"."""
    return all_of(f"{c} = {value}" for c in columns)


def is_in(column: str, codes: Iterable[float]) -> str:
    """Three-valued membership: unknown for a missing answer."""
    return f"{column} IN ({', '.join(str(c) for c in codes)})"


def listed(column: str, codes: Iterable[float]) -> str:
    """Membership that is never NULL: a missing answer is in no list."""
    return f"coalesce({is_in(column, codes)}, false)"


def any_flag(columns: Iterable[str]) -> str:
    """Row-wise "some column is 1", missing cells counting as no."""
    return f"coalesce(exists(array({', '.join(columns)}), x -> x = 1), false)"


def two_way(condition: str, yes: str = "1D", no: str = "0D") -> str:
    """``yes`` where the condition holds, ``no`` where it fails, NULL where it is unknown."""
    return f"CASE WHEN {condition} THEN {yes} WHEN NOT ({condition}) THEN {no} END"


def scored(
    yes: str | None = None,
    no: str | None = None,
    default: int | None = None,
) -> str:
    """1 where ``yes``, else 0 where ``no``, else ``default`` (missing if not given)."""
    branches = []
    if yes is not None:
        branches.append(f"WHEN {yes} THEN 1D")
    if no is not None:
        branches.append(f"WHEN {no} THEN 0D")
    last = "" if default is None else f" ELSE {default}D"
    return f"CASE {' '.join(branches)}{last} END"
