"""Text labels for chart-ready frames."""

from __future__ import annotations


def percent_label(value: str, digits: int = 1) -> str:
    """Fixed number of digits and a percent sign, e.g. ``12.0%``."""
    return f"CASE WHEN {value} IS NOT NULL THEN format_string('%.{digits}f%%', round({value}, {digits})) END"


def rounded_percent_label(value: str, digits: int = 1) -> str:
    """Shortest text of the rounded value and a percent sign, e.g. ``12%``."""
    return f"concat(regexp_replace(CAST(round({value}, {digits}) AS STRING), '[.]0$', ''), '%')"


def wrap_words(text: str, width: int = 20) -> str:
    """Break text between words so that each line keeps within ``width`` characters.

    Lines are filled greedily; a single longer word stays whole.
    """
    fits = f"s.fill + length(w) + 1 <= {width}"
    return f"""aggregate(
        filter(split(trim({text}), ' +'), w -> w != ''),
        named_struct('text', '', 'fill', 0),
        (s, w) -> named_struct(
            'text', CASE WHEN s.fill = 0 THEN concat(s.text, w)
                         WHEN {fits} THEN concat(s.text, ' ', w)
                         ELSE concat(s.text, '\\n', w) END,
            'fill', CASE WHEN s.fill > 0 AND {fits} THEN s.fill + length(w) + 1
                         ELSE length(w) END),
        s -> s.text)"""


def wrap_evenly(text: str, width: int = 20) -> str:
    """Break text between words so that lines are filled as evenly as can be within ``width``.

    Of all ways to break it the one with the least sum of squared blanks at the ends of lines is
    taken, the last line not counted; of equal ones that whose last line starts first.  A word
    longer than a line stays whole in a line of its own and costs nothing.
    """
    line = "array_join(slice(words, j, i - j + 1), ' ')"
    room = f"({width} - length({line}))"
    cost = (
        f"CASE WHEN {room} >= 0 THEN CASE WHEN i = size(words) THEN 0L ELSE CAST({room} * {room} AS BIGINT) END"
        f" WHEN i = j THEN 0L END"
    )
    # best[i - 1] holds cost, start of the last line, and text of the first i words
    ways = f"""filter(transform(sequence(1, i), j -> struct(
        {cost} + CASE WHEN j = 1 THEN 0L ELSE best[j - 2].cost END AS cost, j AS start,
        concat(CASE WHEN j = 1 THEN '' ELSE concat(best[j - 2].text, '\\n') END, {line}) AS text)),
        x -> x.cost IS NOT NULL)"""
    none = "CAST(array() AS ARRAY<STRUCT<cost: BIGINT, start: INT, text: STRING>>)"
    found = f"aggregate(sequence(1, size(words)), {none}, (best, i) -> concat(best, array(array_min({ways}))))"
    words = f"filter(split(trim({text}), ' +'), w -> w != '')"
    # a lambda over one value gives the words a name
    return (
        f"transform(array({words}), words -> CASE WHEN words IS NULL THEN NULL WHEN size(words) = 0 THEN ''"
        f" ELSE element_at({found}, -1).text END)[0]"
    )
