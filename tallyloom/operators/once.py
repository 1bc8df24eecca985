"""SQL over small records that are made once, although a query reads them several times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tallyloom.functions.codes import name


def over_records(records: DataFrame, query: str, by: Sequence[str] = ()) -> DataFrame:
    """Run ``query`` over the table ``s``, the records; it may go on with further ``WITH`` tables.

    Records lie together by the columns ``by``, so a grouping by these or more needs no further shuffle.

    A table that is read twice would be planned twice, each time with the columns of that place,
    and so scan its source twice.  The random mark keeps ``s`` one step of the plan, whose shuffle
    all readers share.
    """
    hint = f"REPARTITION({', '.join(by)})" if by else "REBALANCE"
    s = f"SELECT /*+ {hint} */ *, uuid() AS mark FROM {{records}}"
    return records.sparkSession.sql(f"WITH s AS ({s}) {query}", records=records)


def positions(source: str, columns: list[str], shown: str) -> str:
    """``WITH`` tables that number the rows of ``source`` by columns, from 1; the last is ``placed``.

    Rows are dealt by range, numbered within their part, and moved by the sizes of the parts
    before, of which there is one number for each task.  Missing values come first.
    """
    by = ", ".join(columns)
    return f""", dealt AS (SELECT *, spark_partition_id() AS part
    FROM (SELECT /*+ REPARTITION_BY_RANGE({by}) */ * FROM {source})),
sizes AS (SELECT part, count(1) AS n FROM dealt GROUP BY part),
numbered AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY {by}) AS within,
    (SELECT collect_list(struct(part, n)) FROM sizes) AS parts FROM dealt),
placed AS (SELECT *, CAST(within + aggregate(filter(parts, x -> x.part < part), 0L, (a, x) -> a + x.n) AS INT)
    AS {name(shown)} FROM numbered)"""
