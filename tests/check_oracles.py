"""Compare every registered query with its oracle SQL in DuckDB.

Run as a script: ``python tests/check_oracles.py [sf_dir] [name part ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

KINDS = {
    "BIGINT": "whole",
    "BOOLEAN": "boolean",
    "INTEGER": "whole",
    "HUGEINT": "whole",
    "bigint": "whole",
    "int": "whole",
    "DOUBLE": "double",
    "double": "double",
    "VARCHAR": "string",
    "string": "string",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else str(v)) for v in row)


def _canonical(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(value) + 0.0
    return value


def compare(frame: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if the results agree, else what differs."""
    names = sorted(frame.columns)
    types = dict(frame.dtypes)
    got = [tuple(_canonical(row[n]) for n in names) for row in frame.collect()]
    result = con.execute(sql)
    wanted_types = {d[0]: str(d[1]) for d in result.description}
    order = [d[0] for d in result.description]
    if sorted(order) != names:
        return f"columns {names} != {sorted(order)}"
    bad = {
        n: (types[n], wanted_types[n])
        for n in names
        if KINDS.get(types[n], types[n]) != KINDS.get(wanted_types[n], wanted_types[n])
    }
    if bad:
        return f"types {bad}"
    places = [order.index(n) for n in names]
    wanted = [tuple(_canonical(row[p]) for p in places) for row in result.fetchall()]
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}"
    for a, b in zip(sorted(got, key=_key), sorted(wanted, key=_key)):
        if a != b:
            return f"{names}\n  spark  {a}\n  oracle {b}"
    return None


def main(sf_dir: str, parts: list[str]) -> int:
    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = contract.oracle_sql()
    failed = 0
    for name, query in contract.queries().items():
        if name not in oracles or (parts and not any(p in name for p in parts)):
            continue
        start = time.time()
        try:
            problem = compare(query(spark, sf_dir), con, oracles[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        if problem:
            failed += 1
        state = "FAIL" if problem else "ok  "
        print(f"{state} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed of {len(contract.queries())}")
    return failed


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(bool(main(sf, sys.argv[2:])))
