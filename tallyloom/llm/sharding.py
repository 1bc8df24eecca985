"""Sharding by jump consistent hashing: the key law.

A row's shard depends on its key and the number of shards alone.  No ring table is kept, and
one more shard takes rows only into itself: about 1/(n+1) of all.

Defined results: a null key hashes as its own value and has one shard; a null text has no
bytes and the checksum 0; repeated rows share a shard and get slots of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, table

SHARDS = 24
#: Rows of one shard that are numbered in one task.
SLOT_ROWS = 10_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all keys side by side."""
    key = keys.astype(np.uint64)
    bucket = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((bucket[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """Shard of any key column; the key is first mixed, as the law needs evenly spread bits."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.pandas_udf("int")
    def assign(mixed: pd.Series) -> pd.Series:
        return pd.Series(jump(mixed.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return assign(F.xxhash64(key))


def with_slots(df: DataFrame, shard: str, order: list[str], rows: int = SLOT_ROWS) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard.

    A shard is cut into chunks of about ``rows`` rows, so no task numbers a whole shard, and a
    chunk's first slot is the sum of the chunks before it.  Chunks follow a row number that is
    written with the rows: a key of a third of all rows spreads too, and a retried task sees
    the same chunks again.
    """
    kept = Scratch(df.sparkSession).save(
        df.withColumn("_row", F.monotonically_increasing_id()), "rows"
    )
    sizes = [r["n"] for r in kept.groupBy(shard).agg(F.count("*").alias("n")).collect()]
    chunks = max([1, *(-(-n // rows) for n in sizes)])
    chunked = kept.withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks)))
    before = Window.partitionBy(shard).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(shard, "_chunk")
        .count()
        .select(shard, "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    )
    own = Window.partitionBy(shard, "_chunk").orderBy(*order, "_row")
    return (
        chunked.withColumn("_own", F.row_number().over(own) - 1)
        .join(offsets, [shard, "_chunk"])
        .withColumn("slot", (F.col("_first") + F.col("_own")).cast("long"))
        .drop("_chunk", "_own", "_first", "_row")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    body = F.col("text")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(body, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    return with_slots(narrow, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op2_jump_sharding(spark, sf_dir) -> DataFrame:
    """Every document's shard out of 24, its slot there, and its shard out of 25."""
    return shard_documents(table(spark, sf_dir, "documents"))
