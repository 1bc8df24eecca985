"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are dealt into blocks of bounded size, each turned into postings: for every
dimension the rows that are not zero there, with their integer weights.  Queries are dealt
into blocks too and meet every candidate block.  For one query row the terms are taken one at
a time; each scatters weight x posting weights into a dense array of scores, one slot for each
candidate.  A partition selection keeps the block's k best, and the k best of all blocks are
merged by score, ties to the smaller id.

Work is queries x candidates, as the task is stated, but no task holds more than two blocks.

Defined results: vectors that are null or hold a null, NaN or infinite component, or one
whose scaled value leaves the 64-bit range, take no part, nor do rows without an id; an empty
vector scores 0 with all; where scores could leave the 64-bit range they are summed as Python
integers, and one among a block's best that does leave it is an error, as it is in SQL;
vectors of different length meet in their common dimensions; repeated rows are rows of their
own, and a query skips the rows with its own id; with fewer than k candidates all are given;
an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import table

K = 5
SCALE = 256
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 1024
#: Sums below it, as estimated in floating point, can't leave the 64-bit range.
SAFE = float(1 << 62)


def quantized(df: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, terms): floor(scale x) of each component, without vectors that take no part."""
    scaled = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    double = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    edge = float(1 << 63)
    usable = F.forall(
        double, lambda x: x.isNotNull() & ~F.isnan(x) & (x * scale >= F.lit(-edge)) & (x * scale < F.lit(edge))
    )
    return (
        df.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(usable, F.lit(False)))
        .select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled.cast("array<long>").alias("terms"))
    )


def postings(vectors: list) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each dimension the slots of the rows that are not zero there and their weights.

    A dimension that no row lacks needs no slot list.
    """
    width = max(map(len, vectors), default=0)
    dense = np.zeros((len(vectors), width), np.int64)
    for slot, v in enumerate(vectors):
        dense[slot, : len(v)] = v
    lists = []
    for d in range(width):
        slots = np.flatnonzero(dense[:, d])
        full = len(slots) == len(vectors)
        lists.append((slice(None) if full else slots, np.ascontiguousarray(dense[slots, d])))
    return lists


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Slots of the k best by (score down, id up): selection first, then a sort of the few."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        slots = np.flatnonzero(scores > least)
        tied = np.flatnonzero(scores == least)
        need = k - len(slots)
        if len(tied) > need:
            tied = tied[np.argpartition(ids[tied], need - 1)[:need]]
        slots = np.concatenate([slots, tied])
    else:
        slots = np.arange(len(scores))
    return slots[np.lexsort((ids[slots], -scores[slots]))]


def _search(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(candidates) and len(queries):
            ids = candidates["id"].to_numpy(np.int64)
            lists = postings(list(candidates["terms"]))
            largest = np.array([np.abs(w.astype(np.float64)).max(initial=0) for _, w in lists])
            for query, terms in zip(queries["id"], queries["terms"], strict=True):
                shared = terms[: len(lists)]
                wide = np.abs(shared.astype(np.float64)) @ largest[: len(shared)] >= SAFE
                scores = np.zeros(len(ids), object if wide else np.int64)
                for d in np.flatnonzero(shared):
                    slots, weights = lists[d]
                    scores[slots] += int(terms[d]) * (weights.astype(object) if wide else weights)
                others = ids != query
                kept, score = (ids, scores) if others.all() else (ids[others], scores[others])
                order = np.unique(score, return_inverse=True)[1] if wide else score
                for slot in best(order, kept, k):
                    if wide and not -(1 << 63) <= score[slot] < 1 << 63:
                        raise OverflowError(f"score of {query} and {kept[slot]} leaves the 64-bit range")
                    rows.append((query, kept[slot], score[slot]))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = K,
    candidate_block: int = CANDIDATE_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best; both sides are (id, terms).

    Blocks follow row numbers, not ids, so equal ids cannot crowd one block.
    """
    n, m = candidates.count(), queries.count()
    blocks, asked = max(1, -(-n // candidate_block)), max(1, -(-m // query_block))
    number = F.monotonically_increasing_id()

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = candidates.withColumn("c", F.pmod(F.xxhash64(number), F.lit(blocks)).cast("int")).withColumn(
        "q", every(asked)
    )
    right = queries.withColumn("q", F.pmod(F.xxhash64(number), F.lit(asked)).cast("int")).withColumn(
        "c", every(blocks)
    )
    partial = (
        left.groupBy("c", "q")
        .cogroup(right.groupBy("c", "q"))
        .applyInPandas(_search(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op4_exact_topk(spark, sf_dir) -> DataFrame:
    """The 5 best others of every vector whose id is divisible by 50."""
    vectors = quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
    FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
