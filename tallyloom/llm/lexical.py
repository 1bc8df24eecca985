"""Ranked lexical search by dense blocked matrix products.

Documents become sparse rows of (term, impact) over the terms that occur in items, items sparse
rows of (term, weight).  Documents are dealt into tiles and items into shelves, both of bounded
numbers of postings, and every tile meets every shelf.  There the shelf's terms are numbered
without gaps and cut into vocabulary tiles; weights (items x terms) and impacts (terms x documents)
are laid out densely in float64 and multiplied by BLAS.  A vocabulary tile is so narrow that no
partial sum reaches 2^53, so each product is exact; the tiles are added up as 64-bit integers.
Each tile keeps the k best of each item, of equal scores those with the smaller doc_id, and the
best of all tiles are merged in two steps.

Terms of items are looked up while documents are read if they number no more than
``LOOKUP_TERMS`` and ``LOOKUP_CHARS`` characters; beyond that documents' terms are joined with them.  Both ways give the same.

Defined results: a text that is null or has no term takes no part, on either side; rows without
an id are documents and items as any other, a missing doc_id comes last among equal scores;
repeated documents are rows of their own, and every row of a repeated item has its own ranks; an
empty table on either side gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, table

K = 50
LOOKUP_TERMS = 500_000
LOOKUP_CHARS = 16_000_000
TILE_POSTINGS = 500_000
SHELF_POSTINGS = 500_000
# cells of one dense layout: documents x terms, items x terms
TILE_DOCS = 1024
TILE_ITEMS = 1024
TILE_TERMS = 2048
EXACT = 1 << 53

_KEPT = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
FOLD = bytes(_KEPT[b] + 32 if 65 <= b <= 90 else _KEPT[b] for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters above ASCII; only A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def counted(texts: DataFrame, id_col: str, text: str, lookup: dict[bytes, int] | None = None) -> DataFrame:
    """(id, n, terms, tfs): all terms with repeats, then each distinct one and its occurrences.

    With ``lookup`` only its terms are kept, by number.
    """
    kind = "binary" if lookup is None else "long"
    rows = texts.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    shared = None if lookup is None else texts.sparkSession.sparkContext.broadcast(lookup)

    def run(batches):
        import pyarrow as pa

        numbers = None if shared is None else shared.value
        term = pa.binary() if numbers is None else pa.int64()
        for batch in batches:
            sizes, found = [], []
            for value in batch.column(1).to_pylist():
                every = terms(value)
                sizes.append(len(every))
                if numbers is not None:
                    every = [i for i in map(numbers.get, every) if i is not None]
                found.append(Counter(every))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([list(c) for c in found], pa.list_(term)),
                    pa.array([list(c.values()) for c in found], pa.list_(pa.int64())),
                ],
                ["id", "n", "terms", "tfs"],
            )

    return rows.mapInArrow(run, f"id long, n long, terms array<{kind}>, tfs array<long>")


def _matched(docs: DataFrame, vocabulary: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """(id, n, terms, tfs) of each document over the numbered terms of items."""
    size = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if size[0] <= LOOKUP_TERMS and size[1] <= LOOKUP_CHARS:
        lookup = {bytes(r.term): r.number for r in vocabulary.collect()}
        return scratch.save(counted(docs, doc_id, text, lookup), "matched")
    every = scratch.save(counted(docs, doc_id, text), "counted")
    every = every.withColumn("row", F.monotonically_increasing_id())
    pairs = every.select("row", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("p"))
    known = pairs.select("row", "p.term", "p.tf").join(vocabulary, "term")
    lists = known.groupBy("row").agg(F.collect_list(F.struct("number", "tf")).alias("p"))
    return scratch.save(
        every.select("row", "id", "n")
        .join(lists, "row", "left")
        .select("id", "n", F.coalesce("p.number", F.array()).alias("terms"), F.coalesce("p.tf", F.array()).alias("tfs")),
        "matched",
    )


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """How much each occurrence count weighs in a document of n terms, in whole numbers."""
    sizes, place = np.unique(n, return_inverse=True)
    # Python's integers, as the product may leave 64 bits
    m = np.array([50 + (50 * int(s) * documents) // occurrences for s in sizes], np.int64)[place]
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def term_tile(weight: int, impact: int) -> int:
    """Most terms whose products can be added up below 2^53."""
    return max(1, min(TILE_TERMS, (EXACT - 1) // max(1, weight * impact)))


def _dense(rows: int, columns: int, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros((rows, columns))
    out[row, column] = value
    return out


def products(items: tuple, docs: tuple, n_items: int, n_docs: int, width: int, step: int) -> np.ndarray:
    """Exact scores (items x documents) of sparse (row, term, value) triples sorted by term."""
    scores = np.zeros((n_items, n_docs), np.int64)
    for low in range(0, width, step):
        size = min(step, width - low)
        sides = []
        for (row, term, value), count in ((items, n_items), (docs, n_docs)):
            a, b = np.searchsorted(term, (low, low + size))
            sides.append(_dense(count, size, row[a:b], term[a:b] - low, value[a:b]))
        scores += (sides[0] @ sides[1].T).astype(np.int64)
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by smaller id."""
    places = np.flatnonzero(scores > 0)
    if len(places) > k:
        some = scores[places]
        least = np.partition(some, len(some) - k)[len(some) - k]
        above, tied = places[some > least], places[some == least]
        need = k - len(above)
        if len(tied) > need:
            tied = tied[np.argpartition(ids[tied], need - 1)[:need]]
        places = np.concatenate([above, tied])
    return places[np.lexsort((ids[places], -scores[places]))]


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Values of an Arrow column of lists and the row of each."""
    whole = lists.combine_chunks()
    sizes = np.diff(whole.offsets.to_numpy())
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _search(k: int, documents: int, occurrences: int):
    def run(docs, items):
        import pyarrow as pa

        columns: dict[str, list] = {"item": [], "id": [], "score": []}
        if docs.num_rows and items.num_rows:
            item_term, item_row = _flat(items["terms"])
            weight = _flat(items["weights"])[0]
            vocabulary, item_term = np.unique(item_term, return_inverse=True)
            term, row = _flat(docs["terms"])
            tf = _flat(docs["tfs"])[0]
            place = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
            known = vocabulary[place] == term
            term, row, tf = place[known], row[known], tf[known]
            n = docs["n"].to_numpy()
            impact = impacts(tf, n[row], documents, occurrences)
            step = term_tile(int(weight.max(initial=0)), int(impact.max(initial=0)))
            missing = np.asarray(docs["id"].is_null())
            ids = docs["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            numbers = items["item"].to_numpy()
            shelves = _tiles(item_row, item_term, weight, items.num_rows, TILE_ITEMS)
            for low, n_docs, some in _tiles(row, term, impact, docs.num_rows, TILE_DOCS):
                for first, n_items, wanted in shelves:
                    scores = products(wanted, some, n_items, n_docs, len(vocabulary), step)
                    for i in range(n_items):
                        found = best(scores[i], ids[low : low + n_docs], k)
                        columns["item"].append(np.full(len(found), numbers[first + i]))
                        columns["id"].append(low + found)
                        columns["score"].append(scores[i, found])
            columns = {c: np.concatenate(parts) for c, parts in columns.items()}
            at = columns["id"]
            columns["id"] = pa.array(ids[at], pa.int64(), mask=missing[at])
        return pa.table({c: pa.array(v, pa.int64()) for c, v in columns.items()})

    return run


def _tiles(row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, size: int) -> list:
    """(First row, rows, triples sorted by term) of each run of ``size`` rows; rows ascend."""
    out = []
    for low in range(0, rows, size):
        a, b = np.searchsorted(row, (low, low + size))
        order = np.argsort(term[a:b], kind="stable")
        triples = (row[a:b][order] - low, term[a:b][order], value[a:b][order].astype(np.float64))
        out.append((low, min(size, rows - low), triples))
    return out


def _dealt(rows: DataFrame, mine: str, parts: int, other: str, others: int) -> DataFrame:
    """Each row in one of ``parts`` by its number, once for each part of the other side."""
    number = F.xxhash64(F.monotonically_increasing_id())
    dealt = rows.withColumn(mine, F.pmod(number, F.lit(parts)).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    asked = scratch.save(counted(items, item_id, item_text), "items").withColumn("item", F.monotonically_increasing_id())
    vocabulary = asked.select(F.explode("terms").alias("term")).distinct()
    vocabulary = scratch.save(vocabulary.withColumn("number", F.monotonically_increasing_id()), "vocabulary")
    matched = _matched(docs, vocabulary, doc_id, doc_text, scratch)
    totals = matched.agg(
        F.count_if(F.col("n") > 0),
        F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum(F.size("terms")), F.lit(0)),
    ).first()
    documents, occurrences, postings = totals
    held = matched.select(F.explode("terms").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    weights = vocabulary.join(held, "number").select("term", "number", weight.cast("long").alias("weight"))
    lists = (
        asked.select("item", "id", F.explode("terms").alias("term"))
        .join(weights, "term")
        .groupBy("item", "id")
        .agg(F.collect_list(F.struct("number", "weight")).alias("p"))
        .select("item", F.col("id").alias("item_id"), F.col("p.number").alias("terms"), F.col("p.weight").alias("weights"))
    )
    lists = scratch.save(lists, "weights")
    wanted = lists.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    tiles, shelves = max(1, -(-postings // TILE_POSTINGS)), max(1, -(-wanted // SHELF_POSTINGS))
    left = _dealt(matched.where(F.size("terms") > 0), "tile", tiles, "shelf", shelves)
    right = _dealt(lists.select("item", "terms", "weights"), "shelf", shelves, "tile", tiles)
    side = math.isqrt(tiles) + 1

    found = (
        left.groupBy("tile", "shelf")
        .cogroup(right.groupBy("tile", "shelf"))
        .applyInArrow(_search(k, documents, occurrences), "item long, id long, score long")
    )
    order = [F.desc("score"), F.asc_nulls_last("id")]
    # few rows for each tile, but many tiles: salted first, so that no task takes all rows of an item
    for keys in (["item", "salt"], ["item"]):
        if keys[-1] == "salt":
            found = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(side)))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", place).where(F.col("rank") <= k)
    return found.join(lists.select("item", "item_id"), "item").select(
        "item_id", "rank", F.col("id").alias("doc_id"), "score"
    )


def op12_ranked_search(spark, sf_dir) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, ts, len(ts) AS n
    FROM (SELECT doc_id, {_TERMS} AS ts FROM documents) WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
b AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM benchmark),
q AS (SELECT DISTINCT i, item_id, t FROM (SELECT i, item_id, unnest(ts) AS t FROM b)),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT t, count(*) AS df FROM f GROUP BY t), s),
x AS (SELECT i, item_id, d.r, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
    FROM q JOIN w USING (t) JOIN f USING (t) JOIN d USING (r), s GROUP BY i, item_id, d.r, doc_id),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 50"""
