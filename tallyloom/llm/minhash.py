"""Near-duplicate documents by HyperMinHash, with every link confirmed on full sets.

A document's set holds its distinct five-word shingles.

1. Sketch.  Shingle hashes fall into ``BUCKETS`` buckets; of the smallest value in a bucket the
   register keeps the number of leading zeros (6 bits) and the ten bits after the leading one.
   A bucket that no shingle hits is filled in further rounds of hashing, so small sets have
   full sketches and every register agrees with the probability of the sets' similarity.
2. Classes.  Documents with equal sets form one class; its smallest doc_id stands for it, so
   copies need no pairs.
3. Bands.  Some compressed registers make a band, as many as let two sets at the threshold
   share no band with a probability of at most ``MISSED`` = 1e-5.  At 0.85 these are 48 bands
   of 8 registers, which miss a pair with 2.3e-7; at 0.80, 54 bands of 7, with 3.0e-6.  Nothing
   later looks for a pair that no band shows.
4. First pass.  In every band bucket each class is paired with one leader only, so a bucket of
   any size gives one pair a member.  The leader is the class that shares most buckets with
   others, which in a group of edited copies is the text they come from.  The pairs'
   collision-corrected Jaccard estimates drop what is far below the threshold (six standard
   deviations), and the rest is confirmed on full sets.  The links form components.
5. Second pass.  What is left are members of buckets that hold several components.  They are
   indexed by their rarest shingles: two sets of n and m shingles at the threshold share one of
   the rarest n - ceil(0.85 n) + 1 of the one and m - ceil(0.85 m) + 1 of the other, and after
   the first that they share enough must be left in both to reach the threshold.  Only members
   of different components that share such a shingle and a band form a pair; documents that
   have a passage in common but little else form none, nor do edited copies of one text whose
   own shingles alone keep them below the threshold.  The pairs are checked in the same way, so
   no link between different components is lost.  Pairs within a component can't change it.
   Sizes too unequal to reach the threshold never form a pair.

Components come from the distributed exchange of smallest labels with shortcuts.

Defined results: null or empty texts have an empty set, are linked with nothing and kept;
texts of fewer words than a shingle count as one shingle; repeated rows of a doc_id share its
smallest component; a null doc_id is a component of its own (null) and kept; an empty table
gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import Scratch, table, words

WIDTH = 5
BUCKETS = 384
MISSED = 1e-5
MANTISSA = 10
#: Bits of a value within its bucket, and turns of hashing at most.
REST = 46
LAST_TURN = 510
#: Links are 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Standard deviations of the estimate below the threshold that are still confirmed.
SLACK = 6.0

_WORD_SEED = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's five-word shingles; ``known`` caches words."""
    tokens = words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    for w in set(tokens).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    width = min(WIDTH, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = out * _WORD_SEED + h[i : len(h) - width + 1 + i]
    return np.unique(mixed(out))


def sketch(items: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a non-empty set of hashes.

    A bucket's register comes from the first turn of hashing that hits it, and there from the
    smallest value.  Turns are taken several at a time, about as many as fill all buckets; that
    number doesn't change the result.
    """
    first = np.zeros(BUCKETS, np.uint64)
    empty = np.ones(BUCKETS, bool)
    turn, ahead = 0, max(1, min(BUCKETS, 3000 // len(items)))
    while empty.any():
        turns = np.arange(turn, turn + ahead, dtype=np.uint64)
        values = mixed(items[None, :] + (turns[:, None] + np.uint64(1)) * _WORD_SEED)
        # the high half chooses the bucket; the low half, mixed again, decides within it
        bucket = ((values >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
        rest = (values * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - REST)
        key = (bucket << np.uint64(55)) | (turns[:, None] % np.uint64(512) << np.uint64(REST)) | rest
        key = np.sort(key, axis=None)
        at = (key >> np.uint64(55)).astype(np.int64)
        lead = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        take = lead[empty[at[lead]]]
        first[at[take]] = key[take]
        empty[at[take]] = False
        turn += ahead
        if turn + ahead > LAST_TURN:
            break
    # very small sets: what no turn has hit takes a turn of its own
    for bucket in np.flatnonzero(empty).tolist():
        rest = mixed(items ^ mixed(np.array([bucket + 7], np.uint64))) >> np.uint64(64 - REST)
        first[bucket] = np.uint64(511 << REST) | rest.min()
    return _register(first)


def _register(key: np.ndarray) -> np.ndarray:
    """Leading zeros of the value and the bits after its leading one, in 16 bits.

    The turn is mixed into the bits, so that values of different turns don't agree.
    """
    value = key & np.uint64((1 << REST) - 1)
    turn = key >> np.uint64(REST) & np.uint64(511)
    bits = np.frexp(value.astype(np.float64))[1]
    after = (value << (np.int64(64 + 1) - bits).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    after = np.where(bits > 0, after, 0).astype(np.uint64) ^ (turn * np.uint64(0x2D5) & np.uint64((1 << MANTISSA) - 1))
    return ((REST - bits).astype(np.uint16) << np.uint16(MANTISSA)) | after.astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarities from registers (pairs x BUCKETS), corrected for chance agreement.

    Two unequal minima agree in leading zeros and mantissa with a probability of about
    0.1699 x 2^-MANTISSA x 4 na nb / (na + nb)^2.
    """
    same = (a == b).mean(axis=1)
    chance = 0.169919487159739 / (1 << MANTISSA) * 4 * na * nb / (na + nb) ** 2
    return (same - chance) / (1 - chance)


def band_rows(percent: int) -> int:
    """Registers of a band: the most that keep the chance of a missed pair at the threshold."""
    s = percent / 100
    return max([1, *(r for r in range(1, BUCKETS + 1) if (1 - s**r) ** (BUCKETS // r) <= MISSED)])


def _sketches(batches, band: int):
    known: dict[bytes, int] = {}
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for text in batch.column(1).to_pylist():
            if len(known) > 400_000:
                known.clear()
            items = shingles(text, known)
            rows[0].append(len(items))
            rows[1].append(hashlib.md5(items.tobytes()).digest() if len(items) else None)
            registers = sketch(items) if len(items) else None
            rows[2].append(None if registers is None else registers.tobytes())
            rows[3].append(None if registers is None else _bands(registers, band).tolist())
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))],
            ["doc_id", "n", "print", "registers", "bands"],
        )


def _bands(registers: np.ndarray, band: int) -> np.ndarray:
    """A key for each band, different between bands."""
    count = len(registers) // band
    parts = registers[: count * band].reshape(count, band).astype(np.uint64)
    keys = np.arange(count, dtype=np.uint64)
    for i in range(band):
        keys = mixed(keys * _WORD_SEED + parts[:, i] + np.uint64(1))
    return keys.view(np.int64)


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, print, registers, bands) of every row; nulls for empty sets."""
    band = band_rows(percent)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _sketches(batches, band), "doc_id long, n long, print binary, registers binary, bands array<long>"
    )


@F.pandas_udf(T.DoubleType())
def estimated(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    left = np.frombuffer(b"".join(a), np.uint16).reshape(len(a), -1)
    right = np.frombuffer(b"".join(b), np.uint16).reshape(len(b), -1)
    return pd.Series(estimate(left, right, na.to_numpy(np.float64), nb.to_numpy(np.float64)))


@F.pandas_udf(T.LongType())
def intersection(a: pd.Series, b: pd.Series) -> pd.Series:
    """Common items of sets given as bytes of sorted distinct hashes."""
    return pd.Series(
        [
            np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True).size
            for x, y in zip(a, b, strict=True)
        ],
        dtype="int64",
    )


def _sets(batches):
    known: dict[bytes, int] = {}
    for batch in batches:
        out = []
        ids = []
        columns = (batch.column(i).to_pylist() for i in range(3))
        for key, wanted, text in zip(*columns, strict=True):
            if len(known) > 400_000:
                known.clear()
            items = shingles(text, known).tobytes()
            # a doc_id may have other texts too
            if hashlib.md5(items).digest() == wanted:
                ids.append(key)
                out.append(items)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "items"])


class Links:
    """Confirms pairs of classes; counts what it looked at in ``log``."""

    def __init__(self, docs: DataFrame, heads: DataFrame, classes: DataFrame, scratch: Scratch, percent: int):
        self.docs, self.heads, self.classes = docs, heads, classes
        self.scratch, self.percent = scratch, percent
        self.log: list[tuple[str, int]] = []

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose estimates don't rule the threshold out."""
        level = self.percent / 100
        least = level - SLACK * (level * (1 - level) / BUCKETS) ** 0.5
        side = self.classes.select("class", "registers", "n")
        a = side.toDF("a", "ra", "na")
        b = side.toDF("b", "rb", "nb")
        return (
            pairs.select("a", "b")
            .join(a, "a")
            .join(b, "b")
            .where(estimated("ra", "rb", "na", "nb") >= least)
            .select("a", "b", "na", "nb")
        )

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(id, items): full sets of classes, made from the texts again."""
        wanted = wanted.join(self.heads.select("class", "print", F.col("head").alias("doc_id")), "class")
        return (
            self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(wanted.hint("shuffle_hash"), "doc_id")
            .select("class", "print", "text")
            .mapInArrow(_sets, "id long, items binary")
            .dropDuplicates(["id"])
        )

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that are links, by full sets made from the texts again."""
        pairs = self.scratch.save(self.likely(pairs), f"{name}-likely")
        n = pairs.count()
        self.log.append((name, n))
        if not n:
            return self.scratch.save(pairs.select("a", "b"), name)
        wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        items = self.scratch.save(self.sets(wanted), f"{name}-sets")
        links = (
            pairs.join(items.toDF("b", "ib"), "b")
            .join(items.toDF("a", "ia"), "a")
            .withColumn("common", intersection("ia", "ib"))
            .where(100 * F.col("common") >= self.percent * (F.col("na") + F.col("nb") - F.col("common")))
            .select("a", "b")
        )
        links = self.scratch.save(links, name)
        self.scratch.drop(items)
        return links


def _items(batches):
    """(id, root, n, item) rows of sets given as bytes."""
    for batch in batches:
        ids, roots, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        sizes = np.array([len(x) // 8 for x in sets], np.int64)
        item = np.frombuffer(b"".join(sets), np.int64)
        # in pieces, as a set may be large
        id_, root, n = np.repeat(ids, sizes), np.repeat(roots, sizes), np.repeat(sizes, sizes)
        for low in range(0, len(item), 100_000):
            part = [pa.array(x[low : low + 100_000], pa.int64()) for x in (id_, root, n, item)]
            yield pa.RecordBatch.from_arrays(part, ["id", "root", "n", "item"])


def rare_pairs(sets: DataFrame, left: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b), a < b, of different roots that share a band and whose sets (id, items) can reach the threshold.

    ``left`` holds (id, root, bands); bands are compared by 15 bits each, which lets some more pairs
    through and keeps rows short.

    Items held under one root only can't be shared with another root; they come first, and all
    others after them by the number of sets that hold them.  Of a set of n items only the first
    n - ceil(percent n / 100) + 1 are looked at; two sets without one of these in common have too
    few items in common.  The first that two sets share stands at places i and j, so they share
    1 + min(na - i, nb - j) items at most, which has to reach the threshold as well.  Items of
    one root take places in that order and need no rows.
    """
    rooted = sets.join(left.select("id", "root"), "id").select("id", "root", "items")
    items = scratch.save(rooted.mapInArrow(_items, "id long, root long, n long, item long"), "left-items")
    shared = items.groupBy("item").agg(F.count("*").alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    order = Window.partitionBy("id").orderBy("held", "item")
    places = items.join(shared.where("lo <> hi").select("item", "held"), "item").select(
        "id", "n", "item", F.row_number().over(order).alias("place"), F.count("*").over(Window.partitionBy("id")).alias("known")
    )
    place = (F.col("place") + F.col("n") - F.col("known")).alias("place")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = places.select("id", "n", "item", place).where(F.col("place") <= first)
    short = F.transform("bands", lambda x: F.pmod(x, F.lit(1 << 15)).cast("short")).alias("bands")
    prefix = scratch.save(
        prefix.join(left.select("id", "root", short), "id").select("id", "n", "item", "place", "root", "bands"), "rare"
    )
    a, b = prefix.toDF("a", "na", "item", "ia", "ra", "sa"), prefix.toDF("b", "nb", "item", "ib", "rb", "sb")
    band = F.exists(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same)
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1
    enough = (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))
    near = a.join(b, "item").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _fits(percent) & enough & band)
    return near.select("a", "b").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of every id in edges (a, b): the smallest id reachable.

    Each round every id takes the smallest root among its neighbours', then its root's root.
    The graph stays distributed; a round is a join and a sum, and a long chain takes about the
    logarithm of its length.
    """
    both = scratch.save(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges"
    )
    label = scratch.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).toDF("id", "root"), "root")
    while True:
        near = (
            both.join(label.toDF("b", "root"), "b").groupBy("a").agg(F.min("root").alias("near")).toDF("id", "near")
        )
        # an id's root may learn of a smaller one through the id as well
        told = (
            label.join(near, "id")
            .select(F.explode(F.array("id", "root")).alias("id"), F.least("root", "near").alias("root"))
            .groupBy("id")
            .agg(F.min("root").alias("root"))
        )
        up = told.toDF("root", "up")
        new = scratch.save(
            told.join(up, "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root")), "root"
        )
        changed = new.join(label.toDF("id", "old"), "id").where("root <> old").limit(1).count()
        scratch.drop(label)
        label = new
        if not changed:
            return label


def _fits(percent: int):
    """Sizes that can reach the threshold, as a condition on na and nb."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def cluster(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.save(sketches(docs, percent).withColumn("row", F.monotonically_increasing_id()), "sketches")
    full = rows.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    heads = full.groupBy("print").agg(F.min(F.struct("doc_id", "row")).alias("h"))
    heads = heads.select("print", F.col("h.doc_id").alias("head"), F.col("h.row").alias("row"))
    # a doc_id at the head of several texts can't stand for each: those get a key of their own,
    # above all ids, so that it is never the smallest
    texts = heads.groupBy("head").agg(F.count("*").alias("texts"))
    own = F.lit(1 << 62) + F.pmod(F.xxhash64("print"), F.lit(1 << 61))
    heads = scratch.save(
        heads.join(texts, "head").withColumn("class", F.when(F.col("texts") == 1, F.col("head")).otherwise(own)),
        "heads",
    )
    named = full.select("doc_id", "print").join(heads.select("print", "class"), "print")
    named = scratch.save(named.select("doc_id", "class").where("doc_id <> class").distinct(), "named")
    classes = scratch.save(
        full.select("row", "n", "registers", "bands", "doc_id")
        .join(heads.select("row", "class").hint("shuffle_hash"), "row")
        .drop("row"),
        "classes",
    )
    links = Links(docs, heads, classes, scratch, percent)

    keyed = classes.select("class", "n", F.explode("bands").alias("band"))
    sizes = keyed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    crowded = scratch.save(keyed.join(sizes, "band"), "crowded")
    # the text that others were edited from shares the most, whatever its doc_id
    weight = crowded.groupBy("class").agg(F.sum("size").alias("weight"))
    leads = F.max(F.struct("weight", -F.col("class"), "class", "n")).alias("lead")
    leaders = crowded.join(weight, "class").groupBy("band").agg(leads)
    leaders = leaders.select("band", F.col("lead.class").alias("lead"), F.col("lead.n").alias("na"))
    pairs = (
        crowded.select("band", F.col("class").alias("b"), F.col("n").alias("nb"))
        .join(leaders, "band")
        .where("lead <> b")
        .groupBy(F.col("lead").alias("a"), "b")
        .agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
        .where(_fits(percent))
    )
    found = links.confirmed(pairs, "first")
    root = components(found, scratch)

    # what is left of each bucket: members by their components
    tagged = crowded.select("band", F.col("class").alias("id")).join(root, "id", "left").select(
        "band", "id", F.coalesce("root", "id").alias("root")
    )
    mixed_buckets = tagged.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    left = tagged.join(mixed_buckets.select("band"), "band", "left_semi").select("id", "root").distinct()
    left = scratch.save(left.join(classes.select(F.col("class").alias("id"), "bands"), "id"), "left")
    sets = links.sets(left.select(F.col("id").alias("class")))
    seen = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = rare_pairs(sets, left, percent, scratch).join(seen, ["a", "b"], "left_anti")
    more = links.confirmed(cross, "second")
    edges = found.union(more)
    # documents of a class, and classes of a repeated doc_id, are linked as well
    edges = edges.union(named.select("class", "doc_id")).toDF("a", "b")
    root = components(edges, scratch)
    return (
        rows.select("doc_id", "n")
        .join(root.toDF("doc_id", "root"), "doc_id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("root", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def op1_hyperminhash(spark, sf_dir) -> DataFrame:
    """Every document's set size, component and whether it is the one that stays."""
    return cluster(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(g)) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id
    GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS node FROM n UNION SELECT r.id, d.b FROM r JOIN d ON d.a = r.node),
m AS (SELECT id, min(node) AS c FROM r GROUP BY id)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN m ON id = doc_id"""
