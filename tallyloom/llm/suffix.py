"""Removal of long repeated byte strings by a sampled, range-partitioned suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.  A full
suffix array has an entry for each byte; this one is sampled so that nothing is lost:

1. Sampling.  In every window of ``LENGTH`` bytes the 64-byte gram with the smallest hash is an
   anchor (all of them, if it recurs).  The choice depends on the window's bytes alone, so two
   equal windows have their anchors at equal places.  About one position in 170 is an anchor.
2. Anchors whose gram occurs once can't lie in a repeated window.  Of the others, those whose
   whole context (all bytes of the windows that could have chosen them) occurs again are
   repeated as a whole.  What is left are different contexts of one gram.
3. Sorting.  These suffixes, one of each context, are range-partitioned by splitters that Spark
   samples from their leading grams.  Every bucket sorts its suffixes by multikey quicksort on
   eight-byte characters, and neighbours are compared for their common length.  Splitters fall
   between different grams only, and suffixes that match share their gram, so no comparison is
   left to make across a boundary.
4. Matching.  A run of suffixes with one gram is taken with the bytes before the anchors: two
   of them match if common bytes before and after the anchor add up to ``LENGTH``.  Long runs
   roll a hash over all windows instead of comparing pairs; runs above ``RUN`` contexts are
   spread over the cluster window by window.

Matches never cross rows.  Defined results: a null text is empty; texts shorter than
``LENGTH`` stay whole; repeated rows are occurrences of their own, so both lose what is long
enough; a null doc_id is a document like others; an empty table gives none; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, table

LENGTH = 400
GRAM = 64
#: Offsets of a gram within a window.
BACK = LENGTH - GRAM
#: Contexts of one gram that one task takes.
RUN = 100_000
#: Contexts to a bucket, about.
BUCKET = 20_000
#: Texts are sampled in pieces of so many window starts.
PIECE = 1 << 21
PAIRWISE = 24

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """take (minimum or maximum) over every window, by running values within blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, x[-1], x.dtype)
    padded[: len(x)] = x
    square = padded.reshape(blocks, width)
    ahead = take.accumulate(square, axis=1).ravel()
    behind = take.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return take(behind[:n], ahead[width - 1 : width - 1 + n])


class Sampler:
    """Anchors of byte strings."""

    def __init__(self):
        self.size = 0

    def _grams(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n >= self.size:
            self.size = max(n + 1, 2 * self.size)
            self.power = _powers(_BASE, self.size)
            self.inverse = _powers(pow(_BASE, -1, 1 << 64), self.size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * self.power[:n], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * self.inverse[: n - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def anchors(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions and gram hashes of all anchors."""
        data = np.frombuffer(raw, np.uint8)
        found = []
        for begin in range(0, len(data) - LENGTH + 1, PIECE):
            h = self._grams(data[begin : begin + PIECE + LENGTH - 1])
            least = _sliding(h, BACK + 1, np.minimum)
            # a gram is an anchor if it is the least of some window: the greatest least is its own
            edge = np.zeros(BACK, np.uint64)
            most = _sliding(np.concatenate([edge, least, edge]), BACK + 1, np.maximum)
            at = np.flatnonzero(most == h)
            found.append((at + begin, h[at].view(np.int64)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, h = (np.concatenate(x) for x in zip(*found, strict=True))
        at, once = np.unique(at, return_index=True)
        return at, h[once]


KEYS = ["k1", "k2"]


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text): rows with equal keys are equal rows and have equal results."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.xxhash64("doc_id", text).alias("k1"), F.hash(text, F.col("doc_id")).alias("k2"), "doc_id", text.alias("text")
    )


def _occurrences(batches):
    sampler = Sampler()
    for batch in batches:
        k1, k2 = batch.column(0), batch.column(1)
        rows, gram, context, pos, back, ahead = [], [], [], [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            raw = text.encode("utf-8", "replace")
            if len(raw) < LENGTH:
                continue
            at, h = sampler.anchors(raw)
            lo, hi = np.maximum(at - BACK, 0), np.minimum(at + LENGTH, len(raw))
            context += [
                xxhash.xxh3_64_intdigest(raw[a:b], seed=p - a) - (1 << 63)
                for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)
            ]
            rows.append(np.full(len(at), row))
            gram.append(h)
            pos.append(at)
            back.append(at - lo)
            ahead.append(hi - at)
        if not rows:
            continue
        take = pa.array(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays(
            [k1.take(take), k2.take(take), pa.array(np.concatenate(gram)), pa.array(context, pa.int64())]
            + [pa.array(np.concatenate(x).astype(np.int32)) for x in (pos, back, ahead)],
            [*KEYS, "gram", "context", "pos", "back", "ahead"],
        )


OCCURRENCE = "k1 long, k2 int, gram long, context long, pos int, back int, ahead int"


def _contexts(batches):
    """The wanted contexts of each text: (gram, context, single, suffix, before)."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for k1, k2, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = text.encode("utf-8", "replace")
            for w in wanted:
                p = w["pos"]
                for column, value in zip(
                    out,
                    (k1, k2, w["gram"], w["context"], w["single"], raw[p : p + w["ahead"]], raw[p - w["back"] : p]),
                    strict=True,
                ):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
            [*KEYS, "gram", "context", "single", "suffix", "before"],
        )


def multikey_order(suffixes: list[bytes]) -> list[int]:
    """Indices in the suffixes' order, by three-way radix quicksort on eight-byte characters.

    Shorter suffixes sort as if followed by zero bytes, then by length.
    """
    width = -(-max(map(len, suffixes), default=0) // 8)
    square = np.zeros((len(suffixes), width * 8), np.uint8)
    for i, s in enumerate(suffixes):
        square[i, : len(s)] = np.frombuffer(s, np.uint8)
    chars = square.view(">u8").astype(np.uint64)
    order: list[int] = []
    stack = [(np.arange(len(suffixes)), 0)]
    while stack:
        some, depth = stack.pop()
        if len(some) <= 16 or depth == width:
            order += sorted(some.tolist(), key=lambda i: (suffixes[i], i))
            continue
        key = chars[some, depth]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        stack.append((some[key > pivot], depth))
        stack.append((some[key == pivot], depth + 1))
        stack.append((some[key < pivot], depth))
    return order


def _aligned(suffixes: list[bytes], befores: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as rows of one byte matrix with their anchors in column BACK, and their sizes."""
    square = np.zeros((len(suffixes), BACK + LENGTH), np.uint8)
    for i, (s, b) in enumerate(zip(suffixes, befores, strict=True)):
        square[i, BACK - len(b) : BACK] = np.frombuffer(b, np.uint8)
        square[i, BACK : BACK + len(s)] = np.frombuffer(s, np.uint8)
    return (
        square,
        np.array([len(b) for b in befores], np.int64),
        np.array([len(s) for s in suffixes], np.int64),
    )


def match_pairs(square: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before and after each anchor that repeated windows cover, from all pairs of a run.

    The run is sorted, so the common length of two suffixes is the least of the neighbours'
    between them.
    """
    m = len(square)
    left, right = np.full(m, -1), np.full(m, -1)
    differ = square[1:, BACK:] != square[:-1, BACK:]
    near = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    near = np.minimum(near, np.minimum(ahead[1:], ahead[:-1]))
    for i in range(m - 1):
        after = np.minimum.accumulate(near[i:])
        differ = square[i + 1 :, BACK - 1 :: -1] != square[i, BACK - 1 :: -1]
        before = np.where(differ.any(axis=1), differ.argmax(axis=1), BACK)
        before = np.minimum(before, np.minimum(back[i + 1 :], back[i]))
        hit = np.flatnonzero(before + after >= LENGTH)
        if len(hit):
            j = hit + i + 1
            left[i], right[i] = max(left[i], before[hit].max()), max(right[i], after[hit].max())
            left[j], right[j] = np.maximum(left[j], before[hit]), np.maximum(right[j], after[hit])
    return left, right


def window_hashes(square: np.ndarray, back: np.ndarray, ahead: np.ndarray):
    """For every offset of the anchor in a window: (offset, rows that have it, their hashes)."""
    top = np.uint64(pow(_BASE, LENGTH - 1, 1 << 64))
    base = np.uint64(_BASE)
    h = np.zeros(len(square), np.uint64)
    for i in range(LENGTH):
        h = h * base + _TABLE[square[:, BACK + i]]
    for d in range(BACK + 1):
        if d:
            # one byte to the left: the last one goes, and hashes run from right to left
            h = (h - _TABLE[square[:, BACK + LENGTH - d]]) * _INVERSE + _TABLE[square[:, BACK - d]] * top
        have = np.flatnonzero((back >= d) & (ahead >= LENGTH - d))
        yield d, have, h[have]




def match_windows(square: np.ndarray, back: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as match_pairs, from the hashes of all windows; for long runs."""
    m = len(square)
    left, right = np.full(m, -1), np.full(m, -1)
    for d, have, h in window_hashes(square, back, ahead):
        if len(have) < 2:
            continue
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        hit = have[order[np.r_[same, False] | np.r_[False, same]]]
        left[hit] = d
        right[hit] = np.maximum(right[hit], LENGTH - d)
    return left, right


INTERVAL = "gram long, context long, lo int, hi int"


def _bucket(batches):
    """Sort a bucket's suffixes and match its runs; gives covered bytes before and after."""
    columns: list[list] = [[] for _ in range(5)]
    for batch in batches:
        for c, name in zip(columns, ("gram", "context", "single", "suffix", "before"), strict=True):
            c += batch.column(name).to_pylist()
    gram, context, single, suffix, before = columns
    order = multikey_order(suffix)
    out: list[tuple] = []
    begin = 0
    for i in range(1, len(order) + 1):
        if i < len(order) and suffix[order[i]][:GRAM] == suffix[order[begin]][:GRAM]:
            continue
        run = order[begin:i]
        begin = i
        if len(run) < 2:
            continue
        shape = _aligned([suffix[j] for j in run], [before[j] for j in run])
        left, right = (match_pairs if len(run) <= PAIRWISE else match_windows)(*shape)
        for j, x, y in zip(run, left.tolist(), right.tolist(), strict=True):
            if x >= 0 and single[j]:
                out.append((gram[j], context[j], x, y))
    rows = list(zip(*out, strict=True)) if out else [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["gram", "context", "lo", "hi"]
    )


def _windows(batches):
    """Every window of every context as (gram, context, single, offset, hash)."""
    for batch in batches:
        names = ("gram", "context", "single", "suffix", "before")
        gram, context, single, suffix, before = (batch.column(n).to_pylist() for n in names)
        for d, have, h in window_hashes(*_aligned(suffix, before)):
            take = pa.array(have)
            yield pa.RecordBatch.from_arrays(
                [batch.column("gram").take(take), batch.column("context").take(take), batch.column("single").take(take)]
                + [pa.array(np.full(len(have), d, np.int32)), pa.array(h.view(np.int64))],
                ["gram", "context", "single", "d", "h"],
            )


def repeated(docs: DataFrame, scratch: Scratch, run: int = RUN, bucket: int = BUCKET) -> DataFrame:
    """(k1, k2, start, end): byte intervals that repeated windows cover, of keyed rows."""
    occurrences = scratch.save(
        docs.select("k1", "k2", "text").mapInArrow(_occurrences, OCCURRENCE), "occurrences"
    )
    shared = (
        occurrences.groupBy("gram")
        .agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
        .where("n > 1")
    )
    # written before the join: between two plain exchanges Spark can split a frequent gram
    grams = scratch.save(shared.select("gram", (F.col("lo") != F.col("hi")).alias("varied")), "grams")
    shared = scratch.save(occurrences.join(grams, "gram"), "shared")
    scratch.drop(occurrences)
    one = F.struct("k1", "k2", "pos", "back", "ahead")
    contexts = scratch.save(
        shared.groupBy("gram", "context")
        .agg(F.count("*").alias("n"), F.min(one).alias("one"), F.first("varied").alias("varied")),
        "contexts",
    )
    whole = shared.join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"]).select(
        "k1", "k2", (F.col("pos") - F.col("back")).alias("start"), (F.col("pos") + F.col("ahead")).alias("end")
    )

    varied = contexts.where("varied").select(
        "one.k1", "one.k2",
        F.struct("gram", "context", (F.col("n") == 1).alias("single"), "one.pos", "one.back", "one.ahead").alias("w"),
    )
    wanted = varied.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    # equal rows have equal contexts: one of them is enough
    texts = (
        docs.select("k1", "k2", "text")
        .join(wanted.hint("shuffle_hash"), KEYS)
        .mapInArrow(
            _contexts, "k1 long, k2 int, gram long, context long, single boolean, suffix binary, before binary"
        )
        .drop("k1", "k2")
        .dropDuplicates(["gram", "context"])
    )
    texts = scratch.save(texts, "suffixes")
    sizes = texts.groupBy("gram").agg(F.count("*").alias("m")).where(F.col("m") > run)
    crowded = texts.join(sizes.select("gram"), "gram", "left_semi")
    usual = texts.join(sizes.select("gram"), "gram", "left_anti")
    buckets = max(1, -(-texts.count() // bucket))
    parts = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    matched = (
        usual.repartitionByRange(parts, F.substring("suffix", 1, GRAM))
        .mapInArrow(_bucket, INTERVAL)
    )
    windows = crowded.mapInArrow(_windows, "gram long, context long, single boolean, d int, h long")
    twice = windows.groupBy("gram", "d", "h").agg(F.count("*").alias("n")).where("n > 1").select("gram", "d", "h")
    spread = (
        windows.where("single")
        .join(twice, ["gram", "d", "h"])
        .groupBy("gram", "context")
        .agg(F.max("d").alias("lo"), F.max(LENGTH - F.col("d")).cast("int").alias("hi"))
    )
    single = contexts.where("n = 1").select("gram", "context", "one.k1", "one.k2", "one.pos")
    parted = single.join(matched.union(spread), ["gram", "context"]).select(
        "k1", "k2", (F.col("pos") - F.col("lo")).alias("start"), (F.col("pos") + F.col("hi")).alias("end")
    )
    return whole.union(parted)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the intervals cover."""
    runs: list[list[int]] = []
    for a, b in sorted(intervals):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def _cut(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "replace")
            runs = merged([(f["start"], f["end"]) for f in found or ()])
            ends = [0, *(b for _, b in runs)]
            starts = [*(a for a, _ in runs), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(ends, starts, strict=True))
            values = (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, run: int = RUN, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs)
    found = repeated(rows, scratch, run, bucket).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("start", "end")).alias("found")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        rows.join(found.hint("shuffle_hash"), KEYS, "left")
        .select("doc_id", "text", "found")
        .mapInArrow(
            _cut,
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
        )
    )


def op5_suffix_dedup(spark, sf_dir) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
