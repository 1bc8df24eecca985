"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Fitting, on a bounded sample of the labelled rows (``SAMPLE`` of each label, chosen by a hash
of doc_id):

1. Token labels.  Labels mark documents only, so a token counts as toxic if its document does
   and its word, or a beginning of it, occurs in toxic documents far beyond chance
   (one-sided likelihood ratio).
2. The chain.  Two tags; emissions are sums of hashed features of the word (itself, its
   beginnings and endings).  Each gradient is a Spark job over the sample: tasks run forward
   and backward, and sums of (label - marginal) come back, bounded by the number of features.
3. The document.  A logistic regression on the expected number of toxic tokens, the largest
   marginal and the toxic share, weighted to the labels' true proportions.

Scoring reads whole texts of all rows: forward-backward marginals of every token, the
document's score from them, and the offending offsets where asked for.

Inputs of a score are the text alone.  Defined results: a null or empty text has no token and
gets the score of a document without toxic tokens; a null doc_id is scored; repeated rows are
scored each; if a doc_id is labelled more than once, its largest label counts; null labels are
ignored; with no or one kind of label the score is the share of toxic ones (0 without any);
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.chains import Chains
from tallyloom.llm.common import Scratch, table, words

#: Rows of each label that are fitted on, at most.
SAMPLE = 3000
#: Hashed features, at most.
SIZE = 1 << 16
#: Words and beginnings that mark tokens, at most.
MARKS = 5000
LEAST_RATIO = 15.0
ROUNDS = 15
BLOCK = 1_000_000
#: Bytes of a word's beginning that are a feature, and may be a mark.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
CACHE_WORDS = 300_000
_PUNCT = b".,;:!?\"'()[]{}<>*#%&$-_/\\"
_WORD = re.compile("[^\x20\x09-\x0d]+")


def core(word: bytes) -> bytes:
    """The word without signs around it, or itself if it is nothing else."""
    return word.strip(_PUNCT) or word


def features(word: bytes) -> list[int]:
    w = core(word)
    parts = [b"w" + w]
    parts += [b"b" + w[:n] for n in BEGINNINGS if len(w) > n]
    parts += [b"e" + w[-n:] for n in (3, 4, 5) if len(w) > n]
    return [zlib.crc32(p) % SIZE for p in parts]


def mark_keys(word: bytes) -> list[bytes]:
    w = core(word)
    return [b"w" + w, *(b"b" + w[:n] for n in BEGINNINGS if len(w) > n)]


def sample_rows(docs: DataFrame, labels: DataFrame, train: Column, each: int = SAMPLE) -> tuple[DataFrame, dict]:
    """(text, label) of the sampled rows, and the number of training rows of each label."""
    known = (
        labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(*order).limit(each)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 x SAMPLE narrow rows
    return docs.join(F.broadcast(picked), "doc_id").select("text", "label"), sizes


def _count_marks(batches):
    found: dict[bytes, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for key in {k for w in set(words(text)) for k in mark_keys(w)}:
                found.setdefault(key, [0, 0])[label] += 1
        if len(found) > CACHE_WORDS:
            yield _mark_rows(found)
            found = {}
    yield _mark_rows(found)


def _mark_rows(found: dict) -> pa.RecordBatch:
    counts = np.array(list(found.values()), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(found.keys(), pa.binary()), pa.array(counts[:, 0]), pa.array(counts[:, 1])],
        ["key", "clean", "toxic"],
    )


def marks(sample: DataFrame, toxic_share: float) -> set[bytes]:
    """Keys that stand in toxic documents far more often than by chance; the strongest few."""
    n, k, p = F.col("toxic") + F.col("clean"), F.col("toxic"), F.lit(toxic_share)
    ratio = 2 * (
        k * F.log(k / (n * p))
        + F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)
    )
    rows = (
        sample.mapInArrow(_count_marks, "key binary, clean long, toxic long")
        .groupBy("key")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((k > 0) & (k > n * F.greatest(p, F.lit(0.5))))
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.desc("ratio"), "key")
        .limit(MARKS)
        .collect()
    )
    return {bytes(r["key"]) for r in rows}


def _blocks(lists: list[list], block: int = BLOCK):
    """(begin, end) of runs of lists with about so many items together."""
    begin = size = 0
    for i, one in enumerate(lists):
        size += len(one)
        if size >= block:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(lists):
        yield begin, len(lists)


def encode_sample(sample: DataFrame, marked: set[bytes]) -> DataFrame:
    """Each sampled text as its features, features per token, and token labels."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = words(text)
                each = [features(w) for w in tokens]
                tags = [int(label and any(k in marked for k in mark_keys(w))) for w in tokens]
                out[0].append(np.array([f for fs in each for f in fs], np.uint16).tobytes())
                out[1].append(bytes(map(len, each)))
                out[2].append(bytes(tags))
                out[3].append(label)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, [pa.binary()] * 3 + [pa.int32()], strict=True)],
                ["features", "sizes", "tags", "label"],
            )

    return sample.mapInArrow(run, "features binary, sizes binary, tags binary, label int")


def chain(odds: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> Chains:
    """The chain of given toxic log odds of tokens and tag scores of moves and starts."""
    toxic = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return Chains(np.stack([1 - toxic, toxic], axis=1), lengths, np.exp(moves), np.exp(start))


def _unpack(batch, begin, end):
    feats = np.frombuffer(b"".join(batch.column(0).to_pylist()[begin:end]), np.uint16)
    raw = batch.column(1).to_pylist()[begin:end]
    sizes = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    tags = np.frombuffer(b"".join(batch.column(2).to_pylist()[begin:end]), np.uint8)
    return feats, sizes, tags, np.array([len(r) for r in raw], np.int64)


def _odds(weights: np.ndarray, feats: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[feats], np.concatenate([[0], np.cumsum(sizes)[:-1]])) + weights[SIZE]


def gradient(encoded: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the log likelihood of the token labels, and the number of tokens.

    Cells: SIZE features, a bias, 4 moves, 2 starts, the tokens.
    """

    def run(batches):
        total = np.zeros(SIZE + 8)
        moves, start = weights[SIZE + 1 : SIZE + 5].reshape(2, 2), weights[SIZE + 5 : SIZE + 7]
        for batch in batches:
            for begin, end in _blocks(batch.column(1).to_pylist()):
                feats, sizes, tags, lengths = _unpack(batch, begin, end)
                lengths = lengths[lengths > 0]
                if not len(lengths):
                    continue
                c = chain(_odds(weights, feats, sizes), lengths, moves, start)
                gamma, moved = c.backward(*c.forward())
                miss = tags - gamma[:, 1]
                total[:SIZE] += np.bincount(feats, weights=np.repeat(miss, sizes), minlength=SIZE)
                total[SIZE] += miss.sum()
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                inside = np.ones(len(tags), bool)
                inside[first] = False
                at = np.flatnonzero(inside)
                seen = np.bincount(tags[at - 1] * 2 + tags[at], minlength=4)
                total[SIZE + 1 : SIZE + 5] += seen - moved.ravel()
                total[SIZE + 5 : SIZE + 7] += np.bincount(tags[first], minlength=2) - gamma[first].sum(axis=0)
                total[SIZE + 7] += len(tags)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "value"])

    got = (
        encoded.drop("label").mapInArrow(run, "cell int, value double")
        .groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    )
    sums = np.zeros(SIZE + 8)
    sums[got.column("cell").to_numpy()] = got.column("value").to_numpy()
    return sums[:-1], sums[-1]


def fit_chain(encoded: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Steps by the sign-free rule of Adam on the whole sample, with a small pull to zero."""
    weights = np.zeros(SIZE + 7)
    weights[SIZE] = -3.0
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        g, tokens = gradient(encoded, weights)
        if not tokens:
            break
        g = g / tokens * 1000 - 0.001 * weights
        first, second = 0.8 * first + 0.2 * g, 0.9 * second + 0.1 * g * g
        weights += 0.6 * (first / (1 - 0.8**t)) / (np.sqrt(second / (1 - 0.9**t)) + 1e-3)
    return weights.astype(np.float64)


def summary(p: np.ndarray) -> list[float]:
    """What a document's score is made of: expected toxic tokens, largest marginal, share."""
    n = len(p)
    return [float(np.log1p(p.sum())), float(p.max(initial=0)), float(p.sum() / n) if n else 0.0]


class Scorer:
    """Marginals of texts; keeps the emissions of words it has seen."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.moves, self.start = weights[SIZE + 1 : SIZE + 5].reshape(2, 2), weights[SIZE + 5 : SIZE + 7]
        self.known: dict[bytes, float] = {}

    def odds(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for w in set(tokens).difference(self.known):
            self.known[w] = float(self.weights[features(w)].sum() + self.weights[SIZE])
        return np.fromiter(map(self.known.__getitem__, tokens), np.float64, len(tokens))

    def marginals(self, texts: list[str]):
        """Toxic marginals of every token, text by text, in order."""
        runs, size = [], 0
        for text in texts:
            runs.append(self.odds(words(text)))
            size += len(runs[-1])
            if size >= BLOCK:
                yield from self._run(runs)
                runs, size = [], 0
        yield from self._run(runs)

    def _run(self, runs: list[np.ndarray]):
        lengths = np.array([len(r) for r in runs], np.int64)
        if lengths.any():
            c = chain(np.concatenate(runs), lengths[lengths > 0], self.moves, self.start)
            gamma, _ = c.backward(*c.forward())
            yield from np.split(gamma[:, 1], np.cumsum(lengths)[:-1])
        else:
            yield from (np.zeros(0) for _ in runs)


def fit_document(sample: DataFrame, weights: np.ndarray, sizes: dict, rounds: int = 200) -> np.ndarray:
    """Logistic regression on the summaries of the sampled documents; at most 2 x SAMPLE rows."""

    def run(batches):
        scorer = Scorer(weights)
        for batch in batches:
            rows = [summary(p) for p in scorer.marginals(batch.column(0).to_pylist())]
            columns = [pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["a", "b", "c", "label"])

    got = sample.mapInArrow(run, "a double, b double, c double, label int").toArrow()
    x = np.stack([got.column(c).to_numpy() for c in "abc"] + [np.ones(got.num_rows)], axis=1)
    y = got.column("label").to_numpy().astype(np.float64)
    share = {label: sizes.get(label, 0) / max(1, (y == label).sum()) for label in (0, 1)}
    w = np.where(y == 1, share[1], share[0])
    w /= w.mean()
    coef = np.zeros(4)
    for _ in range(rounds):  # Newton steps, held back by a small ridge
        p = 1 / (1 + np.exp(-x @ coef))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4)
        step = np.linalg.solve(hess, x.T @ (w * (y - p)) - 1e-2 * coef)
        coef += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return coef


class Model:
    """Fitted chain and document weights; ``share`` alone counts where labels are of one kind."""

    def __init__(self, weights: np.ndarray | None, coef: np.ndarray | None, share: float):
        self.weights, self.coef, self.share = weights, coef, share

    def score(self, p: np.ndarray) -> float:
        if self.coef is None:
            return self.share
        z = float(np.dot([*summary(p), 1.0], self.coef))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, train: Column, each: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """``labels``: (doc_id, label 0/1); ``train``: which of its rows may be learnt from."""
    scratch = Scratch(docs.sparkSession)
    sample, sizes = sample_rows(docs.select("doc_id", "text"), labels, train, each)
    total = sum(sizes.values())
    if len([n for n in sizes.values() if n]) < 2:
        return Model(None, None, sizes.get(1, 0) / total if total else 0.0)
    # few but long texts: spread them, so that every task has some
    sample = scratch.save(sample.repartition(12), "sample")
    taken = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(taken) < 2:
        return Model(None, None, sizes[1] / total)
    marked = marks(sample, taken[1] / (taken[0] + taken[1]))
    weights = fit_chain(scratch.save(encode_sample(sample, marked), "encoded"), rounds)
    return Model(weights, fit_document(sample, weights, sizes), sizes[1] / total)


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Code point offsets of runs of tokens with marginals of ``least`` or more."""
    if not (p >= least).any():
        return []
    found: list[tuple[int, int]] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if p[i] >= least:
            if last == i - 1:
                found[-1] = (found[-1][0], m.end())
            else:
                found.append(m.span())
            last = i
    return found


def apply_model(docs: DataFrame, model: Model, keep: list[str], with_spans: bool = False) -> DataFrame:
    """``keep`` columns, ``score`` and, if asked for, ``spans`` of every row."""
    columns = keep if "text" in keep else [*keep, "text"]
    kept = docs.select(*[f"`{c}`" for c in columns])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep]
    body = columns.index("text")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        scorer = Scorer(model.weights if model.weights is not None else np.zeros(SIZE + 7))
        for batch in batches:
            scores, found = [], []
            texts = [t or "" for t in batch.column(body).to_pylist()]
            for text, p in zip(texts, scorer.marginals(texts), strict=True):
                scores.append(model.score(p))
                if with_spans:
                    found.append([{"start": a, "end": b} for a, b in spans(text, p)])
            arrays = [*batch.columns[: len(keep)], pa.array(scores, pa.float64())]
            names = [*keep, "score"]
            if with_spans:
                arrays.append(pa.array(found, pa.list_(span)))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(arrays, names)

    extra = ["score double"] + (["spans array<struct<start:int,end:int>>"] if with_spans else [])
    return kept.mapInArrow(run, ", ".join([*fields, *extra]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    labels = labels.select("doc_id", F.col("toxic").alias("label"))
    return fit(docs, labels, ~held_out(F.col("doc_id")))


def op7_crf_toxicity(spark, sf_dir) -> DataFrame:
    """Every document's toxicity, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return apply_model(docs.select("doc_id", "text"), model, ["doc_id"], with_spans=True).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )
