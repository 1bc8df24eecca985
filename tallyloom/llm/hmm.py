"""Hidden Markov language model, trained by Baum-Welch over the whole training corpus.

Two levels make the model's tables bounded while every word keeps its own probability:

* The latent states emit *symbols*: the ``WORDS`` most frequent words have one each, all
  others share ``CLASSES`` symbols by a hash of their last three bytes.
* Within its symbol a word has its share of the unigram probability after absolute
  discounting: (c - d) / N.  What the discount frees belongs to words not seen in training, a
  share to each class by its number of rare words; there all unseen words are one event.

So log10 P(text) = sum of the words' log10 unigram probabilities + log10 P(symbols) - sum of
log10 symbol masses, where P(symbols) is the scaled forward recursion over the whole text,
whatever its length.

Counting: every task sums its words before the shuffle.  The most frequent words (at most
``TOP``, a bounded broadcast) are scored where the text is; all others go through a join with
the full counts.  A Baum-Welch pass reads all training symbols; tasks send expected counts,
which Spark sums, and the driver sees one bounded table of counts.  Training and scoring take
whole texts; pieces of ``PIECE`` symbols only let training go through a long text side by side,
with the values of the whole text between them.

Bounded whatever the input: WORDS + CLASSES symbols.  A word outside the most frequent WORDS
has its own probability, but shares its states' emissions with its class.

Defined results: a null or empty text is its end token alone; a null doc_id is trained on;
repeated rows are counted and scored each; an empty table gives none; without any training
row all words are unseen and the states are uniform; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.chains import Chains
from tallyloom.llm.common import Scratch, table, words

STATES = 8
ROUNDS = 5
WORDS = 8192
CLASSES = 512
TOP = 200_000
PIECE = 1024
#: Weight of the unigram masses in the states' emissions, and of uniform moves.
PRIOR = 10.0
END = b""
FLUSH = 400_000
BLOCK = 400_000


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def class_of(word: Column) -> Column:
    """``word_class`` as SQL."""
    tail = F.when(F.length(word) > 3, F.substring(word, -3, 3)).otherwise(word)
    return (F.crc32(tail) % CLASSES).cast("int")


def _count(batches):
    """Token counts of a task's texts, flushed before they grow large."""
    found: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"]
        )

    for batch in batches:
        for text in batch.column(0).to_pylist():
            found.update(words(text))
            found[END] += 1
        if len(found) > FLUSH:
            yield rows()
            found.clear()
    if found:
        yield rows()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the empty word stands for the ends."""
    return (
        docs.select("text")
        .mapInArrow(_count, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def _cutoff(counts: DataFrame) -> int:
    """A count that at most TOP words exceed, from a histogram on a logarithmic scale."""
    level = F.floor(F.log2("n") * 32).alias("level")
    levels = counts.groupBy(level).agg(F.count("*").alias("words"), F.max("n").alias("n")).collect()
    room = TOP
    for r in sorted(levels, key=lambda r: -r["level"]):
        room -= r["words"]
        if room < 0:
            return r["n"]
    return 0


class Symbols:
    """The bounded tables: top words with their counts, symbols and symbol masses."""

    def __init__(self, counts: DataFrame):
        once, twice = (F.sum(F.when(F.col("n") == k, 1).otherwise(0)) for k in (1, 2))
        total = counts.agg(F.sum("n"), F.count("*"), once, twice).first()
        self.tokens, self.types = total[0] or 0, total[1]
        self.denominator = self.tokens + self.types + 1
        self.discount = total[2] / (total[2] + 2 * total[3]) if total[2] and total[3] else 0.5
        n_all = max(1, self.tokens)
        free = self.discount * self.types / n_all if self.tokens else 1.0
        #: words counted at most so often are not in the top list
        self.cutoff = _cutoff(counts)
        first = counts.where(F.col("n") > self.cutoff).toArrow()
        pairs = zip(first.column("n").to_pylist(), first.column("word").to_pylist(), strict=True)
        top = sorted((-n, bytes(w)) for n, w in pairs)
        kept = len(top)
        self.index = {w: i for i, (_, w) in enumerate(top)}
        times = np.array([-n for n, _ in top], np.float64)
        self.log_base = np.log10((times + 1) / self.denominator)
        self.log_own = np.log10((times - self.discount) / n_all)
        own = min(kept, WORDS)
        self.symbol = np.array(
            [i if i < own else WORDS + word_class(w) for i, (_, w) in enumerate(top)], np.uint16
        )
        self.mass = np.full(WORDS + CLASSES, 1e-300)
        np.add.at(self.mass, self.symbol, 10**self.log_own)
        rare = np.ones(CLASSES)
        np.add.at(rare, self.symbol[own:].astype(np.int64) - WORDS, 1)
        below = counts.where((F.col("n") <= self.cutoff) & (F.length("word") > 0))
        for c, mass, kinds in (
            below.groupBy(class_of(F.col("word")).alias("c"))
            .agg(F.sum(F.col("n") - self.discount) / n_all, F.count("*"))
            .collect()
        ):
            self.mass[WORDS + c] += mass
            rare[c] += kinds
        #: probability of an unseen word in each class
        self.unseen = free * rare / rare.sum()
        self.mass[WORDS:] += self.unseen


ENCODED = (
    "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, own double, "
    "symbols binary, tail array<struct<word:binary,n:int>>"
)


def encode(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """Every text as symbols, with the top words' part of the sums and the other words' counts."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (symbols.index, symbols.log_base, symbols.log_own, symbols.symbol)
    )
    tails = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def run(batches):
        index, log_base, log_own, symbol = shared.value
        get = index.get
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(3).to_pylist():
                tokens = words(text)
                tokens.append(END)
                code = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
                top = code >= 0
                syms = np.empty(len(code), np.uint16)
                syms[top] = symbol[code[top]]
                others = [tokens[i] for i in np.flatnonzero(~top)]
                syms[~top] = [WORDS + word_class(w) for w in others]
                tail = Counter(others)
                for column, value in zip(
                    out,
                    (
                        len(tokens),
                        int(top.sum()),
                        float(log_base[code[top]].sum()),
                        float(log_own[code[top]].sum()),
                        syms.tobytes(),
                        [{"word": w, "n": n} for w, n in tail.items()],
                    ),
                    strict=True,
                ):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), tails)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2)]
                + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "own", "symbols", "tail"],
            )

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text"
    ).mapInArrow(run, ENCODED)


def _blocks(batches, column: str):
    """(rows, symbols, lengths) of runs of whole rows of about ``BLOCK`` symbols."""
    for batch in batches:
        raw = batch.column(column).to_pylist()
        sizes = np.array([len(r) // 2 for r in raw], np.int64)
        begin = 0
        while begin < len(raw):
            end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), BLOCK, "right")))
            syms = np.frombuffer(b"".join(raw[begin:end]), np.uint16)
            yield batch, begin, end, syms, sizes[begin:end]
            begin = end


def expected_counts(encoded: DataFrame, model: dict) -> DataFrame:
    """(cell, value): expected starts, moves and emissions summed over all training rows."""

    def run(batches):
        emission = np.ascontiguousarray(model["emission"].T.astype(np.float32))
        trans, start = model["trans"].astype(np.float32), model["start"].astype(np.float32)
        states, size = model["emission"].shape
        total = np.zeros(1 + states + states * states + states * size)
        for _, _, _, syms, lengths in _blocks(batches, "symbols"):
            chains = Chains(emission, lengths, trans, start, PIECE, syms)
            alpha, scale = chains.forward_steps()
            gamma, moves = chains.backward_steps(alpha, scale)
            syms = syms[chains.at]
            total[0] += np.log10(scale.astype(np.float64)).sum()
            total[1 : 1 + states] += gamma[:, np.flatnonzero(~chains.later)].sum(axis=1)
            total[1 + states : 1 + states + states * states] += moves.ravel()
            at = 1 + states + states * states
            for s in range(states):
                total[at : at + size] += np.bincount(syms, weights=gamma[s], minlength=size)
                at += size
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "value"]
        )

    return (
        encoded.where(~F.col("held_out"))
        .select("symbols")
        .mapInArrow(run, "cell int, value double")
        .groupBy("cell")
        .agg(F.sum("value").alias("value"))
    )


def initial(mass: np.ndarray, states: int, seed: int = 7) -> dict:
    """States that stay and that each prefer their own random part of the symbols."""
    rng = np.random.default_rng(seed)
    emission = rng.gamma(0.5, size=(states, len(mass))) * mass + 0.05 * mass
    trans = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(trans, 0.9 if states > 1 else 1.0)
    return {
        "emission": emission / emission.sum(axis=1, keepdims=True),
        "trans": trans,
        "start": np.full(states, 1 / states),
    }


def train(encoded: DataFrame, mass: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> dict:
    """Baum-Welch: ``rounds`` passes over all training symbols."""
    model = initial(mass, states)
    size, share = len(mass), mass / mass.sum()
    history = []
    for _ in range(rounds):
        sums = np.zeros(1 + states + states * states + states * size)
        got = expected_counts(encoded, model).toArrow()
        sums[got.column("cell").to_numpy()] = got.column("value").to_numpy()
        history.append(float(sums[0]))
        start, rest = sums[1 : 1 + states], sums[1 + states :]
        moves, emitted = rest[: states * states].reshape(states, states), rest[states * states :].reshape(states, size)
        emission = emitted + PRIOR * share
        model = {
            "emission": emission / emission.sum(axis=1, keepdims=True),
            "trans": (moves + 1) / (moves + 1).sum(axis=1, keepdims=True),
            "start": (start + 1) / (start + 1).sum(),
        }
    return model | {"history": history}


def gains(encoded: DataFrame, model: dict, mass: np.ndarray) -> DataFrame:
    """encoded without its lists, plus ``gain``: log10 P(symbols) less the symbols' masses."""

    def run(batches):
        emission = np.ascontiguousarray(model["emission"].T)
        log_mass = np.log10(mass)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for _, begin, end, syms, lengths in _blocks([batch], "symbols"):
                chains = Chains(emission, lengths, model["trans"], model["start"], symbols=syms)
                each = np.log10(chains.by_position(chains.forward_steps()[1])) - log_mass[syms]
                out[begin:end] = np.add.reduceat(each, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "own"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(out)], [*names, "gain"]
            )

    return encoded.drop("tail").mapInArrow(
        run,
        "row long, doc_id long, held_out boolean, n_tokens long, known long, "
        "base double, own double, gain double",
    )


def score(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows not held out and score every row of (doc_id, text)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = scratch.save(count_words(docs.where(~F.col("held_out"))), "counts")
    symbols = Symbols(counts)
    encoded = scratch.save(encode(docs, symbols), "encoded")
    model = train(encoded, symbols.mass, states, rounds)

    unseen = F.element_at(
        F.array(*[F.lit(float(x)) for x in np.log10(symbols.unseen)]), class_of(F.col("word")) + 1
    )
    known = F.log10((F.col("n") - symbols.discount) / float(max(1, symbols.tokens)))
    tail = (
        encoded.select("row", F.explode("tail").alias("t"))
        .select("row", "t.word", F.col("t.n").alias("times"))
        .join(counts.where(F.col("n") <= symbols.cutoff), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"),
            F.sum(
                F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / float(symbols.denominator))
            ).alias("tail_base"),
            F.sum(F.col("times") * F.coalesce(known, unseen)).alias("tail_own"),
        )
    )

    def plus(name):
        return F.coalesce(name, F.lit(0))

    base = F.col("base") + plus("tail_base")
    return (
        gains(encoded, model, symbols.mass)
        .join(tail, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + plus("tail_known")).cast("long").alias("n_known"),
            F.lit(symbols.tokens).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            (F.col("own") + plus("tail_own") + F.col("gain")).alias("score"),
        )
    )


def op3_hmm_score(spark, sf_dir) -> DataFrame:
    """Every document's log10 probability under the unigram base and under the model."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
