"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Words are lower-cased, without signs.  A pass over all documents counts the words that
   occur in test items.
2. Seeds are the items' three-word grams that chance would put into at most ``RARE`` places a
   document, by the product of their words' frequencies.  Copies of an item don't make its
   grams common in this measure, so an item leaked into many documents keeps its seeds.  An
   item without a rare gram keeps all of its grams.
3. Every document is searched for seeds.  Around the places where an item's seeds occur, the
   item is aligned with the document's words: ``MATCH`` for equal words, ``MISS`` for others,
   ``GAP`` for a word left out or put in.  An alignment with at least ``LEAST`` of the score of
   a perfect copy is a leak, so edited and reworded copies count.  What lies left and right of
   it is aligned again until no part reaches ``LEAST``: each of several copies is a place.

Test items travel to the tasks in slices of at most ``SLICE`` characters, one pass over the
documents for each: what is broadcast is bounded, whatever the size of the benchmark.

Defined results: null or empty texts and items match nothing; items with fewer words than a
gram use their whole as one; repeated rows and items are matched each; a null doc_id is
searched as others; empty tables give no row; other columns are not read.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import table

GRAM = 3
RARE = 1e-4
MATCH, MISS, GAP = 2, -1, -1
LEAST = 0.5
#: Words of the document on both sides of where an item could lie.
PAD = 10
SLICE = 8_000_000
_SIGNS = b".,;:!?\"'()[]{}<>*#%&$_/\\|~^`=+-"
_BITS = 20


def plain_words(text: str | None) -> list[bytes]:
    """Words in lower case without ASCII signs; words that are only signs are left out."""
    return text.lower().encode("utf-8", "replace").translate(None, _SIGNS).split() if text else []


def _mixed(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


class Items:
    """A slice of test items: their words by number, and where each gram occurs."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.words, self.vocabulary = [], [], {}
        for item_id, text in rows:
            found = plain_words(text)
            if found:
                self.ids.append(item_id)
                numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found]
                self.words.append(np.array(numbers, np.int64))

    @classmethod
    def of(cls, state: dict) -> Items:
        """From the attributes of another; what is broadcast are plain values."""
        items = cls([])
        vars(items).update(state)
        return items

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's words by number, -1 for words of no item."""
        tokens = plain_words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))

    def codes(self, numbers: np.ndarray, n: int) -> np.ndarray:
        """One code for each n-gram; -1 where a word belongs to no item."""
        if len(numbers) < n:
            return np.zeros(0, np.int64)
        size, bad = len(self.vocabulary), np.zeros(len(numbers) - n + 1, bool)
        code = np.zeros(len(numbers) - n + 1, np.int64)
        for i in range(n):
            part = numbers[i : len(numbers) - n + 1 + i]
            bad |= part < 0
            code = code * size + part
        code[bad] = -1
        return code

    def seed(self, frequency: np.ndarray, documents: int) -> None:
        """Choose seeds, given the words' numbers of occurrences and that of all words (last)."""
        self.lengths = sorted({min(GRAM, len(w)) for w in self.words})
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {n: {} for n in self.lengths}
        share = frequency[:-1] / max(1.0, frequency[-1])
        for item, words in enumerate(self.words):
            n = min(GRAM, len(words))
            codes = self.codes(words, n)
            expected = np.array([share[words[i : i + n]].prod() for i in range(len(codes))]) * frequency[-1]
            rare = expected <= RARE * documents
            for i in np.flatnonzero(rare if rare.any() else np.ones(len(codes), bool)):
                self.places[n].setdefault(int(codes[i]), []).append((item, int(i)))
        self.marked = {}
        for n, places in self.places.items():
            bits = np.zeros(1 << _BITS, bool)
            bits[_mixed(np.array(list(places), np.int64))] = True
            self.marked[n] = bits

    def hits(self, numbers: np.ndarray) -> dict[int, list[int]]:
        """For each item with a seed in the text: where the item would begin."""
        found: dict[int, list[int]] = {}
        for n in self.lengths:
            codes = self.codes(numbers, n)
            for at in np.flatnonzero(self.marked[n][_mixed(codes)] & (codes >= 0)).tolist():
                for item, place in self.places[n].get(int(codes[at]), ()):
                    found.setdefault(item, []).append(at - place)
        return found


def ends(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Score of the best local alignment that ends at each place of the text.

    Row by row; along a row a gap is a running maximum.
    """
    slope = -GAP * np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best = np.zeros(len(text) + 1, np.int64)
    for word in item:
        step = np.where(text == word, MATCH, MISS)
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + step)
        new[0] = 0
        row = np.maximum.accumulate(new + slope) - slope
        np.maximum(best, row, out=best)
    return best


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its score and the end of it in the text."""
    score = ends(item, text)
    end = int(score.argmax())
    return int(score[end]), end


def extent(item: np.ndarray, text: np.ndarray, score: int) -> int:
    """Words of the shortest alignment of that score that ends where the text ends."""
    item, text = item[::-1], text[::-1]
    slope = -GAP * np.arange(len(text) + 1)
    row = -slope
    least = len(text)
    for word in item:
        new = row + GAP
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == word, MATCH, MISS))
        # an alignment may end at any word of the item
        new[0] = 0
        row = np.maximum.accumulate(new + slope) - slope
        found = np.flatnonzero(row == score)
        if len(found):
            least = min(least, int(found[0]))
    return least


def reach(m: int, least: float) -> int:
    """Words by which an alignment that is good enough can be longer than its item of m words."""
    return max(0, math.ceil(MATCH * m * (1 - least) / -GAP))


def places(item: np.ndarray, text: np.ndarray, least: float = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, score) of all alignments that reach ``least`` and don't overlap, in order.

    The best is taken first, then the best of what is left and right of it, and so on.  Only
    alignments that would begin before the end of a taken one are computed anew.
    """
    whole, longest = MATCH * len(item), len(item) + reach(len(item), least)
    score = ends(item, text)
    taken: list[tuple[int, int, int]] = []
    while True:
        end = int(score.argmax())
        best = int(score[end])
        if best <= 0 or best < least * whole:
            return taken
        start = end - extent(item, text[max(0, end - longest) : end], best)
        at = bisect.bisect(taken, (start, end, best))
        after = min(end + longest, taken[at][0] if at < len(taken) else len(text))
        taken.insert(at, (start, end, best))
        score[start + 1 : end + 1] = 0
        score[end + 1 : after + 1] = ends(item, text[end:after])[1:]


def leaks(items: Items, text: str | None, least: float = LEAST):
    """(item_id, similarity, first word, end word) of the items found, places in order."""
    numbers = items.numbers(text)
    for item, begins in sorted(items.hits(numbers).items()):
        words = items.words[item]
        m, whole = len(words), MATCH * len(words)
        pad = max(PAD + m // 2, reach(m, least))
        begins.sort()
        first = 0
        for i in range(1, len(begins) + 1):
            # places whose surroundings meet belong to one stretch
            if i < len(begins) and begins[i] - begins[i - 1] <= m + 2 * pad:
                continue
            lo = max(0, begins[first] - pad)
            part = numbers[lo : begins[i - 1] + m + pad]
            first = i
            for start, end, score in places(words, part, least):
                yield items.ids[item], score / whole, lo + start, lo + end


def _slices(benchmark: DataFrame, limit: int):
    """Runs of items of bounded size, read one after the other."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= limit:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """Occurrences of each of the items' words in all documents, and of all words."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches):
        get = vocabulary.value.get
        size = len(vocabulary.value)
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = plain_words(text)
                numbers = np.fromiter((get(w, size) for w in tokens), np.int64, len(tokens))
                total += np.bincount(numbers, minlength=size + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["word", "n"])

    got = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(items.vocabulary) + 1)
    counts[got.column("word").to_numpy()] = got.column("n").to_numpy()
    counts[-1] = counts.sum()
    return counts


def prepared(docs: DataFrame, benchmark: DataFrame, limit: int = SLICE):
    """Slices of the benchmark with their seeds chosen."""
    documents = docs.count()
    for rows in _slices(benchmark, limit):
        items = Items(rows)
        if items.words:
            items.seed(_frequencies(docs, items), documents)
            yield items


MATCHES = "doc_id long, item_id long, similarity double, start_word int, end_word int"


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, limit: int = SLICE) -> DataFrame:
    """One row for each place of a test item in a document."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], MATCHES)
    for items in prepared(docs, benchmark, limit):
        shared = spark.sparkContext.broadcast(vars(items))

        def run(batches, shared=shared):
            items = Items.of(shared.value)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    rows += [(doc_id, *found) for found in leaks(items, text, least)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "item_id", "similarity", "start_word", "end_word"],
                )

        out = out.union(narrow.mapInArrow(run, MATCHES))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, limit: int = SLICE) -> DataFrame:
    """The rows without any test item, all columns; the texts stay where they are."""
    at = docs.columns.index("text")
    out = docs
    for items in prepared(docs, benchmark, limit):
        shared = docs.sparkSession.sparkContext.broadcast(vars(items))

        def run(batches, shared=shared):
            items = Items.of(shared.value)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                yield batch.filter(pa.array([next(leaks(items, t, least), None) is None for t in texts], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op8_decontaminate(spark, sf_dir) -> DataFrame:
    """Every place of a test item in a document: ids, similarity, and the words it spans."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
