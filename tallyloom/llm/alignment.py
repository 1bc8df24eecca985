"""Alignment of two tokenizers' ids over the same texts, with an identity map for equal tokens.

A is a byte-level BPE, B a SentencePiece model.  Both are asked for the bytes of a blank and the
text.  Byte offsets where tokens of both end cut them into groups; two tokens are linked where they
share a group.

A text is cut before every blank that follows another character than white space.  Neither
tokenizer has a token across such a place: A's pattern has white space only before other
characters, and B's pieces have markers only at their start.  So groups lie within these chunks,
and each distinct chunk of a block is encoded and aligned once.

``identity`` gives for each A id the B id of the same bytes.  Links of one A token with its identity
need no pair: how many documents hold one is counted in a vector as long as A's vocabulary.  All
other pairs, which only groups of several tokens have, are counted for each block of documents and
then summed over the corpus by a shuffle of one row for each block and pair.  The counts go back
the same way: a block's documents meet the counts of the block's pairs.  What goes to all tasks has
one number for each A id.

Defined results: texts that are null, empty or hold a character that B alters (U+2581) have no
tokens: zeros and an empty string; strings of special tokens are plain text; repeated rows are
documents of their own; without linked tokens ``n_best`` and ``count_sum`` are 0; an empty table
gives none; kept columns are passed through, one with the name of a result is an error.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, table

BLOCK_CHARS = 32_000_000
BLOCK_CHUNKS = 1_000_000
RUN_CHARS = 4_000_000
MARK = "▁"

# white space, other characters, and any white space but a blank with what follows it
CHUNK = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")

RESULTS = (
    "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def byte_values() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # tasks are the unit of parallel work
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        values = byte_values()
        names = self.a.get_vocab(with_added_tokens=True)
        self.size_a, self.size_b = max(names.values()) + 1, self.b.get_piece_size()
        bytes_a = {i: bytes(map(values.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        #: bytes of each B id; control pieces never come from a text
        self.bytes_b: dict[int, bytes] = {}
        same: dict[bytes, int] = {}
        for i in range(self.size_b):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[1:-1], 16)])
                same.setdefault(self.bytes_b[i], i)
            elif not self.b.is_control(i) and not self.b.is_unknown(i):
                self.bytes_b[i] = piece.replace(MARK, " ").encode()
                # B takes a byte piece only where it has no other
                same[self.bytes_b[i]] = i
        self.identity = np.full(self.size_a, -1, np.int64)
        for i, raw in bytes_a.items():
            self.identity[i] = same.get(raw, -1)
        self.length_a = np.array([len(bytes_a.get(i, b"")) for i in range(self.size_a)], np.int64)
        self.length_b = np.array([len(self.bytes_b.get(i, b"")) for i in range(self.size_b)], np.int64)
        #: a group of an A token and its identity as text
        self.shown = [f"{i}|{j}" for i, j in enumerate(self.identity.tolist())]
        self.blank = self.b.piece_to_id(MARK)

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks that start with a blank, which B puts first by itself."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        return a, [ids if c != " " else [self.blank] for c, ids in zip(chunks, b, strict=True)]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(sizes))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, .. of runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Groups:
    """Groups of two lists of tokens over the same bytes.

    ``first_a`` and ``first_b`` hold where each group starts, with one place more for the end.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, t: Tokenizers):
        ends_a, ends_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
        self.ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        self.first_a = np.append(0, np.searchsorted(ends_a, self.ends) + 1)
        self.first_b = np.append(0, np.searchsorted(ends_b, self.ends) + 1)
        self.n_a, self.n_b = np.diff(self.first_a), np.diff(self.first_b)
        one = (self.n_a == 1) & (self.n_b == 1)
        #: groups of one A token and its identity
        self.plain = one & (t.identity[a[self.first_a[:-1]]] == b[self.first_b[:-1]])

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(Group, A id, B id) of every link, group by group."""
        sizes = self.n_a * self.n_b
        group = np.repeat(np.arange(len(sizes)), sizes)
        within = _spread(np.zeros(len(sizes), np.int64), sizes)
        left = a[self.first_a[group] + within // self.n_b[group]]
        return group, left, b[self.first_b[group] + within % self.n_b[group]]


class Block:
    """Aligned chunks of a block of documents, and how many of its documents hold each pair.

    A chunk's links are codes: an A id for a link with its identity, else ``size_a`` plus the
    number of the pair within the block.
    """

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.pairs: dict[int, int] = {}
        self.holders = np.zeros(0, np.int64)
        self.chars = 0
        # numbers of chunks added together: A and B tokens, groups, links; and all their codes
        self.counts, self.codes = [np.zeros((0, 4), np.int64)], [np.zeros(0, np.int32)]

    def add(self, chunks: list[str]) -> None:
        """Encode and align chunks that the block does not have yet."""
        for low in range(0, len(chunks), 20_000):
            some = chunks[low : low + 20_000]
            self.number.update(zip(some, range(len(self.text), len(self.text) + len(some)), strict=True))
            self._align(*self.t.encode(some))

    def _align(self, lists_a: list[list[int]], lists_b: list[list[int]]) -> None:
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (lists_a, lists_b))
        found = Groups(a, b, self.t)
        # a chunk's last byte ends a group
        last = np.cumsum(self.t.length_a[a])[np.cumsum([len(x) for x in lists_a]) - 1]
        per_chunk = np.diff(np.append(0, np.searchsorted(found.ends, last) + 1))
        group, left, right = found.links(a, b)
        codes = left.copy()
        odd = self.t.identity[left] != right
        keys, place = np.unique(left[odd] * self.t.size_b + right[odd], return_inverse=True)
        for key in keys.tolist():
            self.pairs.setdefault(key, len(self.pairs))
        numbers = np.fromiter(map(self.pairs.__getitem__, keys.tolist()), np.int64, len(keys))
        codes[odd] = self.t.size_a + numbers[place]
        chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)
        links = np.bincount(chunk_of[group], minlength=len(per_chunk))
        n_a, n_b = ([len(x) for x in lists] for lists in (lists_a, lists_b))
        self.counts.append(np.array([n_a, n_b, per_chunk, links]).T)
        self.codes.append(codes.astype(np.int32))
        shown = self._shown(a.tolist(), b.tolist(), found)
        ends = np.cumsum(per_chunk).tolist()
        self.text += [";".join(shown[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def _shown(self, a: list[int], b: list[int], found: Groups) -> list[str]:
        """Each group as text."""
        name, out = self.t.shown, []
        first = zip(found.first_a.tolist(), found.first_a[1:].tolist(), found.first_b.tolist(), found.first_b[1:].tolist(), strict=False)
        for plain, (i, j, k, m) in zip(found.plain.tolist(), first, strict=True):
            if plain:
                out.append(name[a[i]])
            else:
                out.append(f"{','.join(map(str, a[i:j]))}|{','.join(map(str, b[k:m]))}")
        return out

    def documents(self, chunks: list[list[str]], vector: np.ndarray):
        """Counts, digests, and links (sizes, codes, times) of documents, which are counted for their links."""
        self.counts, self.codes = [np.concatenate(self.counts)], [np.concatenate(self.codes)]
        counts, flat = self.counts[0], self.codes[0]
        sizes = np.array([len(c) for c in chunks], np.int64)
        places = np.fromiter(map(self.number.__getitem__, chain.from_iterable(chunks)), np.int64, sizes.sum())
        document = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.array([np.bincount(document, counts[places, i], len(sizes)) for i in range(4)]).astype(np.int64)
        digests, listed, at = [], places.tolist(), 0
        for size in sizes.tolist():
            shown = ";".join(map(self.text.__getitem__, listed[at : at + size]))
            digests.append(hashlib.sha256(shown.encode()).hexdigest() if size else "")
            at += size
        # distinct chunks of a document, then its distinct codes, with how often each comes
        held, often = np.unique(document * len(counts) + places, return_counts=True)
        document, chunk = np.divmod(held, max(1, len(counts)))
        runs = counts[chunk, 3]
        codes = flat[_spread(_starts(counts[:, 3])[chunk], runs)]
        wide = self.t.size_a + len(self.pairs)
        held, place = np.unique(np.repeat(document, runs) * wide + codes, return_inverse=True)
        times = np.bincount(place, np.repeat(often, runs), len(held)).astype(np.int64)
        document, codes = np.divmod(held, wide)
        held = np.bincount(codes, minlength=wide)
        vector += held[: self.t.size_a]
        self.holders = np.append(self.holders, np.zeros(len(self.pairs) - len(self.holders), np.int64))
        self.holders += held[self.t.size_a :]
        return sums, digests, np.bincount(document, minlength=len(sizes)), codes, times

    def full(self) -> bool:
        return self.chars > BLOCK_CHARS or len(self.text) > BLOCK_CHUNKS


def cut(text: str | None) -> list[str]:
    """Chunks of a blank and the text; none for texts that B alters."""
    return CHUNK.findall(" " + text) if text and MARK not in text else []


def _runs(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """First and last place of runs of texts of about so many characters."""
    start, size = 0, 0
    for i, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= chars or i == len(texts):
            yield start, i
            start, size = i, 0


LISTS = {"keys": "long", "holders": "long", "codes": "int", "times": "int"}
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "block"]


def _aligned(kept: DataFrame, keep: list[str], path_a: str, path_b: str) -> DataFrame:
    """Three kinds of rows: documents, each block's pairs with their documents, each task's vector.

    Document rows have ``block``, ``codes`` and ``times``; the others the lists ``keys`` and
    ``holders``, of a vector only the latter.
    """
    types = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name in keep]
    schema = [*types, "kind string", *[f"{n} long" for n in NUMBERS], "groups_sha256 string"]
    schema += [f"{n} array<{t}>" for n, t in LISTS.items()]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        arrow = {n: pa.int64() for n in NUMBERS} | {"groups_sha256": pa.string()}
        arrow |= {n: pa.list_(pa.int64() if t == "long" else pa.int32()) for n, t in LISTS.items()}
        t = Tokenizers(path_a, path_b)
        vector = np.zeros(t.size_a, np.int64)
        block, number = Block(t), TaskContext.get().partitionId() << 32
        own: list = []

        def rows(kind: str, arrays: list, made: dict, count: int):
            """Rows of one kind; what the kind does not have is null."""
            made = [made.get(n, pa.nulls(count, type_)) for n, type_ in arrow.items()]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([kind] * count), *made], [*keep, "kind", *arrow])

        def lists(sizes, values, type_):
            return pa.ListArray.from_arrays(pa.array(_starts(sizes), pa.int32()), pa.array(values, type_))

        def single(kind: str, **values):
            return rows(kind, own, {n: pa.array([v], arrow[n]) for n, v in values.items()}, 1)

        for batch in batches:
            own = own or [pa.nulls(1, batch.column(i).type) for i in range(len(keep))]
            texts = batch.column(len(keep)).to_pylist()
            for start, stop in _runs(texts, RUN_CHARS):
                chunks = [cut(x) for x in texts[start:stop]]
                block.add(list(set().union(*chunks).difference(block.number)))
                block.chars += sum(len(x or "") for x in texts[start:stop])
                sums, digests, sizes, codes, times = block.documents(chunks, vector)
                made = {n: pa.array(v) for n, v in zip(NUMBERS, sums, strict=False)}
                made |= {"block": pa.array(np.full(stop - start, number)), "groups_sha256": pa.array(digests, pa.string())}
                made |= {"codes": lists(sizes, codes, pa.int32()), "times": lists(sizes, times, pa.int32())}
                yield rows("document", [batch.column(i).slice(start, stop - start) for i in range(len(keep))], made, stop - start)
                if block.full():
                    yield single("pairs", block=number, keys=list(block.pairs), holders=block.holders)
                    block, number = Block(t), number + 1
        if own:
            yield single("pairs", block=number, keys=list(block.pairs), holders=block.holders)
            yield single("vector", holders=vector)

    return kept.mapInArrow(run, ", ".join(schema))


def _summed(size_a: int, vector: np.ndarray, highest: np.ndarray, keep: list[str]):
    """Per block: the sums of documents from the counts of their codes."""

    def run(docs, pairs):
        import pyarrow as pa

        code, count = pairs["code"].to_numpy(), pairs["n"].to_numpy()
        # counts by code: A ids first, then the block's pairs
        counts = np.append(vector, np.zeros(int(code.max(initial=-1)) + 1, np.int64))
        top = np.append(vector == highest, np.zeros(len(counts) - size_a, bool))
        counts[size_a + code] = count
        top[size_a + code] = count == highest[pairs["a"].to_numpy()]
        lists, often = docs["codes"].combine_chunks(), docs["times"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        codes, times = lists.flatten().to_numpy(), often.flatten().to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        total = np.append(0, np.cumsum(times * counts[codes]))
        best = np.append(0, np.cumsum(times * top[codes]))
        made = {"n_best": best[ends] - best[ends - sizes], "count_sum": total[ends] - total[ends - sizes]}
        out = {c: docs[c] for c in [*keep, "n_a", "n_b", "n_groups", "n_links"]}
        out |= {n: pa.array(v, pa.int64()) for n, v in made.items()}
        return pa.table(out | {"groups_sha256": docs["groups_sha256"]})

    return run


def align(docs: DataFrame, path_a: str, path_b: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and each document's counts, sums over links and digest of groups."""
    if clash := set(keep) & {f.split()[0] for f in RESULTS.split(", ")}:
        raise ValueError(f"columns {sorted(clash)} have the name of a result")
    scratch = Scratch(docs.sparkSession)
    t = Tokenizers(path_a, path_b)
    size_a, wide = t.size_a, t.size_b
    # kept columns under names of their own, so that any name can be kept
    inner = [f"k{i}" for i in range(len(keep))]
    kept = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner, strict=True)], F.col(f"`{text}`").alias("body"))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)]]
    every = scratch.save(_aligned(kept, inner, path_a, path_b), "aligned")
    lists = every.where("kind = 'pairs'").select("block", F.posexplode(F.arrays_zip("keys", "holders")).alias("code", "p"))
    pairs = lists.select(F.col("block").alias("part"), "code", F.col("p.keys").alias("key"), F.col("p.holders").alias("held"))
    counts = scratch.save(pairs.groupBy("key").agg(F.sum("held").alias("n")), "counts")
    # one number for each A id
    vector = np.zeros(size_a, np.int64)
    held = every.where("kind = 'vector'").select(F.posexplode("holders").alias("a", "n"))
    for r in held.groupBy("a").agg(F.sum("n").alias("n")).where("n > 0").collect():
        vector[r.a] = r.n
    highest = vector.copy()
    of_a = counts.groupBy(F.floor(F.col("key") / wide).cast("int").alias("a")).agg(F.max("n").alias("n"))
    for r in of_a.collect():
        highest[r.a] = max(highest[r.a], r.n)
    known = pairs.join(counts, "key").select("part", "code", F.expr(f"CAST(key DIV {wide} AS INT)").alias("a"), "n")
    own = every.where("kind = 'document'").drop("kind", "keys", "holders")
    schema = ", ".join([*types, RESULTS])
    out = (
        own.groupBy("block")
        .cogroup(known.groupBy("part"))
        .applyInArrow(_summed(size_a, vector, highest, inner), schema)
    )
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)], *out.columns[len(keep) :])


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_cross_alignment(spark, sf_dir) -> DataFrame:
    """Every document's tokens of the byte-level and the piece vocabulary, aligned."""
    return align(table(spark, sf_dir, "documents"), *vocabularies(), ["doc_id"])
