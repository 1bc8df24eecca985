"""SentencePiece BPE through tables of distinct chunks.

In the vocabulary no piece holds a white-space marker behind another character, so no piece
crosses the place before a run of markers, and a text is cut there into chunks: a run of markers
and the characters up to the next one.  Each block of texts has a table of its distinct chunks.
Every chunk of the table is segmented once; its ids, their number and their decoded text are then
joined back to the texts by position.  The table outlives its block and only new chunks are added,
until it has ``TABLE_CHUNKS`` of them or ``TABLE_CHARS`` characters and starts anew, which costs time and nothing else.

A chunk's pieces are merged by score, the best pair first and the leftmost of equal ones.  Chunks
of up to ``WIDTHS[-1]`` characters stand side by side as rows of a matrix and take one merge each
in a round; longer ones keep their pairs in a heap, so that a text without any white space takes
n log n steps.  Characters that are no piece become the byte pieces of their UTF-8 form.

The vocabulary is a public tokenizer's file, whose path is a parameter.  A vocabulary with a piece
that crosses a marker, with pieces taken whole from the text or with a normalization of its own is
refused, because chunks would not be independent.

Defined results: a null or empty text has no ids and decodes to the empty text; U+2581 in a text
is a white-space marker and decodes to a blank, as the library has it; names of control pieces
inside a text are ordinary text; repeated rows each get their result; an empty table gives none;
other columns are not read, but a kept column with the name of a result is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tallyloom.llm.common import table

MARK = "▁"
WIDTHS = (8, 16, 32, 64)
MATRIX_ROWS = 50_000
TABLE_CHUNKS = 1_000_000
TABLE_CHARS = 32_000_000
BLOCK_CHARS = 4_000_000

CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """Pieces of a model file: ids, ranks by score, and what each id decodes to.

    A symbol is a piece's id, or ``base`` plus the code point of a character that is no piece.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = spec.SentencePiece
        norm = spec.normalizer_spec
        plain = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        byte_ids = [i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE]
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError(f"{path} changes texts before they are cut")
        if len(byte_ids) != 256 or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError(f"{path} needs byte pieces, and no unused or user-defined ones")
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError(f"{path} has pieces that cross a white-space marker")
        self.ids = plain
        self.base = len(spec.pieces)
        self.bytes = [0] * 256
        for i in byte_ids:
            self.bytes[int(spec.pieces[i].piece[1:-1], 16)] = i
        self.decoded = {i: p.replace(MARK, " ").encode() for p, i in plain.items()}
        self.decoded |= {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.symbol_of = np.arange(0x110000, dtype=np.int32) + self.base
        for piece, i in plain.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        self._rules([(p.piece, p.score) for p in spec.pieces if p.type == kinds.NORMAL])

    def _rules(self, scored: list[tuple[str, float]]) -> None:
        """Every pair of symbols that makes a piece, with its rank; equal scores share theirs."""
        order = {s: rank for rank, s in enumerate(sorted({s for _, s in scored}, reverse=True))}
        self.none = len(order)
        self.rule: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, score in scored:
            for i in range(1, len(piece)):
                left, right = self._symbol(piece[:i]), self._symbol(piece[i:])
                if left >= 0 and right >= 0:
                    self.rule[left, right] = (order[score], self.ids[piece])
        pairs = np.array(list(self.rule), np.int64).reshape(-1, 2)
        found = np.array(list(self.rule.values()), np.int64).reshape(-1, 2)
        self.wide = self.base + 0x110000
        keys = pairs[:, 0] * self.wide + pairs[:, 1]
        by_key = np.argsort(keys)
        self.keys = keys[by_key]
        self.rank, self.made = found[by_key, 0].astype(np.int32), found[by_key, 1].astype(np.int32)

    def _symbol(self, piece: str) -> int:
        return int(self.symbol_of[ord(piece)]) if len(piece) == 1 else self.ids.get(piece, -1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of pairs of symbols and what they make; a negative symbol is in no pair."""
        key = left.astype(np.int64) * self.wide + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank[at], np.int32(self.none)), self.made[at]

    def segment(self, chunks: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(Number of the chunk, its symbols) of every chunk, in no fixed order."""
        sizes = np.array([len(c) for c in chunks], np.int64)
        least = 0
        for width in WIDTHS:
            some = np.flatnonzero((sizes > least) & (sizes <= width))
            for i in range(0, len(some), MATRIX_ROWS):
                part = some[i : i + MATRIX_ROWS].tolist()
                yield from zip(part, self._in_matrix([chunks[j] for j in part], width), strict=True)
            least = width
        for j in np.flatnonzero(sizes > least).tolist():
            yield j, self._in_heap(chunks[j])

    def _in_matrix(self, chunks: list[str], width: int) -> list[list[int]]:
        """One merge for each chunk in a round: argmin finds the leftmost of its best pairs."""
        n = len(chunks)
        live = np.array([len(c) for c in chunks], np.int64)
        points = np.array(chunks, f"<U{width}").view(np.uint32).reshape(n, width)
        place = np.arange(width)
        symbols = np.where(place < live[:, None], self.symbol_of[points], np.int32(-1))
        ranks, made = self._ranks(symbols[:, :-1], symbols[:, 1:])
        out = np.full((n, width), -1, np.int32)
        row = np.arange(n)
        while True:
            at = ranks.argmin(axis=1)
            mine = np.arange(len(row))
            going = ranks[mine, at] < self.none
            out[row[~going]] = symbols[~going]
            if not going.any():
                break
            if not going.all():
                row, at, symbols, ranks, made = row[going], at[going], symbols[going], ranks[going], made[going]
                mine = mine[: len(row)]
            symbols[mine, at] = made[mine, at]
            # close the gap that the right symbol leaves
            later = place[None, :-1] > at[:, None]
            symbols[:, :-1] = np.where(later, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            for values, nothing in ((ranks, self.none), (made, 0)):
                values[:, :-1] = np.where(later[:, :-1], values[:, 1:], values[:, :-1])
                values[:, -1] = nothing
            for i, some in ((at - 1, at > 0), (at, at < width - 1)):
                here, i = mine[some], i[some]
                ranks[here, i], made[here, i] = self._ranks(symbols[here, i], symbols[here, i + 1])
        live = (out >= 0).sum(axis=1).tolist()
        return [s[:k] for s, k in zip(out.tolist(), live, strict=True)]

    def _in_heap(self, chunk: str) -> list[int]:
        """Merges of a long chunk; entries whose pair has changed since are passed over."""
        symbols = self.symbol_of[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)].tolist()
        end = len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def note(i: int) -> None:
            j = after[i]
            if j < end and (found := self.rule.get((symbols[i], symbols[j]))):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(end - 1):
            note(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if j == end or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            note(i)
            if before[i] >= 0:
                note(before[i])
        return [s for s in symbols if s >= 0]

    def ids_of(self, symbol: int) -> list[int]:
        """The symbol's id, or the byte pieces of a character that is no piece."""
        if symbol < self.base:
            return [symbol]
        return [self.bytes[b] for b in chr(symbol - self.base).encode()]

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, the blank put first is left out."""
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")


class _Named(dict):
    """Values by key, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


def cut(text: str) -> list[str]:
    """Chunks of a text in order; joined they are the text with its blanks as markers, one put first."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class ChunkTable:
    """Distinct chunks of the texts so far: ids, their number and their decoded text, by the chunk's number.

    Ids are kept as decimal text, so that a large table is no load for Python's garbage collector.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        # a character's byte pieces are whole, so symbols decode one by one
        self.id_text = _Named(lambda s: ",".join(map(str, pieces.ids_of(s))))
        self.text = _Named(lambda s: b"".join(pieces.decoded[i] for i in pieces.ids_of(s)).decode())
        self._empty()

    def _empty(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[str] = []
        self.counts: list[int] = []
        self.decoded: list[str] = []
        self.chars = 0

    def add(self, chunks: set[str]) -> None:
        """Put chunks in; one that is there already is not segmented again."""
        if len(self.ids) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self._empty()
        new = list(chunks.difference(self.number))
        for i, symbols in self.pieces.segment(new):
            ids = ",".join(map(self.id_text.__getitem__, symbols))
            self.number[new[i]] = len(self.ids)
            self.ids.append(ids)
            self.counts.append(ids.count(",") + 1)
            self.decoded.append("".join(map(self.text.__getitem__, symbols)))
            self.chars += len(new[i])

    def at(self, chunks: list[str]) -> tuple[int, str, str]:
        """Number of ids, ids and decoded text of chunks in their order."""
        places = list(map(self.number.__getitem__, chunks))
        return (
            sum(map(self.counts.__getitem__, places)),
            ",".join(map(self.ids.__getitem__, places)),
            "".join(map(self.decoded.__getitem__, places)).removeprefix(" "),
        )


def blocks(texts: list[str], chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about so many characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_texts(texts: list[str], known: ChunkTable) -> Iterator[tuple[int, str, str]]:
    """For each text the number of its ids, the ids with commas between, and what they decode to."""
    for run in blocks(texts):
        chunks = [cut(t) for t in run]
        known.add(set().union(*chunks))
        yield from map(known.at, chunks)


RESULTS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """``keep`` columns plus ``n_tokens`` and digests of ids and decoded text; ``with_ids`` adds both themselves."""
    results = ({"ids": "array<int>", "decoded": "string"} if with_ids else {}) | RESULTS
    if clash := set(keep) & set(results):
        raise ValueError(f"columns {sorted(clash)} have the name of a result")
    columns = keep if text in keep else [*keep, text]
    kept = docs.select(*[f"`{c}`" for c in columns])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep]
    schema = ", ".join([*fields, *[f"{n} {t}" for n, t in results.items()]])
    body = columns.index(text)

    def run(batches):
        import pyarrow as pa

        known = ChunkTable(Pieces(path))
        types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
        for batch in batches:
            out: dict[str, list] = {n: [] for n in results}
            texts = [t or "" for t in batch.column(body).to_pylist()]
            for n, ids, decoded in encode_texts(texts, known):
                out["n_tokens"].append(n)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append([int(i) for i in ids.split(",") if i])
                    out["decoded"].append(decoded)
            arrays = [batch.column(columns.index(c)) for c in keep]
            arrays += [pa.array(v, types.get(n, pa.string())) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *out])

    return kept.mapInArrow(run, schema)


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark, sf_dir) -> DataFrame:
    """Every document encoded and decoded with the piece vocabulary."""
    return encode(table(spark, sf_dir, "documents"), piece_vocabulary(), ["doc_id"])
