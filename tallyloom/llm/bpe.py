"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a batch lie side by side in one list of symbols.  An index maps
every adjacent pair that has a merge rule to all its positions.  Active ranks are applied in
ascending order: all positions of the pair with the lowest rank merge, from left to right,
and only the lists of the pairs that they touch are updated.  A word's ids are then read off.

Words stay encoded between the batches of a task, up to ``CACHE_WORDS``; past that the store
starts anew, which costs time and nothing else.

The vocabulary is a public tokenizer's file; its path is a parameter and every executor reads
it where the package of public tokenizers is installed.

Defined results: a null or empty text has no tokens and decodes to the empty text; strings
of special tokens inside a text are those tokens, as the tokenizers library has it;
repeated rows each get
their result; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from tallyloom.llm.common import table

CACHE_WORDS = 400_000
# white space as Unicode defines it
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# letters and numbers of Latin-1
LATIN_LETTERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile(r"[\x00-\xff]*").fullmatch


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def newer_characters(path: str) -> tuple[str, dict[int, str]]:
    """What the tokenizers library knows of characters that Python's own tables lack.

    The regex module, Python and the library know different versions of Unicode.  Gives the
    letters and numbers of the regex module that the library has as neither, as ranges for a
    character class, and the lower-case forms that only the library knows.  The order of a few
    recently added combining marks still follows Python's tables.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    cut, put = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    ranges: list[list[int]] = []
    lower: dict[int, str] = {}
    for c in regex.findall(r"[\p{L}\p{N}]", every):
        if unicodedata.category(c) != "Cn":
            continue
        if put(c) != c:
            lower[ord(c)] = put(c)
        # a sign and a letter or number are two pieces, two signs are one
        if len(cut("&" + c)) == 1:
            if ranges and ord(c) == ranges[-1][1] + 1:
                ranges[-1][1] += 1
            else:
                ranges.append([ord(c), ord(c)])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) or "\\U0010ffff", lower


class Vocabulary:
    """What a tokenizer's file says: tokens, merges, and how texts are cut.

    ``newer`` is what ``newer_characters`` gives.
    """

    def __init__(self, path: str, newer: tuple[str, dict[int, str]]):
        newer, self.lower = newer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        #: left id, right id and merged id of each rank
        self.rules = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]]
        self.base = len(self.ids)
        keys = np.array([a * self.base + b for a, b, _ in self.rules], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        symbols = byte_symbols()
        self.inner = np.array([self.ids[s] for s in symbols], np.int64)
        self.last = np.array([self.ids[s + self.suffix] for s in symbols], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        for old, new in (
            (r"[^\s\p{L}\p{N}]", rf"[[^{SPACE}\p{{L}}\p{{N}}]||[{newer}]]"),
            (r"[\p{L}]", rf"[\p{{L}}--[{newer}]]"),
            (r"[\p{N}]", rf"[\p{{N}}--[{newer}]]"),
        ):
            pattern = pattern.replace(old, new)
        self.words = regex.compile(pattern, regex.V1)
        # the same over Latin-1, with its letters and numbers written out
        pattern = split["pattern"]["Regex"].replace(r"\s", SPACE)
        pattern = pattern.replace(r"\p{L}", LATIN_LETTERS).replace(r"\p{N}", LATIN_NUMBERS)
        self.plain_words = re.compile(pattern)
        names = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 for pairs without a rule or with no second symbol."""
        key = np.where(right >= 0, left * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens in order; special tokens as ids.

        Special tokens are found in the raw text; between them it is composed, its white space
        separates, and it is put in lower case letter by letter.
        """
        found: list[str | int] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                # lower() alone turns a capital sigma by its place in a word
                part = part.replace("Σ", "σ").lower()
                if _PLAIN(part):
                    found += self.plain_words.findall(part)
                else:
                    found += self.words.findall(part.translate(self.lower))
        return found


def encode_words(words: list[str], v: Vocabulary) -> list[list[int]]:
    """Ids of each word, through one pair occurrence index over all of them.

    ``sym`` holds the symbols, -1 where a symbol was merged away; ``prev`` and ``next`` link
    the live places of a word, with one place past the end for none.
    """
    data = [w.encode("utf-8") for w in words]
    sizes = np.array([len(d) for d in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    last = np.cumsum(sizes) - 1
    sym = np.append(v.inner[flat], -1)
    sym[last] = v.last[flat[last]]
    none = len(flat)
    next_, prev = np.arange(1, none + 2), np.arange(-1, none)
    next_[last] = none
    prev[last - sizes + 1] = none

    places: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(at: np.ndarray) -> None:
        """List the places whose pairs have a rank under it."""
        rank = v.ranks(sym[at], sym[next_[at]])
        known = rank >= 0
        at, rank = at[known], rank[known]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, some in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
            if r in places:
                places[r].append(some)
            else:
                places[r] = [some]
                heapq.heappush(heap, r)

    note(np.arange(none))
    while heap:
        rank = heapq.heappop(heap)
        listed = places.pop(rank)
        left, right, made = v.rules[rank]
        at = listed[0] if len(listed) == 1 else np.unique(np.concatenate(listed))
        at = at[(sym[at] == left) & (sym[next_[at]] == right)]
        if left == right and len(at) > 1:
            at = _apart(at, next_)
        if not len(at):
            continue
        gone = next_[at]
        after = next_[gone]
        sym[at], sym[gone] = made, -1
        next_[at], prev[after] = after, at
        before = prev[at]
        note(np.unique(np.concatenate([at, before[before < none]])))
    live = sym[:none] >= 0
    ids = sym[:none][live].tolist()
    ends = np.cumsum(live)[last].tolist()
    return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _apart(at: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Of overlapping pairs of one symbol with itself, those that a pass from the left takes."""
    kept, taken = [], -1
    for i, j in zip(at.tolist(), next_[at].tolist(), strict=True):
        if i != taken:
            kept.append(i)
            taken = j
    return np.array(kept, np.int64)


def encode_texts(texts: list[str], v: Vocabulary, known: dict) -> Iterator[list[int]]:
    """Ids of each text; ``known`` keeps the words of earlier calls."""
    cut = [v.pieces(t) for t in texts]
    every = set().union(*cut)
    if len(known) + len(every) > CACHE_WORDS:
        known.clear()
    known.update((i, [i]) for i in v.special.values())
    new = [p for p in every if p not in known]
    if new:
        known.update(zip(new, encode_words(new, v), strict=True))
    for pieces in cut:
        yield list(chain.from_iterable(map(known.__getitem__, pieces)))


def decode(ids, v: Vocabulary) -> str:
    """Token strings joined by blanks, as the file names no decoder."""
    return " ".join(map(v.names.__getitem__, ids))


def _chunks(texts: list[str], chars: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, so that token lists stay small."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


ENCODED = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text", with_ids: bool = False) -> DataFrame:
    """``keep`` columns plus counts and digests, and the ids themselves with ``with_ids``."""
    columns = keep if text in keep else [*keep, text]
    kept = docs.select(*[f"`{c}`" for c in columns])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep]
    body = columns.index(text)
    schema = ", ".join([*fields, *(["ids binary"] if with_ids else []), ENCODED])

    newer = newer_characters(path)

    def run(batches):
        import pyarrow as pa

        v, known = Vocabulary(path, newer), {}
        for batch in batches:
            out: dict[str, list] = {"ids": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            texts = [t or "" for t in batch.column(body).to_pylist()]
            for chunk in _chunks(texts):
                for ids in encode_texts(chunk, v, known):
                    raw = np.array(array("I", ids), "<u4").tobytes()
                    out["ids"].append(raw if with_ids else None)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decode(ids, v).encode()).hexdigest())
            arrays = [batch.column(i) for i in range(len(keep))]
            names = list(keep)
            for name, kind in (("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())):
                if name != "ids" or with_ids:
                    arrays.append(pa.array(out[name], kind))
                    names.append(name)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return kept.mapInArrow(run, schema)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark, sf_dir) -> DataFrame:
    """Every document encoded and decoded with the word vocabulary."""
    return encode(table(spark, sf_dir, "documents"), word_vocabulary(), ["doc_id"])
