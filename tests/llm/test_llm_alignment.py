"""Cross-tokenizer alignment against a plain version over all links."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from tallyloom.llm import alignment

A, B = alignment.vocabularies()


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(A, B)


@lru_cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(text):
    """Whole-text ids of both libraries with each token's bytes; none if bytes differ from blank and text."""
    if not text:
        return [], []
    a, b = libraries()
    values = alignment.byte_values()
    ta = [(i, bytes(values[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        tb.append((i, bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    whole = [b"".join(raw for _, raw in side) == want for side in (ta, tb)]
    return (ta, tb) if all(whole) else ([], [])


def plain_groups(ta, tb):
    ends = [set(np.cumsum([len(raw) for _, raw in side]).tolist()) for side in (ta, tb)]
    cuts, out = sorted(ends[0] & ends[1]), []
    sides = []
    for side in (ta, tb):
        at, parts = 0, [[] for _ in cuts]
        for i, raw in side:
            at += len(raw)
            parts[bisect_left(cuts, at)].append(i)
        sides.append(parts)
    for xs, ys in zip(*sides, strict=True):
        out.append((xs, ys))
    return out


def brute_force(texts):
    """Result columns of each text."""
    docs = []
    for text in texts:
        ta, tb = plain_tokens(text)
        docs.append((ta, tb, plain_groups(ta, tb)))
    links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for _, _, g in docs]
    count = Counter(p for c in links for p in c)
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    rows = []
    for (ta, tb, g), c in zip(docs, links, strict=True):
        shown = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in g)
        best = sum(n for p, n in c.items() if count[p] == highest[p[0]])
        total = sum(n * count[p] for p, n in c.items())
        digest = hashlib.sha256(shown.encode()).hexdigest() if ta else ""
        rows.append((len(ta), len(tb), len(g), c.total(), best, total, digest))
    return rows


FIELDS = [f.split()[0] for f in alignment.RESULTS.split(", ")]


def test_cutting_changes_nothing(tokenizers):
    """Chunk by chunk both tokenizers give the ids of the whole text."""
    r = random.Random(3)
    letters = "ab  \n\t\r\0é漢😀́　xX<>0s'/\xa0\x85\x1cß�"
    for _ in range(3000):
        text = "".join(r.choices(letters, k=r.choice([1, 2, 5, 30, 90]))) + r.choice(["", "'ll", " <|endoftext|>", "</s>"])
        chunks = alignment.cut(text)
        assert "".join(chunks) == " " + text and all(c[0] == " " for c in chunks)
        a, b = tokenizers.encode(chunks)
        assert sum(a, []) == tokenizers.a.encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == tokenizers.b.encode(text)


def test_identity_map(tokenizers):
    values = alignment.byte_values()
    for name, i in tokenizers.a.get_vocab(with_added_tokens=False).items():
        same = int(tokenizers.identity[i])
        assert same < 0 or tokenizers.bytes_b[same] == bytes(values[c] for c in name)
    assert (tokenizers.identity >= 0).sum() > 10_000


@pytest.mark.parametrize("chars", [alignment.BLOCK_CHARS, 300])
def test_nasty_rows(monkeypatch, nasty, nothing, chars):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", chars)
    texts = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    want = sorted((str(i), *row) for (i, _), row in zip(texts, brute_force([t for _, t in texts]), strict=True))
    got = alignment.align(nasty, A, B, ["doc_id", "n", "k1", "score"]).collect()
    assert sorted((str(r.doc_id), *[r[f] for f in FIELDS]) for r in got) == want
    assert alignment.align(nothing, A, B, ["doc_id"]).count() == 0


def test_odd_texts(spark):
    texts = ["a▁b", "▁", " ", "  x", "a \n b", "a\n\n  b\t", "x" * 3000, "<|endoftext|></s>", "'s 'S don't", "ababa\0", "", None, " " * 500]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in alignment.align(frame, A, B, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == brute_force(texts)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], brute_force([d.text for d in docs]), strict=True))
    got = alignment.op13_cross_alignment(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: tuple(r[f] for f in FIELDS) for r in got} == want
