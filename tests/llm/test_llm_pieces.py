"""SentencePiece by tables of distinct chunks, against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import pytest

from tallyloom.llm import pieces

PATH = pieces.piece_vocabulary()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(PATH)


def expected(library, text):
    ids = library.encode(text)
    return len(ids), ",".join(map(str, ids)), library.decode(ids)


def test_random_texts(library, vocabulary):
    r = random.Random(5)
    letters = "abth ▁\n\t\0é漢😀́　xX<>0s /\\'\"�\xa0ß"
    texts = ["".join(r.choices(letters, k=r.choice([1, 2, 9, 40, 300]))) for _ in range(3000)]
    known = pieces.ChunkTable(vocabulary)
    got = list(pieces.encode_texts(texts, known))
    assert got == [expected(library, t) for t in texts]
    for t, (_, ids, decoded) in zip(texts, got, strict=True):
        assert vocabulary.decode(map(int, ids.split(","))) == decoded == t.replace("▁", " ")


@pytest.mark.parametrize("text", ["x" * 50_000, " " * 30_001 + "a", "ab" * 20_000, "<s></s><0x0A><unk>", " ", "▁", "\0\0"])
def test_long_and_odd_texts(library, vocabulary, text):
    known = pieces.ChunkTable(vocabulary)
    assert list(pieces.encode_texts([text], known)) == [expected(library, text)]


def test_every_width_agrees_with_the_heap(vocabulary):
    r = random.Random(6)
    chunks = ["".join(r.choices("aberstinoé 漢", k=k)).replace(" ", "▁") for k in range(1, 65) for _ in range(30)]
    for i, symbols in vocabulary.segment(chunks):
        assert symbols == vocabulary._in_heap(chunks[i])


def test_table_starts_anew(monkeypatch, library, vocabulary):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 3)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 10)
    texts = ["one two three four", "", "five one two", "one", "six seven eight one"]
    known = pieces.ChunkTable(vocabulary)
    assert list(pieces.encode_texts(texts, known)) == [expected(library, t) if t else (0, "", "") for t in texts]


def test_nasty_rows(nasty, nothing, library):
    rows = pieces.encode(nasty, PATH, ["doc_id", "score"], with_ids=True).collect()
    texts = nasty.select("doc_id", "text").collect()
    assert len(rows) == len(texts)

    def digest(i, text):
        n, ids, decoded = expected(library, text) if text else (0, "", "")
        return (str(i), n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    assert got == sorted(digest(t.doc_id, t.text) for t in texts)
    assert all(",".join(map(str, r.ids)) == (expected(library, r.decoded)[1] if r.decoded else "") for r in rows)
    assert pieces.encode(nothing, PATH, ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        pieces.encode(nasty.withColumnRenamed("score", "n_tokens"), PATH, ["n_tokens"])


def test_query(spark, sf_dir, library):
    got = {r.doc_id: r for r in pieces.op11_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, ids, decoded = expected(library, d.text) if d.text else (0, "", "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (n, hashlib.sha256(ids.encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
