"""Operators that work row by row or by key: sharding, chat, secrets, tokens, top-k."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from check_oracles import compare
from tokenizers import Tokenizer

from tallyloom.llm import bpe, chat, secret_scan, sharding, topk
from tallyloom.llm.common import Scratch


def test_jump_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 20000, np.uint64)
    for n in (1, 2, 24):
        old, new = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        moved = old != new
        assert (new[moved] == n).all()
        assert abs(moved.mean() - 1 / (n + 1)) < 0.02
        assert old.max() < n


@pytest.mark.parametrize("rows", [3, 10_000])
def test_shards_of_nasty_rows(nasty, monkeypatch, rows):
    monkeypatch.setattr(sharding.with_slots, "__defaults__", (rows,))
    texts = [(r.doc_id, r.text) for r in nasty.collect()]
    got = sharding.shard_documents(nasty, 4).toPandas()
    expected = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in texts)
    assert sorted(zip(got["size"], got["text_crc32"], strict=True)) == expected
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert (got["grown_shard"].eq(got["shard"]) | got["grown_shard"].eq(4)).all()
    assert got.groupby("doc_id", dropna=False)["shard"].nunique().max() == 1


def test_shards_of_nothing(nothing):
    assert sharding.shard_documents(nothing).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in rng.integers(-2, 3, (60, 6)) / 4]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7]), (60, None), (61, [1.0, None]), (62, [float("nan")])]
    rows += [(63, [float("inf")]), (64, []), (65, [0.3]), (66, [1e30])]
    df = spark.createDataFrame(rows, "id0 long, v array<double>")
    q = topk.quantized(df, "id0", "v")
    got = topk.top_k(q, q.where("id % 5 = 0"), k=4, candidate_block=9, query_block=4).collect()
    usable = [(i, np.floor(256 * np.array(v))) for i, v in rows if v is not None and i not in (61, 62, 63, 66)]
    expected = []
    for i, a in usable:
        if i % 5 == 0:
            scored = []
            for j, b in usable:
                n = min(len(a), len(b))
                if i != j:
                    scored.append((-int(a[:n] @ b[:n]), j))
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:4])]
    assert sorted(map(tuple, got)) == sorted(expected)
    none = topk.quantized(df.limit(0), "id0", "v")
    assert topk.top_k(none, none).count() == 0


def test_top_k_of_large_components(spark):
    import duckdb

    small = [(i, [float(i % 7) - 3, 0.25 * i]) for i in range(40)]
    # 8388608 * 256 is 2 ** 31; with 150 the sums are estimated beyond the 64-bit range but fit
    rows = [*small, (50, [8388608.0, 1.0]), (51, [-9e6, 2e6]), (52, [1e7, -1e7]), (100, [3e6, 3e6]), (150, [1e12, 1e12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = topk.quantized(df, "vec_id", "embedding")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows[:-1])
    got = topk.top_k(q.where("id <> 150"), q.where("id % 50 = 0 AND id <> 150"), candidate_block=9, query_block=2)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(topk.ORACLE).fetchall())
    assert {50, 51, 52} & {r.vec_id for r in got.collect()}
    ids = {r.vec_id: r.score for r in topk.top_k(q.where("id IN (39, 52, 150)"), q.where("id = 150")).collect()}
    v39 = [int(256 * x) for x in small[39][1]]
    assert ids == {52: 0, 39: 256 * 10**12 * sum(v39)}


def test_top_k_matches_sql(spark, sf_dir, con):
    assert compare(topk.op4_exact_topk(spark, sf_dir), con, topk.ORACLE) is None


TRICKY = ["", "plain", r"\### Assistant: </turn> ok", "a\\", "### x:\n</turn>\n", "<image> \\<image>", "x:\ny", ":\n", "</turn>", "\\\\###"]


def test_formatted_turns_read_back():
    whole, expected = "", []
    for role in ("user", "assistant", "we:\nird\\", ""):
        for text in TRICKY:
            body, _ = chat.flatten([{"type": "text", "text": text}])
            whole += chat.wrap(role, body)
            expected.append((role, text))
    got = [(r, "".join(p["text"] for p in parts)) for r, parts, _ in chat.read_back(whole)]
    assert got == expected


def test_parts_become_placeholders_in_order():
    parts = [
        {"type": "text", "text": "see <image>"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15},
        {"type": "audio", "ref": "b.wav", "seconds": 2.01}, {"type": "document", "ref": "c.pdf", "pages": 3},
    ]
    text, found = chat.flatten(parts)
    assert text == r"see \<image><image><audio><document>"
    assert [(k, r, n) for k, r, _, n in found] == [("image", "a.png", 4), ("audio", "b.wav", 51), ("document", "c.pdf", 1500)]
    assert all(text[at:].startswith(f"<{k}>") for k, _, at, _ in found)
    (role, back, _), = chat.read_back(chat.wrap("user", text))
    assert [p["type"] for p in back] == ["text", "image", "audio", "document"] and back[0]["text"] == "see <image>"
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])


def test_conversations_against_their_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], TRICKY[t]) for t in range(len(TRICKY))]
    rows += [(2, 0, None, None), (None, 0, "assistant", "x"), (1, 3, "assistant", "tie"), (1, 3, "assistant", "tie"), (3, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(chat.text_parts(df))).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        turns = [(t, ro or "", x or "") for c, t, ro, x in rows if c == conv]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], chat.escape(t[2]) + chat.TURN_END))
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{b}\n{c}\n" for _, b, c in turns).encode()).hexdigest()
        learnt = "".join(c for _, b, c in turns if b == "assistant")
        assert r.loss_chars == len(learnt)
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.wrap(b, chat.escape(c))) for _, b, c in turns)


def test_secrets_match_sql(spark, nasty, tmp_path):
    import duckdb

    docs = nasty.select("doc_id", "text").where("doc_id IS NOT NULL").distinct()
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert compare(secret_scan.op9_secret_scan(spark, str(tmp_path)), con, secret_scan.ORACLE) is None
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.secrets_by_document(docs).collect()}
    assert got[14] == [("assign", 0, 19), ("access", 25, 49), ("hex", 52, 84)]
    assert got[15] == [("assign", 11, 28)]


def test_secrets_of_nasty_rows(nasty, nothing):
    assert secret_scan.secrets_by_document(nasty).count() == nasty.count()
    assert secret_scan.secrets_by_document(nothing).count() == 0


def test_only_unseen_pairs_are_scanned(spark):
    v1 = spark.createDataFrame([("a", "token=abcdef1"), ("b", "token=abcdef1"), ("c", "x")], "p string, t string")
    v2 = spark.createDataFrame([("a", "password: qwertz99"), ("d", "x"), ("e", "token=abcdef1")], "p string, t string")
    first = secret_scan.versions_of(v1, "p", "t")
    _, ledger = secret_scan.scan(first)
    assert ledger.count() == 2 * len(secret_scan.RULES)
    both = first.unionByName(secret_scan.versions_of(v2, "p", "t"))
    found, fresh = secret_scan.scan(both, ledger=ledger)
    assert fresh.select("blob").distinct().count() == 1 and fresh.count() == len(secret_scan.RULES)
    hits = both.join(found, "blob").select("path").collect()
    assert sorted(r.path for r in hits) == ["a", "a", "b", "e"]
    newer = (*secret_scan.RULES[:2], secret_scan.Rule("hex", "[0-9a-f]{8,}", version=2))
    _, again = secret_scan.scan(both, rules=newer, ledger=ledger.unionByName(fresh))
    assert {(r.kind, r.version) for r in again.collect()} == {("hex", 2)} and again.count() == 3


def test_redaction(spark):
    from pyspark.sql import functions as F

    rows = [("é password=abcdef0123456789abcdef0123 tail", 1), ("clean", 2)]
    docs = spark.createDataFrame(rows, "text string, doc_id long")
    spans = secret_scan.secrets_by_document(docs)
    got = docs.join(spans, "doc_id").orderBy("doc_id").select(secret_scan.redacted(F.col("text"), F.col("spans")).alias("t"))
    assert [r.t for r in got.collect()] == ["é [SECRET] tail", "clean"]


def test_no_python_in_the_secret_scan(spark, sf_dir):
    plan = secret_scan.op9_secret_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_tokens_equal_the_library(nasty, nothing):
    path = bpe.word_vocabulary()
    library = Tokenizer.from_file(path)
    rows = {r.doc_id: r.text or "" for r in nasty.where("doc_id IS NOT NULL").collect()}
    got = bpe.encode(nasty, path, ["doc_id", "n"], with_ids=True).collect()
    assert len(got) == nasty.count()
    for r in got:
        if r.doc_id is None:
            continue
        ids = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.ids == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(nothing, path, ["doc_id"]).count() == 0


def test_tokens_of_every_token_and_odd_characters(monkeypatch):
    path = bpe.word_vocabulary()
    library, v = Tokenizer.from_file(path), bpe.Vocabulary(path, bpe.newer_characters(path))
    rng = np.random.default_rng(5)
    names = list(v.ids)
    texts = [" ".join(rng.choice(names, 300)) for _ in range(30)]
    texts += ["".join(chr(c) for c in rng.integers(*r, 300)) for r in [(32, 0x600), (0x1E00, 0x2C00)] * 15] + ["aaaa" * 50, "abab" * 50]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3000)  # the store starts anew on the way
    got = [ids for i in range(0, len(texts), 7) for ids in bpe.encode_texts(texts[i : i + 7], v, {})]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert all(bpe.decode(ids, v) == library.decode(ids, skip_special_tokens=False) for ids in got)


def test_scratch_tables_can_be_dropped(spark):
    scratch = Scratch(spark)
    saved = scratch.save(spark.range(3), "x")
    assert saved.count() == 3
    scratch.drop(saved)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{scratch.root}/1-x").count()
