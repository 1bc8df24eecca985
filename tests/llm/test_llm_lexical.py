"""Ranked lexical search against brute force and SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def brute_force(docs, items, k):
    """(item id, rank, doc_id, score), sorted."""
    counts = [(i, words(t)) for i, t in docs]
    counts = [(i, w, Counter(w)) for i, w in counts if w]
    n_docs, total = len(counts), sum(len(w) for _, w, _ in counts)
    df = Counter(t for _, _, c in counts for t in c)
    rows = []
    for item, text in items:
        found = []
        for doc, every, c in counts:
            m = 50 + (50 * len(every) * n_docs) // total
            score = 0
            for t in set(words(text)) & set(c):
                w = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        for r, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            rows.append((item, r, doc, -score))
    return sorted(rows, key=str)


def collected(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


def test_terms():
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choices("aZ9 é漢\0\x7f\x80_@[`{/:-ſK ", k=40))
        assert [t.decode() for t in lexical.terms(text)] == words(text)
    assert lexical.terms(None) == lexical.terms("") == lexical.terms("-- \n") == []


@pytest.mark.parametrize("lookup", [lexical.LOOKUP_TERMS, -1])
def test_nasty_rows(monkeypatch, spark, nasty, lookup):
    monkeypatch.setattr(lexical, "LOOKUP_TERMS", lookup)
    monkeypatch.setattr(lexical, "TILE_POSTINGS", 40)
    monkeypatch.setattr(lexical, "SHELF_POSTINGS", 60)
    monkeypatch.setattr(lexical, "TILE_DOCS", 2)
    monkeypatch.setattr(lexical, "TILE_ITEMS", 2)
    monkeypatch.setattr(lexical, "TILE_TERMS", 5)
    docs = [(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()]
    asked = [(1, docs[0][1]), (2, "one TWO two"), (3, None), (4, "...") , (5, "absent"), (6, docs[5][1]), (None, "token abc"), (8, "password = hunter22 é")]
    items = spark.createDataFrame([(i, t, 0, "x") for i, t in asked], "item_id long, text string, rank int, score string")
    for k in (1, 3, 50):
        assert collected(lexical.rank(nasty, items, k)) == brute_force(docs, asked, k)


def test_repeated_items_and_empty_tables(spark, nasty, nothing):
    items = spark.createDataFrame([(1, "one two"), (1, "one two")], "item_id long, text string")
    rows = collected(lexical.rank(nasty, items, 2))
    assert len(rows) == 4 and len(set(rows)) == 2
    assert lexical.rank(nothing, items).count() == 0
    assert lexical.rank(nasty, items.where("false")).count() == 0


def test_ties_over_tiles(monkeypatch, spark):
    """Hundreds of equal documents in many tiles: the smallest ids win."""
    monkeypatch.setattr(lexical, "TILE_POSTINGS", 30)
    ids = random.Random(2).sample(range(1000), 600)
    docs = spark.createDataFrame([(i, "same words here") for i in ids] + [(5000, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "words same")], "item_id long, text string")
    got = [r.doc_id for r in lexical.rank(docs, items).orderBy("rank").collect()]
    assert got == sorted(ids)[:50]


def test_products_are_exact():
    """Sums far beyond 2^53 stay exact, as no vocabulary tile reaches it."""
    r = np.random.default_rng(3)
    width = 400
    weight = r.integers(1, 28_000, (3, width)) * 50_000
    impact = r.integers(1, 1_000_000, (5, width))
    step = lexical.term_tile(int(weight.max()), int(impact.max()))
    assert step * int(weight.max()) * int(impact.max()) < lexical.EXACT and step < 10

    def triples(m):
        term, row = np.divmod(np.arange(m.size), len(m))
        return row, term, m[row, term].astype(float)

    got = lexical.products(triples(weight), triples(impact), 3, 5, width, step)
    assert (got == weight @ impact.T).all() and got.max() > lexical.EXACT


def test_query_equals_sql(spark, sf_dir, con):
    want = sorted(con.execute(lexical.ORACLE).fetchall(), key=str)
    assert collected(lexical.op12_ranked_search(spark, sf_dir)) == want
