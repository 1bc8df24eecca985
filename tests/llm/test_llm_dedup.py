"""Near-duplicates and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from check_oracles import compare

from tallyloom.llm import minhash, suffix
from tallyloom.llm.common import Scratch


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: find(i) for i in root}


def test_components_of_nasty_rows(spark, nasty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    expected = brute_components(rows)
    got = minhash.cluster(nasty).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == expected.get(r.doc_id)
        assert r.kept == (r.doc_id == r.component_id)
    sizes = {i: len(shingle_set(t)) for i, t in rows if i is not None}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got if r.doc_id is not None)


def test_chains_of_links_and_a_repeated_id(spark):
    """A chain whose ends are unlike each other, and one id with two texts."""
    words = [f"w{i}" for i in range(200)]
    rows = [(100 - k, " ".join(words[4 * k : 4 * k + 120])) for k in range(12)]
    rows += [(500, "a b c d e f g"), (500, "h i j k l m n"), (501, "h i j k l m n"), (499, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.cluster(docs).collect()}
    assert got == brute_components(rows)
    assert len({got[i] for i, _ in rows[:12]}) == 1 and got[501] == 499


def test_second_pass_finds_links_the_first_leader_lacks(spark):
    """Two groups that share buckets with a smaller class that is like neither."""
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base[:300]))]
    for g in range(2):
        own = base[:250] + [f"g{g}x{i}" for i in range(60)]
        for k in range(6):
            text = own[:]
            text[300] = f"edit{k}"
            rows.append((10 * (g + 1) + k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (85, 80):
        got = {r.doc_id: r.component_id for r in minhash.cluster(docs, percent).collect()}
        assert got == brute_components(rows, percent)


def test_cluster_of_nothing(nothing):
    assert minhash.cluster(nothing).count() == 0


@pytest.mark.parametrize("size", [1, 6, 60, 3000])
def test_registers_agree_as_often_as_sets_overlap(size):
    rng = np.random.default_rng(size)
    same, n = 0, 30
    for _ in range(n):
        items = np.unique(rng.integers(0, 1 << 63, 2 * size, np.uint64))
        third = max(1, size // 3)
        a, b = items[: 2 * third], items[third : 3 * third]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sizes = np.array([len(a)]), np.array([len(b)])
        same += minhash.estimate(minhash.sketch(a)[None], minhash.sketch(b)[None], *sizes)[0] - true
    assert abs(same / n) < 0.02


def brute_repeats(rows):
    seen = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        seen.update(raw[i : i + suffix.LENGTH] for i in range(len(raw) - suffix.LENGTH + 1))
    out = []
    for raw in raws:
        hits = [(i, i + suffix.LENGTH) for i in range(len(raw) - suffix.LENGTH + 1) if seen[raw[i : i + suffix.LENGTH]] > 1]
        runs = suffix.merged(hits)
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + raw[at:a], b
        kept += raw[at:]
        out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def repeats(frame):
    return sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


@pytest.mark.parametrize("run", [suffix.RUN, 1])
def test_repeats_of_nasty_rows(spark, nasty, run):
    """With one context to a run, every run takes the spread way."""
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    got = suffix.remove_repeats(nasty, run=run)
    assert repeats(got) == sorted(brute_repeats(rows))


def test_repeats_of_edited_copies(spark):
    """Many contexts of one gram: long runs, edits at all distances."""
    import random

    r = random.Random(3)
    base = "".join(r.choices("abcdefgh ", k=1500))
    rows = []
    for i in range(60):
        text = list(base[r.randrange(300) : len(base) - r.randrange(300)])
        for _ in range(r.randrange(5)):
            text[r.randrange(len(text))] = r.choice("xyz")
        rows.append((i, "".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats(suffix.remove_repeats(docs, bucket=50)) == sorted(brute_repeats(rows))


def test_repeats_of_nothing(nothing):
    assert suffix.remove_repeats(nothing).count() == 0


def test_long_texts_are_sampled_in_pieces(monkeypatch):
    raw = bytes(np.random.default_rng(1).integers(0, 4, 5000, np.uint8))
    whole = suffix.Sampler().anchors(raw)
    monkeypatch.setattr(suffix, "PIECE", 700)
    parts = suffix.Sampler().anchors(raw)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_multikey_order():
    rng = np.random.default_rng(2)
    items = [bytes(rng.integers(0, 2, rng.integers(1, 40), np.uint8) + 1) for _ in range(500)]
    order = suffix.multikey_order(items)
    assert [items[i] for i in order] == sorted(items)


def test_components_match_sql(spark, sf_dir, con):
    assert compare(minhash.op1_hyperminhash(spark, sf_dir), con, minhash.ORACLE) is None


@pytest.mark.parametrize(("percent", "stated"), [(85, "2.3e-7"), (80, "3.0e-6")])
def test_stated_chance_of_a_missed_pair(percent, stated):
    rows = minhash.band_rows(percent)
    chance = (1 - (percent / 100) ** rows) ** (minhash.BUCKETS // rows)
    assert f"{chance:.1e}".replace("e-0", "e-") == stated and chance <= minhash.MISSED
    assert stated in minhash.__doc__


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefg", k=r.randint(3, 8))) for _ in range(n))


def looked_at(monkeypatch, docs):
    """Pairs that each pass estimates, and the rows of the result."""
    made = []
    before = minhash.Links.likely

    def likely(self, pairs):
        made.append(pairs.count())
        return before(self, pairs)

    monkeypatch.setattr(minhash.Links, "likely", likely)
    rows = minhash.cluster(docs).collect()
    monkeypatch.setattr(minhash.Links, "likely", before)
    return made, rows


def test_documents_that_share_a_passage_form_few_pairs(monkeypatch, spark):
    """Two thirds in common, no link: pairs grow no faster than documents."""
    shared = passage(900, 100)
    found = {}
    for count in (200, 400):
        texts = [(i, f"{passage(1000 + i, 25)} {shared} {passage(5000 + i, 25)}") for i in range(count)]
        made, rows = looked_at(monkeypatch, spark.createDataFrame(texts, "doc_id long, text string"))
        assert all(r.kept for r in rows) and len(rows) == count
        found[count] = made
    assert found[400][1] <= 2 * max(1, found[200][1]) and sum(found[400]) <= 48 * 400


@pytest.mark.parametrize("first", [0, 10_000])
def test_edited_copies_below_the_threshold_form_few_pairs(monkeypatch, spark, first):
    """Copies with one to four edits, wherever their text's doc_id stands: pairs grow as documents do."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(first, " ".join(base))]
    for i in range(1, 401):
        text = base[:]
        for at in r.sample(range(150), 1 + i % 4):
            text[at] = f"e{i}x{at}"
        rows.append((i, " ".join(text)))
    found = {}
    for count in (201, 401):
        made, got = looked_at(monkeypatch, spark.createDataFrame(rows[:count], "doc_id long, text string"))
        assert {x.doc_id: x.component_id for x in got} == brute_components(rows[:count])
        found[count] = made
    assert sum(found[401]) <= 2.5 * sum(found[201]) and sum(found[401]) <= 8 * 401


def test_rare_pairs_hold_every_link(spark, tmp_path):
    """Against all pairs, with sets around the threshold and items in many sets."""
    r = random.Random(8)
    common = r.sample(range(1, 10**6), 60)
    sets = {}
    for i in range(80):
        if i % 4:
            base = list(sets[r.randrange(i // 4 * 4)] if i >= 4 else common)
            gone = set(r.sample(base, r.randint(0, len(base) // 5)))
            sets[i] = set(base) - gone | set(r.sample(range(1, 10**6), r.randint(0, 9)))
        else:
            sets[i] = set(common[: r.randint(10, 60)]) | set(r.sample(range(1, 10**6), r.randint(1, 20)))
    frame = spark.createDataFrame(
        [(i, np.array(sorted(x), np.uint64).tobytes()) for i, x in sets.items()], "id long, items binary"
    )
    root = spark.createDataFrame([(i, i, [i, 7]) for i in sets], "id long, root long, bands array<long>")
    got = {tuple(x) for x in minhash.rare_pairs(frame, root, 85, Scratch(spark)).collect()}
    want = {
        (i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    }
    assert want and want <= got and len(got) < 80 * 79 / 2
