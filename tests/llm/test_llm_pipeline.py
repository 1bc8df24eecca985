"""Stages of the corpus pipeline on rows with clashing columns, and the pipeline as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_clashing_columns(spark, nasty, nothing, sf_dir):
    """Each stage takes further columns of any name, and tables without n_chars."""
    docs = nasty.drop("n_chars").select(
        "*", F.lit("own").alias("_spans"), F.lit("b").alias("_blob"), F.lit("n").alias("_new"), F.lit(7).alias("ids"), F.lit("t").alias("n_tokens")
    )
    docs = docs.withColumn("score", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        last = name == corpus_pipeline.STAGES[-1][0]
        if not last:
            assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and all(r.score == "mine" and r._spans == "own" and r.k1 is None for r in kept), name
        if last:
            assert len(kept) == docs.count() and all(r.n_tokens >= 0 for r in kept)


def test_secrets_are_masked_and_nothing_else(spark, nasty, sf_dir):
    out = corpus_pipeline.secrets(spark, nasty, sf_dir).select("doc_id", "text", "n_chars").collect()
    before = {(r.doc_id, r.text) for r in nasty.select("doc_id", "text").collect()}
    changed = [r for r in out if (r.doc_id, r.text) not in before]
    assert {r.doc_id for r in changed} >= {14, 15} and all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in changed)
    assert len(out) == nasty.count()


def test_whole_pipeline(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "text", "n_tokens").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert 0 < len(rows) <= len(docs) and len({r.doc_id for r in rows}) == len(rows)
    untouched = [r for r in rows if r.text == docs[r.doc_id]]
    assert len(untouched) > len(rows) // 2 and all(r.n_tokens > 0 for r in rows if r.text)
