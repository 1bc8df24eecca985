"""From raw documents to token ids: five stages, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents that it keeps, the last one with their token ids.

Defined results, for every stage: a null or empty text is a document as any other, without secrets
and tokens; repeated rows go through each for itself, but a doc_id goes or stays as a whole where
near-duplicates are told; a null doc_id is kept by that stage; an empty table gives none; columns
beside those of ``documents`` go through whatever their names, except that the last stage leaves
out one with the name of a result; without ``n_chars`` none is made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, crf, decontam, minhash, secret_scan
from tallyloom.llm.common import Scratch, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Stage) -> Stage:
    """The stage with all further columns under names of their own while it works."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"_further{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        made = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        back = {own: c for c, own in names.items()}
        hidden = [own for own, c in back.items() if c in made.columns]
        return made.drop(*hidden).withColumnsRenamed({own: c for own, c in back.items() if own not in hidden})

    return run


@apart
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half."""
    model = crf.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return crf.apply_model(docs, model, docs.columns).where("score < 0.5").drop("score")


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Five-word shingles, similarity 0.8 or more.  doc_id is the documents' key: rows that
    repeat one stay or go together.
    """
    gone = minhash.cluster(docs, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


@apart
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@apart
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret; n_chars follows."""
    versions = secret_scan.versions_of(docs, "doc_id", "text")
    found, _ = secret_scan.scan(versions)
    found = found.select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    marked = docs.withColumn("_blob", F.sha2("text", 256)).join(found.hint("shuffle_hash"), "_blob", "left")
    hit = F.col("_spans").isNotNull()
    # step by step: within one select, lambdas would take the new text for the old
    marked = marked.withColumn(
        "_new", F.when(hit, secret_scan.redacted(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    )
    if "n_chars" in docs.columns:
        size = F.when(hit, F.length("_new").cast("long")).otherwise(F.col("n_chars"))
        marked = marked.withColumn("n_chars", size)
    return marked.withColumn("text", F.col("_new")).select(*docs.columns)


@apart
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids (little-endian unsigned 32-bit) and digests."""
    return bpe.encode(docs, bpe.word_vocabulary(), docs.columns, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("bpe encoding", tokens),
]

#: Models and alignments have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before wrote."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
