"""Secret scans over versioned texts, kept incremental by a ledger of scanned blobs.

Every text version is addressed by its content (SHA-256).  A blob is scanned once per rule
version, however many paths or versions carry it; what the ledger already holds is not
scanned again.  Findings are joined back to all paths.  Everything is built-in SQL
functions: no Python runs on rows.

Positions come from two built-ins that use one regular-expression engine: the pieces
between matches (``split``) and the matches (``regexp_extract_all``) alternate, so running
sums of their lengths are the offsets, in code points.

Defined results: a null text counts as empty and has no finding; repeated rows each get
their result; an empty table gives an empty table; columns named like the operator's own are
not read, because only the named path and text columns are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, table


@dataclass(frozen=True)
class Rule:
    """``kind`` names the findings; matches whose ``group`` is shorter than ``least`` are dropped.

    ``version`` belongs to the ledger key: a changed pattern needs a new version.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# Maximal runs of hex digits are the leftmost matches of [0-9a-f]+, so asking for 24 or more
# behind a non-digit drops the short ones without listing them; a run of [A-Z0-9] behind AKIA
# is either long enough as a whole or holds no other that is.
RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=1,
        least=6,
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """All kept matches of one rule as (start, rank, end, kind), end exclusive, in order."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    group = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    matches = F.arrays_zip(pieces.alias("gap"), whole.alias("size"), group.alias("kept"))
    # the last piece follows the last match and zips with nulls
    folded = F.aggregate(
        F.filter(matches, lambda m: m["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["size"]).alias("at"),
            F.when(
                m["kept"] >= rule.least,
                F.concat(
                    acc["found"],
                    F.array(
                        F.struct(
                            (acc["at"] + m["gap"]).alias("start"),
                            F.lit(rank).alias("rank"),
                            (acc["at"] + m["gap"] + m["size"]).alias("end"),
                            F.lit(rule.kind).alias("kind"),
                        )
                    ),
                ),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(text.rlike(rule.pattern), folded).otherwise(F.array().cast(f"array<{SPAN}>"))


def _key(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def findings(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, text, done) to a row for each blob and rule not done: blob, kind, version, spans."""
    each = F.array(
        *[
            F.when(
                ~F.array_contains("done", _key(r)),
                F.struct(
                    F.lit(r.kind).alias("kind"),
                    F.lit(r.version).alias("version"),
                    spans_of(F.col("text"), r, i).alias("spans"),
                ),
            )
            for i, r in enumerate(rules)
        ]
    )
    return (
        blobs.select("blob", F.explode(each).alias("f"))
        .where(F.col("f").isNotNull())
        .select("blob", "f.*")
    )


def versions_of(df: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob, text): every version under its content address; a null text is empty."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(
        F.col(f"`{path}`").alias("path"), F.sha2(body, 256).alias("blob"), body.alias("text")
    )


def unseen(versions: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """(blob, text, done) of each blob that some rule version hasn't scanned yet, once.

    ``done`` lists the rule versions that have.  Which path stands for a blob is settled on
    narrow rows, so copies of one text meet as partial minima; only then are texts picked, by
    a join that needs no sort of them.
    """
    first = versions.groupBy("blob").agg(F.min("path").alias("path"))
    none = F.array().cast("array<string>")
    if ledger is None:
        first = first.withColumn("done", none)
    else:
        key = F.concat_ws(":", "kind", "version")
        done = (
            ledger.where(key.isin([_key(r) for r in rules]))
            .groupBy("blob")
            .agg(F.collect_set(key).alias("done"))
        )
        first = first.join(done, "blob", "left").withColumn("done", F.coalesce("done", none))
        first = first.where(F.size("done") < len(rules))
    picked = first.select(F.col("blob").alias("b"), F.col("path").alias("p"), "done")
    return versions.join(
        picked.hint("shuffle_hash"),
        (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")),
    ).select("blob", "text", "done")


def scan(
    versions: DataFrame, rules=RULES, ledger: DataFrame | None = None, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks; gives (findings by blob, new ledger entries).

    ``versions`` has path, blob and text, any number of rows per path.  The new entries
    (blob, kind, version, spans) go to the shared folder and can be appended to the ledger
    by the caller; findings are blob and the ordered spans of all rules, where there are any.
    """
    scratch = scratch or Scratch(versions.sparkSession)
    fresh = scratch.save(
        findings(unseen(versions, rules, ledger), rules).dropDuplicates(["blob", "kind", "version"]),
        "ledger",
    )
    known = fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh)
    wanted = [_key(r) for r in rules]
    by_blob = (
        known.where(F.size("spans") > 0)
        .where(F.concat_ws(":", "kind", "version").isin(wanted))
        .dropDuplicates(["blob", "kind", "version"])
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    return by_blob, fresh


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch covered by spans replaced by one mark."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(
                    acc["out"],
                    F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                    F.lit(mark),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def secrets_by_document(docs: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, blob and the ordered spans of every document."""
    versions = versions_of(docs, "doc_id", "text")
    found, _ = scan(versions, rules, ledger)
    none = F.array().cast(f"array<{SPAN}>")
    return (
        versions.select("path", "blob")
        .join(found, "blob", "left")
        .select(F.col("path").alias("doc_id"), "blob", F.coalesce("spans", none).alias("spans"))
    )


def op9_secret_scan(spark, sf_dir) -> DataFrame:
    """Counts, digest and list of the secrets of every document."""
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    joined = F.array_join(
        F.transform(
            "spans",
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
    return secrets_by_document(table(spark, sf_dir, "documents")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined, 256).alias("base_sha256"),
        joined.alias("spans"),
    )


# DuckDB, over whole texts.  Pieces and matches alternate here too; offsets by a running sum.
_KINDS = [
    (
        "assign",
        0,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    ("hex", 2, "[0-9a-f]+", 0, 24),
]


def _oracle() -> str:
    parts = []
    for kind, rank, pattern, group, least in _KINDS:
        parts.append(
            f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank,
            unnest(regexp_split_to_array(body, '{pattern}')) AS gap,
            unnest(list_concat(regexp_extract_all(body, '{pattern}'), [NULL])) AS hit,
            unnest(list_concat(regexp_extract_all(body, '{pattern}', {group}), [NULL])) AS kept,
            generate_subscripts(regexp_split_to_array(body, '{pattern}'), 1) AS i, {least} AS least
            FROM d"""
        )
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    o AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER
        (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
    s AS (SELECT doc_id, kind, rank, CAST(e - length(hit) AS BIGINT) AS b, CAST(e AS BIGINT) AS e
        FROM o WHERE hit IS NOT NULL AND length(kept) >= least),
    g AS (SELECT doc_id,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans
        FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
        coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256,
        coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)"""


ORACLE = _oracle()
