"""Reading survey tables from files and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyloom.functions.codes import name, quoted
from tallyloom.functions.labels import label_columns, read_labels

#: Cells that stand for a missing answer, quoted or not.
MISSING = ("", "NA")
#: Quotes inside a quoted cell are doubled; blanks around a cell without quotes are no part of it.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
TRIMMED = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
#: Folder of a table's labels beside its data; readers of data pass over names with an underscore.
LABELS = "_labels"
LABEL_SCHEMA = "column string, label string, code double, answer string"
FAULT = "_fault"


def _present(columns: list[str], schema: StructType, path: str) -> None:
    missing = [f.name for f in schema if f.name not in columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")


def _typed(field: StructField) -> str:
    """A cell as its column's type; a cell that is neither missing nor of that type stops the query."""
    column, kind = name(field.name), field.dataType.simpleString()
    cell = f"CASE WHEN {column} NOT IN ({', '.join(map(quoted, MISSING))}) THEN {column} END"
    if field.dataType == StringType():
        return f"{cell} AS {column}"
    value = f"try_cast({cell} AS {kind})"
    if field.dataType == LongType():
        # a whole number may be written with a decimal point or an exponent
        number = f"try_cast({cell} AS DOUBLE)"
        value = f"coalesce({value}, CASE WHEN {number} = floor({number}) THEN try_cast({number} AS BIGINT) END)"
    what = quoted(f"column {field.name} is no {kind}: ")
    return (
        f"CASE WHEN {cell} IS NOT NULL AND {value} IS NULL"
        f" THEN CAST(raise_error(concat({what}, {column})) AS {kind}) ELSE {value} END AS {column}"
    )


def read_csv(spark: SparkSession, path: str, schema: StructType, labels: bool = False) -> DataFrame:
    """CSV with a header, as spreadsheet programs and statistics packages write it.

    A record may go over several lines inside quotes, where quotes are doubled.  Empty cells and
    ``NA`` are missing.  Columns are found by their header names, in any order; others are left out.
    A missing column is an error at once; a record with too few or too many cells, or a cell that
    is not of its column's type, when it is read.  Line breaks in quotes make a file the unit of
    parallel reading: large tables are many files.

    With ``labels`` the columns get the labels written beside the table.
    """
    names = spark.read.options(**CSV_OPTIONS, **TRIMMED).csv(path).columns
    _present(names, schema, path)
    text = StructType([StructField(n, StringType()) for n in [*names, FAULT]])
    raw = (
        spark.read.schema(text)
        .options(**CSV_OPTIONS, **TRIMMED, enforceSchema=False, columnNameOfCorruptRecord=FAULT)
        .csv(path)
    )
    wrong = f"raise_error(concat('not as many cells as columns: ', {FAULT}, coalesce(left({name(names[0])}, 0), '')))"
    whole = raw.where(f"CASE WHEN {FAULT} IS NULL THEN true ELSE CAST({wrong} AS BOOLEAN) END")
    out = whole.selectExpr(*[_typed(f) for f in schema])
    return with_written_labels(out, path) if labels else out


def read_parquet(spark: SparkSession, path: str, schema: StructType, labels: bool = False) -> DataFrame:
    """Parquet read with an explicit schema; a column that no file has is an error.

    With ``labels`` the columns get the labels written beside the table.
    """
    _present(spark.read.parquet(path).columns, schema, path)
    out = spark.read.schema(schema).parquet(path)
    return with_written_labels(out, path) if labels else out


def write_csv(frame: DataFrame, path: str, labels: bool = False) -> None:
    """CSV with a header that ``read_csv`` reads back, one file per partition; missing cells are empty.

    A text that is empty, ``NA`` or has blanks around it can't be told from its reading.
    """
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    frame.write.mode("errorifexists").options(**options).csv(path)
    if labels:
        write_labels(frame, path)


def write_parquet(frame: DataFrame, path: str, labels: bool = False) -> None:
    """Parquet, one file per partition."""
    frame.write.mode("errorifexists").parquet(path)
    if labels:
        write_labels(frame, path)


def write_labels(frame: DataFrame, path: str) -> None:
    """Variable and value labels of a table's columns, as JSON in a folder beside its data.

    One row for each labelled column and answer; there are no more than the questionnaire has.
    """
    rows = []
    for column in frame.columns:
        label, answers = read_labels(frame, column)
        if label is not None or answers:
            rows += [(column, label, None, None), *[(column, label, float(v), text) for text, v in answers.items()]]
    made = frame.sparkSession.createDataFrame(rows, LABEL_SCHEMA).coalesce(1)
    made.write.mode("errorifexists").json(f"{path.rstrip('/')}/{LABELS}")


def with_written_labels(frame: DataFrame, path: str) -> DataFrame:
    """The table with the labels that were written beside it.

    Labels of columns that were not asked for are left out; labels whose answers name a code twice
    are an error.
    """
    written = frame.sparkSession.read.schema(LABEL_SCHEMA).json(f"{path.rstrip('/')}/{LABELS}").collect()
    labels: dict[str, tuple[str | None, dict[str, float]]] = {}
    for r in written:
        answers = labels.setdefault(r["column"], (r.label, {}))[1]
        if r.answer is not None:
            if r.answer in answers or r.code in answers.values():
                raise ValueError(f"{path}: labels of {r['column']} name {r.answer} or {r.code} twice")
            answers[r.answer] = r.code
    return label_columns(frame, {c: found for c, found in labels.items() if c in frame.columns})


def export_table(table: DataFrame, path: str) -> None:
    """A finished summary table as a single CSV file.

    For summary tables only: they hold one row per indicator and group.  The rows are made
    in parallel and meet in the last step.
    """
    write_csv(table.repartition(1), path)


def export_by_group(table: DataFrame, path: str, by: list[str], rows_per_file: int = 5_000_000) -> None:
    """A table as Parquet, one folder per value of the keys, in files of bounded size.

    Groups are counted first.  One that fits a file has one; a larger one is dealt out in turn to as
    many parts as it fills, which different tasks write.  Parts of small groups share tasks.  No
    file has more than ``rows_per_file`` rows.
    """
    keys = [f"k{i}" for i in range(len(by))]
    parts = table.selectExpr(*[f"{name(c)} AS {k}" for c, k in zip(by, keys)]).groupBy(*keys).count()
    # a tenth to spare, as dealing is not quite even
    parts = parts.selectExpr(*keys, f"CAST(ceil(count * 1.1 / {rows_per_file}) AS BIGINT) AS parts").alias("p")
    same = [F.col(f"t.{name(c)}").eqNullSafe(F.col(f"p.{k}")) for c, k in zip(by, keys)]
    dealt = table.withColumn("_turn", F.monotonically_increasing_id()).alias("t").join(parts, same)
    dealt = dealt.withColumn("_part", F.expr("CASE WHEN p.parts > 1 THEN _turn % p.parts ELSE 0L END"))
    dealt = dealt.repartition(*[F.col(f"t.{name(c)}") for c in by], F.col("_part"))
    written = dealt.select(*[F.col(f"t.{name(c)}") for c in table.columns])
    written.write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)
