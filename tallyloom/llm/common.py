"""Helpers shared by the operators: tables, shared scratch tables, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables as Parquet in the shared folder.

    A written table cuts the lineage: a lost executor costs a reread, not a recomputation.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that no later step reads."""
        files = df.inputFiles()
        if files:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of anything but the six ASCII white-space characters.

    ``bytes.split`` separates at exactly those, and ``bytes.lower`` touches only A-Z.
    """
    return text.encode("utf-8", "replace").lower().split() if text else []
