"""Session settings for the wide expressions of this package."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # A generated method above 8000 bytes is never compiled by the JVM and runs many
    # times slower, so wider stages fall back to Spark's split expressions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A wide aggregate has more than the 100 columns at which generation is given up.
    "spark.sql.codegen.maxFields": "400",
    # Joined rows are narrow but fan out into many expressions, so a partition is
    # heavy long before it reaches the default 256 MB: split skewed ones earlier.
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; what the user has set stays.

    Nothing in the package calls this: results are the same without, wide tables are slower.
    """
    own = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in own:
            spark.conf.set(key, value)
    return spark


_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the checkpoint folder of the session.

    Only in local mode, where all work is done by one process, a temporary folder takes its
    place, which goes when Python ends; on a cluster without the setting this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="tallyloom-"))
    return _LOCAL[0].name
