"""What the registered queries share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed value: how many partitions the rows of one split of a table are dealt out to.
SHARES = 16


def shares(table: DataFrame) -> int:
    """Over how many partitions a table that was read is dealt: by its splits, so that a task's rows don't grow with it, and
    no fewer than Spark would take."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), SHARES * table.rdd.getNumPartitions())


def rounded(c: str | Column, places: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def scratch(spark: SparkSession) -> str:
    """A path of its own in the folder in ``spark.checkpoint.dir``; only a local master gets such a folder where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/tallyloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def writer(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a frame to a path of its own and reads it back."""
    scratch(spark)  # without a shared folder it fails here, not in the midst of the work

    def write(df: DataFrame) -> DataFrame:
        path = scratch(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write
