"""What the training-data operators share: shared-folder tables, input sizing and batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; where that is unset a local master gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/tallyloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    The application's tables lie in one folder; ``discard`` deletes one that nothing needs any more, ``release`` all.
    """
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.stored_path = path
    return held


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    for held in tables:
        _delete(spark, held.stored_path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored; results that read them must have been written before."""
    _delete(spark, _folder(spark))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key with more than one in this many of all rows is hot; so there are never more hot keys than this.
HOT_SHARE = 1024


def spread_join(rows: DataFrame, side: DataFrame, key: str, many: str, total: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``side``, which has one row per key and in ``many`` how many of the ``total`` rows have it.

    The hot keys of ``side``, at most ``HOT_SHARE``, are broadcast, so that their rows stay where they are; all others
    meet by a shuffle. Rows with a null key meet nothing and aren't moved; they stay if ``how`` is "left".
    """
    hot = side.where(F.col(many) * HOT_SHARE > total).drop(many)
    cold = side.where(F.col(many) * HOT_SHARE <= total).drop(many)
    parts = [rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how), rows.join(F.broadcast(hot), key)]
    if how == "left":
        parts.append(rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in hot.schema if f.name != key)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts of a column: one pass that moves nothing."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``limit`` bytes in each; a single longer row stays whole."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
        # What earlier batches took goes back to the system: workers live through many stages.
        pa.default_memory_pool().release_unused()


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Joins consecutive batches of a task until ``column`` holds about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in by_bytes(batches, column, limit):
        n = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and total + n > limit:
            yield pa.Table.from_batches(held)
            held, total = [], 0
        held.append(batch)
        total += n
    if held:
        yield pa.Table.from_batches(held)


def texts(batch, column: str = "text") -> list[str]:
    """Texts of a batch; a null text is an empty one."""
    return [x or "" for x in batch.column(column).to_pylist()]
