"""A barrier over a stream: each group is emitted once, in the batch in which its last expected member arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CompleteOnce:
    """A ``foreachBatch`` function that emits complete groups, each once, over any cut of the stream into batches.

    ``expected``: keys, expected (how many distinct members). The folder, on a file system that all share, holds by batch
    number ``groups`` (those emitted), ``open`` (members of groups not yet complete) and ``progress``, one row written
    last: a batch without it has not happened. A batch that is run again finds what lies before it unchanged and writes
    the same. Only open groups are carried on; of ``open`` the last two batches are kept.

    progress: batch, completed, members, digest (of all members seen, whatever their order), stalled (batches in a row in
    which neither changed).
    """

    def __init__(self, expected: DataFrame, keys: list[str], folder: str, member: str = "member"):
        self.expected, self.keys, self.folder, self.member = expected, keys, folder, member

    def _path(self, what: str, batch: int) -> str:
        return f"{self.folder}/{what}/batch={batch}"

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where

    def _batches(self, spark: SparkSession, what: str) -> list[int]:
        """Numbers of the finished batches under a name."""
        fs, where = self._fs(spark, f"{self.folder}/{what}")
        if not fs.exists(where):
            return []
        names = [s.getPath() for s in fs.listStatus(where)]
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().removeprefix("batch=")) for p in names if p.getName().startswith("batch=") and fs.exists(done(p, "_SUCCESS")))

    def emitted(self, spark: SparkSession, before: int = 1 << 62) -> DataFrame | None:
        """Groups with the batch that emitted them, of finished batches; None if there is none yet."""
        numbers = [n for n in self._batches(spark, "progress") if n < before]
        if not numbers:
            return None
        return spark.read.parquet(*(self._path("groups", n) for n in numbers))

    def progress(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(*(self._path("progress", n) for n in self._batches(spark, "progress")))

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark, keys = rows.sparkSession, self.keys
        before = [n for n in self._batches(spark, "progress") if n < batch]
        fresh = rows.select(*keys, self.member).distinct()
        old, last, emitted = None, None, self.emitted(spark, batch)
        if before:
            old = spark.read.parquet(self._path("open", before[-1]))
            last = spark.read.parquet(self._path("progress", before[-1])).first()
            # A member that comes again after its group is complete opens nothing.
            fresh = fresh.join(emitted.select(*keys), keys, "left_anti").join(old, [*keys, self.member], "left_anti")
        fresh = fresh.withColumn("fresh_", F.lit(True))
        members = fresh if old is None else fresh.unionByName(old.withColumn("fresh_", F.lit(False)))
        seen = members.groupBy(*keys).agg(F.count("*").alias("seen"))
        whole = seen.join(self.expected.select(*keys, "expected"), keys).where("seen >= expected").select(*keys)
        whole.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(self._path("groups", batch))
        done = spark.read.parquet(self._path("groups", batch))
        members.join(done.select(*keys), keys, "left_anti").drop("fresh_").write.mode("overwrite").parquet(self._path("open", batch))
        # The digest is a sum over members, so that it doesn't depend on how batches cut the stream.
        digest = F.sum(F.xxhash64(*keys, self.member).cast("decimal(38,0)"))
        new = members.where("fresh_").agg(F.count("*").alias("n"), F.coalesce(digest, F.lit(0)).cast("decimal(38,0)").alias("d")).first()
        completed, count, total = done.count() + (last["completed"] if last else 0), new["n"] + (last["members"] if last else 0), new["d"] + (int(last["digest"]) if last else 0)
        moved = last is None or count != last["members"] or completed != last["completed"]
        row = [(batch, completed, count, str(total), 0 if moved else last["stalled"] + 1)]
        spark.createDataFrame(row, "batch long, completed long, members long, digest string, stalled long").write.mode("overwrite").parquet(self._path("progress", batch))
        for n in self._batches(spark, "open"):
            if before and n < before[-1]:
                fs, where = self._fs(spark, self._path("open", n))
                fs.delete(where, True)
