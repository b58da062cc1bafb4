"""Digest trees kept as tables, and differences found by descending only where digests differ."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of a leaf's range, and nodes below each node: so many at most come together in a group.
FAN = 1024
_LAID = "id long, part string, top long"


@dataclass(frozen=True)
class DigestTree:
    """A table's digests by range of ids, from leaves up to at most ``fan`` top nodes; rows and digests lie by top node."""

    path: str
    levels: int
    fan: int

    def width(self, level: int) -> int:
        """Ids that a node of a level spans; leaves are level 0."""
        return self.fan ** (level + 1)

    def digests(self, spark: SparkSession, level: int) -> DataFrame:
        return spark.read.schema(_LAID).parquet(f"{self.path}/level={level}")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_LAID).parquet(f"{self.path}/rows")


def build(parts: DataFrame, path: str, fan: int = FAN) -> DigestTree:
    """A digest tree of (id, part): id a whole number, part the text or digest that stands for its row.

    Repeated ids count with all their parts, in order. Nothing is gathered but the largest and smallest id.
    """
    rows = parts.select(F.col("id").cast("long").alias("id"), F.coalesce(F.sha2(F.col("part").cast("string"), 256), F.lit("")).alias("part"))
    ends = rows.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    span = max(abs(ends["low"] or 0), abs(ends["high"] or 0)) + 1
    levels = 1
    # Ids on either side of zero have top nodes of their own.
    while span > fan ** (levels + 1) // 2:
        levels += 1
    tree = DigestTree(path, levels, fan)
    top = F.floor(F.col("id") / F.lit(tree.width(levels - 1))).cast("long")
    rows.withColumn("top", top).repartition("top", F.floor(F.col("id") / F.lit(fan))).sortWithinPartitions("id").write.partitionBy("top").parquet(f"{path}/rows")
    spark = parts.sparkSession
    below = spark.read.schema(_LAID).parquet(f"{path}/rows").select("id", "part", "top")
    for level in range(levels):
        node = F.floor(F.col("id") / F.lit(fan)).cast("long")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "part"))), lambda x: F.concat_ws(":", x["id"], x["part"])), ",")
        below = below.groupBy(node.alias("node"), "top").agg(F.sha2(joined, 256).alias("part")).select(F.col("node").alias("id"), "part", "top")
        below.repartition("top").write.partitionBy("top").parquet(f"{path}/level={level}")
        below = spark.read.schema(_LAID).parquet(f"{path}/level={level}")
    return tree


def _unlike(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old, new) of ids whose parts differ, or that one side lacks."""
    both = old.select("id", F.col("part").alias("old")).join(new.select("id", F.col("part").alias("new")), "id", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def difference(spark: SparkSession, old: DigestTree, new: DigestTree) -> DataFrame:
    """(id, change): ids that are changed, new or gone in ``new``.

    The top nodes that differ, at most twice the fan, choose the folders that are read of all lower levels and of the
    rows; within these, each level meets only the children of nodes that differ.
    """
    if (old.levels, old.fan) != (new.levels, new.fan):
        raise ValueError("trees of one height and fan can be compared")
    tops = [r["id"] for r in _unlike(old.digests(spark, old.levels - 1), new.digests(spark, new.levels - 1)).select("id").collect()]
    near = lambda df: df.where(F.col("top").isin(tops)).drop("top")
    open_ = spark.createDataFrame([(t,) for t in tops], "node long")
    for level in range(old.levels - 2, -1, -1):
        below = lambda tree, at=level: near(tree.digests(spark, at)).join(open_, F.floor(F.col("id") / F.lit(old.fan)) == F.col("node"), "left_semi")  # noqa: B023, E731
        open_ = _unlike(below(old), below(new)).select(F.col("id").alias("node"))
    of = lambda tree: near(tree.rows(spark)).join(open_, F.floor(F.col("id") / F.lit(old.fan)) == F.col("node"), "left_semi")
    one = lambda df: df.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("part")), ",").alias("part"))
    found = _unlike(one(of(old)), one(of(new)))
    return found.select("id", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").otherwise("changed").alias("change"))
