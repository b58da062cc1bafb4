"""Pages of a sorted table by an index of places: a page reads the one or two partitions that hold it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART, PLACE = "part_", "place_"


@dataclass(frozen=True)
class Places:
    """A sorted copy of a table, by range partition, and how many rows lie before each partition."""

    path: str
    schema: T.StructType
    before: tuple[tuple[int, int], ...]
    total: int

    def page(self, spark: SparkSession, offset: int = 0, limit: int = 100) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order, with place (from 0), total_rows and next_offset (null behind the last)."""
        if offset < 0 or not 1 <= limit <= 200:
            raise ValueError("a page begins at row 0 or later and holds 1 to 200 rows")
        ends = [*(start for _, start in self.before[1:]), self.total]
        parts = [(part, start) for (part, start), end in zip(self.before, ends, strict=False) if start < offset + limit and end > offset]
        laid = T.StructType([*self.schema.fields, T.StructField(PLACE, T.LongType()), T.StructField(PART, T.LongType())])
        rows = spark.read.schema(laid).parquet(self.path).where(F.col(PART).isin([p for p, _ in parts]))
        begin = F.lit(0)
        for part, start in parts:
            begin = F.when(F.col(PART) == part, start).otherwise(begin)
        rows = rows.withColumn("place", (begin + F.col(PLACE)).cast("long"))
        # What the file's own statistics can use: places within the partitions, not in the table.
        within = [(F.col(PART) == part) & F.col(PLACE).between(offset - start, offset + limit - 1 - start) for part, start in parts]
        kept = within[0] if within else F.lit(False)
        for condition in within[1:]:
            kept = kept | condition
        more = offset + limit if offset + limit < self.total else None
        return rows.where(kept).select("place", *(f.name for f in self.schema), F.lit(self.total).cast("long").alias("total_rows"), F.lit(more).cast("long").alias("next_offset")).orderBy("place")


def placed(df: DataFrame, order: list[str | Column], path: str) -> Places:
    """Writes ``df`` sorted by ``order``, which should be total, and finds each partition's first place.

    The driver holds one number per partition. Range partitions are sized by Spark; a page reads at most two of them,
    unless they are smaller than it.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    laid = parts.withColumn(PLACE, F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))).withColumn(PART, F.shiftright("at_", 33)).drop("at_")
    laid.write.partitionBy(PART).parquet(path)
    spark = df.sparkSession
    schema = T.StructType([T.StructField(PLACE, T.LongType()), T.StructField(PART, T.LongType())])
    sizes = spark.read.schema(schema).parquet(path).groupBy(PART).agg(F.count("*").alias("n")).orderBy(PART).collect()
    before, total = [], 0
    for r in sizes:
        before.append((r[PART], total))
        total += r["n"]
    return Places(path, df.schema, tuple(before), total)


def every_page(spark: SparkSession, places: Places, limit: int, summary: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A summary of the rows by page: page (from 0) is added before ``summary`` groups them; one pass over the copy."""
    begin = spark.createDataFrame(places.before or [], f"{PART} long, begin_ long")
    laid = T.StructType([*places.schema.fields, T.StructField(PLACE, T.LongType()), T.StructField(PART, T.LongType())])
    rows = spark.read.schema(laid).parquet(places.path).join(F.broadcast(begin), PART)
    return summary(rows.withColumn("page", F.floor((F.col("begin_") + F.col(PLACE)) / limit).cast("long")).drop(PART, PLACE, "begin_"))
