"""Ordered operators: islands, chunks, first occurrences, carried values and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import scans


def carry_forward(df: DataFrame, value: Column, name: str, keys: list[str], order: list[str], write: scans.Write) -> DataFrame:
    """The last non-null value up to each row."""
    return scans.scan(df.withColumn("given_", value), keys, order, {name: scans.Last("given_")}, write).drop("given_")


def batches(df: DataFrame, alone: Column, size: int, keys: list[str], order: list[str], write: scans.Write) -> DataFrame:
    """Consecutive rows in batches of at most ``size``; rows where ``alone`` holds are batches of their own. Adds batch (from 1).

    A run of other rows may reach over partitions: how many of its rows came before shifts where the batches of its
    first part here begin, while those of later runs are counted on the spot.
    """
    if size < 1:
        raise ValueError("size must be positive")
    marked = scans.ranged(df.withColumn("alone_", F.coalesce(alone, F.lit(False))), keys, order)
    marked = marked.withColumn("other_", (~F.col("alone_")).cast("long"))
    # run: rows since the last that stands alone. Those of an open run can't be dealt into batches yet, only counted.
    marked = scans.local(marked, keys, {"run": scans.Sum("other_", "alone_")})
    opens = F.when(~F.col("run_open"), (F.col("alone_") | ((F.col("run") - 1) % size == 0)).cast("long"))
    marked = marked.withColumn("opens_", opens).withColumn("waits_", F.when(F.col("run_open"), F.col("other_")))
    held = write(scans.local(marked, keys, {"settled": scans.Sum("opens_"), "waiting": scans.Sum("waits_")}))
    parts = scans.tails(held, keys, ["run", "run_open", "settled", "settled_open", "waiting"])
    parts = scans.carried(parts, "run_in", F.col("run"), F.col("run_open"))
    dealt = lambda n: F.ceil(n / size) - F.ceil(F.col("run_in") / size)
    # A later key of a partition has no open run, so nothing waits.
    parts = scans.carried(parts, "batch_in", F.col("settled") + F.when(F.col("settled_open"), dealt(F.col("run_in") + F.col("waiting"))).otherwise(0), F.col("settled_open"))
    joined = held.join(F.broadcast(parts.select(scans.PART, "run_in", "batch_in")), scans.PART)
    before = F.when(F.col("settled_open"), F.col("batch_in") + dealt(F.col("run_in") + F.col("waiting"))).otherwise(0)
    return joined.withColumn("batch", F.col("settled") + before).select(*df.columns, "batch")


def chunks(df: DataFrame, size: int, keys: list[str], order: list[str], write: scans.Write | None = None) -> DataFrame:
    """chunk (from 0) of ``size`` consecutive rows per key. Without ``write``, a key is one task's work."""
    return placed(df, order, keys, write).withColumn("chunk", F.floor((F.col("nth_") - 1) / size).cast("long")).drop("nth_")


def placed(df: DataFrame, order: list[str], keys: list[str], write: scans.Write | None = None, name: str = "nth_") -> DataFrame:
    """The place (from 1) of each row within its key."""
    if write is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return scans.scan(df.withColumn("one_", F.lit(1)), keys, order, {name: scans.Sum("one_")}, write).drop("one_")


def first_of_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of every key, by aggregation: hot keys shrink before the shuffle."""
    kept = df.withColumn("key_", key).where("key_ is not null and key_ <> ''").groupBy("key_").agg(F.min(F.struct(*order, *(c for c in df.columns if c not in order))).alias("row_"))
    return kept.select("key_", "row_.*").withColumnRenamed("key_", "key")


def first_seen(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key with the least order at which it stands: sorted by it, keys come in the order of their first occurrence."""
    return df.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))


def visible(df: DataFrame, positive: Column, keys: list[str], order: list[str], write: scans.Write, few: int = 10, shown: int = 2) -> DataFrame:
    """All rows of keys with up to ``few``; of others every row that isn't positive, and the first ``shown`` that are.

    How many rows a key has matters only to its other positive rows among the first ``few``, so no more of a key meet
    its count.
    """
    marked = df.withColumn("yes_", F.coalesce(positive, F.lit(False)).cast("long")).withColumn("one_", F.lit(1))
    marked = scans.scan(marked, keys, order, {"yeses_": scans.Sum("yes_"), "nth_": scans.Sum("one_")}, write)
    kept = (F.col("yes_") == 0) | (F.col("yeses_") <= shown)
    small = df.groupBy(*keys).agg(F.count("*").alias("all_")).where(F.col("all_") <= few).select(*(F.col(k).alias(f"{k}__") for k in keys))
    doubtful = marked.where(~kept & (F.col("nth_") <= few))
    same = [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]
    return marked.where(kept).select(*df.columns).unionByName(doubtful.join(small, same, "left_semi").select(*df.columns))


def numbered(df: DataFrame, order: list[str], keys: list[str], form: str = "R%03d", name: str = "label", write: scans.Write | None = None) -> DataFrame:
    """A label with each row's place within its key. Without ``write``, a key is one task's work."""
    return placed(df, order, keys, write).withColumn(name, F.format_string(form, F.col("nth_"))).drop("nth_")


def stalled_rounds(df: DataFrame, progress: Column, keys: list[str], order: list[str], write: scans.Write) -> DataFrame:
    """How many rounds in a row, up to each row, made no progress; an unknown progress is none."""
    marked = df.withColumn("moved_", F.coalesce(progress, F.lit(False))).withColumn("idle_", (~F.col("moved_")).cast("long"))
    return scans.scan(marked, keys, order, {"stalled": scans.Sum("idle_", "moved_")}, write).drop("moved_", "idle_")


def ranked(df: DataFrame, order: list[Column], write: Callable[[DataFrame], DataFrame], name: str = "rank") -> DataFrame:
    """Rows with their place (from 1) in a total order, without one task that sees all: range partitions are sorted and
    written, and a partition's places begin after the rows of those before it, whose numbers are all that is gathered."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    held = write(parts.withColumn("part_", F.shiftright("at_", 33)))
    sizes = held.groupBy("part_").agg(F.count("*").alias("n_"))
    before = sizes.withColumn("before_", F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")).drop("n_")
    place = F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return held.join(F.broadcast(before), "part_").withColumn(name, place).drop("part_", "at_", "before_")


def natural_order(c: Column) -> list[Column]:
    """Sort columns of dotted task numbers: 1.2 before 1.10."""
    part = lambda i: F.split(c, r"\.").getItem(i).cast("long")
    return [part(0), part(1)]
