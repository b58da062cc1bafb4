"""Scans along an order within keys, over range partitions: a key may be spread over any number of tasks.

Rows are sorted by key and order into range partitions, and each partition is scanned by itself, in the stage that
sorts it. What a row still lacks then is one value from before its partition; that value follows from one row per
partition, which is all that has to be gathered. A scan's result is ``name``; where ``name_open`` holds, what lies before
the partition (``name_in``) still belongs to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Write = Callable[[DataFrame], DataFrame]
PART, PLACE = "part_", "place_"


@dataclass(frozen=True)
class Last:
    """The last value up to each row that isn't null."""

    value: str


@dataclass(frozen=True)
class Sum:
    """The sum of whole numbers up to each row, nulls left out; begins anew at each row where ``since`` holds."""

    value: str
    since: str | None = None


Scan = Last | Sum


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in range partitions of (keys, order), sorted; adds the partition's number."""
    by = [*keys, *order]
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id())


def _differs(column: pa.Array) -> np.ndarray:
    """Where a value isn't the one before it; nulls are equal to nulls, and NaN to NaN."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    out = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        out = out & ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
    return out | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _since(starts: np.ndarray) -> np.ndarray:
    """The last row up to each that starts something; -1 before the first."""
    return np.maximum.accumulate(np.where(starts, np.arange(len(starts)), -1))


class _Partition:
    """One partition's scans; each batch is scanned behind the last row of the one before."""

    def __init__(self, keys: list[str], scans: dict[str, Scan]):
        self.keys, self.scans = keys, scans
        self.before: pa.RecordBatch | None = None
        self.place, self.head, self.held = 0, True, dict.fromkeys(scans)

    def scanned(self, batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
        n = batch.num_rows
        joined = batch if self.before is None else pa.concat_batches([self.before, batch])
        starts = np.zeros(joined.num_rows, bool)
        for key in self.keys:
            starts[1:] |= _differs(joined.column(key))
        starts = starts[joined.num_rows - n :]
        key_at = _since(starts)
        head = (key_at < 0) & self.head
        columns = []
        for name, scan in self.scans.items():
            found, opened, self.held[name] = (self._last if isinstance(scan, Last) else self._sum)(batch, scan, key_at, head, self.held[name])
            columns += [found, pa.array(opened)]
        places = pa.array(np.arange(self.place, self.place + n))
        self.place, self.head, self.before = self.place + n, bool(head[-1]), batch.slice(n - 1)
        kept = [c for c in batch.schema.names if c != PLACE]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), places, *columns], names=names)

    @staticmethod
    def _last(batch: pa.RecordBatch, scan: Last, key_at: np.ndarray, head: np.ndarray, held: tuple | None) -> tuple:
        values = batch.column(scan.value)
        at = _since(values.is_valid().to_numpy(zero_copy_only=False))
        at = np.where(at >= np.maximum(key_at, 0), at, -1)
        # Row 0 of the joined values is what the batches before left for the key that goes on.
        left = values.slice(0, 0) if held is None else held
        source = pa.concat_arrays([left if len(left) else pa.nulls(1, values.type), values])
        take = np.where(at >= 0, at + 1, np.where(key_at < 0, 0, -1))
        found = source.take(pa.array(take, mask=take < 0))
        return found, head & found.is_null().to_numpy(zero_copy_only=False), found.slice(len(found) - 1)

    @staticmethod
    def _sum(batch: pa.RecordBatch, scan: Sum, key_at: np.ndarray, head: np.ndarray, held: tuple | None) -> tuple:
        values = pc.fill_null(batch.column(scan.value).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        left, untouched = held or (0, True)
        reset = pc.fill_null(batch.column(scan.since), False).to_numpy(zero_copy_only=False) if scan.since else np.zeros(len(values), bool)
        reset_at = _since(reset)
        at = np.maximum(key_at, reset_at)
        total = np.cumsum(values)
        found = np.where(at < 0, total + left, total - np.where(at > 0, total[np.maximum(at - 1, 0)], 0))
        opened = head & (reset_at < 0) & untouched
        # A new key starts untouched, but nothing open lies before it.
        return pa.array(found), opened, (int(found[-1]), bool(opened[-1]))


def local(df: DataFrame, keys: list[str], scans: dict[str, Scan]) -> DataFrame:
    """Each partition of ``ranged`` rows scanned by itself: adds place_ and for each scan its result and whether it is open.

    ``keys`` hold plain values, not arrays, maps or structs.
    """
    kept = [f for f in df.schema if f.name != PLACE]
    kind = lambda s: df.schema[s.value].dataType if isinstance(s, Last) else T.LongType()
    schema = T.StructType([*kept, T.StructField(PLACE, T.LongType()), *(f for name, s in scans.items() for f in (T.StructField(name, kind(s)), T.StructField(f"{name}_open", T.BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Partition(keys, scans)
        for batch in batches:
            if batch.num_rows:
                yield state.scanned(batch, schema.names)

    return df.mapInArrow(run, schema)


def tails(held: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per partition: its first and last row's keys, and its last row's ``columns``."""
    key = F.struct(*keys) if keys else F.lit(0)
    last = F.max_by(F.struct(key.alias("to_"), *columns), PLACE).alias("last_")
    return held.groupBy(PART).agg(F.min_by(key, PLACE).alias("from_"), last).select(PART, "from_", "last_.*")


def carried(parts: DataFrame, name: str, value: Column, opened: Column, kind: type = Sum) -> DataFrame:
    """Adds ``name``: what goes from the partitions before into each, as its first key's sum or last value so far.

    ``parts`` has a row per partition; ``value`` and ``opened`` are those of its last row.
    """
    line = Window.orderBy(PART)
    goes_on = F.coalesce(F.col("from_").eqNullSafe(F.lag("to_").over(line)), F.lit(False))
    # From one partition that settles its own value, what follows adds to it as long as it stays open.
    rows = parts.withColumn("on_", goes_on).withColumn("open_", opened & F.col("on_")).withColumn("value_", value)
    rows = rows.withColumn("run_", F.sum((~F.col("open_")).cast("long")).over(line))
    within = Window.partitionBy("run_").orderBy(PART)
    rows = rows.withColumn("upto_", F.last("value_", ignorenulls=True).over(within) if kind is Last else F.sum("value_").over(within))
    empty = F.lit(None) if kind is Last else F.lit(0)
    return rows.withColumn(name, F.when(F.col("on_"), F.lag("upto_").over(line)).otherwise(empty)).drop("on_", "open_", "value_", "run_", "upto_")


def scan(df: DataFrame, keys: list[str], order: list[str], scans: dict[str, Scan], write: Write) -> DataFrame:
    """``df`` with each scan's result; its rows keep nothing else of the work. One shuffle, one written copy, one row per
    partition broadcast. The order should be total: equal rows stand in any order."""
    held = write(local(ranged(df, keys, order), keys, scans))
    parts = tails(held, keys, [c for name in scans for c in (name, f"{name}_open")])
    for name, s in scans.items():
        parts = carried(parts, f"{name}_in", F.col(name), F.col(f"{name}_open"), type(s))
    joined = held.join(F.broadcast(parts.select(PART, *(f"{name}_in" for name in scans))), PART)
    for name, s in scans.items():
        whole = F.coalesce(name, F.when(F.col(f"{name}_open"), F.col(f"{name}_in"))) if isinstance(s, Last) else F.col(name) + F.when(F.col(f"{name}_open"), F.col(f"{name}_in")).otherwise(0)
        joined = joined.withColumn(name, whole)
    return joined.select(*df.columns, *scans)
