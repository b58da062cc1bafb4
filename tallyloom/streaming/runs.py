"""Streams that remember: line numbers of growing logs, and runs that fall silent, are overdue, done or still running.

State lies in the query's checkpoint (RocksDB), by key, so that a restart goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _remembering(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class _Lines(StatefulProcessor):
    """Numbers a log's lines over all of its segments; segments of one batch in their own order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "pos long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        pos = self.next.get()[0] if self.next.exists() else 0
        for row in sorted(rows, key=lambda r: r["segment"]):
            for line in (row["value"] or "").removesuffix("\n").split("\n"):
                yield Row(file=key[0], pos=pos, line=line)
                pos += 1
        self.next.update((pos,))

    def close(self) -> None:
        pass


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of logs as they grow, each line numbered from 0 over the whole log.

    A log is a file ``name.jsonl``, or grows by segments ``name.1.jsonl``, ``name.2.jsonl``: then file is ``name.jsonl``.
    Segments count in the order of their numbers within a batch, and of their arrival between batches.
    """
    _remembering(spark)
    name = F.col("_metadata.file_path")
    segment = F.coalesce(F.regexp_extract(name, r"\.(\d+)\.jsonl$", 1).try_cast("long"), F.lit(0))
    texts = spark.readStream.text(path, wholetext=True).select(F.regexp_replace(name, r"\.\d+(\.jsonl)$", "$1").alias("file"), segment.alias("segment"), "value")
    return texts.groupBy("file").transformWithState(_Lines(), "file string, pos long, line string", "Append", "None")


class _Runs(StatefulProcessor):
    """A run's state from when it began, spoke first and was done; a timer ends each wait."""

    def __init__(self, names: list[str], first: int, total: int):
        self.row, self.first, self.total = Row(*names, "state", "as_of"), first, total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "started long, first long, done long, state string")

    def _state(self, started: int, first: int | None, done: int | None, now: int) -> str:
        if (now if first is None else first) - started > self.first:
            return "silent"
        if (now if done is None else done) - started > self.total:
            return "overdue"
        return "running" if done is None else "done"

    def _told(self, key, now: int, started, first, done, state) -> Iterator[Row]:
        """The state as it is now, if it isn't the one told last."""
        current = None if started is None else self._state(started, first, done, now)
        self.known.update((started, first, done, current))
        if current != state:
            yield self.row(*key, current, now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        started, first, done, state = self.known.get() if self.known.exists() else (None,) * 4
        least = lambda old, at: at if old is None else min(old, at)
        for row in rows:
            at = int(row["at"].timestamp() // 1)
            if row["starts"]:
                started = least(started, at)
            else:
                first = least(first, at)
                done = least(done, at) if row["done"] else done
        if started is not None:
            for wait in {self.first, self.total}:
                self.handle.registerTimer((started + wait + 1) * 1000)
        yield from self._told(key, timerValues.getCurrentWatermarkInMs() // 1000, started, first, done, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.known.exists():
            started, *rest = self.known.get()
            now = timerValues.getCurrentWatermarkInMs() // 1000
            yield from self._told(key, now, started, *rest)
            if now - started > max(self.first, self.total):
                # Nothing that is still let in can change it.
                self.known.clear()

    def close(self) -> None:
        pass


def run_states(starts: DataFrame, events: DataFrame, keys: list[str], first: int, total: int, late: str = "0 seconds") -> DataFrame:
    """A stream of (keys, state, as_of): one row whenever a run's state changes; the last row of a run is its state.

    ``starts``: keys, started_at; ``events``: keys, at, done; both streams. silent: no event within ``first`` seconds of
    the start; overdue: not done within ``total``; else done or running, as ``resolve.timeouts`` says of a table with now
    at the watermark. What is older than the watermark is dropped; an event may come before its start. A run's state is
    forgotten once both waits are over.
    """
    _remembering(events.sparkSession)
    one = starts.select(*keys, F.col("started_at").cast("timestamp").alias("at"), F.lit(True).alias("starts"), F.lit(False).alias("done"))
    other = events.select(*keys, F.col("at").cast("timestamp").alias("at"), F.lit(False).alias("starts"), F.coalesce("done", F.lit(False)).alias("done"))
    rows = one.unionByName(other).withWatermark("at", late)
    schema = T.StructType([*(one.schema[k] for k in keys), T.StructField("state", T.StringType()), T.StructField("as_of", T.LongType())])
    return rows.groupBy(*keys).transformWithState(_Runs(keys, first, total), schema, "Update", "EventTime")
