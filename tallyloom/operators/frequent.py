"""Frequent values in two passes: candidates with error bounds from every task, then exact counts of the candidates alone."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import is_empty

#: Values of a column that a task keeps count of. A value that it has dropped stood there no more often than its error says.
KEPT = 4096
SHOWN = 25
#: Candidates of all columns that are sent to every task; more of them meet the rows by a shuffle.
BROADCAST = 100_000


class Summary:
    """Misra-Gries counts of one column: never above the truth, and below it by ``error`` at most."""

    def __init__(self, kept: int = KEPT):
        self.kept, self.error, self.counts = kept, 0, Counter()

    def add(self, counts: dict[str, int]) -> None:
        self.counts.update(counts)
        if len(self.counts) > self.kept:
            cut = sorted(self.counts.values(), reverse=True)[self.kept]
            self.error += cut
            self.counts = Counter({v: n - cut for v, n in self.counts.items() if n > cut})


def _candidates(rows: DataFrame, columns: list[str], kept: int) -> DataFrame:
    """(name, value, n) with at most ``kept`` values per task and column, and (name, null, error) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: Summary(kept) for c in columns}
        for batch in batches:
            for c in columns:
                found = pc.value_counts(batch.column(c).drop_null())
                held[c].add(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)))
        for c, summary in held.items():
            values, counts = [*summary.counts, None], [*summary.counts.values(), summary.error]
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(values), pa.string()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], names=["name", "value", "n"])

    return rows.select(*columns).mapInArrow(run, "name string, value string, n long").groupBy("name", "value").agg(F.sum("n").alias("n"))


def frequent_values(spark: SparkSession, df: DataFrame, columns: list[str], order: list[str], write, k: int = SHOWN, kept: int = KEPT) -> DataFrame:
    """(name, place, value, n, proven): the ``k`` most frequent nonempty values of each column, as text; of equally
    frequent ones the one first met in ``order`` comes first, then the lesser text.

    Summaries of the tasks are added up. Their k-th highest count is a bound from below for the k-th most frequent value:
    what can't reach it, even with all the errors, is no candidate, and the others are counted exactly. Where the errors
    themselves reach it, the summaries prove nothing (``proven`` is false): all values of that column are counted, without
    where they stand, and those as frequent as the k-th are the candidates.
    """
    named = {c: f"c{i}" for i, c in enumerate(columns)}
    at = F.struct(*order)
    cells = df.select(*(F.when(~is_empty(F.col(c)), F.col(c).cast("string")).alias(x) for c, x in named.items()), at.alias("at"))
    found = write(_candidates(cells, list(named.values()), kept))
    # One row per column: its errors, and the k-th of the counts that are surely reached.
    best = found.where("value is not null").withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))).where(F.col("nth") <= k)
    best = best.groupBy("name").agg(F.when(F.count("*") == k, F.min("n")).otherwise(1).alias("least"))
    errors = found.where("value is null").select("name", F.col("n").alias("error"))
    bounds = {x: (0, 1) for x in named.values()} | {r["name"]: (r["error"], r["least"] or 1) for r in errors.join(best, "name", "left").collect()}
    sure = [x for x in named.values() if bounds[x][0] < bounds[x][1]]
    limits = spark.createDataFrame([(x, *bounds[x]) for x in sure], "name string, error long, least long")
    picked = [found.where("value is not null").join(F.broadcast(limits), "name").where("n + error >= least").select("name", "value")]
    for x in named.values():
        if x not in sure:
            every = write(cells.select(F.col(x).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n")))
            most = [r["n"] for r in every.select("n").orderBy(F.desc("n")).limit(k).collect()]
            picked.append(every.where(F.col("n") >= min(most, default=1)).select(F.lit(x).alias("name"), "value"))
    chosen = write(reduce(DataFrame.unionByName, picked))
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST else chosen
    long = cells.select(F.explode(F.array(*(F.struct(F.lit(x).alias("name"), F.col(x).alias("value")) for x in named.values()))).alias("cell"), "at").select("cell.*", "at").where("value is not null")
    counted = long.join(chosen, ["name", "value"], "left_semi").groupBy("name", "value").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "first", "value"))
    back = F.create_map(*(F.lit(v) for c, x in named.items() for v in (x, c)))
    return counted.withColumn("place", place).where(F.col("place") <= k).select(back[F.col("name")].alias("name"), "place", "value", "n", F.col("name").isin(*sure).alias("proven"))
