"""Score rollup: weighted sums, ceilings, scoped zeroing, means, baseline differences, extrema and losses.

Long tables throughout: contributions (task, subject, metric, atom, weight, state), ceilings (task, subject, metric,
cap), scores (task, subject, metric, raw, final). Every step aggregates before it joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metric_scores(contributions: DataFrame, keys: list[str], metric: str = "metric", whole: str | None = "completion") -> DataFrame:
    """raw per key and metric: sum of weight * state, a twentieth of it but for the ``whole`` metric (0 to 100)."""
    total = F.sum(F.col("weight") * F.col("state"))
    scale = F.lit(1) if whole is None else F.when(F.col(metric) == whole, F.lit(1)).otherwise(F.lit(20))
    return contributions.groupBy(*keys, metric).agg(total.alias("total")).withColumn("raw", F.col("total") / scale).drop("total")


def apply_caps(scores: DataFrame, caps: DataFrame, keys: list[str]) -> DataFrame:
    """final = the least of raw and the ceilings; scores without a ceiling keep raw."""
    lowest = caps.groupBy(*keys).agg(F.min("cap").alias("cap"))
    return scores.join(lowest, keys, "left").withColumn("final", F.least("raw", "cap"))


def zero_scoped(contributions: DataFrame, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """Contributions with the state of atoms in a scoped zero ceiling set to 0; ``scopes`` has the keys of such atoms."""
    marked = contributions.join(scopes.select(*keys).distinct().withColumn("hit_", F.lit(True)), keys, "left")
    return marked.withColumn("state", F.when(F.col("hit_"), F.lit(0).cast(contributions.schema["state"].dataType)).otherwise(F.col("state"))).drop("hit_")


def equal_means(scores: DataFrame, dimension: str, keys: list[str], value: str = "final") -> DataFrame:
    """Means over tasks by dimension, and over all tasks directly (dimension null), in one pass."""
    return scores.groupingSets([[dimension, *keys], keys], dimension, *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("tasks"))


def baseline_differences(scores: DataFrame, baseline: str, keys: list[str], subject: str = "subject", value: str = "final") -> DataFrame:
    """Every other subject's value less the baseline's, per key."""
    base = scores.where(F.col(subject) == baseline).select(*keys, F.col(value).alias("base"))
    return scores.where(F.col(subject) != baseline).join(base, keys).withColumn("difference", F.col(value) - F.col("base"))


def extrema(differences: DataFrame, keys: list[str], task: str) -> DataFrame:
    """The largest absolute difference per key with all tasks tied for it, and the tasks above, below and at zero."""
    most = differences.groupBy(*keys).agg(F.max(F.abs("difference")).alias("largest"))
    joined = differences.join(most, keys)
    tasks = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col(task).cast("string")))), ",")
    return joined.groupBy(*keys, "largest").agg(
        tasks(F.abs("difference") == F.col("largest")).alias("tied"),
        tasks(F.col("difference") > 0).alias("positive"),
        tasks(F.col("difference") < 0).alias("negative"),
        tasks(F.col("difference") == 0).alias("equal"),
    )


def lowest(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows per key in a total order (Spark limits each group before the shuffle)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def quality_mean(scores: DataFrame, keys: list[str], metrics: list[str], value: str = "final") -> DataFrame:
    """The sum of the quality metrics' values over their number."""
    return scores.where(F.col("metric").isin(*metrics)).groupBy(*keys).agg((F.sum(value) / len(metrics)).alias("quality_mean"))


def process_stats(records: DataFrame, keys: list[str]) -> DataFrame:
    """Timed runs, their mean seconds, and successes that no negation takes back."""
    ok = F.col("status").contains("成功") & ~F.col("status").rlike("未成功|不成功|失败")
    return records.groupBy(*keys).agg(F.count("seconds").alias("duration_count"), F.avg("seconds").alias("mean_seconds"), F.count_if(F.coalesce(ok, F.lit(False))).alias("success_count"))
