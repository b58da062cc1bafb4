"""Score rollups over the order tables: lineitems are atoms, orders tasks, return flags metrics, priorities dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import score
from tallyloom.plans.base import read, rounded, shares
from tallyloom.sources.rubric import rubric_violations


def _atoms(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """Lines as atoms, where columns are given dealt by these over as many partitions as the table's splits ask for."""
    li = read(spark, d, "lineitem")
    li = li.repartition(shares(li), *by) if by else li
    return li.select(F.col("l_orderkey").alias("task"), F.col("l_returnflag").alias("metric"), F.col("l_linenumber").alias("atom"), F.col("l_quantity").alias("weight"), F.least(F.col("l_quantity") / 50, F.lit(1.0)).alias("state"), "l_tax")


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("dimension"), "o_orderstatus")


def _scores(atoms: DataFrame) -> DataFrame:
    return score.metric_scores(atoms, ["task"], whole="N")


_RAW = """atoms AS (SELECT l_orderkey AS task, l_returnflag AS metric, l_linenumber AS atom, l_quantity AS weight, least(l_quantity / 50, 1.0) AS state, l_tax FROM lineitem),
raws AS (SELECT task, metric, sum(weight * state) / CASE WHEN metric = 'N' THEN 1 ELSE 20 END AS raw FROM atoms GROUP BY task, metric)"""
_FINAL = f"{_RAW}, finals AS (SELECT task, metric, raw, least(raw, 4.0) AS final FROM raws), scored AS (SELECT o_orderpriority AS dimension, o_orderstatus, finals.* FROM finals JOIN orders ON o_orderkey = task)"


def _finals(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_atoms(spark, d, "l_orderkey")).withColumn("final", F.least("raw", F.lit(4.0))).join(_tasks(spark, d), "task")


def weighted_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _finals(spark, d).groupBy("dimension", "metric").agg(rounded(F.avg("final")).alias("mean"), F.count("*").alias("tasks"))


def _caps(spark: SparkSession, d: str) -> DataFrame:
    """Ceilings that error rules set: a finished order caps R at 2.5 and A at 3, an urgent one A at 2."""
    tasks = _tasks(spark, d)
    rule = lambda test, caps: tasks.where(test).select("task", F.explode(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))).alias("metric", "cap"))
    return rule("o_orderstatus = 'F'", {"R": 2.5, "A": 3.0}).unionByName(rule("dimension = '1-URGENT'", {"A": 2.0}))


_CAPS = """caps AS (SELECT o_orderkey AS task, 'R' AS metric, 2.5 AS cap FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'A', 3.0 FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 'A', 2.0 FROM orders WHERE o_orderpriority = '1-URGENT'), lowest AS (SELECT task, metric, min(cap) AS cap FROM caps GROUP BY task, metric)"""


def capped_scores(spark: SparkSession, d: str) -> DataFrame:
    out = score.apply_caps(_scores(_atoms(spark, d)), _caps(spark, d), ["task", "metric"])
    return out.select("task", "metric", rounded("raw", 9).alias("raw"), F.col("cap").cast("double").alias("cap"), rounded("final", 9).alias("final"))


def scoped_zero(spark: SparkSession, d: str) -> DataFrame:
    """Highly taxed lines of urgent orders count nothing; then the ceilings that name no lines apply."""
    atoms, tasks = _atoms(spark, d), _tasks(spark, d)
    scopes = atoms.where("l_tax >= 0.06").join(tasks.where("dimension = '1-URGENT'"), "task", "left_semi").select("task", "metric", "atom")
    reduced = _scores(score.zero_scoped(atoms, scopes, ["task", "metric", "atom"])).select("task", "metric", F.col("raw").alias("reduced"))
    out = score.apply_caps(reduced.withColumnRenamed("reduced", "raw"), _caps(spark, d), ["task", "metric"])
    return out.select("task", "metric", rounded("raw", 9).alias("reduced"), rounded("final", 9).alias("final"))


def quality_mean(spark: SparkSession, d: str) -> DataFrame:
    out = score.quality_mean(_finals(spark, d), ["task", "dimension"], ["A", "N", "R"])
    return out.select("task", "dimension", rounded("quality_mean", 9).alias("quality_mean"))


def dim_mean_vs_global_mean(spark: SparkSession, d: str) -> DataFrame:
    out = score.equal_means(_finals(spark, d), "dimension", ["metric"])
    return out.select("dimension", "metric", rounded("mean").alias("mean"), "tasks")


def _subject_scores(spark: SparkSession, d: str) -> DataFrame:
    """Nations as tasks, regions as dimensions, market segments as subjects, mean balance as score (in cents, exact)."""
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    cents = F.floor(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) / F.count("*")).cast("long")
    means = c.groupBy("c_nationkey", F.col("c_mktsegment").alias("subject")).agg(cents.alias("final"))
    return means.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long").alias("dimension"), F.col("n_nationkey").cast("long").alias("task"), "subject", "final")


_SUBJECTS = """scores AS (SELECT CAST(n_regionkey AS BIGINT) AS dimension, CAST(n_nationkey AS BIGINT) AS task, c_mktsegment AS subject,
CAST(floor(CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*)) AS BIGINT) AS final FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
diffs AS (SELECT a.dimension, a.task, a.subject, a.final, b.final AS base, a.final - b.final AS difference FROM scores a JOIN scores b ON a.task = b.task AND b.subject = 'AUTOMOBILE' WHERE a.subject <> 'AUTOMOBILE')"""


def baseline_diff(spark: SparkSession, d: str) -> DataFrame:
    return score.baseline_differences(_subject_scores(spark, d), "AUTOMOBILE", ["dimension", "task"])


def diff_extrema_ties(spark: SparkSession, d: str) -> DataFrame:
    coarse = baseline_diff(spark, d).withColumn("difference", F.floor(F.col("difference") / 50_000).cast("long"))
    return score.extrema(coarse, ["dimension", "subject"], "task")


def topk_losses(spark: SparkSession, d: str) -> DataFrame:
    """The three worst lines of each order that lost something: lowest state, then largest weight, then first."""
    lost = _atoms(spark, d, "l_orderkey").where("state < 1")
    out = score.lowest(lost, ["task"], [F.col("state"), F.col("weight").desc(), F.col("atom")], 3)
    return out.select("task", F.col("atom").cast("long").alias("atom"), rounded("state").alias("state"), F.col("rank").cast("long").alias("rank"))


def weakest_atoms(spark: SparkSession, d: str) -> DataFrame:
    joined = _atoms(spark, d, "l_orderkey").join(_tasks(spark, d), "task")
    out = score.lowest(joined, ["dimension", "metric"], [F.col("state"), F.col("weight").desc(), F.col("task"), F.col("atom")], 8)
    return out.select("dimension", "metric", "task", F.col("atom").cast("long").alias("atom"), F.col("rank").cast("long").alias("rank"))


def first_losses(spark: SparkSession, d: str) -> DataFrame:
    """Per dimension the four orders of lowest quality, each with its first loss."""
    first = score.lowest(_atoms(spark, d, "l_orderkey").where("state < 1"), ["task"], [F.col("state"), F.col("atom")], 1).select("task", "atom")
    low = score.lowest(quality_mean(spark, d).join(first, "task"), ["dimension"], [F.col("quality_mean"), F.col("task")], 4)
    return low.select("dimension", "task", F.col("atom").cast("long").alias("atom"), "quality_mean")


def required_weights(spark: SparkSession, d: str) -> DataFrame:
    """What makes orders unfit as rubrics: return flags are metrics, quantities weights, highly taxed lines have no kind."""
    metric = F.when(F.col("l_returnflag") == "R", "completion").when(F.col("l_returnflag") == "A", "coverage").otherwise("accuracy")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), metric.alias("metric"), F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("long").alias("weight"), F.when(F.col("l_tax") < 0.07, "BIN").alias("kind"))
    return rubric_violations(rows)


QUERIES = {f.__name__: f for f in (weighted_rollup, capped_scores, scoped_zero, quality_mean, dim_mean_vs_global_mean, baseline_diff, diff_extrema_ties, topk_losses, weakest_atoms, first_losses, required_weights)}

ORACLES = {
    "weighted_rollup": f"WITH {_FINAL} SELECT dimension, metric, round(avg(final), 4) AS mean, count(*) AS tasks FROM scored GROUP BY dimension, metric",
    "capped_scores": f"WITH {_RAW}, {_CAPS} SELECT r.task, r.metric, round(raw, 9) AS raw, CAST(cap AS DOUBLE) AS cap, round(CASE WHEN cap < raw THEN cap ELSE raw END, 9) AS final FROM raws r LEFT JOIN lowest l ON r.task = l.task AND r.metric = l.metric",
    "scoped_zero": f"""WITH {_RAW}, {_CAPS}, scopes AS (SELECT DISTINCT task, metric, atom FROM atoms JOIN orders ON o_orderkey = task WHERE l_tax >= 0.06 AND o_orderpriority = '1-URGENT'),
        cut AS (SELECT a.task, a.metric, weight, CASE WHEN s.task IS NULL THEN state ELSE 0 END AS state FROM atoms a LEFT JOIN scopes s ON a.task = s.task AND a.metric = s.metric AND a.atom = s.atom),
        low AS (SELECT task, metric, sum(weight * state) / CASE WHEN metric = 'N' THEN 1 ELSE 20 END AS raw FROM cut GROUP BY task, metric)
        SELECT r.task, r.metric, round(raw, 9) AS reduced, round(CASE WHEN cap < raw THEN cap ELSE raw END, 9) AS final FROM low r LEFT JOIN lowest l ON r.task = l.task AND r.metric = l.metric""",
    "quality_mean": f"WITH {_FINAL} SELECT task, dimension, round(sum(final) / 3, 9) AS quality_mean FROM scored GROUP BY task, dimension",
    "dim_mean_vs_global_mean": f"WITH {_FINAL} SELECT dimension, metric, round(avg(final), 4) AS mean, count(*) AS tasks FROM scored GROUP BY GROUPING SETS ((dimension, metric), (metric))",
    "baseline_diff": f"WITH {_SUBJECTS} SELECT dimension, task, subject, final, base, difference FROM diffs",
    "diff_extrema_ties": f"""WITH {_SUBJECTS}, coarse AS (SELECT dimension, task, subject, CAST(floor(CAST(difference AS DOUBLE) / 50000) AS BIGINT) AS difference FROM diffs),
        most AS (SELECT *, max(abs(difference)) OVER (PARTITION BY dimension, subject) AS largest FROM coarse)
        SELECT dimension, subject, largest, coalesce(string_agg(CAST(task AS VARCHAR), ',' ORDER BY CAST(task AS VARCHAR)) FILTER (WHERE abs(difference) = largest), '') AS tied,
        coalesce(string_agg(CAST(task AS VARCHAR), ',' ORDER BY CAST(task AS VARCHAR)) FILTER (WHERE difference > 0), '') AS positive,
        coalesce(string_agg(CAST(task AS VARCHAR), ',' ORDER BY CAST(task AS VARCHAR)) FILTER (WHERE difference < 0), '') AS negative,
        coalesce(string_agg(CAST(task AS VARCHAR), ',' ORDER BY CAST(task AS VARCHAR)) FILTER (WHERE difference = 0), '') AS equal FROM most GROUP BY dimension, subject, largest""",
    "topk_losses": f"WITH {_RAW}, ranked AS (SELECT task, atom, state, row_number() OVER (PARTITION BY task ORDER BY state, weight DESC, atom) AS rank FROM atoms WHERE state < 1) SELECT task, CAST(atom AS BIGINT) AS atom, round(state, 4) AS state, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 3",
    "weakest_atoms": f"WITH {_RAW}, ranked AS (SELECT o_orderpriority AS dimension, metric, task, atom, row_number() OVER (PARTITION BY o_orderpriority, metric ORDER BY state, weight DESC, task, atom) AS rank FROM atoms JOIN orders ON o_orderkey = task) SELECT dimension, metric, task, CAST(atom AS BIGINT) AS atom, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 8",
    "first_losses": f"""WITH {_FINAL}, means AS (SELECT task, dimension, round(sum(final) / 3, 9) AS quality_mean FROM scored GROUP BY task, dimension),
        firsts AS (SELECT task, atom FROM (SELECT task, atom, row_number() OVER (PARTITION BY task ORDER BY state, atom) AS n FROM atoms WHERE state < 1) WHERE n = 1),
        ranked AS (SELECT dimension, means.task, atom, quality_mean, row_number() OVER (PARTITION BY dimension ORDER BY quality_mean, means.task) AS n FROM means JOIN firsts ON means.task = firsts.task)
        SELECT dimension, task, CAST(atom AS BIGINT) AS atom, quality_mean FROM ranked WHERE n <= 4""",
    "required_weights": """WITH a AS (SELECT l_orderkey AS file, CASE l_returnflag WHEN 'R' THEN 'completion' WHEN 'A' THEN 'coverage' ELSE 'accuracy' END AS metric, CAST(l_linenumber AS VARCHAR) AS id, CAST(l_quantity AS BIGINT) AS weight, l_tax FROM lineitem)
        SELECT file, 'weight' AS rule, metric AS detail FROM a GROUP BY ALL HAVING sum(weight) <> 100 UNION ALL SELECT file, 'repeated id', id FROM a GROUP BY file, id HAVING count(*) > 1 UNION ALL SELECT file, 'kind', id FROM a WHERE NOT l_tax < 0.07
        UNION ALL SELECT file, 'missing metric', m FROM (SELECT DISTINCT file FROM a) f, (SELECT unnest(['completion', 'coverage', 'accuracy', 'format', 'structure', 'hallucination']) AS m) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.file = f.file AND a.metric = m)""",
}
