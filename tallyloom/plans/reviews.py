"""Review, reporting and inventory queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import review, score
from tallyloom.plans.base import read, rounded, shares
from tallyloom.sources import sinks


def affected_findings(spark: SparkSession, d: str) -> DataFrame:
    """Costly lines in the metrics that finished or urgent orders touch."""
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    errors = o.select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "E1").otherwise("E2").alias("error"), ((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT")).alias("triggered"))
    rules = spark.createDataFrame([("E1", "R"), ("E1", "A"), ("E2", "N")], "error string, metric string")
    parts = shares(li)
    found = li.repartition(parts, "l_orderkey", "l_returnflag").select(F.col("l_orderkey").alias("task"), F.col("l_returnflag").alias("metric"), (F.col("l_quantity") / 50).alias("state"), F.col("l_linenumber").cast("long").alias("atom"))
    return review.eligible(found, review.affected_metrics(errors, rules, parts)).groupBy("task", "metric").agg(F.count("*").alias("n"), F.min("atom").alias("least"))


def process_stats(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs of their users: purchases succeed, views don't, errors have no status; a value is a time."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "运行成功").when(kind == "view", "未成功").when(kind == "click", "部分成功")
    out = score.process_stats(read(spark, d, "events").select("user_id", status.alias("status"), F.when(F.col("value") > 5, F.floor("value")).alias("seconds")), ["user_id"])
    return out.select("user_id", "duration_count", rounded("mean_seconds", 6).alias("mean_seconds"), "success_count")


def shallow_inventory(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "pages").select(F.regexp_extract("url", r"^https?://(?:www\.|m\.|blog\.)?([^/]+)", 1).alias("host"), F.regexp_replace("url", "^https?://", "").alias("file")).distinct()
    return review.shallow_files(files, ["host"], 12, 200).select("host", "file", F.col("nth").cast("long").alias("nth"))


def scope_problems(spark: SparkSession, d: str) -> DataFrame:
    """Labels asked of English documents, beside those that came for any."""
    asked = read(spark, d, "documents").where("lang = 'en'").select("doc_id")
    return review.wrong_scope(read(spark, d, "labels").select("doc_id").distinct(), asked, ["doc_id"])


def supported_shares(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("supported"))
    return review.supported_share(items, ["source"]).select("source", "numerator", "denominator", rounded("state", 9).alias("state"))


def owner_problems(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as owners of parts, known if they aren't in debt: unknown ones, and two of one nation for a part."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("metric"), "s_acctbal")
    lines = read(spark, d, "lineitem").select(F.col("l_partkey").alias("defect"), F.col("l_suppkey").alias("atom_id")).distinct()
    owners = lines.join(s.select(F.col("id").alias("atom_id"), "metric"), "atom_id")
    return review.owner_violations(owners, s.where("s_acctbal >= 0").select("id", "metric")).groupBy("entity", "rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("defects"))


def uncovered_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Customers that neither order nor share a key with a supplier."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return review.uncovered(c, read(spark, d, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("id")), read(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


def delivery_dates(spark: SparkSession, d: str) -> DataFrame:
    """Distinct days of each user's events, in order."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(day)), ",").alias("days"))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("files"))


def score_table(spark: SparkSession, d: str) -> DataFrame:
    """Markdown rows of segment balances per nation, two decimals half up."""
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("task"), F.col("c_mktsegment").alias("subject")).agg(F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))
    scores = c.select("task", F.lit("balance").alias("metric"), F.lit(1).alias("metric_pos"), F.col("subject").alias("subject_pos"), (F.col("cents").cast("decimal(20,0)") / 100).alias("final"))
    return sinks.score_lines(scores).select("task", "line")


def chart_pages(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), "c_custkey")
    return sinks.chart_ledger(c, ["nation"], ["c_custkey"]).groupBy("nation", "offset").agg(F.count("*").alias("rows"), F.min("c_custkey").alias("first"))


def stated_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Witnesses made of lineitems: a price against a part's number, each in a quote of its own."""
    price = F.format_string("%d", F.floor("l_extendedprice").cast("long"))
    side = lambda v, q: F.struct(v.alias("value"), F.lit("u").alias("unit"), q.alias("quote"))
    w = read(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").alias("id"), F.when(F.col("l_linenumber") == 7, "ne").otherwise("gt").alias("operator"),
        side(price, F.concat(F.lit("price "), F.when(F.col("l_linenumber") == 1, "none").otherwise(price))).alias("left"), side(F.col("l_partkey").cast("string"), F.concat(F.lit("part "), F.col("l_partkey"))).alias("right"), "l_linenumber",
    )
    out = review.witness_check(w)
    return out.where("times = 1").groupBy(F.col("l_linenumber").cast("long").alias("line"), "holds", F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (affected_findings, process_stats, shallow_inventory, scope_problems, supported_shares, owner_problems, uncovered_reviews, delivery_dates, category_counts, score_table, chart_pages, stated_comparisons)
}

ORACLES = {
    "affected_findings": """WITH e AS (SELECT o_orderkey AS task, CASE WHEN o_orderstatus = 'F' THEN 'E1' ELSE 'E2' END AS error FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'), r(error, metric) AS (VALUES ('E1', 'R'), ('E1', 'A'), ('E2', 'N')), a AS (SELECT DISTINCT task, metric FROM e JOIN r USING (error))
        SELECT l_orderkey AS task, l_returnflag AS metric, count(*) AS n, CAST(min(l_linenumber) AS BIGINT) AS least FROM lineitem JOIN a ON l_orderkey = task AND l_returnflag = metric WHERE l_quantity / 50 < 1 GROUP BY ALL""",
    "process_stats": "SELECT user_id, count(*) FILTER (WHERE value > 5) AS duration_count, round(avg(CASE WHEN value > 5 THEN floor(value) END), 6) AS mean_seconds, count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS success_count FROM events GROUP BY user_id",
    "shallow_inventory": r"""WITH f AS (SELECT DISTINCT regexp_extract(url, '^https?://(?:www\.|m\.|blog\.)?([^/]+)', 1) AS host, regexp_replace(url, '^https?://', '') AS file FROM pages), n AS (SELECT *, row_number() OVER w AS nth, sum(length(file)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM f WINDOW w AS (PARTITION BY host ORDER BY length(file) - length(replace(file, '/', '')), file))
        SELECT host, file, nth FROM n WHERE nth <= 12 AND used <= 200""",
    "scope_problems": "WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), c AS (SELECT DISTINCT doc_id FROM labels) SELECT doc_id, 'not asked for' AS problem FROM c WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION ALL SELECT doc_id, 'missing' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM c)",
    "supported_shares": "SELECT source, count(*) FILTER (WHERE quality = 1) AS numerator, count(*) AS denominator, round(count(*) FILTER (WHERE quality = 1) / count(*), 9) AS state FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "owner_problems": """WITH o AS (SELECT DISTINCT l_partkey AS defect, s_suppkey AS atom, s_nationkey AS metric, s_acctbal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), v AS (SELECT defect, 'unknown owner' AS rule FROM o WHERE s_acctbal < 0 UNION ALL SELECT defect, 'two owners in a metric' FROM o GROUP BY defect, metric HAVING count(*) > 1)
        SELECT 'defect' AS entity, rule, count(*) AS n, count(DISTINCT defect) AS defects FROM v GROUP BY rule""",
    "uncovered_reviews": "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "delivery_dates": "SELECT user_id, string_agg(DISTINCT strftime(ts, '%Y-%m-%d'), ',' ORDER BY strftime(ts, '%Y-%m-%d')) AS days FROM events GROUP BY user_id",
    "category_counts": "SELECT source, lang, count(*) AS files FROM documents GROUP BY source, lang",
    "score_table": "WITH s AS (SELECT CAST(c_nationkey AS BIGINT) AS task, c_mktsegment AS subject, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS cents FROM customer GROUP BY ALL) SELECT task, '| balance | ' || string_agg(CAST(CAST(cents AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2))::VARCHAR, ' | ' ORDER BY subject) || ' |' AS line FROM s GROUP BY task",
    "chart_pages": 'WITH n AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 15 * 15 AS o FROM customer) SELECT nation, CAST(o AS BIGINT) AS "offset", count(*) AS rows, min(c_custkey) AS first FROM n GROUP BY nation, o',
    "stated_comparisons": """WITH w AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS times FROM lineitem)
        SELECT CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_linenumber = 7 THEN NULL ELSE floor(l_extendedprice) > l_partkey END AS holds, CASE l_linenumber WHEN 7 THEN 'operator' WHEN 1 THEN 'left not in its quote' ELSE '' END AS broken, count(*) AS n FROM w WHERE times = 1 GROUP BY ALL""",
}
