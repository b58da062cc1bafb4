"""Tabular inspection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import repair
from tallyloom.functions.items import json_page
from tallyloom.operators import frequent, places
from tallyloom.operators import inspect as ins
from tallyloom.operators.ordered import natural_order, ranked
from tallyloom.plans.base import read, rounded, scratch, writer


def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of part; a fifth one is a tab, line ends, a padded number or nothing."""
    blank = F.when(F.col("p_size") % 4 == 0, "\t").when(F.col("p_size") % 4 == 1, "\n \n").when(F.col("p_size") % 4 == 2, F.concat(F.lit("\t"), F.col("p_size"), F.lit("\n")))
    out = ins.profile(read(spark, d, "part").withColumn("blank", blank), ["p_name", "p_brand", "p_size", "p_retailprice", "blank"])
    counts = ["nonempty", "empty", "distinct_values", "duplicate_nonempty", "numeric_count", "noninteger_count"]
    return out.select("name", *(F.col(c).cast("long").alias(c) for c in counts), *(rounded(c, 2).alias(c) for c in ("sum_value", "mean_value", "min_value", "max_value")))


def top_values(spark: SparkSession, d: str) -> DataFrame:
    return ins.top_values(read(spark, d, "part"), "p_type", ["p_partkey"])


#: Columns of lineitem with few values, many, and one for nearly every row.
FREQUENT = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def frequent_values(spark: SparkSession, d: str) -> DataFrame:
    """The 25 most frequent values of lineitem's columns, those first met first among equals."""
    li = read(spark, d, "lineitem")
    return frequent.frequent_values(spark, li, list(FREQUENT), ["l_orderkey", "l_linenumber", "l_partkey"], writer(spark)).select("name", "place", "value", "n")


def filter_conditions(spark: SparkSession, d: str) -> DataFrame:
    filters = [{"column": "o_orderstatus", "op": "ne", "value": "P"}, {"column": 5, "op": "not_empty"}, {"column": "o_orderpriority", "op": "contains", "value": "URGENT"}, {"column": "D", "op": "gt", "value": 1000}, {"column": "o_totalprice", "op": "lt", "value": "200000"}]
    return ins.where(read(spark, d, "orders"), filters).select("o_orderkey", "o_custkey")


def filter_null_safe(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    kept = ins.where(docs, [{"column": "lang", "op": "eq", "value": "de"}, {"column": "source", "op": "ne", "value": None}])
    return kept.select("doc_id", "source")


def group_stats(spark: SparkSession, d: str) -> DataFrame:
    out = ins.inspect(read(spark, d, "events"), {"operation": "group", "group_by": "event_type", "columns": ["value", "props"]}, ["event_id"])
    return out.select("event_type", "row_count", "value_count", rounded("value_sum", 2).alias("value_sum"), rounded("value_mean", 4).alias("value_mean"), "props_count", "props_sum")


def correlation(spark: SparkSession, d: str) -> DataFrame:
    out = ins.correlation(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("pair_count", rounded("pearson", 6).alias("pearson"))


def correlation_constant(spark: SparkSession, d: str) -> DataFrame:
    return ins.correlation(read(spark, d, "events").select(F.lit(1).alias("one"), "value"), "one", "value").select("pair_count", rounded("pearson", 6).alias("pearson"))


def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return ins.duplicate_rows(read(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag"))


def rows_page(spark: SparkSession, d: str) -> DataFrame:
    """The feature is a page: 100 rows from the 200th in order of date and key."""
    return ins.page(read(spark, d, "orders"), ["o_orderdate", "o_orderkey"], 200, 100).select("o_orderkey", "o_custkey")


def placed_page(spark: SparkSession, d: str) -> DataFrame:
    """The same page by an index of places, with what it says of the whole."""
    held = places.placed(read(spark, d, "orders"), ["o_orderdate", "o_orderkey"], scratch(spark))
    return held.page(spark, 200, 100).select("place", "o_orderkey", "o_custkey", "total_rows", "next_offset")


def placed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page of 200 orders by date and key: its rows, its first key, and the sum of its customers."""
    held = places.placed(read(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_custkey"), ["o_orderdate", "o_orderkey"], scratch(spark))
    first = F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"]
    return places.every_page(spark, held, 200, lambda rows: rows.groupBy("page").agg(F.count("*").alias("n"), first.alias("first_key"), F.sum("o_custkey").cast("long").alias("customers")))


def mended_props(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events, damaged in one of five ways and mended: how many are whole again, their sum, and what was said."""
    damage = [("}", ""), ('"', "'"), (":", ""), ("}", ",,}"), ("{", 'so: {"x": [1] ')]
    at = F.col("event_id") % len(damage)
    broken = F.col("props")
    for i, (old, new) in enumerate(damage):
        broken = F.when(at == i, F.replace("props", F.lit(old), F.lit(new))).otherwise(broken)
    rows = read(spark, d, "events").select("event_type", at.alias("kind"), repair.mended_objects(broken).alias("m"))
    k = F.try_variant_get(F.try_parse_json("m.json"), "$.k", "long")
    return rows.groupBy("event_type", F.col("kind").cast("long").alias("kind")).agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.array_join(F.array_sort(F.collect_set(F.array_join("m.mended", ","))), ";").alias("said"))


def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    """All dotted numbers of orders' lines with their place in natural order."""
    tasks = read(spark, d, "lineitem").select(F.concat_ws(".", F.col("l_orderkey"), F.col("l_linenumber")).alias("task")).distinct()
    return ranked(tasks, natural_order(F.col("task")), writer(spark)).select("task", "rank")


def json_values(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events by page: how many there are, and the sum of the first one's values, by its key."""
    p = json_page(F.col("props"), [], 0, 1)
    page = read(spark, d, "events").select("event_type", p.alias("p"))
    return page.groupBy("event_type", F.col("p.keys")[0].alias("field"), F.col("p.total").alias("fields")).agg(F.count("*").alias("n"), F.sum(F.col("p.values")[0].try_cast("long")).alias("total"))


def empty_values(spark: SparkSession, d: str) -> DataFrame:
    """Documents, every third reduced to its white space and a tab, that are empty to the inspector."""
    value = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\t"), F.regexp_replace("text", r"\S", ""))).otherwise(F.col("text"))
    return read(spark, d, "documents").groupBy("lang").agg(F.count_if(ins.condition(value, "empty", None)).alias("empty"), F.count_if(ins.condition(value, "not_empty", None)).alias("filled"))


QUERIES = {f.__name__: f for f in (profile_columns, top_values, frequent_values, filter_conditions, filter_null_safe, group_stats, correlation, correlation_constant, duplicate_rows, rows_page, placed_page, placed_pages, mended_props, natural_sort, json_values, empty_values)}


def _profile_sql(c: str, number: bool) -> str:
    n = f"CAST({c} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{c}' AS name, CAST(count({c}) AS BIGINT) AS nonempty, CAST(count(*) - count({c}) AS BIGINT) AS empty, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values, CAST(count({c}) - count(DISTINCT {c}) AS BIGINT) AS duplicate_nonempty,
    CAST(count({n}) AS BIGINT) AS numeric_count, CAST(count(*) FILTER (WHERE {n} <> floor({n})) AS BIGINT) AS noninteger_count, round(sum({n}), 2) AS sum_value, round(avg({n}), 2) AS mean_value, round(min({n}), 2) AS min_value, round(max({n}), 2) AS max_value FROM part"""


ORACLES = {
    "profile_columns": " UNION ALL ".join(_profile_sql(c, n) for c, n in (("p_name", False), ("p_brand", False), ("p_size", True), ("p_retailprice", True))) + " UNION ALL " + _profile_sql("blank", True).replace("FROM part", "FROM (SELECT CASE WHEN p_size % 4 = 2 THEN p_size END AS blank FROM part)"),
    "top_values": "SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, min(p_partkey) LIMIT 25",
    "frequent_values": " UNION ALL ".join(f"SELECT '{c}' AS name, place, value, n FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min((l_orderkey, l_linenumber, l_partkey)), CAST({c} AS VARCHAR)) AS place FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}) WHERE place <= 25" for c in FREQUENT),
    "filter_conditions": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P' AND o_orderdate IS NOT NULL AND contains(o_orderpriority, 'URGENT') AND o_totalprice > 1000 AND o_totalprice < 200000",
    "filter_null_safe": "SELECT doc_id, source FROM documents WHERE lang = 'de' AND source IS NOT NULL",
    "group_stats": "SELECT event_type, count(*) AS row_count, count(value) AS value_count, round(coalesce(sum(value), 0), 2) AS value_sum, round(avg(value), 4) AS value_mean, CAST(0 AS BIGINT) AS props_count, CAST(0 AS DOUBLE) AS props_sum FROM events GROUP BY event_type",
    "correlation": "SELECT count(*) AS pair_count, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem",
    "correlation_constant": "SELECT count(value) AS pair_count, CAST(NULL AS DOUBLE) AS pearson FROM events",
    "duplicate_rows": "SELECT CAST(count(*) AS BIGINT) AS selected_rows, CAST(count(*) - count(DISTINCT (l_quantity, l_discount, l_returnflag)) AS BIGINT) AS duplicate_rows FROM lineitem",
    "rows_page": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 200",
    "placed_page": "SELECT place, o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total_rows, CASE WHEN (SELECT count(*) FROM orders) > 300 THEN CAST(300 AS BIGINT) END AS next_offset FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders) WHERE place BETWEEN 200 AND 299",
    "placed_pages": "SELECT (place - 1) // 200 AS page, count(*) AS n, arg_min(o_orderkey, place) AS first_key, CAST(sum(o_custkey) AS BIGINT) AS customers FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders) GROUP BY 1",
    "mended_props": """SELECT event_type, event_id % 5 AS kind, count(json_extract_string(props, '$.k')) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CASE WHEN count(props) > 0 THEN CASE event_id % 5 WHEN 0 THEN 'bracket left open' WHEN 1 THEN 'other quotes' WHEN 2 THEN 'missing colon' WHEN 3 THEN 'extra comma' ELSE 'words before,missing comma' END ELSE '' END AS said FROM events GROUP BY event_type, event_id % 5""",
    "natural_sort": "SELECT task, row_number() OVER (ORDER BY major, minor) AS rank FROM (SELECT DISTINCT concat(l_orderkey, '.', l_linenumber) AS task, l_orderkey AS major, l_linenumber AS minor FROM lineitem)",
    "json_values": "SELECT event_type, json_keys(props)[1] AS field, CAST(len(json_keys(props)) AS BIGINT) AS fields, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2, 3",
    "empty_values": r"WITH v AS (SELECT lang, text IS NULL OR doc_id % 3 = 0 OR NOT regexp_matches(text, '\S') AS bare FROM documents) SELECT lang, CAST(count(*) FILTER (WHERE bare) AS BIGINT) AS empty, CAST(count(*) FILTER (WHERE NOT bare) AS BIGINT) AS filled FROM v GROUP BY lang",
}
