"""Queries over layouts, process records, answers, corrections, quotes and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import items, text
from tallyloom.operators import contract, inspect, review, validate
from tallyloom.plans.base import read, writer
from tallyloom.sources import deliveries, files, material, office


def discovered_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files two levels deep: priorities are dimensions, orders tasks; those of customers divisible by 7 are temporary."""
    name = F.concat(F.when(F.col("o_custkey") % 7 == 0, "~$").otherwise(""), F.lit("f"), F.col("o_custkey"), F.lit(".txt"))
    paths = read(spark, d, "orders").select(F.concat_ws("/", F.when(F.col("o_orderstatus") == "F", F.translate("o_orderpriority", "12345", "一二三四五")).otherwise(F.col("o_orderpriority")), F.concat(F.col("o_orderkey"), F.lit("."), F.col("o_orderstatus")), name).alias("path"))
    found = files.discover(paths)
    return found.select("task", F.col("dimension").cast("long").alias("dimension"), "dimension_name", "task_name", "rest")


def owned_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files of their customers: who owns each by its name or folder, and how many prefixes match."""
    return deliveries.owned(_order_files(spark, d), _subjects(spark), ["x"]).select("task", "path", "matches", "owner")


def delivery_problems(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with customers' folders of orders: no question or rubric, files of several subjects, no delivery of one."""
    files_ = _order_files(spark, d)
    found = deliveries.delivery_violations(files_, deliveries.owned(files_, _subjects(spark), ["x"]), _subjects(spark))
    return found.groupBy("entity", "rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def _subjects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("alpha", "A"), ("beta", "b"), ("gamma", "BB")], "id string, prefix string")


def _order_files(spark: SparkSession, d: str) -> DataFrame:
    """A file per order in its customer's folder: by price under a folder, by priority with a prefix; the cheapest are
    questions and rubrics, those of state P temporary."""
    cents = F.floor(F.col("o_totalprice")).cast("long")
    folder = F.element_at(F.array(*map(F.lit, ("a-x/", "Bb/sub/", "x1/", "", "c/"))), (cents % 5 + 1).cast("int"))
    name = F.concat(F.when(F.col("o_orderstatus") == "P", "~$").otherwise(""), F.element_at(F.array(*map(F.lit, ("a", "B", "bb", "s", "X"))), F.left("o_orderpriority", F.lit(1)).cast("int")), F.col("o_orderkey"), F.lit(".txt"))
    path = F.when(cents % 11 == 0, deliveries.QUESTION).when(cents % 11 == 1, deliveries.RUBRIC).otherwise(F.concat(folder, name))
    return read(spark, d, "orders").select(F.col("o_custkey").alias("task"), path.alias("path"))


def process_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows of a process sheet, their columns as cells; the labels of some are mapped to tasks."""
    c = read(spark, d, "customer")
    cell = lambda col, value: F.struct(F.lit(col).cast("long").alias("col"), value.alias("value"))
    label = F.when(F.col("c_nationkey") < 5, F.col("c_name")).otherwise(F.concat_ws(".", "c_nationkey", "c_custkey"))
    cells = c.select(F.col("c_custkey").alias("row"), F.explode(F.array(cell(3, label), cell(28, F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))))).alias("c")).select("row", "c.col", "c.value").where("value is not null")
    labels = c.where("c_nationkey < 3").select(F.col("c_name").alias("label"), F.concat_ws(".", F.lit("9"), "c_custkey").alias("task"))
    out = files.process_records(cells, {"task_label": "C", "runtime": "AB"}, 5, 10_000_000, labels)
    return out.select(F.col("row").cast("long").alias("row"), "task_label", "task", "runtime")


def worksheet_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a range of a sheet made of the parts: rows are parts, columns their sizes and prices."""
    p = read(spark, d, "part")
    cells = p.select(F.col("p_partkey").alias("row"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("col"), v.alias("value")) for i, v in ((1, F.col("p_name")), (2, F.col("p_size").cast("string")), (27, F.col("p_brand")))))).alias("c")).select("row", "c.*")
    return office.cell_range(cells, "B1:AA150").select("row", "col", "value")


def answer_documents(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties as answers: between marker lines, between markers, in a fence, or with words around that leave none."""
    p = F.col("props")
    answer = F.when(F.col("event_type") == "click", F.concat(F.lit("as BEGIN_JUDGMENT and END_JUDGMENT say\nBEGIN_JUDGMENT\n"), p, F.lit("\nEND_JUDGMENT\n"))).when(F.col("event_type") == "view", F.concat(F.lit("so BEGIN_JUDGMENT "), p, F.lit(" END_JUDGMENT."))).when(F.col("event_type") == "purchase", F.concat(F.lit("```json\n"), p, F.lit("\n```"))).otherwise(F.concat(F.lit("I say "), p))
    k = F.try_variant_get(files.json_block(answer), "$.k", "long")
    return read(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


def newest_events(spark: SparkSession, d: str) -> DataFrame:
    """The five newest events of each user."""
    e = read(spark, d, "events").select("user_id", F.col("ts").alias("modified_at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("file"))
    return files.newest(e, ["user_id"], 5).select("user_id", "file")


def permanent_failures(spark: SparkSession, d: str) -> DataFrame:
    """Documents one of whose lines holds a marker of failures that last."""
    lines = F.split("text", "\n")
    return read(spark, d, "documents").select("doc_id", F.coalesce(review.is_permanent(lines, ["Nthe", " ER "]), F.lit(False)).alias("lasting"))


def corrected_balances(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances, corrected by those of the supplier of their number."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    return review.corrected_records(c, s, ["balance"])


def correction_problems(spark: SparkSession, d: str) -> DataFrame:
    """Orders' lines as corrections of parts' states: known small parts, eligible if cheap, that must not get worse."""
    before = read(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 40).alias("state"))
    cheap = read(spark, d, "part").where("p_retailprice < 950").select(F.col("p_partkey").alias("id"))
    after = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"), (F.col("l_quantity") / 50).alias("state"))
    return review.correction_violations(before, after, cheap).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("parts"))


def lowered_states(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose tax is under their discount, as states that a review lowers."""
    li = read(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").alias("id"), "l_tax", "l_discount").dropDuplicates(["id"])
    text_ = lambda c: F.concat(F.round(F.col(c) * 100).cast("long"), F.lit("/100"))
    out = validate.lowered(li.select("id", text_("l_discount").alias("state")), li.select("id", text_("l_tax").alias("state")))
    return out.groupBy(F.col("old").cast("double").alias("old"), "state").agg(F.count("*").alias("n"))


def quote_problems(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of documents that aren't in them: the middle of their text, of German ones backwards, of some from no document."""
    docs = read(spark, d, "documents").where("length(text) > 100")
    quote = F.substring("text", 20, 60)
    quotes = docs.select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src1", "none").otherwise(F.col("doc_id").cast("string")).alias("file"), F.when(F.col("lang") == "de", F.reverse(quote)).otherwise(quote).alias("quote"))
    return review.unfounded_quotes(quotes, docs.select(F.col("doc_id").cast("string").alias("file"), "text")).select("id", "file")


def accounted_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ratios over half as many again things as they have lines: heavy lines are groups of two members, light
    ones what an inspector counted (their tax in per cent, from 0 up, or a word), others themselves; urgent ones have a target."""
    members = F.when(F.col("l_quantity") > 40, F.array_repeat(F.lit("m"), 2)).otherwise(F.array().cast("array<string>"))
    light = F.col("l_quantity") < 8
    count = F.when(light, F.when(F.col("l_tax") > 0.075, "some").otherwise(F.concat(F.lit(" "), F.round(F.col("l_tax") * 100).cast("long"), F.lit("\n"))))
    item = F.struct(members.alias("members"), count.alias("count"), F.when(light, validate.INSPECTED).alias("method"), F.lit("all").alias("scope"), F.when(F.col("l_linenumber") < 6, "here").otherwise("").alias("location"), F.col("l_linenumber").alias("nth"))
    # Of light lines of one number the one that comes first in the table is named.
    row = F.when(light, F.struct("_metadata.file_path", "_metadata.row_index"))
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row"), item.alias("item")))).alias("items"), F.count("*").alias("n"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "BIN").when(F.col("o_orderstatus") == "O", "RATIO").otherwise("CLAIM-RATIO").alias("kind"), F.when(F.col("o_orderpriority") == "1-URGENT", "min(n/5, 1)").otherwise("n").alias("rule"))
    rows = lines.withColumn("items", F.transform("items", lambda x: x["item"])).join(o, "id").withColumn("denominator", F.floor(F.col("n") * 1.5))
    return validate.accounting(rows)


def review_problems(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reviews of their lines: how many problems of each kind a review contract finds.

    Suppliers' lines are defects, their parts atoms, comparisons of price with a bound witnesses; what is left out, named
    twice or unlike follows from quantities, days and priorities.
    """
    values = ("l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus", "l_extendedprice", "l_suppkey")
    # Every part of a review reads the lines: they are grouped once.
    lines = writer(spark)(read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in values)))
    li = lines.select(F.col("l_orderkey").alias("review"), F.col("l_linenumber").alias("n"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"), *values)
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("review"), "o_orderpriority", "o_custkey")
    named = F.when(F.col("o_custkey") % 9 == 0, F.lit("\t\n")).otherwise(F.col("o_orderpriority"))
    checks = orders.select("review", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), (F.lit("\n ") if c == "ownership" else named).alias("text")) for c in contract.CHECKS[:3]), F.struct(F.lit(contract.CHECKS[3]).alias("name"), F.col("o_orderpriority").alias("text")))).alias("c")).select("review", "c.*")
    metric = F.col("l_returnflag")
    atoms = li.select("review", "id", metric.alias("metric"))
    evidence = lambda quote: F.array(F.struct(F.lit("f.txt").alias("file"), F.lit("L1").alias("locator"), quote.alias("quote"), F.lit("text").alias("kind"), F.lit("").alias("description")))
    items = F.array(F.struct(F.lit("x").alias("label"), F.lit("").alias("result"), F.array().cast("array<string>").alias("members"), F.lit("1").alias("count"), F.lit("").alias("method"), F.lit("").alias("scope"), F.lit("").alias("location")))
    records = li.select("review", "id", F.lit("RATIO").alias("kind"), F.lit("n").alias("rule"), F.when(F.col("l_quantity") < 25, "0").otherwise("1").alias("state"), F.when(F.col("l_quantity") < 25, "0").otherwise("1").alias("numerator"), F.when(F.col("l_quantity") > 48, "2").otherwise("1").alias("denominator"), F.lit("a reason that is long enough").alias("reason"), F.lit("seen there").alias("observation"), evidence(F.lit("q")).alias("evidence"), items.alias("items"))
    fixed = (F.col("state") == "0") & (F.substring("id", -1, 1) == "2")
    corrections = records.where(fixed).withColumn("state", F.lit("0.5"))
    defects = li.where("l_discount >= 0.05").select("review", F.concat(F.lit("D"), F.when(F.col("l_discount") > 0.09, "1").otherwise(F.col("n").cast("string"))).alias("id"), F.when(F.col("l_tax") < 0.01, " \t").otherwise("conflict").alias("description"), F.when(F.col("l_tax") > 0.075, F.array().cast(records.schema["evidence"].dataType)).otherwise(evidence(F.when(F.col("l_quantity") > 45, "").otherwise("q"))).alias("evidence"))
    owners = li.where("l_discount >= 0.05 and l_linestatus = 'O'").select("review", F.concat(F.lit("D"), F.col("n").cast("string")).alias("defect"), F.col("id").alias("atom_id"), F.when(F.col("l_tax") > 0.06, "Z").otherwise(metric).alias("metric"), F.when(F.col("l_suppkey") % 5 == 0, "\n").otherwise("lost").alias("consequence"))
    witnesses = li.select("review", "id", F.when(F.col("l_returnflag") == "A", "conditional").otherwise("asserted").alias("kind"), (F.col("l_extendedprice") > 30000).alias("holds"))
    findings = li.where("l_tax < 0.07").select("review", F.when(F.col("l_tax") == 0, "none").otherwise(F.col("id")).alias("id"), F.when(F.col("l_quantity") == 7, "").otherwise("why").alias("reason"), F.when(F.col("l_linestatus") == "O", contract.CONFIRMED).when(F.col("l_returnflag") == "A", contract.EXCLUDED).otherwise("open").alias("decision"), F.concat(F.lit("D"), F.col("n").cast("string")).alias("defect_id"), F.when(F.col("l_quantity") > 30, F.col("id")).alias("rule_id"))
    found = contract.review_violations(orders.select("review"), checks, records, corrections, defects, owners, atoms, spark.createDataFrame([("f.txt",)], "file string"), witnesses, None, findings)
    return found.groupBy("entity", "rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def count_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets that orders' rules state: n over the customer, clipped to it, clipped to another number, or none."""
    k = F.col("o_custkey").cast("string")
    rule = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("MIN( n / "), k, F.lit(" , 1.0 )"))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("min(n，"), k, F.lit(")/"), F.when(F.col("o_totalprice") > 200000, k).otherwise("7"))).otherwise(F.concat(F.lit("n / "), k))
    return read(spark, d, "orders").select("o_orderkey", validate.count_target(rule).alias("target"))


def time_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Orders as decisions on when something ran: failed and urgent ones without a date need another look."""
    rule = F.when(F.col("o_orderpriority") == "1-URGENT", "实际执行不晚于截止日").when(F.col("o_orderpriority") == "2-HIGH", "实际执行").otherwise("运行早于截止")
    need = review.needs_time_review(F.when(F.col("o_totalprice") > 100000, "BIN").otherwise("RATIO"), (F.col("o_orderstatus") == "O").cast("int"), rule, F.when(F.col("o_custkey") > 500, F.col("o_orderdate")))
    return read(spark, d, "orders").select("o_orderkey", need.alias("need"))


def mentioned_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that orders' rules mention, call the same as theirs, and share the sample of."""
    a, b = F.concat(F.lit("A"), F.col("o_custkey")), F.concat(F.lit("T"), F.col("o_orderkey"))
    rule = F.concat(F.when(F.col("o_orderstatus") == "F", "核验全集同 ").when(F.col("o_orderstatus") == "O", "拆分 同").otherwise("见 "), a, F.lit(" / "), b, F.lit("；另见 C7"))
    list_ = lambda c: F.array_join(c, ",")
    return read(spark, d, "orders").select("o_orderkey", list_(review.mentioned(rule)).alias("mentioned"), list_(review.references(rule)).alias("same"), list_(review.shared_references(rule)).alias("shared"))


def blank_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents left without those that have neither text nor language."""
    rows = read(spark, d, "documents").select(F.nullif("lang", F.lit("fr")).alias("lang"), F.when(F.length("text") > 500, F.length("text")).alias("size"))
    return inspect.drop_blank(rows).groupBy("lang").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


def page_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages by their number."""
    found = material.evidence(read(spark, d, "pages"), ["page_id"])
    return found.select("page_id", "kind", "locator", "text", "target", "limitation")


def located_text(spark: SparkSession, d: str) -> DataFrame:
    """How many lines conversations' turns have, by the locator of the last."""
    last = F.regexp_extract(text.locate_lines(F.col("text")), r"(?s).*(?:^|\n)L(\d+): ", 1)
    return read(spark, d, "conversations").groupBy("role", last.try_cast("long").alias("lines")).agg(F.count("*").alias("n"))


def repeated_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders' lines as process records of their suppliers: tasks with more than one that says anything."""
    li = read(spark, d, "lineitem").select(F.concat_ws(".", "l_suppkey", "l_linenumber").alias("task"), F.when(F.col("l_tax") > 0.06, F.lit("3m")).alias("runtime"), F.when(F.col("l_returnflag") == "R", F.lit("成功")).alias("status"))
    return files.repeated_tasks(li)


def error_problems(spark: SparkSession, d: str) -> DataFrame:
    """Orders as decisions on customers' errors: each customer of the machinery segment once, with a reason, with evidence if finished."""
    known = read(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("id"))
    evidence = F.when(F.col("o_totalprice") > 100000, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    told = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("triggered"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("reason"), evidence.alias("evidence"))
    return validate.error_violations(told, known).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("errors"))


def loss_briefs(spark: SparkSession, d: str) -> DataFrame:
    """Orders' losses: returned lines failed, by part; those without any say why in their priority."""
    item = F.to_json(F.struct(F.concat(F.lit("part "), "l_partkey").alias("claim"), F.when(F.col("l_returnflag") == "R", F.when(F.col("l_tax") > 0.04, "unsupported").otherwise("fail")).otherwise("pass").alias("result"), F.when(F.col("l_discount") > 0.05, F.concat(F.lit("line "), "l_linenumber")).alias("location")))
    li = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_quantity", item.alias("item")))), lambda x: x["item"]).alias("items"), F.count("*").alias("n"))
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(li, "o_orderkey")
    return o.select("o_orderkey", items.loss_brief(F.col("items"), F.lit(0), F.col("n"), F.col("o_orderpriority")).alias("brief"))


QUERIES = {
    f.__name__: f
    for f in (
        discovered_files, process_rows, worksheet_cells, answer_documents, newest_events, permanent_failures, corrected_balances, correction_problems, lowered_states, quote_problems, accounted_items, review_problems, owned_deliveries, delivery_problems, count_targets, time_reviews, mentioned_ids, blank_rows,
        page_evidence, located_text, repeated_records, error_problems, loss_briefs,
    )
}

_OWNED = """f AS (SELECT o_custkey AS task, CASE CAST(floor(o_totalprice) AS BIGINT) % 11 WHEN 0 THEN '问题描述.txt' WHEN 1 THEN 'rubric.md' ELSE ['a-x/', 'Bb/sub/', 'x1/', '', 'c/'][CAST(floor(o_totalprice) AS BIGINT) % 5 + 1] || CASE WHEN o_orderstatus = 'P' THEN '~$' ELSE '' END || ['a', 'B', 'bb', 's', 'X'][CAST(left(o_orderpriority, 1) AS INT)] || o_orderkey || '.txt' END AS path FROM orders),
    n AS (SELECT task, path, lower(regexp_extract(path, '[^/]*$')) AS name, lower(string_split(path, '/')[1]) AS first FROM f WHERE path NOT IN ('问题描述.txt', 'rubric.md')),
    o AS (SELECT task, path, list_filter(['alpha', 'beta', 'gamma'], lambda s: starts_with(name, CASE s WHEN 'alpha' THEN 'a' WHEN 'beta' THEN 'b' ELSE 'bb' END) OR starts_with(first, CASE s WHEN 'alpha' THEN 'a' WHEN 'beta' THEN 'b' ELSE 'bb' END)) AS ids FROM n WHERE NOT starts_with(name, '~$') AND NOT starts_with(name, 'x') AND NOT starts_with(first, 'x'))"""

ORACLES = {
    "discovered_files": """SELECT substr(o_orderpriority, 1, 1) || '.' || o_orderkey AS task, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS dimension, substr(o_orderpriority, 3) AS dimension_name, o_orderstatus AS task_name, 'f' || o_custkey || '.txt' AS rest FROM orders WHERE o_custkey % 7 <> 0""",
    "process_rows": """WITH c AS (SELECT c_custkey AS row, CASE WHEN c_nationkey < 5 THEN c_name ELSE c_nationkey || '.' || c_custkey END AS task_label, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS runtime FROM customer WHERE c_custkey >= 5)
        SELECT row, task_label, CASE WHEN c_nationkey < 3 THEN '9.' || row WHEN c_nationkey >= 5 THEN task_label END AS task, runtime FROM c""",
    "worksheet_cells": "SELECT p_partkey AS row, CAST(2 AS BIGINT) AS col, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_partkey BETWEEN 1 AND 150 UNION ALL SELECT p_partkey, 27, p_brand FROM part WHERE p_partkey BETWEEN 1 AND 150",
    "answer_documents": "SELECT event_type, count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase') AND props IS NOT NULL) AS n, CAST(sum(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS total FROM events GROUP BY event_type",
    "newest_events": "SELECT user_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS file FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 5",
    "permanent_failures": "SELECT doc_id, coalesce(contains(lower(text), 'nthe') OR contains(lower(text), ' er '), false) AS lasting FROM documents",
    "corrected_balances": "SELECT c_custkey AS id, c_name AS name, coalesce(CASE WHEN s_acctbal > 0 THEN s_acctbal END, c_acctbal) AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "correction_problems": """WITH a AS (SELECT l_partkey AS id, l_quantity / 50 AS state, count(*) OVER (PARTITION BY l_partkey) AS times FROM lineitem WHERE l_returnflag = 'R'), j AS (SELECT a.*, p_size / 40 AS old FROM a LEFT JOIN part ON p_partkey = id AND p_size < 40),
        v AS (SELECT id, 'unknown' AS rule FROM j WHERE old IS NULL UNION ALL SELECT id, 'not eligible' FROM j WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_retailprice < 950) UNION ALL SELECT id, 'lowers the state' FROM j WHERE state < old UNION ALL SELECT id, 'repeated' FROM j WHERE times > 1)
        SELECT rule, count(*) AS n, count(DISTINCT id) AS parts FROM v GROUP BY rule""",
    "lowered_states": """WITH l AS (SELECT DISTINCT ON (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) CAST(round(l_tax * 100) AS BIGINT) AS t, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem) SELECT d / 100 AS old, t || '/100' AS state, count(*) AS n FROM l WHERE t < d GROUP BY ALL""",
    "quote_problems": r"""WITH q AS (SELECT doc_id, source, regexp_replace(CASE WHEN lang = 'de' THEN reverse(substr(text, 20, 60)) ELSE substr(text, 20, 60) END, '\s+', '', 'g') AS q, regexp_replace(text, '\s+', '', 'g') AS t FROM documents WHERE length(text) > 100)
        SELECT doc_id AS id, CASE WHEN source = 'src1' THEN 'none' ELSE CAST(doc_id AS VARCHAR) END AS file FROM q WHERE coalesce(source = 'src1', false) OR NOT contains(t, q)""",
    "owned_deliveries": f"""WITH {_OWNED} SELECT task, path, CAST(len(ids) AS BIGINT) AS matches, CASE len(ids) WHEN 0 THEN 'source' WHEN 1 THEN ids[1] END AS owner FROM o""",
    "delivery_problems": f"""WITH {_OWNED}, t AS (SELECT task, max(path = '问题描述.txt') AS q, max(path = 'rubric.md') AS r FROM f GROUP BY task),
        v AS (SELECT 'task' AS entity, CAST(task AS VARCHAR) AS key, 'no question' AS rule FROM t WHERE NOT q UNION ALL SELECT 'task', CAST(task AS VARCHAR), 'no rubric' FROM t WHERE NOT r
        UNION ALL SELECT 'file', task || '/' || path, 'several subjects' FROM o WHERE len(ids) > 1
        UNION ALL SELECT 'task', t.task || '/' || s, 'no delivery' FROM t, (SELECT unnest(['alpha', 'beta', 'gamma']) AS s) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.task = t.task AND len(ids) = 1 AND ids[1] = s))
        SELECT entity, rule, count(*) AS n, count(DISTINCT key) AS keys FROM v GROUP BY ALL""",
    "accounted_items": r"""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity < 8 AND l_linenumber < 6 THEN CASE WHEN l_tax > 0.075 THEN -2 WHEN round(l_tax * 100) < 1 THEN -3 ELSE round(l_tax * 100) END ELSE 1 END AS k FROM lineitem),
        g AS (SELECT id, count(*) AS n, floor(count(*) * 1.5) AS d, sum(k) AS total, arg_min(k, n) FILTER (WHERE k < 0) AS bad FROM c GROUP BY id),
        a AS (SELECT g.*, CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 0 WHEN n = d THEN 1 ELSE 2 END AS asked FROM g JOIN orders ON o_orderkey = id),
        p AS (SELECT *, CASE WHEN asked < 2 THEN NULL WHEN bad = -2 THEN 'no whole count' WHEN bad = -3 THEN 'a count below one' WHEN total <> d THEN 'items don''t make up the denominator' END AS problem FROM a)
        SELECT id, CAST(CASE asked WHEN 1 THEN d WHEN 2 THEN CASE WHEN bad IS NULL THEN total END END AS BIGINT) AS accounted, CAST(d AS BIGINT) AS denominator, problem, problem IS NULL AS agrees FROM p""",
    "review_problems": r"""WITH li AS (SELECT l_orderkey AS review, l_linenumber AS n, l_orderkey || '.' || l_linenumber AS id, min(l_quantity) AS q, min(l_tax) AS tax, min(l_discount) AS disc, min(l_returnflag) AS m, min(l_linestatus) AS ls, min(l_extendedprice) AS price, min(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey, l_linenumber),
        fin AS (SELECT *, CASE WHEN q < 25 THEN CASE WHEN id LIKE '%2' THEN 0.5 ELSE 0 END ELSE 1 END AS state, q < 25 AND id LIKE '%2' AS fixed FROM li),
        d AS (SELECT *, review || '/' || did AS key FROM (SELECT *, 'D' || CASE WHEN disc > 0.09 THEN '1' ELSE n::VARCHAR END AS did FROM li WHERE disc >= 0.05)),
        o AS (SELECT *, 'D' || n AS did, CASE WHEN tax > 0.06 THEN 'Z' ELSE m END AS om FROM li WHERE disc >= 0.05 AND ls = 'O'),
        own AS (SELECT review, did, count(*) AS c FROM o GROUP BY ALL), dup AS (SELECT review, did, count(*) AS c FROM d GROUP BY ALL), odup AS (SELECT review, did, om, count(*) AS c FROM o GROUP BY ALL),
        sc AS (SELECT o.review, o.did, bool_and(f.state < 1) AS scored FROM o JOIN fin f ON f.id = o.id GROUP BY ALL),
        fi AS (SELECT *, CASE WHEN tax = 0 THEN 'none' ELSE id END AS fid, CASE WHEN ls = 'O' THEN 1 WHEN m = 'A' THEN 2 ELSE 0 END AS dec, 'D' || n AS did FROM li WHERE tax < 0.07),
        fdup AS (SELECT review, fid, count(*) AS c FROM fi GROUP BY ALL),
        fx AS (SELECT fi.*, fi.review || '/' || fi.fid AS key, fdup.c, coalesce(sc.scored AND dd.did IS NOT NULL, false) AS scored FROM fi JOIN fdup ON fi.review = fdup.review AND fi.fid = fdup.fid LEFT JOIN (SELECT DISTINCT review, did FROM d) dd ON dd.review = fi.review AND dd.did = fi.did LEFT JOIN sc ON sc.review = fi.review AND sc.did = fi.did),
        v AS (SELECT 'check' AS entity, o_orderkey || '/' || c AS key, 'not explained' AS rule FROM orders, (SELECT unnest(['file_coverage', 'item_accounting', 'ownership']) AS c) WHERE c = 'ownership' OR o_custkey % 9 = 0
        UNION ALL SELECT 'correction', id, 'state' FROM fin WHERE fixed
        UNION ALL SELECT 'record', id, 'items don''t make up the denominator' FROM fin WHERE q > 48
        UNION ALL SELECT 'defect', d.key, 'repeated' FROM d JOIN dup ON d.review = dup.review AND d.did = dup.did AND dup.c > 1
        UNION ALL SELECT 'defect', key, 'no description' FROM d WHERE tax < 0.01 UNION ALL SELECT 'defect', key, 'no evidence' FROM d WHERE tax > 0.075
        UNION ALL SELECT 'defect', key, 'evidence without place or content' FROM d WHERE tax <= 0.075 AND q > 45
        UNION ALL SELECT 'defect', d.key, 'no owner' FROM d LEFT JOIN own ON d.review = own.review AND d.did = own.did WHERE own.c IS NULL
        UNION ALL SELECT DISTINCT 'owner', review || '/' || did || '/' || om, 'no atom of its metric' FROM o WHERE tax > 0.06
        UNION ALL SELECT DISTINCT 'owner', review || '/' || did || '/' || om, 'metric owned twice' FROM odup WHERE c > 1
        UNION ALL SELECT DISTINCT 'owner', review || '/' || did || '/' || om, 'no consequence' FROM o WHERE supp % 5 = 0
        UNION ALL SELECT DISTINCT 'finding', key, 'unknown' FROM fx WHERE tax = 0 UNION ALL SELECT DISTINCT 'finding', key, 'repeated' FROM fx WHERE c > 1
        UNION ALL SELECT DISTINCT 'finding', key, 'no reason' FROM fx WHERE q = 7 UNION ALL SELECT DISTINCT 'finding', key, 'undecided' FROM fx WHERE dec = 0
        UNION ALL SELECT DISTINCT 'finding', key, 'confirmed without a defect that cost points' FROM fx WHERE dec = 1 AND NOT scored
        UNION ALL SELECT DISTINCT 'finding', key, 'excluded without a rule' FROM fx WHERE dec = 2 AND q <= 30
        UNION ALL SELECT 'witness', review || '/' || id, 'passed over' FROM li WHERE m <> 'A' AND price <= 30000 AND NOT (tax < 0.07 AND tax <> 0))
        SELECT entity, rule, count(*) AS n, count(DISTINCT key) AS keys FROM v GROUP BY ALL""",
    "count_targets": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderstatus = 'O' AND (o_totalprice > 200000 OR o_custkey = 7) THEN CAST(o_custkey AS VARCHAR) END AS target FROM orders",
    "time_reviews": "SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus <> 'O' AND o_orderpriority = '1-URGENT' AND NOT o_custkey > 500 AS need FROM orders",
    "mentioned_ids": "SELECT o_orderkey, 'A' || o_custkey || ',T' || o_orderkey || ',C7' AS mentioned, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'A' || o_custkey || ',T' || o_orderkey ELSE '' END AS same, CASE WHEN o_orderstatus = 'F' THEN 'A' || o_custkey || ',T' || o_orderkey ELSE '' END AS shared FROM orders",
    "blank_rows": "SELECT nullif(lang, 'fr') AS lang, count(*) AS n, CAST(sum(CASE WHEN length(text) > 500 THEN length(text) END) AS BIGINT) AS total FROM documents WHERE nullif(lang, 'fr') IS NOT NULL OR length(text) > 500 GROUP BY 1",
    "page_evidence": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*')) AS a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*'), 1) AS n FROM pages) SELECT page_id, 'link' AS kind, 'a[href] #' || n AS locator, regexp_extract(a, '>(.*)$', 1) AS text, regexp_extract(a, '"([^"]*)"', 1) AS target, CAST(NULL AS VARCHAR) AS limitation FROM l""",
    "repeated_records": "SELECT l_suppkey || '.' || l_linenumber AS task, count(*) AS n FROM lineitem WHERE l_tax > 0.06 OR l_returnflag = 'R' GROUP BY 1 HAVING count(*) > 1",
    "error_problems": """WITH k AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY'), c AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY o_custkey), v AS (SELECT id, 'missing' AS rule FROM k WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, 'unknown' FROM c WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT id, 'repeated' FROM c WHERE n > 1
        UNION ALL SELECT o_custkey, 'untyped' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 'no reason' FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT o_custkey, 'no evidence' FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 100000) SELECT rule, count(*) AS n, count(DISTINCT id) AS errors FROM v GROUP BY rule""",
    "loss_briefs": """WITH f AS (SELECT l_orderkey, 'part ' || l_partkey || CASE WHEN l_discount > 0.05 THEN '（line ' || l_linenumber || '）' ELSE '' END || '：' || CASE WHEN l_tax > 0.04 THEN '缺少可识别的来源支撑' ELSE '与已核来源不一致' END AS told, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_quantity) AS k FROM lineitem WHERE l_returnflag = 'R'),
        t AS (SELECT l_orderkey, string_agg(told, '；' ORDER BY k) FILTER (WHERE k <= 2) || CASE WHEN count(*) > 2 THEN '；另有 ' || (count(*) - 2) || ' 项，详见逐题结果' ELSE '' END || '。' AS told FROM f GROUP BY l_orderkey), n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey, '0/' || n || '；' || coalesce(told, o_orderpriority) AS brief FROM orders JOIN n ON n.l_orderkey = o_orderkey LEFT JOIN t ON t.l_orderkey = o_orderkey""",
    "located_text": "SELECT role, CASE WHEN text IS NOT NULL THEN length(text) - length(replace(text, chr(10), '')) + 1 END AS lines, count(*) AS n FROM conversations GROUP BY ALL",
}
