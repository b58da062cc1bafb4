"""Joins, sets, ordered operators and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import digests, ordered, relate, results
from tallyloom.plans.base import read, rounded, scratch, writer
from tallyloom.sources import files
from tallyloom.streaming import events as streams


def missing_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Nation and segment pairs without a rich customer: the full grid less what is there."""
    c = read(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("task"), F.col("c_mktsegment").alias("subject"), "c_acctbal")
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("task"))
    return results.missing_process(n, c.select("subject"), c.where("c_acctbal > 9500")).select(F.col("task").alias("nation"), F.col("subject").alias("segment"))


def prefix_assign(spark: SparkSession, d: str) -> DataFrame:
    subjects = spark.createDataFrame([("a", "brand#1"), ("b", "BRAND#12"), ("c", "Brand#2"), ("e", "brand#33")], "id string, prefix string")
    files = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name"))
    return relate.owners_by_prefix(files, subjects).select("p_partkey", "name", "owner", "matches")


def unique_path_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of pages' paths against those of pages served by https: in full, with a dot, by base name, or out of the folder."""
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/$", "")
    pages = read(spark, d, "pages").select("page_id", "url", F.concat_ws("/", F.regexp_extract("url", r"^https?://([^/]+)/", 1), path).alias("file"))
    known = pages.where(F.col("url").startswith("https:")).select("file").distinct()
    name = F.element_at(F.split("file", "/"), -1)
    given = F.when(F.contains("url", F.lit("?")), name).when(F.contains("url", F.lit("#")), F.concat(F.lit("./"), F.col("file"))).when(F.col("file").startswith("m."), F.concat(F.lit("../"), F.col("file"))).otherwise(F.col("file"))
    return relate.resolve_paths(pages.select("page_id", given.alias("given")), known).select("page_id", "given", "file")


def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's n-th user turn beside its n-th other turn."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "user").otherwise("other").alias("side"), F.length("text").cast("long").alias("size"))
    out = relate.positional_pairs(c.where("side = 'user'"), c.where("side = 'other'"), ["conv_id"], "turn", "size")
    return out.select("conv_id", F.col("nth").cast("long").alias("nth"), "left_value", "right_value", F.col("left_value").eqNullSafe(F.col("right_value")).alias("same"))


def label_join_diff(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("label"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("pos"), (F.col("l_tax") < 0.04).alias("passed"), "l_discount")
    left = li.where("l_discount < 0.05").select("task", "label", "passed")
    out = relate.label_differences(left, li.where("l_discount >= 0.05").drop("l_discount"), ["task"])
    return out.where("right_passed is not null").groupBy("task", "label", "passed", "right_passed").agg(F.count("*").alias("n"))


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").where("l_quantity > 0")
    boxes = li.groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("id")).agg(F.max("l_quantity").alias("width"), F.max(F.col("l_discount") * 100 + 1).alias("height"), (F.max("l_partkey") % 50).cast("double").alias("left"), (F.max("l_suppkey") % 10).cast("double").alias("top"))
    return relate.overlaps(boxes, "l_orderkey", 0.4).select("l_orderkey", "first", "second", rounded("share").alias("share"))


def upsert_records(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances, with those of the same key's supplier where there is one."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.col("s_acctbal").alias("balance"))
    return relate.upsert(c, s, ["key"], ["name", "balance"])


def batch_islands(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation in batches of at most four; very long turns alone."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.length("text") > 400, F.lit(False)).alias("long"))
    return ordered.batches(c, F.col("long"), 4, ["conv_id"], ["turn"], writer(spark)).select("conv_id", "turn", F.col("batch").cast("long").alias("batch"))


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders in pages of 15, oldest first."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return ordered.chunks(o, 15, ["o_custkey"], ["o_orderdate", "o_orderkey"], writer(spark)).groupBy("o_custkey", "chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


def first_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first document of every text, letters and digits compared only."""
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    key = F.sha2(F.nullif(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", ""), F.lit("")), 256)
    return ordered.first_of_key(docs.withColumn("k", key).drop("text"), F.col("k"), ["doc_id"]).select("doc_id", "source", "key")


def visible_items(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    return ordered.visible(e, F.col("event_type").isin("view", "click"), ["user_id"], ["event_id"], writer(spark)).select("user_id", "event_id")


def carried_sections(spark: SparkSession, d: str) -> DataFrame:
    """Each event under its user's last purchase so far."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    return ordered.carry_forward(e, F.when(F.col("event_type") == "purchase", F.col("event_id")), "section", ["user_id"], ["event_id"], writer(spark)).select("event_id", "section")


def stalled_rounds(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", "value")
    return ordered.stalled_rounds(e, F.coalesce(F.col("value") > 50, F.lit(False)), ["user_id"], ["event_id"], writer(spark)).select("event_id", F.col("stalled").cast("long").alias("stalled"))


def renumbered(spark: SparkSession, d: str) -> DataFrame:
    """Distinct brand and type pairs by size, numbered within each size."""
    p = read(spark, d, "part").select("p_size", "p_brand", "p_type").distinct()
    return ordered.numbered(p, ["p_brand", "p_type"], ["p_size"], write=writer(spark)).select(F.col("p_size").cast("long").alias("size"), "p_brand", "p_type", "label")


def first_mismatch(spark: SparkSession, d: str) -> DataFrame:
    pairs = positional_zip(spark, d)
    return pairs.where("not same").groupBy("conv_id").agg(F.min("nth").alias("nth"))


def set_equality(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"))
    return relate.set_difference(read(spark, d, "labels").select("doc_id"), turns, "doc_id")


def subset_violations(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems whose part or supplier isn't known, or whose quantity is out of range."""
    li = read(spark, d, "lineitem")
    li = li.join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("part")), "l_partkey", "left").join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("supplier")), "l_suppkey", "left")
    rules = {"unknown part": F.col("part").isNull(), "unknown supplier": F.col("supplier").isNull(), "quantity": ~F.col("l_quantity").between(2, 49), "discounted return": (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)}
    return relate.violations(li, "lineitem", F.col("l_orderkey"), rules).groupBy("entity", "rule").agg(F.count("*").alias("n"), F.count_distinct("key").alias("tasks"))


def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Customers in the order of their first order."""
    return ordered.first_seen(read(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("first.o_orderkey").alias("first_order"))


def union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Names and balances of customers and suppliers, content once, the lowest key kept."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("nation"), F.round("c_acctbal").cast("long").alias("balance"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").cast("long").alias("nation"), F.round("s_acctbal").cast("long").alias("balance"))
    return relate.union_distinct([c, s], ["nation", "balance"], "key")


def ref_closure(spark: SparkSession, d: str) -> DataFrame:
    """All parts that a part leads to, each leading to the one of half its number, and customers' nations to their regions."""
    p = read(spark, d, "part").where("p_partkey > 1").select(F.concat(F.lit("part "), "p_partkey").alias("start"), F.concat(F.lit("part "), F.expr("p_partkey div 2")).alias("node"))
    c = read(spark, d, "customer").select(F.concat(F.lit("customer "), "c_custkey").alias("start"), F.concat(F.lit("nation "), "c_nationkey").alias("node"))
    n = read(spark, d, "nation").select(F.concat(F.lit("nation "), "n_nationkey").alias("start"), F.concat(F.lit("region "), "n_regionkey").alias("node"))
    return relate.closure(spark, p.unionByName(c).unionByName(n), writer(spark)).select("start", "node")


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Per source, one digest over its documents in order of id: a tree of digests, each over at most 1024 ids or digests."""
    docs = read(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("part"))
    return relate.fingerprints(docs, ["source"]).select("source", "digest")


def incremental_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """New work: documents without a stored label."""
    return streams.new_work(read(spark, d, "documents"), read(spark, d, "labels"), ["doc_id"]).select("doc_id", "source")


def complete_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sources and languages all of whose documents are labelled: the barrier before their summary."""
    docs = read(spark, d, "documents").select("source", "lang", F.col("doc_id").alias("member"))
    expected = docs.groupBy("source", "lang").agg(F.count_distinct("member").alias("expected"))
    done = docs.join(read(spark, d, "labels").select(F.col("doc_id").alias("member")), "member", "left_semi")
    return streams.complete_groups(done, expected, ["source", "lang"])


def changed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents against an edited copy, by digest trees: German ones end otherwise, French ones of over 800 characters are
    gone, and English ones of over 2000 stand in it a second time, under a negative id."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("part"), "lang")
    size = F.length("part")
    edited = docs.where(~F.coalesce((F.col("lang") == "fr") & (size > 800), F.lit(False))).withColumn("part", F.when(F.col("lang") == "de", F.concat("part", F.lit("!"))).otherwise(F.col("part")))
    more = docs.where((F.col("lang") == "en") & (size > 2000)).withColumn("id", -F.col("id") - 1)
    old, new = (digests.build(df, scratch(spark)) for df in (docs, edited.unionByName(more)))
    return digests.difference(spark, old, new)


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as logs: assistant turns are texts, user turns sessions, empty ones errors, long user turns reads."""
    c, user = read(spark, d, "conversations"), F.col("role") == "user"
    logs = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", "text").otherwise("other").alias("type"), F.when(user, F.concat(F.col("role"), "turn")).alias("session"), F.concat("text", F.lit("\n")).alias("text"), F.when(user & (F.length("text") > 200), "read").alias("tool"), F.lit("completed").alias("status"), F.when(F.col("text").isNull(), F.concat(F.lit("empty "), "turn")).alias("error"))
    out = files.log_summary(logs)
    return out.select(F.col("file").alias("conv_id"), F.sha2("text", 256).alias("text"), "error", "session", "used_read")


QUERIES = {
    f.__name__: f
    for f in (
        missing_pairs, prefix_assign, unique_path_resolve, positional_zip, label_join_diff, overlap_pairs, upsert_records, batch_islands, chunk_pages, first_dedup, visible_items, carried_sections,
        stalled_rounds, renumbered, first_mismatch, set_equality, subset_violations, ordered_distinct, union_dedup, ref_closure, fingerprint, incremental_antijoin, complete_groups, latest_event, changed_documents,
    )
}

_ZIP = """sides AS (SELECT conv_id, CASE WHEN role = 'user' THEN 'user' ELSE 'other' END AS side, CAST(length(text) AS BIGINT) AS size, turn FROM conversations),
nums AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn) AS nth FROM sides),
zip AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, CAST(coalesce(a.nth, b.nth) AS BIGINT) AS nth, a.size AS left_value, b.size AS right_value, a.size IS NOT DISTINCT FROM b.size AS same FROM (SELECT * FROM nums WHERE side = 'user') a FULL JOIN (SELECT * FROM nums WHERE side = 'other') b ON a.conv_id = b.conv_id AND a.nth = b.nth)"""

ORACLES = {
    "missing_pairs": "SELECT CAST(n_nationkey AS BIGINT) AS nation, s.c_mktsegment AS segment FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n_nationkey AND c.c_mktsegment = s.c_mktsegment AND c.c_acctbal > 9500)",
    "prefix_assign": """WITH subjects(id, prefix) AS (VALUES ('a', 'brand#1'), ('b', 'brand#12'), ('c', 'brand#2'), ('e', 'brand#33')), found AS (SELECT p_partkey, count(DISTINCT id) AS matches, min(id) AS owner FROM part JOIN subjects ON starts_with(lower(p_brand), prefix) GROUP BY p_partkey)
        SELECT p.p_partkey, p_brand AS name, CASE coalesce(matches, 0) WHEN 0 THEN 'source' WHEN 1 THEN owner END AS owner, CAST(coalesce(matches, 0) AS BIGINT) AS matches FROM part p LEFT JOIN found f ON p.p_partkey = f.p_partkey""",
    "unique_path_resolve": r"""WITH pg AS (SELECT page_id, url, concat_ws('/', regexp_extract(url, '^https?://([^/]+)/', 1), regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/$', '')) AS file FROM pages),
        known AS (SELECT DISTINCT file FROM pg WHERE url LIKE 'https:%'), alone AS (SELECT regexp_extract(file, '[^/]*$') AS base, min(file) AS named FROM known GROUP BY 1 HAVING count(*) = 1),
        wanted AS (SELECT page_id, CASE WHEN url LIKE '%?%' THEN regexp_extract(file, '[^/]*$') WHEN url LIKE '%#%' THEN './' || file WHEN file LIKE 'm.%' THEN '../' || file ELSE file END AS given FROM pg),
        cleaned AS (SELECT *, CASE WHEN given LIKE '../%' THEN NULL WHEN given LIKE './%' THEN substr(given, 3) ELSE given END AS clean FROM wanted)
        SELECT page_id, given, coalesce(k.file, CASE WHEN NOT contains(clean, '/') THEN named END) AS file FROM cleaned LEFT JOIN known k ON clean = k.file LEFT JOIN alone ON clean = base""",
    "positional_zip": f"WITH {_ZIP} SELECT * FROM zip",
    "first_mismatch": f"WITH {_ZIP} SELECT conv_id, min(nth) AS nth FROM zip WHERE NOT same GROUP BY conv_id",
    "label_join_diff": """WITH li AS (SELECT l_orderkey AS task, l_suppkey AS label, l_linenumber, l_partkey, l_quantity, l_tax < 0.04 AS passed, l_discount FROM lineitem),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY task, label ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS n FROM li WHERE l_discount >= 0.05)
        SELECT l.task, l.label, l.passed, r.passed AS right_passed, count(*) AS n FROM li l JOIN ranked r ON l.task = r.task AND l.label = r.label AND r.n = 1 WHERE l.l_discount < 0.05 AND l.passed <> r.passed GROUP BY ALL""",
    "overlap_pairs": """WITH boxes AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS id, max(l_quantity) AS width, max(l_discount * 100 + 1) AS height, CAST(max(l_partkey) % 50 AS DOUBLE) AS x, CAST(max(l_suppkey) % 10 AS DOUBLE) AS y FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
        pairs AS (SELECT a.l_orderkey, a.id AS first, b.id AS second, greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) / least(a.width * a.height, b.width * b.height) AS share FROM boxes a JOIN boxes b ON a.l_orderkey = b.l_orderkey AND a.id < b.id)
        SELECT l_orderkey, first, second, round(share, 4) AS share FROM pairs WHERE share > 0.4""",
    "upsert_records": "SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, c_name) AS name, coalesce(s_acctbal, c_acctbal) AS balance FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "batch_islands": """WITH t AS (SELECT conv_id, turn, coalesce(length(text) > 400, false) AS alone FROM conversations), i AS (SELECT *, sum(alone::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM t),
        p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, island, alone ORDER BY turn) - 1) AS n FROM i) SELECT conv_id, turn, CAST(sum((alone OR n % 4 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS batch FROM p""",
    "chunk_pages": "WITH n AS (SELECT *, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 15 AS BIGINT) AS chunk FROM orders) SELECT o_custkey, chunk, count(*) AS n, min(o_orderkey) AS least FROM n GROUP BY o_custkey, chunk",
    "first_dedup": "WITH k AS (SELECT doc_id, source, sha256(nullif(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), '')) AS key FROM documents) SELECT doc_id, source, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM k WHERE key IS NOT NULL) WHERE n = 1",
    "visible_items": "WITH m AS (SELECT user_id, event_id, coalesce(event_type IN ('view', 'click'), false) AS yes FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS total, sum(yes::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM m) SELECT user_id, event_id FROM n WHERE total <= 10 OR NOT yes OR nth <= 2",
    "carried_sections": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM events",
    "stalled_rounds": "WITH m AS (SELECT *, coalesce(value > 50, false) AS moved FROM events), r AS (SELECT *, sum(moved::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) SELECT event_id, CAST(sum(1 - moved::INT) OVER (PARTITION BY user_id, run ORDER BY event_id) AS BIGINT) AS stalled FROM r",
    "renumbered": "SELECT CAST(p_size AS BIGINT) AS size, p_brand, p_type, format('R{:03d}', row_number() OVER (PARTITION BY p_size ORDER BY p_brand, p_type)) AS label FROM (SELECT DISTINCT p_size, p_brand, p_type FROM part)",
    "set_equality": "SELECT DISTINCT doc_id, 'left' AS side FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations) UNION ALL SELECT DISTINCT conv_id, 'right' FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT conv_id, 'right repeated' FROM conversations GROUP BY conv_id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'left repeated' FROM labels GROUP BY doc_id HAVING count(*) > 1",
    "subset_violations": """WITH v AS (SELECT l_orderkey, 'unknown part' AS rule FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT l_orderkey, 'unknown supplier' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT l_orderkey, 'quantity' FROM lineitem WHERE l_quantity NOT BETWEEN 2 AND 49 UNION ALL SELECT l_orderkey, 'discounted return' FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)
        SELECT 'lineitem' AS entity, rule, count(*) AS n, count(DISTINCT l_orderkey) AS tasks FROM v GROUP BY rule""",
    "ordered_distinct": "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order FROM orders GROUP BY o_custkey",
    "union_dedup": "SELECT nation, balance, min(key) AS key FROM (SELECT c_custkey AS key, CAST(c_nationkey AS BIGINT) AS nation, CAST(round(c_acctbal) AS BIGINT) AS balance FROM customer UNION ALL SELECT s_suppkey, CAST(s_nationkey AS BIGINT), CAST(round(s_acctbal) AS BIGINT) FROM supplier) GROUP BY ALL",
    "ref_closure": """WITH RECURSIVE hops AS (SELECT 'part ' || p_partkey AS start, 'part ' || p_partkey // 2 AS node FROM part WHERE p_partkey > 1 UNION SELECT 'customer ' || c_custkey, 'nation ' || c_nationkey FROM customer UNION SELECT 'nation ' || n_nationkey, 'region ' || n_regionkey FROM nation),
        reach AS (SELECT start, node FROM hops UNION SELECT r.start, h.node FROM reach r JOIN hops h ON r.node = h.start) SELECT start, node FROM reach""",
    "fingerprint": """WITH parts AS (SELECT source, doc_id AS id, CASE WHEN text IS NULL THEN CAST(doc_id AS VARCHAR) ELSE doc_id || ':' || sha256(text) END AS part FROM documents),
        one AS (SELECT source, id // 1024 AS id, sha256(string_agg(part, ',' ORDER BY id, part)) AS part FROM parts GROUP BY source, id // 1024), two AS (SELECT source, id // 1024 AS id, sha256(string_agg(part, ',' ORDER BY id)) AS part FROM one GROUP BY source, id // 1024)
        SELECT source, sha256(string_agg(part, ',' ORDER BY id)) AS digest FROM two GROUP BY source""",
    "incremental_antijoin": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "complete_groups": "SELECT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang HAVING count(DISTINCT doc_id) = count(DISTINCT doc_id) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels))",
    "changed_documents": "SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'changed' ELSE 'gone' END AS change FROM documents WHERE lang = 'de' AND text IS NOT NULL OR lang = 'fr' AND length(text) > 800 UNION ALL SELECT -doc_id - 1, 'new' FROM documents WHERE lang = 'en' AND length(text) > 2000",
    "latest_event": r"""SELECT conv_id, sha256(coalesce(regexp_replace(string_agg(text || chr(10), chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant' AND text IS NOT NULL), '^\s+|\s+$', '', 'g'), '')) AS text, arg_max(CASE WHEN text IS NULL THEN 'empty ' || turn END, turn) FILTER (WHERE text IS NULL) AS error,
        arg_max('user' || turn, turn) FILTER (WHERE role = 'user') AS session, coalesce(bool_or(role = 'user' AND length(text) > 200), false) AS used_read FROM conversations GROUP BY conv_id""",
}
