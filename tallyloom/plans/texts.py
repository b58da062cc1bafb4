"""Text and number queries over documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import numbers, text
from tallyloom.operators.quotes import contained
from tallyloom.operators.scopes import packed_paragraphs, text_scopes
from tallyloom.plans.base import read, rounded, writer


def verdict_tristate(spark: SparkSession, d: str) -> DataFrame:
    """Turns, behind tabs and line ends, read as outcomes: most say nothing, some begin like a yes or a no; every fifth says so."""
    c = read(spark, d, "conversations")
    said = F.concat(F.lit("\n\t"), F.when(F.col("turn") % 5 == 0, F.element_at(F.array(*map(F.lit, ("满足", "不满足", "1 ", "No", "0\n"))), (F.col("conv_id") % 5 + 1).cast("int"))).otherwise(F.col("text")))
    return c.groupBy("role", text.verdict(said).alias("passed")).agg(F.count("*").alias("n"))


def duration_parse(spark: SparkSession, d: str) -> DataFrame:
    """Times of day written as durations, errors with a blank in them and purchases without seconds."""
    form = lambda f: F.date_format("ts", f)
    raw = F.when(F.col("event_type") == "error", form("H'h 'm'm'")).when(F.col("event_type") == "purchase", form("H'H'm'm'")).otherwise(F.concat(F.lit("\t "), form("H'h'm'm's's'"), F.lit("\n")))
    return read(spark, d, "events").select("event_id", text.duration_seconds(raw).alias("seconds"))


def url_valid(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages; those with a fragment lose their scheme, those with a query get another."""
    url = F.when(F.contains("url", F.lit("#")), F.regexp_replace("url", "^https?://", "")).when(F.contains("url", F.lit("?")), F.regexp_replace("url", "^https?", "ftp")).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", text.is_source_url(url).alias("valid"))


def short_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.short_reason(F.regexp_replace(F.col("text"), r"\.", "。")).alias("short"))


def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.explode(text.number_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def number_tokens_signed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.explode(text.signed_numbers(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that are rows of a bar table, with their number of cells."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "row")).where(F.contains("row", F.lit(" | ")))
    cells = text.table_cells(F.concat(F.lit("| "), F.trim("row")))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.size(cells).cast("long").alias("cells"), cells[0].alias("first"))


def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.sha2(text.markdown_safe(F.col("text")), 256).alias("safe"), F.sha2(text.locate_lines(F.col("text")), 256).alias("located"))


def text_page(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", text.text_page(F.col("text"), 300, 200).alias("p")).select("doc_id", "p.*")


def clean_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pages' addresses as paths: from a mobile host with a drive, with a query out of the folder, by https with dots."""
    bare = F.regexp_replace("url", "^https?://", "")
    raw = F.when(F.contains("url", F.lit("//m.")), F.concat(F.lit("C:\\"), bare)).when(F.contains("url", F.lit("?")), F.concat(F.lit("..\\"), bare)).when(F.col("url").startswith("https"), F.concat(F.lit("./a/./"), bare)).otherwise(bare)
    return read(spark, d, "pages").select("page_id", text.clean_path(raw).alias("path"))


def logical_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.logical_name(F.concat(F.lit("BRAND-1.2_"), F.col("p_name")), "brand-", "1.2").alias("name"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    links = read(spark, d, "pages").select("page_id", F.explode(text.html_links(F.col("html"))).alias("l"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("l.target").alias("targets"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


def nfkc_key_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", text.label_key(F.col("text")).alias("key"))
    return docs.groupBy(F.sha2("key", 256).alias("key")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose n-th turns on either side resemble each other, compared as label keys of the whole turns."""
    from tallyloom.operators.relate import positional_pairs

    c = read(spark, d, "conversations").select("conv_id", "turn", "role", text.label_key(F.col("text")).alias("key"))
    pairs = positional_pairs(c.where("role = 'user'"), c.where("role <> 'user'"), ["conv_id"], "turn", "key").where("left_value is not null and right_value is not null")
    return pairs.select("conv_id", F.col("nth").cast("long").alias("nth"), rounded(text.whole_similarity("left_value", "right_value"), 6).alias("ratio"))


def scope_table(spark: SparkSession, d: str) -> DataFrame:
    out = text_scopes(read(spark, d, "documents"), "doc_id", "text")
    return out.select("id", "scope", "start", "end", F.length("body").cast("long").alias("size"))


def sentence_packing(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents with full stops as sentence ends: how many, the longest, and the sum of their squared lengths."""
    docs = read(spark, d, "documents").select("doc_id", F.translate("text", ".", "。").alias("text"))
    out = packed_paragraphs(docs, "doc_id", "text")
    return out.groupBy("id").agg(F.count("*").alias("paragraphs"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(F.length("text").cast("long") * F.length("text")).alias("squares"))


def quote_containment(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items that stand whole in documents, compared without white space and references."""
    return contained(spark, read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark").select("item_id", "text"), writer(spark))


def numeric_guard(spark: SparkSession, d: str) -> DataFrame:
    """Prices, priorities and dates of orders as numbers, by their status."""
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(12,2)"))).when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy'e'M"))
    return read(spark, d, "orders").select("o_orderkey", rounded(numbers.numeric(raw), 2).alias("n"))


def ratio_states(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    n, den = F.col("l_quantity").cast("long"), (F.col("l_partkey") % 40).cast("long")
    share = numbers.ratio_state(n, den, F.lit(True), F.col("l_returnflag") == "R")
    return li.select("l_orderkey", n.alias("n"), den.alias("d"), F.round(share, 6).cast("double").alias("state")).distinct()


def compare_truth(spark: SparkSession, d: str) -> DataFrame:
    left = F.concat(F.floor(F.col("l_extendedprice") / 1000).cast("string"), F.when(F.col("l_linenumber") == 1, ",").otherwise(""), F.lpad(F.col("l_quantity").cast("long").cast("string"), 3, "0"))
    right = F.when(F.col("l_linenumber") == 2, ">135").otherwise(F.col("l_partkey").cast("string"))
    op = F.element_at(F.array(*(F.lit(x) for x in ("gt", "lt", "ge", "le", "eq"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    truth = numbers.relation_holds(left, op, right, F.lit("u"), F.when(F.col("l_linenumber") == 3, "v").otherwise("u"))
    return read(spark, d, "lineitem").groupBy(truth.alias("holds"), op.alias("op")).agg(F.count("*").alias("n"))


def numeric_closure(spark: SparkSession, d: str) -> DataFrame:
    """Totals whose stated mean (a rounding of it, or of its neighbour) isn't covered by the order's own mean."""
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("lines"))
    mean = (F.col("cents").cast("decimal(20,0)") / F.col("lines").cast("decimal(20,0)")).cast("decimal(28,10)")
    stated = F.when(F.col("l_orderkey") % 3 == 0, F.round(mean, 3)).when(F.col("l_orderkey") % 3 == 1, F.round(mean, 1)).otherwise(F.round(mean, 2) + F.lit("0.01").cast("decimal(10,2)"))
    ok = numbers.covered(stated.cast(numbers.DECIMAL), F.array(mean.cast(numbers.DECIMAL)))
    return o.select("l_orderkey", ok.alias("covered"))


def displayed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", numbers.display(F.col("c_acctbal") / 7).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (
        verdict_tristate, duration_parse, url_valid, short_text, number_tokens, number_tokens_signed, table_cells, markdown_lines, text_page, clean_paths, logical_names, html_links, html_text,
        nfkc_key_dedup, fuzzy_match, scope_table, sentence_packing, quote_containment, numeric_guard, ratio_states, compare_truth, numeric_closure, displayed,
    )
}

ORACLES = {
    "verdict_tristate": r"""SELECT role, CASE WHEN regexp_matches(s, '^(?:不满足|不一致|不支持|无支撑|未覆盖|缺失|错误|冲突|矛盾)') THEN false WHEN regexp_matches(s, '^(?:满足|一致|支持|有支撑|已覆盖|正确|可追溯|非虚构|无问题|无冲突|satisfied|supported|consistent|correct|traceable|pass|present|yes)') THEN true
        WHEN regexp_matches(s, '^(?:not satisfied|unsatisfied|unsupported|inconsistent|incorrect|fail|missing|absent|no)') THEN false WHEN s IN ('1', 'true') THEN true WHEN s IN ('0', 'false') THEN false END AS passed, count(*) AS n FROM (SELECT role, lower(regexp_replace(coalesce(CASE WHEN turn % 5 = 0 THEN ['满足', '不满足', '1 ', 'No', '0'][conv_id % 5 + 1] ELSE text END, ''), '^\s+|\s+$', '', 'g')) AS s FROM conversations) GROUP BY ALL""",
    "duration_parse": "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE hour(ts) * 3600 + minute(ts) * 60 + CASE WHEN event_type = 'purchase' THEN 0 ELSE second(ts) END END AS seconds FROM events",
    "url_valid": "SELECT page_id, NOT contains(url, '#') AND NOT contains(url, '?') AND regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages",
    "short_text": r"""WITH s AS (SELECT doc_id, trim(regexp_replace(replace(text, '.', '。'), '\s+', ' ', 'g'), ' ') AS s FROM documents), h AS (SELECT doc_id, s, left(s, 145) AS head FROM s), e AS (SELECT *, length(regexp_extract(head, '(?s)^(.*[。；])', 1)) AS stop FROM h)
        SELECT doc_id, CASE WHEN length(s) <= 145 THEN s WHEN stop > 66 THEN left(head, stop) ELSE regexp_replace(head, '[，、；。 ]+$', '') || '……' END AS short FROM e""",
    "number_tokens": r"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS token FROM documents) GROUP BY token",
    "table_cells": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), c AS (SELECT doc_id, line, string_split(regexp_replace(trim(row, ' '), '\|$', ''), '|') AS cells FROM l WHERE contains(row, ' | ')) SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(len(cells) AS BIGINT) AS cells, trim(cells[1], ' ') AS first FROM c",
    "markdown_lines": r"""SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\|'), chr(10), ' ')) AS safe,
        sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: 'L' || i || ': ' || x), chr(10))) AS located FROM documents""",
    "text_page": "SELECT doc_id, substr(text, 301, 200) AS text, length(text) AS total_characters, length(left(text, 300)) - length(replace(left(text, 300), chr(10), '')) + 1 AS starting_line, CASE WHEN length(text) > 500 THEN CAST(500 AS BIGINT) END AS next_offset FROM documents",
    "clean_paths": "SELECT page_id, CASE WHEN contains(url, '//m.') OR contains(url, '?') THEN NULL WHEN url LIKE 'https%' THEN 'a/' || u ELSE u END AS path FROM (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS u FROM pages)",
    "logical_names": "SELECT p_partkey, lower(p_name) AS name FROM part",
    "html_links": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) SELECT page_id, count(*) AS links, count(DISTINCT target) AS targets FROM l GROUP BY page_id""",
    "numeric_guard": "SELECT o_orderkey, round(CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN NULL ELSE year(o_orderdate) * pow(10, month(o_orderdate)) END, 2) AS n FROM orders",
    "scope_table": """WITH RECURSIVE t AS (SELECT doc_id AS id, text, length(text) AS n FROM documents WHERE length(text) > 0),
        s AS (SELECT id, 0 AS scope, 0 AS start, CASE WHEN n <= 8000 THEN n WHEN instr(reverse(substr(text, 4001, 4000)), chr(10)) > 0 THEN 8001 - instr(reverse(substr(text, 4001, 4000)), chr(10)) ELSE 8000 END AS stop FROM t
        UNION ALL SELECT s.id, scope + 1, stop, CASE WHEN n - stop <= 8000 THEN n WHEN instr(reverse(substr(text, stop + 4001, 4000)), chr(10)) > 0 THEN stop + 8001 - instr(reverse(substr(text, stop + 4001, 4000)), chr(10)) ELSE stop + 8000 END FROM s JOIN t ON s.id = t.id WHERE stop < n)
        SELECT id, CAST(scope AS BIGINT) AS scope, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", CAST(stop - start AS BIGINT) AS size FROM s""",
    "sentence_packing": """WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER () AS nth, trim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(translate(text, '.', '。'), chr(10))) AS line FROM documents)),
        s AS (SELECT doc_id, nth, list_transform(regexp_extract_all(line, '[^。！？]*[。！？]|[^。！？]+$'), lambda x: length(x)) AS sizes FROM l WHERE line <> ''),
        p AS (SELECT doc_id, nth, sizes, 1 AS k, sizes[1] AS held, 1 AS paragraph FROM s
        UNION ALL SELECT doc_id, nth, sizes, k + 1, CASE WHEN held + sizes[k + 1] > 350 THEN sizes[k + 1] ELSE held + sizes[k + 1] END, CASE WHEN held + sizes[k + 1] > 350 THEN paragraph + 1 ELSE paragraph END FROM p WHERE k < len(sizes)),
        w AS (SELECT doc_id, nth, paragraph, max(held) AS size FROM p GROUP BY ALL)
        SELECT doc_id AS id, count(*) AS paragraphs, max(size) AS longest, CAST(sum(size * size) AS BIGINT) AS squares FROM w GROUP BY doc_id""",
    "quote_containment": r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents), q AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS t FROM benchmark) SELECT DISTINCT doc_id, item_id FROM d JOIN q ON q.t <> '' AND contains(d.t, q.t)""",
    "numeric_closure": """WITH o AS (SELECT l_orderkey, sum(CAST(l_extendedprice * 100 AS BIGINT)) AS cents, count(*) AS lines FROM lineitem GROUP BY l_orderkey), m AS (SELECT l_orderkey, (CAST(cents AS HUGEINT) * 20000000000 + lines) // (2 * lines) AS mean FROM o),
        s AS (SELECT *, CASE l_orderkey % 3 WHEN 0 THEN (mean + 5000000) // 10000000 * 10000000 WHEN 1 THEN (mean + 500000000) // 1000000000 * 1000000000 ELSE (mean + 50000000) // 100000000 * 100000000 + 100000000 END AS stated FROM m)
        SELECT l_orderkey, stated = mean OR len(list_filter([1, 2, 3, 4, 5, 6], lambda p: stated = (mean + CAST(5 * pow(10, 9 - p) AS HUGEINT)) // CAST(pow(10, 10 - p) AS HUGEINT) * CAST(pow(10, 10 - p) AS HUGEINT))) > 0 AS covered FROM s""",
    "ratio_states": "SELECT DISTINCT l_orderkey, CAST(l_quantity AS BIGINT) AS n, l_partkey % 40 AS d, CAST(round(CASE WHEN l_partkey % 40 = 0 THEN CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END ELSE least(l_quantity / (l_partkey % 40), 1) END, 6) AS DOUBLE) AS state FROM lineitem",
    "compare_truth": """WITH c AS (SELECT l_linenumber, CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) || lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 3, '0') AS BIGINT) AS a, l_partkey AS b, (['gt', 'lt', 'ge', 'le', 'eq'])[l_suppkey % 5 + 1] AS op FROM lineitem)
        SELECT CASE WHEN l_linenumber IN (2, 3) THEN NULL WHEN op = 'gt' THEN a > b WHEN op = 'lt' THEN a < b WHEN op = 'ge' THEN a >= b WHEN op = 'le' THEN a <= b ELSE a = b END AS holds, op, count(*) AS n FROM c GROUP BY ALL""",
    "displayed": "SELECT c_custkey, format('{:.2f}', round(c_acctbal / 7, 2) + 0.0) AS shown FROM customer",
}
