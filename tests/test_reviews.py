import pytest
from pyspark.sql import functions as F

from tallyloom.functions import items
from tallyloom.operators import review, scopes
from tallyloom.sources import sinks


def test_references_and_edges(spark):
    atoms = spark.createDataFrame([("H01", "see A01 and T01, not X99"), ("A01", "T01"), ("T01", "none")], "id string, rule string")
    rules = spark.createDataFrame([("覆盖 H3 与 E1；核验全集同 A01/A02，见 T01",), ("抽样规则同 C01",), ("同 A1 / B2、C3",), ("none",)], "r string")
    got = [(r.a, r.b) for r in rules.select(review.references(F.col("r")).alias("a"), review.shared_references(F.col("r")).alias("b")).collect()]
    assert got == [(["A01", "A02"], ["A01", "A02"]), (["C01"], []), (["A1", "B2"], []), ([], [])]
    late = spark.createDataFrame([("BIN", 0, "实际执行须在截止日前", None), ("BIN", 0, "实际执行须在截止日前", " "), ("BIN", 0, "实际执行须在截止日前", "2024"), ("BIN", 0, "运行早于", None), ("BIN", 1, "实际执行 截止", None)], "k string, s int, r string, e string")
    assert [r.x for r in late.select(review.needs_time_review(F.col("k"), F.col("s"), F.col("r"), F.col("e")).alias("x")).collect()] == [True, True, False, False, False]
    assert {tuple(r) for r in review.reference_edges(atoms).collect()} == {("H01", "A01"), ("H01", "T01"), ("A01", "T01")}


def test_corrections(spark):
    before = spark.createDataFrame([("A", 0.5), ("B", 0.0), ("C", 1.0)], "id string, state double")
    after = spark.createDataFrame([("A", 0.4), ("B", 1.0), ("C", 1.0), ("Z", 1.0), ("Z", 1.0)], "id string, state double")
    got = {(r.key, r.rule) for r in review.correction_violations(before, after, before.where("state < 1").select("id")).collect()}
    assert got == {("A", "lowers the state"), ("C", "not eligible"), ("Z", "unknown"), ("Z", "not eligible"), ("Z", "repeated")}
    fixed = {r.id: r.state for r in review.corrected_records(before, after.where("id = 'B'"), ["state"]).collect()}
    assert fixed == {"A": 0.5, "B": 1.0, "C": 1.0}


def test_locked_samples(spark):
    before = spark.createDataFrame([("a", 1, "甲 10 亿元"), ("a", 2, "one claim"), ("b", 1, "first"), ("b", 2, "second"), ("c", 1, "x")], "id string, pos int, label string")
    after = spark.createDataFrame([("a", 1, "甲10亿元"), ("a", 2, "One  claim!"), ("b", 1, "second"), ("b", 2, "first"), ("c", 1, "x"), ("c", 2, "y")], "id string, pos int, label string")
    got = {r.id: (r.same, r.first_mismatch) for r in review.locked_samples(before, after).collect()}
    assert got == {"a": (True, None), "b": (False, 1), "c": (False, 2)}


def test_witnesses(spark):
    side = "struct<value:string,unit:string,quote:string>"
    q = lambda v, t, u="a": (v, u, t)
    rows = [("1", "gt", q("135", "is 135"), q("167.05", "was 167.05")), ("2", "lt", q("135", "is 135"), q("167", "was 167.05")), ("3", "gt", q(">135", "over 135"), q("1", "1")), ("4", "eq", q("2", "is 3"), q("2", "2")), ("5", "gt", q("2", "2"), q("1", "1", "b")), ("6", "gt", q("2", "2"), q("1", "1")), ("6", "gt", q("2", "2"), q("1", "1")), ("7", "eq", q("1.23457", "1.234565"), q("1.23456", "1.234565"))]
    got = {(r.id, r.holds, ",".join(r.broken)) for r in review.witness_check(spark.createDataFrame(rows, f"id string, operator string, left {side}, right {side}")).collect()}
    assert got == {("1", False, ""), ("2", True, ""), ("3", None, ""), ("4", True, "left not in its quote"), ("5", None, ""), ("6", True, "repeated id"), ("7", False, "right not in its quote")}


def test_quotes_owners_and_scopes(spark):
    texts = spark.createDataFrame([("f", "a &amp; b\n c")], "file string, text string")
    quotes = spark.createDataFrame([(1, "f", "a & b c"), (2, "f", "z"), (3, "g", "a")], "id int, file string, quote string")
    assert {r.id for r in review.unfounded_quotes(quotes, texts).collect()} == {2, 3}
    asked, came = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",), ("c",)], "id string")
    assert {tuple(r) for r in review.wrong_scope(came, asked, ["id"]).collect()} == {("c", "not asked for"), ("a", "missing")}
    marks = spark.createDataFrame([(["Quota exceeded (x)"],), (["fine"],), ([],)], "m array<string>")
    assert [r.p for r in marks.select(review.is_permanent(F.col("m"), ["QUOTA", "a.b"]).alias("p")).collect()] == [True, False, False]


def test_text_scopes_cover_a_text(spark):
    text = "\n".join("line %d of the text." % i for i in range(3000))
    found = scopes.scopes(text).tolist()
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    assert all(e - s <= scopes.SIZE and c == max(0, s - 400) for s, e, c, _ in found)
    with pytest.raises(ValueError):
        list(scopes.scopes(text, 100))
    df = scopes.text_scopes(spark.createDataFrame([(1, text), (2, ""), (3, None)], "i int, t string"), "i", "t")
    assert "".join(r.body for r in df.orderBy("scope").collect()) == text
    assert scopes.pack_sentences("一。二。" * 200, 10)[0] == "一。二。一。二。一。"
    assert scopes.pack_sentences(None) == []


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("1.1", "a", 1), ("1.1", "b", 2)], "task string, subject string, x int")
    sinks.write_results(rows, f"file://{tmp_path}/r")
    sinks.write_results(rows, f"file://{tmp_path}/r")
    assert not sinks.write_changed(rows, f"file://{tmp_path}/r") and sinks.write_changed(rows, f"file://{tmp_path}/new")
    assert sinks.write_changed(rows.where("x = 1"), f"file://{tmp_path}/new") and spark.read.json(f"file://{tmp_path}/new").count() == 1
    sinks.append_log(rows, f"file://{tmp_path}/log")
    sinks.append_log(rows, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/r").count() == 2 and spark.read.json(f"file://{tmp_path}/log").count() == 4
    assert sinks.unused_path("a/r.docx", {"a/r.docx", "a/r-2.docx"}) == "a/r-3.docx" and sinks.unused_path("r", set()) == "r"
    items_ = ['{"claim": "x", "result": "fail", "reason": "why"}', '{"element": "y", "result": "pass"}', '{"id": "z", "verdict": "Unsupported", "location": "p. 3"}', '{"result": "not satisfied", "scope": "extracted/a.txt"}']
    losses = spark.createDataFrame([(items_, 1, 4, "r"), (items_[2:], None, None, "r"), ([], None, None, "plain process-record.json a runtime=3m; text")], "items array<string>, n int, d int, reason string")
    got = [r.t for r in losses.select(items.loss_brief(F.col("items"), F.col("n"), F.col("d"), F.col("reason")).alias("t")).collect()]
    assert got == ["1/4；x：why；z（p. 3）：缺少可识别的来源支撑；另有 1 项，详见逐题结果。", "z（p. 3）：缺少可识别的来源支撑；核验项：页面无法取得，来源及内容未获证实。", "plain  text"]
    lines = spark.createDataFrame([("t", 2, 1, "b"), ("t", 1, 2, "a2"), ("t", 1, 1, "a1")], "task string, section int, pos int, line string")
    assert sinks.task_markdown(lines).first().text == "a1\na2\nb"
    ledger = sinks.chart_ledger(spark.createDataFrame([("k", i) for i in range(30)], "k string, i int"), ["k"], ["i"])
    assert {(r.offset, r.n) for r in ledger.groupBy("offset").agg(F.count("*").alias("n")).collect()} == {(0, 15), (15, 15)}
