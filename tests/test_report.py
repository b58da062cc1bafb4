"""Lines of a task's report, each by hand."""

from pyspark.sql import functions as F

from tallyloom.operators import report

ITEM = "struct<label:string,source:string,result:string,verdict:string,passed:boolean,location:string,locator:string,scope:string,reason:string,explanation:string,note:string,basis:string,quote:string>"


def item(label=None, passed=None, **more):
    names = ("source", "result", "verdict", "location", "locator", "scope", "reason", "explanation", "note", "basis", "quote")
    held = {n: more.get(n) for n in names}
    return (label, held["source"], held["result"], held["verdict"], passed, *(held[n] for n in names[3:]))


def test_ceilings(spark):
    scoped = "array<struct<atoms:array<string>,ceiling:string>>"
    scores = spark.createDataFrame([("1.1", "a", "A|", "m", 90.0, 60.0, True, []), ("1.1", "a", "A|", "n", 50.0, 40.005, False, [(["F1", "F2"], "0"), (["F3"], "0.5")]), ("1.1", "a", "A|", "o", 1.0, 1.0, None, None), ("1.1", "b", "B", "m", 1.0, 1.0, True, None)], f"task string, subject string, name string, metric string, raw double, final double, capped boolean, scoped {scoped}")
    errors = spark.createDataFrame([("1.1", "a", 2, "E9", True), ("1.1", "a", 1, "E10", True), ("1.1", "a", 3, "E1", False), ("1.1", "b", 1, "E1", None)], "task string, subject string, pos int, id string, triggered boolean")
    got = [tuple(r) for r in report.ceiling_notes(scores, errors, {"n": "N", "m": "M", "o": "O"}).collect()]
    assert got == [("1.1", "a", "- A\\|：触发 E10、E9；N 50.00 → 40.01；M 90.00 → 60.00；N仅对 F1、F2 应用局部上限 0；N仅对 F3 应用局部上限 0.5。具体依据见该对象的关键错误与封顶记录。")]


def test_differences(spark):
    items = "array<struct<label:string,passed:boolean,source:string>>"
    rows = [("1", "A1", "m", 1, s, n, st, it, "seen", "why") for s, n, st, it in ((1, "b", "0.5", [("x", False, "")]), (0, "a", "1", [("x", True, "")]), (2, "c", "1.000", None))]
    rows += [("1", "A2", "m", 2, s, "x", "0.5", None, None, None) for s in (0, 1)]
    df = spark.createDataFrame(rows, f"task string, id string, metric string, pos int, subject_pos int, name string, state string, items {items}, observation string, reason string")
    assert [tuple(r) for r in report.difference_rows(df, {"m": "M"}).collect()] == [("1", 1, "| A1（M） | 1.00 / 0.50 / 1.00 | x：a满足，b未满足 |")]


def test_items_corrections_and_evidence(spark):
    many = [item(f"i{i}", i != 7) for i in range(12)]
    few = [item("a|b", True, location="L1", note="n", quote="q"), item(None, None, source="s", verdict="unclear", scope="all"), item("\n", False)]
    df = spark.createDataFrame([(many,), (few,), ([],)], f"items array<{ITEM}>")
    got = [r.lines for r in df.select(report.item_lines(F.col("items")).alias("lines")).collect()]
    assert got[0] == ["- i0 — 通过", "- i1 — 通过", "- i7 — 未通过", "- 其余 9 条核验项见完整 JSON；此处未省略已识别的未通过项。"]
    assert got[1] == ["- a\\|b — 通过；位置：L1；依据：n；摘录：q", "- s — unclear；位置：all", "- 核验项 — 未通过"] and got[2] == []
    kind = "struct<reason:string,original_denominator:int,audited_count:int,`from`:string,`to`:string>"
    fixed = spark.createDataFrame([(("r", 61, 26, None, None),), (("r", None, 26, "1", "0"),)], f"c {kind}")
    assert [r.x for r in fixed.select(report.correction_line(F.col("c")).alias("x")).collect()] == ["- 记录修正：r 原分母 61，实际计分样本 26。", "- 记录修正：r 判定由 1 改为 0。"]
    seen = spark.createDataFrame([(("f.png", "p1", "visual", "q", "a chart"),), (("f.txt", "L1", "visual", "q", ""),), (("f|.txt", None, None, None, "d"),)], "e struct<file:string,locator:string,kind:string,quote:string,description:string>")
    assert [r.x for r in seen.select(report.evidence_line(F.col("e")).alias("x")).collect()] == ["- 证据：`f.png` · p1 · 视觉观察：a chart", "- 证据：`f.txt` · L1 · q", "- 证据：`f\\|.txt` ·  · "]
