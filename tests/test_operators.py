"""Small literal fixtures of the rubric engine."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import numbers, text
from tallyloom.operators import inspect as ins
from tallyloom.operators import ordered, relate, score, validate
from tallyloom.plans.base import writer


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_durations(spark):
    cases = {"266m13s": 15973, "1h2m3s": 3723, " 5S ": 5, "": None, "abc": None, None: None, "3m2h": None}
    assert {k: one(spark, text.duration_seconds, k) for k in cases} == cases


def test_verdicts(spark):
    cases = {"Supported": True, "unsupported": False, "一致": True, "不一致（金额）": False, "not_applicable": False, "1": True, "0": False, "unclear": None, None: None}
    assert {k: one(spark, text.verdict, k) for k in cases} == cases


def test_urls_and_paths(spark):
    urls = {"https://a.b/c": True, "http://": False, "ftp://a.b": False, "nonsense": False, None: False}
    assert {k: one(spark, text.is_source_url, k) for k in urls} == urls
    paths = {"a\\b.txt": "a/b.txt", "./a": "a", "../a": None, "/a": None, "C:\\a": None, "a/./b": "a/b"}
    assert {k: one(spark, text.clean_path, k) for k in paths} == paths


def test_cells_and_numbers(spark):
    assert one(spark, text.table_cells, r"| a \| b | c |") == ["a | b", "c"]
    assert one(spark, text.signed_numbers, "data:[80.80,9.83]，价格1,919.50, -3") == ["80.80", "9.83", "1919.50", "-3"]
    assert one(spark, lambda c: text.text_page(c, 2, 3), "a\nbcd") == ("bcd", 5, 2, None)
    numeric = {"1d": None, "0x1p3": None, "inf": None, "nan": None, "1_000": 1000.0, " 2.5 ": 2.5, "1e3": 1000.0, "x": None, None: None}
    assert {k: one(spark, numbers.numeric, k) for k in numeric} == numeric
    assert [one(spark, numbers.state, x) for x in ("0.67", "1/0", "x")] == [Decimal("0.67"), None, None]
    assert abs(one(spark, numbers.state, "2/3") - Decimal(2) / 3) < Decimal("1e-9")
    assert [one(spark, numbers.display, x, "double") for x in (-0.001, 1.005, 2.675)] == ["0.00", "1.01", "2.68"]


def test_relations(spark):
    rows = [("135", "gt", "167.05", "a", "a", False), ("135", "lt", "167.05", "a", "a", True), (">135", "gt", "1", "a", "a", None), ("40-65", "gt", "1", "a", "a", None), ("1,919.5", "eq", "1919.50", "a", "a", True), ("2", "gt", "1", "a", "b", None)]
    df = spark.createDataFrame(rows, "l string, op string, r string, u string, v string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", numbers.relation_holds(*(F.col(c) for c in ("l", "op", "r", "u", "v")))).collect())
    auth = F.array(F.lit("4.903225806").cast(numbers.DECIMAL))
    assert [one(spark, lambda c: numbers.covered(c.cast(numbers.DECIMAL), auth), x) for x in ("4.903", "4.904", "4.9")] == [True, False, True]


def test_labels(spark):
    df = spark.createDataFrame([("甲 10 亿_元", "甲10亿元"), ("Ａb-c", "ABC")], "a string, b string")
    assert all(r.x == r.y for r in df.select(text.label_key("a").alias("x"), text.label_key("b").alias("y")).collect())
    assert df.select(text.similarity("a", "a").alias("s")).first()["s"] == 1.0


def test_inspector(spark):
    sheet = spark.createDataFrame([(2, "x", 1.0), (3, "x", 1.0), (4, "y", 3.0)], "_row int, kind string, value double")
    stats = {r.name: r for r in ins.inspect(sheet, {"operation": "stats", "columns": ["kind", "value"]}, ["_row"]).collect()}
    assert stats["value"].sum_value == 5 and stats["value"].duplicate_nonempty == 1 and stats["kind"].numeric_count == 0 and stats["kind"].sum_value is None
    kept = ins.inspect(sheet, {"operation": "rows", "filters": [{"column": "kind", "value": "x"}], "limit": 1}, ["_row"]).collect()
    assert [r._row for r in kept] == [2]
    assert ins.inspect(sheet.select("kind", "value"), {"operation": "duplicates"}, []).first() == (3, 1)
    assert {r.kind: (r.row_count, r.value_sum) for r in ins.inspect(sheet, {"operation": "group", "group_by": "kind", "columns": ["value"]}, []).collect()} == {"x": (2, 2.0), "y": (1, 3.0)}
    assert ins.inspect(sheet, {"operation": "correlation", "x": "value", "y": "value"}, []).first().pair_count == 3
    heads = ["项目", "2024", "2025"]
    assert [ins.resolve(k, heads) for k in (2, "B", "2025")] == ["2024", "2024", "2025"]
    for bad in (0, -1, 4, "Z"):
        with pytest.raises(ValueError):
            ins.resolve(bad, heads)
    for bad in ({"limit": 201}, {"offset": -1}):
        with pytest.raises(ValueError):
            ins.inspect(sheet, {"operation": "rows", **bad}, ["_row"])


def test_scores(spark):
    atoms = spark.createDataFrame([("t", "completion", "T01", 40.0, 1.0), ("t", "completion", "T02", 60.0, 1.0), ("t", "coverage", "C01", 100.0, 1.0)], "task string, metric string, atom string, weight double, state double")
    raw = score.metric_scores(atoms, ["task"])
    assert {r.metric: r.raw for r in raw.collect()} == {"completion": 100.0, "coverage": 5.0}
    caps = spark.createDataFrame([("t", "coverage", 1.0), ("t", "coverage", 2.0)], "task string, metric string, cap double")
    assert {r.metric: r.final for r in score.apply_caps(raw, caps, ["task", "metric"]).collect()} == {"completion": 100.0, "coverage": 1.0}
    scope = spark.createDataFrame([("t", "completion", "T01")], "task string, metric string, atom string")
    cut = score.metric_scores(score.zero_scoped(atoms, scope, ["task", "metric", "atom"]), ["task"])
    assert {r.metric: r.raw for r in cut.collect()} == {"completion": 60.0, "coverage": 5.0}


def test_extrema_ties(spark):
    rows = [("1.1", "a", 3000000), ("1.1", "b", 4063000), ("1.2", "a", 3000000), ("1.2", "b", 4322500), ("1.3", "a", 4322500), ("1.3", "b", 3000000)]
    df = spark.createDataFrame(rows, "task string, subject string, final long").withColumn("dimension", F.lit("1"))
    r = score.extrema(score.baseline_differences(df, "a", ["dimension", "task"]), ["dimension", "subject"], "task").first()
    assert (r.largest, r.tied, r.positive, r.negative, r.equal) == (1322500, "1.2,1.3", "1.1,1.2", "1.3", "")


def test_batches_and_pools(spark):
    kinds = ["BIN", "RATIO", "CLAIM-RATIO", "CLAIM-RATIO", "BIN", "BIN", "BIN", "BIN", "BIN"]
    df = spark.createDataFrame([(i, k, 1) for i, k in enumerate(kinds)], "pos int, kind string, g int")
    got = {r.pos: r.batch for r in ordered.batches(df, F.col("kind") == "CLAIM-RATIO", 4, ["g"], ["pos"], writer(spark)).collect()}
    assert [got[i] for i in range(9)] == [1, 1, 2, 3, 4, 4, 4, 4, 5]
    pool = spark.createDataFrame([(0, 1, "甲 10 亿元"), (1, 1, "甲10亿元"), (1, 2, "乙 20 亿元"), (2, 1, None)], "ref int, pos int, claim string")
    assert sorted((r.ref, r.pos) for r in ordered.first_of_key(pool, text.label_key("claim"), ["ref", "pos"]).collect()) == [(0, 1), (1, 2)]
    rounds = spark.createDataFrame([(i, p, 1) for i, p in enumerate([True, False, False, True, False])], "n int, p boolean, g int")
    assert [r.stalled for r in ordered.stalled_rounds(rounds, F.col("p"), ["g"], ["n"], writer(spark)).orderBy("n").collect()] == [0, 1, 2, 0, 1]


def test_ownership_and_paths(spark):
    subjects = spark.createDataFrame([("a", "alpha-"), ("b", "beta-")], "id string, prefix string")
    files = spark.createDataFrame([("ALPHA-x.txt",), ("beta-y.txt",), ("common.txt",)], "name string")
    assert {r.name: r.owner for r in relate.owners_by_prefix(files, subjects).collect()} == {"ALPHA-x.txt": "a", "beta-y.txt": "b", "common.txt": "source"}
    known = spark.createDataFrame([("a/report.txt",), ("b/report.txt",), ("extracted/deep/table.xlsx.txt",), ("c/only.md",)], "file string")
    wanted = spark.createDataFrame([("a\\report.txt",), ("report.txt",), ("table.xlsx",), ("only.md",), ("../c/only.md",), ("zz",)], "given string")
    got = {r.given: r.file for r in relate.resolve_paths(wanted, known).collect()}
    assert got == {"a\\report.txt": "a/report.txt", "report.txt": None, "table.xlsx": "extracted/deep/table.xlsx.txt", "only.md": "c/only.md", "../c/only.md": None, "zz": None}


def test_closure_ends_on_cycles(spark, tmp_path):
    edges = spark.createDataFrame([("H", "A"), ("A", "T"), ("T", "A")], "start string, node string")
    n = iter(range(99))

    def write(df):
        path = f"file://{tmp_path}/{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    assert {tuple(r) for r in relate.closure(spark, edges, write).collect()} == {("H", "A"), ("H", "T"), ("A", "T"), ("A", "A"), ("T", "A"), ("T", "T")}


EVIDENCE = "array<struct<file:string,locator:string,quote:string,kind:string,description:string>>"
ITEMS = "array<struct<label:string,result:string,members:array<string>,count:long,method:string,scope:string,location:string>>"
SCHEMA = f"id string, kind string, rule string, state string, numerator long, denominator long, reason string, observation string, evidence {EVIDENCE}, items {ITEMS}"


def decision(i, state, n, d, rule="", kind="RATIO", items=1, said="", result="supported"):
    return (i, kind, rule, state, n, d, "a reason of more than twenty characters " + said, "observed it", [("f.txt", "L1", "quote", None, None)], [("x", result, None, None, None, None, None)] * items)


def test_decisions(spark):
    rows = [
        decision("ok", "0.67", 2, 3),
        decision("wrong", "1", 2, 3),
        decision("capped", "1", 20, 10, "min(distinct_sources / 10, 1.0)"),
        decision("target", "1", 20, 20, "min(distinct_sources / 10, 1.0)"),
        decision("over", "1", 20, 10),
        decision("count", "1", 4, 3, "min(n,3)/3", "COUNT"),
        decision("audit", "1", 61, 61, "抽样核验", "CLAIM-RATIO", 26, "实际核验 26 条"),
        decision("audit2", "1", 61, 61, "抽样核验", "CLAIM-RATIO", 26, "实际核验 26 条", "unclear"),
        decision("bare", "0.5", 1, 2, items=0),
        decision("empty", "1", 0, 0, "空集合状态=1", "CLAIM-RATIO", 0),
        decision("bin", "0.5", None, None, kind="BIN"),
    ]
    df, files = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("f.txt",)], "file string")
    broken = validate.decision_violations(df, files)
    assert {(r.key, r.rule) for r in broken.collect()} == {("wrong", "state"), ("target", "target"), ("over", "bounds"), ("over", "state"), ("bare", "no items"), ("bin", "binary")}
    fixed = {r.id: (r.numerator, r.denominator, r.original_denominator) for r in validate.corrected(df).collect()}
    assert fixed["audit"] == (26, 26, 61) and fixed["audit2"] == (61, 61, 61)
    assert validate.accepted(df, broken).count() == 6
    assert {r.key for r in validate.decision_violations(df, files.limit(0)).where("rule = 'unknown file'").collect()} == {r[0] for r in rows}
    assert {r.id: r.agrees for r in validate.accounting(df.where("id in ('ok', 'audit')")).collect()} == {"ok": False, "audit": False}


def test_error_decisions(spark):
    rules = spark.createDataFrame([("E1",), ("E2",), ("E3",)], "id string")
    rows = [("E1", True, "why", []), ("E2", False, "why", None), ("E2", False, "", None), ("E9", None, "x", None)]
    got = {(r.key, r.rule) for r in validate.error_violations(spark.createDataFrame(rows, f"id string, triggered boolean, reason string, evidence {EVIDENCE}"), rules).collect()}
    assert got == {("E3", "missing"), ("E9", "unknown"), ("E2", "repeated"), ("E1", "no evidence"), ("E2", "no reason"), ("E9", "untyped")}
