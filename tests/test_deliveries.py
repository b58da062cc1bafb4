"""Configurations read from files, ownership by name or folder, and whole answers of the inspector."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import inspect as ins
from tallyloom.sources import deliveries


def test_configurations(spark, tmp_path):
    (tmp_path / "data").mkdir()
    good = {"dataset": f"{tmp_path}/data", "subjects": [{"id": "a", "name": "A", "prefix": "x"}, {"id": "b", "prefix": "y"}], "dimensions": ["2", "1"], "other": 1}
    bad = {"dataset": f"{tmp_path}/none", "subjects": [{"id": "a", "prefix": "x"}, {"id": "a", "prefix": "X"}]}
    for name, config in {"good": good, "bad": bad, "empty": {"dataset": f"{tmp_path}/data", "subjects": []}, "bare": {}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(config))
    configs = deliveries.read_config(spark, f"{tmp_path}/*.json")
    got = {(r.key.rsplit("/", 1)[1].removesuffix(".json"), r.rule) for r in deliveries.config_violations(spark, configs).collect()}
    assert got == {("bad", "repeated id"), ("bad", "repeated prefix"), ("bad", "no data set"), ("empty", "number of subjects"), ("bare", "number of subjects"), ("bare", "no data set")}
    held = configs.where("config like '%good.json'").first()
    assert held.dimensions == ["2", "1"] and held.tasks == [] and [s.prefix for s in held.subjects] == ["x", "y"]
    tasks = spark.createDataFrame([(t,) for t in ("1.2", "1.10", "2.1", "3.1")], "t string")
    assert [r.t for r in tasks.orderBy(*deliveries.task_order(F.col("t"), held.dimensions)).collect()] == ["2.1", "1.2", "1.10", "3.1"]
    assert [r.t for r in tasks.orderBy(*deliveries.task_order(F.col("t"))).collect()] == ["1.2", "1.10", "2.1", "3.1"]


FILES = ["问题描述.txt", "rubric.md", "Alpha-1.txt", "beta/report.md", "BETA-x/alpha.txt", "alpha/alpha-2.txt", "notes.txt", "deep/alpha-3.txt", "deep/rubric.md", "~$alpha.txt", "old-alpha.txt", "OLD/beta.txt"]
WANT = {"Alpha-1.txt": "a", "beta/report.md": "b", "BETA-x/alpha.txt": None, "alpha/alpha-2.txt": "a", "notes.txt": "source", "deep/alpha-3.txt": "a", "deep/rubric.md": "source"}


@pytest.mark.parametrize("literal", [4096, 0])
def test_owners_by_name_or_folder(spark, monkeypatch, literal):
    monkeypatch.setattr(deliveries, "LITERAL", literal)
    subjects = spark.createDataFrame([("a", "alpha"), ("b", "Beta")], "id string, prefix string")
    files = spark.createDataFrame([("1.1", f) for f in FILES] + [("1.2", "alpha.txt")], "task string, path string")
    owned = deliveries.owned(files, subjects, ["old"])
    assert {r.path: r.owner for r in owned.where("task = '1.1'").collect()} == WANT
    got = {tuple(r) for r in deliveries.delivery_violations(files, owned, subjects).collect()}
    assert got == {("file", "1.1/BETA-x/alpha.txt", "several subjects"), ("task", "1.2", "no question"), ("task", "1.2", "no rubric"), ("task", "1.2/b", "no delivery")}


def test_whole_answers(spark):
    rows = [(2, "b", "1"), (3, "a", "x"), (4, "b", "1"), (5, None, "\n"), (6, "a", "2.5")]
    df = spark.createDataFrame(rows, "_row int, kind string, value string")
    ask = lambda **request: ins.answer(df, request, ["_row"], ["kind", "value"], 1).first()
    stats = ask(operation="stats", columns=["value", "kind"])
    assert (stats.headers, stats.header_row, stats.selected_rows, stats.duplicate_rows) == (["kind", "value"], 1, 5, 1)
    assert [(r.name, r.nonempty, r.empty, [tuple(x) for x in r.top_values]) for r in stats.result] == [("value", 4, 1, [("1", 2), ("x", 1), ("2.5", 1)]), ("kind", 4, 1, [("b", 2), ("a", 2)])]
    groups = ask(operation="group", group_by="kind", columns=["value"])
    assert [(r.kind, r.row_count, r.value_sum) for r in groups.result] == [("b", 2, 2.0), ("a", 2, 2.5), (None, 1, 0.0)]
    page = ask(operation="rows", offset=1, limit=2, filters=[{"column": 2, "op": "not_empty"}])
    assert [(r._row, r.kind) for r in page.result] == [(3, "a"), (4, "b")] and page.result[0].next_offset == 3 and page.selected_rows == 4
    assert ask(operation="duplicates").result[0].duplicate_rows == 1
    none = ask(operation="stats", columns=["kind"], filters=[{"column": "kind", "value": "z"}])
    assert (none.selected_rows, none.duplicate_rows) == (0, 0) and [(r.name, r.nonempty, r.empty, r.sum_value, r.top_values) for r in none.result] == [("kind", 0, 0, None, [])]
