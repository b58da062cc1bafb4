"""Documents replaced whole or not at all, and differences found through digest trees."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import digests
from tallyloom.sources import documents


def state(folder):
    return {os.path.relpath(os.path.join(d, f), folder): (open(os.path.join(d, f)).read(), os.stat(os.path.join(d, f)).st_ino) for d, _, names in os.walk(folder) for f in names}


def test_only_changed_documents_are_replaced(spark, tmp_path):
    folder = tmp_path / "docs"
    rows = [(f"t{i}/a.json", f'{{"x": {i}}}') for i in range(12)] + [("empty.md", None)]
    first = spark.createDataFrame(rows, "name string, content string").repartition(4)
    documents.write_documents(first, f"file://{folder}")
    before = state(folder)
    assert {k: v[0] for k, v in before.items()} == {n: c or "" for n, c in rows}
    documents.write_documents(first, str(folder))
    assert state(folder) == before, "the same contents touch no file"
    documents.write_documents(first.withColumn("content", F.when(F.col("name") == "t3/a.json", "new").otherwise(F.col("content"))), str(folder))
    after = state(folder)
    assert {k for k in after if after[k] != before[k]} == {"t3/a.json"} and after["t3/a.json"][0] == "new"
    got = {r["name"]: r["content"] for r in documents.read_documents(spark, str(folder)).collect()}
    assert got == {k: v[0] for k, v in after.items() if v[0]}


def test_a_failed_write_leaves_everything_as_it_was(spark, tmp_path):
    folder = tmp_path / "docs"
    df = spark.createDataFrame([(f"{i}.txt", "old") for i in range(8)], "name string, content string")
    documents.write_documents(df, str(folder))
    before = state(folder)
    broken = df.withColumn("content", F.when(F.col("name") == "5.txt", F.raise_error(F.lit("killed"))).otherwise("new")).repartition(4)
    with pytest.raises(Exception, match="killed"):
        documents.write_documents(broken, str(folder))
    assert state(folder) == before
    for bad in (df.withColumn("content", F.lit("new")).union(df), df.withColumn("name", F.concat(F.lit("../"), "name")), df.withColumn("name", F.lit(None).cast("string")), df.withColumn("name", F.lit(".x"))):
        with pytest.raises(Exception, match="written twice|relative path"):
            documents.write_documents(bad, str(folder))
        assert state(folder) == before
    with pytest.raises(Exception, match="append"):
        df.write.format("documents").mode("overwrite").save(str(folder))


def test_a_loser_of_a_race_leaves_nothing(tmp_path):
    writer = documents.DocumentWriter(str(tmp_path))
    row = {"name": "a.txt", "content": "x"}
    won, lost = writer.write(iter([row])), writer.write(iter([row]))
    assert won.changed and lost.changed and len(os.listdir(writer.staging)) == 2
    writer.commit([won])
    assert {k: v[0] for k, v in state(tmp_path).items()} == {"a.txt": "x"} and os.listdir(tmp_path) == ["a.txt"]


def test_result_documents(spark):
    results = spark.createDataFrame([("1.1", "a", 0.5, ["x"])], "task string, subject string, final double, notes array<string>")
    assert [tuple(r) for r in documents.result_documents(results).collect()] == [("1.1/a.json", '{"final":0.5,"notes":["x"]}')]


@pytest.mark.parametrize("fan", [4, 16, 1024])
def test_difference(spark, tmp_path, fan):
    rng = random.Random(fan)
    old = {i: f"t{i}" for i in rng.sample(range(-50, 900), 500)}
    new = {i: t for i, t in old.items() if rng.random() > 0.02} | {i: "new" for i in rng.sample(range(899), 6)} | {7: "seven"}
    frame = lambda d: spark.createDataFrame([*d.items(), (899, "end")], "id long, part string")
    a, b = (digests.build(frame(d), f"file://{tmp_path}/{name}", fan) for name, d in (("a", old), ("b", new)))
    got = {(r["id"], r["change"]) for r in digests.difference(spark, a, b).collect()}
    want = {(i, "gone") for i in old.keys() - new.keys()} | {(i, "new") for i in new.keys() - old.keys()} | {(i, "changed") for i in old.keys() & new.keys() if old[i] != new[i]}
    assert got == want
    assert digests.difference(spark, a, a).count() == 0


def test_repeated_ids_nulls_and_what_is_read(spark, tmp_path, capsys):
    rows = [(1, "a"), (1, "b"), (2, None), (300, "x"), (9000, "y")]
    a = digests.build(spark.createDataFrame(rows, "id long, part string"), f"file://{tmp_path}/a", 16)
    b = digests.build(spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (300, "z"), (9000, "y")], "id long, part string"), f"file://{tmp_path}/b", 16)
    found = digests.difference(spark, a, b)
    assert [tuple(r) for r in found.collect()] == [(300, "changed")]
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("PartitionFilters: [isnotnull(top") + plan.count("PartitionFilters: [top") >= 2
    assert digests.difference(spark, *(digests.build(spark.createDataFrame([], "id long, part string"), f"file://{tmp_path}/{n}") for n in "cd")).count() == 0
    with pytest.raises(ValueError):
        digests.difference(spark, a, digests.build(spark.createDataFrame(rows, "id long, part string"), f"file://{tmp_path}/e", 4))
