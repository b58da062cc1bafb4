"""Streams with state against the same questions asked of tables, over several batches and restarts."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import resolve
from tallyloom.sources import files
from tallyloom.streaming import events, runs
from tallyloom.streaming.barrier import CompleteOnce

DAY, HOUR = 86400, 3600


def drained(stream, folder, mode="append", name="out"):
    """Runs a stream over all there is, as a query that ends and may be started again from its checkpoint."""
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/{name}/{n:05d}")).option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def test_lines_are_numbered_over_restarts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    line = lambda kind, **x: json.dumps({"type": kind, **x}) + "\n"
    (inbox / "a.2.jsonl").write_text(line("text", part={"text": "two secret"}) + "broken\n")
    (inbox / "a.1.jsonl").write_text(line("text", part={"text": "one"}, sessionID="s"))
    (inbox / "b.jsonl").write_text(line("text", part={"text": "alone"}))
    drained(events.log_stream(spark, str(inbox), ["secret"]), tmp_path)
    (inbox / "a.3.jsonl").write_text(line("text", part={"text": "three"}) + line("error", error="boom"))
    drained(events.log_stream(spark, str(inbox), ["secret"]), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out/*")
    at = {(r["file"].rsplit("/", 1)[1], r["pos"]): r["text"] for r in got.collect()}
    assert at == {("a.jsonl", 0): "one", ("a.jsonl", 1): "two ***", ("a.jsonl", 3): "three", ("a.jsonl", 4): None, ("b.jsonl", 0): "alone"}
    told = {r["file"].rsplit("/", 1)[1]: (r["text"], r["error"], r["session"]) for r in files.log_summary(got).collect()}
    assert told == {"a.jsonl": ("one\ntwo ***\nthree", "boom", "s"), "b.jsonl": ("alone", None, None)}


def test_runs_as_in_a_table(spark, tmp_path):
    """Users' events as runs, in files by time, read in two queries with a restart between them."""
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("done"))
    begin = table.agg(F.min("at").alias("t")).first()["t"]
    starts = table.select("run").distinct().withColumn("started_at", F.lit(begin))
    # Two runs without any event, and one that is done at once.
    quiet = spark.createDataFrame([(-1, begin), (-2, begin + dt.timedelta(days=1))], "run long, started_at timestamp")
    starts = starts.unionByName(quiet.withColumn("run", F.col("run").cast(starts.schema["run"].dataType)))
    first, total = 6 * HOUR, 2 * DAY
    starts.coalesce(1).write.mode("append").parquet(str(tmp_path / "starts"))
    bounds = [begin + dt.timedelta(hours=h) for h in (0, 5, 9, 30, 70, 24 * 400)]

    def deal(lo, hi):
        for a, b in zip(bounds[lo:hi], bounds[lo + 1 : hi + 1], strict=True):
            table.where((F.col("at") >= F.lit(a)) & (F.col("at") < F.lit(b))).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))

    def stream():
        read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        return runs.run_states(read("starts", starts.schema), read("events", table.schema), ["run"], first, total)

    deal(0, 3)
    drained(stream(), tmp_path, "update")
    deal(3, 5)
    drained(stream(), tmp_path, "update")
    told = spark.read.parquet(f"{tmp_path}/out/*")
    last = {r["run"]: (r["state"], r["as_of"]) for r in told.groupBy("run").agg(F.max_by("state", F.struct("as_of", "batch")).alias("state"), F.max("as_of").alias("as_of")).collect()}
    now = table.agg(F.max("at").alias("t")).first()["t"]
    want = {r["run"]: r["state"] for r in resolve.timeouts(starts, table, ["run"], first, total, F.lit(now)).collect()}
    assert {k: v[0] for k, v in last.items()} == want
    assert len(set(want.values())) >= 3 and told.groupBy("run", "batch").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("cuts", [[200], [1, 50, 149], [40, 40, 40, 80]])
def test_groups_once(spark, tmp_path, cuts):
    rng = random.Random(len(cuts))
    expected = {f"g{i}": rng.randrange(1, 8) for i in range(30)}
    rows = [(g, m) for g, n in expected.items() for m in range(n if g != "g0" else n - 1)]
    rows += rng.choices(rows, k=200 - len(rows))
    rng.shuffle(rows)
    barrier = CompleteOnce(spark.createDataFrame(list(expected.items()), "k string, expected int"), ["k"], f"file://{tmp_path}/barrier")
    at, seen, want = 0, {}, {}
    for batch, size in enumerate(cuts):
        part = rows[at : at + size]
        at += size
        df = spark.createDataFrame(part, "k string, member int")
        barrier(df, batch)
        if batch % 2 == 0:
            barrier(df, batch)  # run again
        for g, m in part:
            seen.setdefault(g, set()).add(m)
        want |= {g: batch for g in seen if len(seen[g]) >= expected[g] and g not in want}
    got = [(r["k"], r["batch"]) for r in barrier.emitted(spark).collect()]
    assert sorted(got) == sorted(want.items()) and "g0" not in want
    for batch in range(len(cuts), len(cuts) + 2):
        barrier(spark.createDataFrame(rows[:5], "k string, member int"), batch)
    progress = {r["batch"]: r for r in barrier.progress(spark).collect()}
    assert [progress[n]["stalled"] for n in sorted(progress)][-2:] == [1, 2]
    final = progress[len(cuts)]
    assert (final["completed"], final["members"]) == (len(want), sum(map(len, seen.values())))
    (tmp_path / "all").mkdir()
    once = CompleteOnce(barrier.expected, ["k"], f"file://{tmp_path}/all")
    once(spark.createDataFrame(rows, "k string, member int"), 7)
    assert once.progress(spark).first()["digest"] == final["digest"], "however the stream is cut"


def test_barrier_in_a_query(spark, tmp_path):
    """The same through a query that is stopped and started again."""
    labels = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("member"))
    expected = labels.groupBy("k").agg(F.count_distinct("member").alias("expected"))
    barrier = CompleteOnce(expected, ["k"], f"file://{tmp_path}/barrier")

    def go():
        stream = spark.readStream.schema(labels.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(barrier).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(180)

    labels.where("member > 2").repartition(2).write.parquet(str(tmp_path / "in"))
    go()
    early = barrier.emitted(spark).count()
    labels.where("member <= 2").repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    groups = barrier.emitted(spark)
    assert early == labels.groupBy("k").agg(F.min("member").alias("m")).where("m > 2").count() < groups.count() == groups.select("k").distinct().count() == expected.count()
