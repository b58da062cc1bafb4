"""Scans over many range partitions, with one key that holds half of the rows, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ordered, scans
from tallyloom.plans.base import writer


@pytest.fixture
def parted(spark):
    """Twenty-five range partitions whatever their size, each in several batches."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "25")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(seed, n=600):
    """(key, at, value, flag): key "hot" has half of the rows, one key is null, many are short; values and flags are often null."""
    rng = random.Random(seed)
    keys = [rng.choice(["hot", "hot", None, *"abcdefghij"]) if i % 2 else "hot" for i in range(n)]
    return [(k, i, rng.choice([None, None, None, i]), rng.choice([True, False, False, False, None] if seed % 2 else [False] * 30 + [True])) for i, k in enumerate(keys)]


def by_key(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out.values()


SCHEMA = "key string, at int, value int, flag boolean"


@pytest.mark.parametrize("seed", range(4))
def test_scans(parted, seed):
    data = rows(seed)
    df = parted.createDataFrame(random.Random(seed).sample(data, len(data)), SCHEMA)
    got = scans.scan(df, ["key"], ["at"], {"last": scans.Last("value"), "total": scans.Sum("value"), "since": scans.Sum("value", "flag")}, writer(parted)).collect()
    want = []
    for part in by_key(data):
        last, total, since = None, 0, 0
        for k, at, value, flag in part:
            last, total, since = value if value is not None else last, total + (value or 0), (0 if flag else since) + (value or 0)
            want.append((k, at, value, flag, last, total, since))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("size", [1, 4, 100])
def test_batches(parted, seed, size):
    data = rows(seed)
    df = parted.createDataFrame(data, SCHEMA)
    got = {r["at"]: r["batch"] for r in ordered.batches(df, F.col("flag"), size, ["key"], ["at"], writer(parted)).collect()}
    for part in by_key(data):
        batch, held = 0, size
        for _, at, _, flag in part:
            if flag or held == size:
                batch, held = batch + 1, 0
            held = size if flag else held + 1
            assert got[at] == batch


@pytest.mark.parametrize("seed", range(2))
def test_counts_and_visible(parted, seed):
    data = rows(seed)
    df, write = parted.createDataFrame(data, SCHEMA), writer(parted)
    stalled = {r["at"]: r["stalled"] for r in ordered.stalled_rounds(df, F.col("flag"), ["key"], ["at"], write).collect()}
    labels = {r["at"]: r["label"] for r in ordered.numbered(df, ["at"], ["key"], write=write).collect()}
    chunks = {r["at"]: r["chunk"] for r in ordered.chunks(df, 7, ["key"], ["at"], write).collect()}
    seen = {r["at"] for r in ordered.visible(df, F.col("flag"), ["key"], ["at"], write, few=25, shown=3).collect()}
    shown = set()
    for part in by_key(data):
        idle = 0
        for nth, (_, at, _, flag) in enumerate(part):
            idle = 0 if flag else idle + 1
            assert (stalled[at], labels[at], chunks[at]) == (idle, f"R{nth + 1:03d}", nth // 7)
        yes = [r[1] for r in part if r[3]]
        shown |= {r[1] for r in part if len(part) <= 25 or not r[3] or r[1] in yes[:3]}
    assert seen == shown


def test_odd_tables(parted):
    write = writer(parted)
    empty = parted.createDataFrame([], SCHEMA)
    assert ordered.carry_forward(empty, F.col("value"), "x", ["key"], ["at"], write).count() == 0
    assert ordered.batches(empty, F.col("flag"), 2, ["key"], ["at"], write).count() == 0
    floats = parted.createDataFrame([(k, i) for i, k in enumerate([math.nan, None, 0.0, -0.0, math.nan, None])], "key double, at int")
    placed = {r["at"]: r["n"] for r in ordered.placed(floats, ["at"], ["key"], write, "n").collect()}
    assert placed == {0: 1, 4: 2, 1: 1, 5: 2, 2: 1, 3: 2}
    whole = ordered.placed(floats.withColumn("one", F.lit(1)), ["at"], [], write, "n").collect()
    assert {r["at"]: r["n"] for r in whole} == {i: i + 1 for i in range(6)}
    with pytest.raises(ValueError):
        ordered.batches(empty, F.col("flag"), 0, ["key"], ["at"], write)


def test_hot_key_is_shared_out(parted):
    """The events of all users given to two of them: no range partition has over twice the rows of the median one."""
    events = parted.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("user_id", F.when(F.col("event_id") % 2 == 0, 1).otherwise(F.col("user_id")))
    sizes = sorted(r["count"] for r in scans.ranged(events, ["user_id"], ["event_id"]).groupBy(scans.PART).count().collect())
    assert len(sizes) == 25 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    got = ordered.carry_forward(events, F.when(F.col("event_type") == "purchase", F.col("event_id")), "section", ["user_id"], ["event_id"], writer(parted))
    held = sorted((tuple(r) for r in events.select("user_id", "event_id", "event_type").collect()))
    last, want = {}, {}
    for user, event, kind in held:
        if kind == "purchase":
            last[user] = event
        want[event] = last.get(user)
    assert {r["event_id"]: r["section"] for r in got.collect()} == want
