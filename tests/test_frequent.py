"""Frequent values of summaries and exact counts against plain counting."""

import random
from collections import Counter

import pytest

from tallyloom.operators.frequent import Summary, frequent_values
from tallyloom.plans.base import writer


def test_a_summary_is_never_off_by_more_than_its_error():
    rng = random.Random(2)
    true, summary = Counter(), Summary(20)
    for _ in range(60):
        part = Counter(str(min(int(rng.paretovariate(0.6)), 400)) for _ in range(100))
        true.update(part)
        summary.add(part)
        assert len(summary.counts) <= 20
        assert all(n - summary.error <= summary.counts.get(v, 0) <= n for v, n in true.items())
    assert summary.error <= sum(true.values()) / 20


@pytest.mark.parametrize("kept", [1, 6, 60, 4000])
def test_as_plain_counting(spark, kept):
    rng = random.Random(kept)
    rows = [(i, rng.choice(["a", "b", None, "\t", "", "x" * rng.randrange(1, 9)]), min(int(rng.paretovariate(0.7)), 300), i, rng.choice([1.5, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, s string, n int, own int, few double").repartition(6)
    got = frequent_values(spark, df, ["s", "n", "own", "few"], ["i"], writer(spark), k=5, kept=kept).collect()
    for at, name in ((1, "s"), (2, "n"), (3, "own"), (4, "few")):
        first, counts = {}, Counter()
        for r in rows:
            if r[at] is not None and str(r[at]).strip():
                counts[str(r[at])] += 1
                first.setdefault(str(r[at]), r[0])
        want = sorted(counts.items(), key=lambda x: (-x[1], first[x[0]]))[:5]
        assert [(r["value"], r["n"]) for r in sorted((r for r in got if r["name"] == name), key=lambda r: r["place"])] == want
    proven = {r["name"]: r["proven"] for r in got}
    assert proven["own"] == (kept == 4000) and proven["few"] and (kept < 60 or proven["n"] and proven["s"])


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "x")], "i long, none string, x string")
    assert [tuple(r) for r in frequent_values(spark, df, ["none", "x"], ["i"], writer(spark)).collect()] == [("x", 1, "x", 2, True)]
    assert frequent_values(spark, df.limit(0), ["none", "x"], ["i"], writer(spark)).count() == 0
