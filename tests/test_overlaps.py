"""Overlapping boxes of very unlike sizes against all pairs."""

import random

import pytest

from tallyloom.operators import relate


@pytest.mark.parametrize("seed", range(3))
def test_boxes_of_all_sizes(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b"]), rng.uniform(-50, 50), rng.uniform(-50, 50), 2.0 ** rng.uniform(-4, 5), 2.0 ** rng.uniform(-4, 5)) for i in range(150)]
    rows += [(900, "a", -60.0, -60.0, 200.0, 200.0), (901, "a", 0.0, 0.0, 0.0, 5.0), (902, "b", 1.0, 1.0, 1.0, 1.0), (903, "b", 1.0, 1.0, 1.0, 1.0)]
    want = {}
    for i, (a, ga, x, y, w, h) in enumerate(rows):
        for b, gb, u, v, p, q in rows[i + 1 :]:
            common = max(0.0, min(x + w, u + p) - max(x, u)) * max(0.0, min(y + h, v + q) - max(y, v))
            smaller = min(w * h, p * q)
            if ga == gb and smaller and common / smaller > 0.4:
                want[a, b] = common / smaller
    df = spark.createDataFrame(rows, 'id long, g string, left double, top double, width double, height double')
    got = {(r["first"], r["second"]): r["share"] for r in relate.overlaps(df, "g").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sum(900 in k for k in want) > 20


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, "g", 0.0, 0.0, 0.0, 0.0), (2, "g", 0.0, 0.0, None, 1.0)], "id long, g string, left double, top double, width double, height double")
    assert relate.overlaps(df, "g").count() == 0 and relate.overlaps(df.limit(0), "g").count() == 0
