"""Damaged JSON read as it was meant, pages by places, and documents compared with an edited copy."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.repair import mended, mended_objects, mended_values
from tallyloom.operators.places import placed


@pytest.mark.parametrize(
    ("text", "value", "said"),
    [
        ('{"a": 1}', {"a": 1}, []),
        ('{"a": 1 "b": [1 2]}', {"a": 1, "b": [1, 2]}, ["missing comma"]),
        ('{"a": [1,, 2,],}', {"a": [1, 2]}, ["extra comma"]),
        ("{'a': 'it''s'}", None, None),
        ("{'a': 'x', b: True}", {"a": "x", "b": True}, ["other quotes", "name without quotes", "word of another language"]),
        ('{"a": [1, {"b": 2', {"a": [1, {"b": 2}]}, ["bracket left open"]),
        ('{"a": [1, 2}', {"a": [1, 2]}, ["bracket left open"]),
        ('{"a": (1)}', {"a": "(1)"}, ["text without quotes"]),
        ('{"a" 1}', {"a": 1}, ["missing colon"]),
        ('{"a": , "b": 2}', {"a": None, "b": 2}, ["missing value"]),
        ('{"a": "say "yes" now", "b": 1}', {"a": 'say "yes" now', "b": 1}, ["quote inside a string"]),
        ('{"a": "one\ntwo"}', {"a": "one\ntwo"}, ["line end inside a string"]),
        ('{"a": "open', {"a": "open"}, ["string left open", "bracket left open"]),
        ('{"a": 1, // note\n "b": /* x */ 2}', {"a": 1, "b": 2}, ["comment"]),
        ('so: {"a": 1} end', {"a": 1}, ["words before", "words behind"]),
        ('{"a": plain words here, "b": 007}', {"a": "plain words here", "b": "007"}, ["text without quotes"]),
        ("{“a”: “b”}", {"a": "b"}, ["other quotes"]),
        ('{"a": "\\q\\u00e9\\n"}', {"a": "qé\n"}, ["escape that is none"]),
        ("{", {}, ["bracket left open"]),
        ("[1]", None, []),
        ("none", None, []),
        ("", None, []),
        (None, None, []),
    ],
)
def test_each_damage(text, value, said):
    got, told = mended(text)
    if said is None:
        assert isinstance(json.loads(got), dict)
        return
    assert (None if got is None else json.loads(got), told) == (value, said)


def test_lists_only_where_allowed():
    assert mended("[1]") == (None, []) and mended("[1]", True) == ("[1]", []) and mended("[1, 2", True)[0] == "[1, 2]"
    assert json.loads(mended('[{"a": 1}]')[0]) == {"a": 1}
    deep = "[" * 30_000 + "]" * 29_990
    assert mended('{"a": ' + deep)[1] in ([], ["bracket left open"])


def plain(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice([True, False, None, 0, -3, 2.5, 10**9])
    if kind < 3:
        return "".join(rng.choices("abc xyzé_-", k=rng.randrange(8))).strip()
    if kind == 3:
        return [plain(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": plain(rng, depth + 1) for i in range(rng.randrange(4))}


def test_random_damage_is_undone():
    """Damage that loses nothing: commas dropped between parts, doubled and trailing ones, other quotes, closings cut off."""
    rng = random.Random(4)
    for _ in range(1500):
        value = {"a": plain(rng), "b": [plain(rng), plain(rng)], "z": {"last": plain(rng)}}
        text = json.dumps(value, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        for damage in rng.sample(range(4), rng.randrange(1, 4)):
            if damage == 0:
                text = text.replace(", ", ",, ", 1)
            elif damage == 1:
                text = text.replace('"', "'")
            elif damage == 2:
                text = text.rstrip("}] \n")
                if text.endswith("["):
                    text += "]"
            else:
                text = "Here it is:\n" + text
        got, said = mended(text)
        assert json.loads(got) == value or text.endswith(("{", "[")), (text, got, said)
    for _ in range(3000):
        text = json.dumps({"a": plain(rng), "b": plain(rng)})
        at = rng.randrange(len(text))
        damaged = text[:at] + rng.choice(["", ",", '"', "'", "}", "]", "[", "{", ":", "\\", "x"]) + text[at + rng.randrange(2) :]
        got, _ = mended(damaged)
        assert got is None or isinstance(json.loads(got), dict), damaged


def test_columns(spark):
    df = spark.createDataFrame([(1, '{"a": 1'), (2, "[1"), (3, None)], "i int, x string")
    got = {r["i"]: (r["o"]["json"], r["v"]["json"], r["o"]["mended"]) for r in df.select("i", mended_objects("x").alias("o"), mended_values("x").alias("v")).collect()}
    assert got == {1: ('{"a": 1}', '{"a": 1}', ["bracket left open"]), 2: (None, "[1]", []), 3: (None, None, [])}


def test_pages_by_places(spark, tmp_path, capsys):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit("x").alias("v"))
        held = placed(df, ["k"], f"file://{tmp_path}/places")
        assert len(held.before) == 9 and held.total == 1000
        for offset, limit in ((0, 1), (0, 200), (95, 30), (111, 1), (890, 150), (999, 5)):
            got = [(r["place"], r["k"], r["next_offset"], r["total_rows"]) for r in held.page(spark, offset, limit).collect()]
            more = offset + limit if offset + limit < 1000 else None
            assert got == [(i, i, more, 1000) for i in range(offset, min(offset + limit, 1000))]
        assert held.page(spark, 5000, 10).count() == 0
        page = held.page(spark, 300, 20)
        page.explain("formatted")
        plan = capsys.readouterr().out
        assert "PartitionFilters: [isnotnull(part_" in plan or "PartitionFilters: [(part_" in plan or "PartitionFilters: [part_" in plan
        assert "place_" in plan.split("PushedFilters")[1] and page.rdd.getNumPartitions() <= 9
        with pytest.raises(ValueError):
            held.page(spark, -1)
        assert placed(df.limit(0), ["k"], f"file://{tmp_path}/none").page(spark, 0, 5).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
