"""Texts go through Python a few at a time, and only where they must."""

import html

import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.functions.text import SPACES, plain, slices


def test_plain_is_pythons_form(spark):
    texts = [None, "", "a b", f"&amp;{SPACES}x&nbsp;y &lt", f"{SPACES}a\u200b\x1bb{SPACES}", "&#32;&", "zß 水\u3000\U0001f600"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(plain(F.col("t"))).collect()]
    assert got == [None if x is None else "".join(html.unescape(x).split()) for x in texts]


def test_plain_sends_python_no_text_without_a_reference(spark):
    text = spark.range(1).select(F.lit("a b").alias("t")).select(plain(F.col("t")))._jdf.queryExecution().toString()
    assert "&" in text and "CASE WHEN" in text


def test_slices_hold_few_rows():
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(slices([batch], 256))
    assert [p.num_rows for p in parts] == [256, 256, 256, 232] and [x for p in parts for x in p.column("x").to_pylist()] == list(range(1000))
