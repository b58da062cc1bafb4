"""How often queries read their tables and make their texts."""

from pyspark.sql import functions as F

from tallyloom.operators import frequent, relate
from tallyloom.plans import registry

D = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return registry.queries()[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()


def test_review_problems_groups_lines_once(spark):
    text = plan(spark, "review_problems")
    assert "min(l_tax" not in text and text.count("Window [count(1)") >= 2


def test_loss_briefs_judges_an_item_once(spark):
    assert plan(spark, "loss_briefs").count("get_json_object") < 60


def test_witness_outcomes_reads_lines_once(spark):
    assert plan(spark, "witness_outcomes").count("parquet") == 1


def test_rubric_ceilings_reads_rules_once_for_ceilings_and_scopes(spark):
    assert plan(spark, "rubric_ceilings").count("parquet") == 2


def test_closure_of_a_chain_doubles_its_steps(spark):
    written = []
    edges = spark.createDataFrame([(i, i + 1) for i in range(16)] + [(20, 21), (21, 20)], "start int, node int")
    got = relate.closure(spark, edges, lambda df: written.append(df) or df.localCheckpoint())
    want = {(a, b) for a in range(16) for b in range(a + 1, 17)} | {(a, b) for a in (20, 21) for b in (20, 21)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(written) <= 12


def test_frequent_values_of_an_unproven_column_are_counted_without_their_places(spark):
    written = []
    df = spark.range(300).select(F.col("id").alias("i"), F.when(F.col("id") < 290, F.col("id")).otherwise(7).alias("x"))
    got = frequent.frequent_values(spark, df, ["x"], ["i"], lambda x: written.append(x.columns) or x.localCheckpoint(), k=2, kept=8)
    assert [tuple(r)[1:] for r in got.orderBy("place").collect()] == [(1, "7", 11, False), (2, "0", 1, False)]
    assert ["value", "n"] in written
