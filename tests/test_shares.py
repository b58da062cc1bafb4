"""Shuffles of large tables are dealt over as many partitions as the tables' splits ask for."""

import re

import pytest

from tallyloom.plans import registry

D = "/root/testdata/sf0.01"


@pytest.fixture
def small_splits(spark):
    # Tables this small would all be broadcast.
    wanted = {"spark.sql.files.maxPartitionBytes": "32k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wanted}
    for conf in (wanted, before):
        for k, v in conf.items():
            spark.conf.set(k, v)
        if conf is wanted:
            yield


@pytest.mark.parametrize("name", ["decision_problems", "affected_findings", "first_losses", "topk_losses", "weakest_atoms", "quality_mean", "weighted_rollup", "dim_mean_vs_global_mean"])
def test_shuffles_grow_with_the_table(spark, small_splits, capsys, name):
    splits = spark.read.parquet(f"{D}/lineitem.parquet").rdd.getNumPartitions()
    registry.queries()[name](spark, D).explain()
    found = re.findall(r"hashpartitioning\(([^()]*), (\d+)\)", capsys.readouterr().out)
    # What comes together at the end for each rule, dimension or metric is a few rows of each task.
    large = [int(n) for keys, n in found if not re.fullmatch(r"(?:(?:rule|dimension|metric|spark_grouping_id)#\d+L?(?:, )?)+", keys)]
    assert splits > 8 and large and min(large) >= splits
