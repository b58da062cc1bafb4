"""Configurations as tables: what makes them unfit, task codes, and the materials that a manifest allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import numeric
from tallyloom.functions.text import clean_path
from tallyloom.operators.relate import violations

# Fixed value: categories of files that questions may be asked of.
CATEGORIES = ("question", "rubric", "sources", "deliveries")


def subject_violations(subjects: DataFrame, most: int = 3) -> DataFrame:
    """(entity, key, rule) of configurations' subjects (config, id, prefix): one to ``most``, ids and prefixes unique, case aside."""
    sized = subjects.groupBy("config").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct(F.lower("prefix")).alias("prefixes"))
    return violations(sized, "config", F.col("config"), {"number of subjects": ~F.col("n").between(1, most), "repeated id": F.col("ids") < F.col("n"), "repeated prefix": F.col("prefixes") < F.col("n")})


def is_temperature(c: Column) -> Column:
    """A finite number from 0 to 2; words, true and false are none."""
    return F.coalesce(numeric(c).between(0, 2), F.lit(False))


def task_codes(tasks: DataFrame, aliases: DataFrame) -> DataFrame:
    """(task, codes): a task's own id and the labels mapped to it, sorted. ``aliases``: label, task."""
    named = tasks.select("task", F.col("task").alias("code")).unionByName(aliases.select("task", F.col("label").alias("code")).join(tasks.select("task"), "task", "left_semi"))
    return named.groupBy("task").agg(F.array_sort(F.collect_set(F.col("code").cast("string"))).alias("codes"))


def allowed(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Requests (file) for materials that the manifest (file, category) lists, by paths that stay below its folder."""
    known = manifest.where(F.col("category").isin(*CATEGORIES)).select("file").distinct()
    return requests.where(clean_path(F.col("file")).isNotNull()).join(known, "file", "left_semi")
