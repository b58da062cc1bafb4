"""Configurations, and the files of a data set dealt out to those who delivered them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.relate import owners_by_prefix, violations
from tallyloom.sources.config import subject_violations

#: Prefixes that go into the plan as a literal; more of them meet the files by joins.
LITERAL = 4096
#: The files of a task that belong to nobody.
QUESTION, RUBRIC = "问题描述.txt", "rubric.md"
_CONFIG = "dataset string, subjects array<struct<id: string, name: string, prefix: string>>, dimensions array<string>, tasks array<string>, excluded_prefixes array<string>"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(config, dataset, subjects, dimensions, tasks, excluded_prefixes) of configurations as JSON, a file each; lists that aren't there are empty."""
    held = spark.read.schema(_CONFIG).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("config"), "*")
    kinds = {f.name: f.dataType for f in held.schema}
    lists = [c for c, kind in kinds.items() if isinstance(kind, T.ArrayType)]
    return held.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in lists})


def config_subjects(configs: DataFrame) -> DataFrame:
    """(config, pos, id, name, prefix)"""
    return configs.select("config", F.posexplode("subjects").alias("pos", "s")).select("config", "pos", "s.*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def config_violations(spark: SparkSession, configs: DataFrame) -> DataFrame:
    """(entity, key, rule): what makes configurations unfit, data sets that are no folder among it. A folder is asked for
    once for each configuration, by the driver, on whatever file system it lies."""
    none = configs.where(F.size("subjects") == 0)
    found = subject_violations(config_subjects(configs)).unionByName(violations(none, "config", F.col("config"), {"number of subjects": F.lit(True)}))
    asked = [(r["config"], bool(r["dataset"]) and _is_folder(spark, r["dataset"])) for r in configs.select("config", "dataset").collect()]
    there = spark.createDataFrame(asked, "config string, there boolean")
    return found.unionByName(violations(there, "config", F.col("config"), {"no data set": ~F.col("there")}))


def _lengths(prefixes: list[str]) -> list[int]:
    return sorted({len(p) for p in prefixes})


def _held(texts: list[Column], owners: dict[str, list[str]]) -> Column:
    """All owners of prefixes with which any of the texts begins."""
    none = F.array().cast("array<string>")
    if not owners:
        return none
    table = F.create_map(*(x for p, ids in owners.items() for x in (F.lit(p), F.array(*map(F.lit, ids)))))
    return F.array_distinct(F.concat(none, *(F.coalesce(F.try_element_at(table, F.left(F.lower(t), F.lit(n))), none) for t in texts for n in _lengths([*owners]))))


def owned(files: DataFrame, subjects: DataFrame, excluded: list[str] = (), question: str = QUESTION, rubric: str = RUBRIC) -> DataFrame:
    """Files (path, relative to their task's folder) that are deliveries or sources, with matches and owner.

    A subject's prefix may begin the file's name or the first part of its path, case aside. The owner is the one subject
    that matches, ``source`` without any, null with more. Question, rubric, temporary files and those with an excluded
    prefix, in either place, go.
    """
    name, first = F.element_at(F.split("path", "/"), -1), F.split("path", "/")[0]
    barred = [F.lower(x).startswith(p.lower()) for x in (name, first) for p in excluded]
    kept = files.where(~F.col("path").isin(question, rubric) & ~name.startswith("~$"))
    for b in barred:
        kept = kept.where(~b)
    held = subjects.groupBy(F.lower("prefix").alias("prefix")).agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("ids")).limit(LITERAL + 1).collect()
    if len(held) <= LITERAL:
        ids = _held([name, first], {r["prefix"]: r["ids"] for r in held})
        rows = kept.withColumn("ids_", ids)
    else:
        # Where the two places agree on a subject it counts once; different ones make the file ambiguous.
        rows = owners_by_prefix(owners_by_prefix(kept.withColumn("name_", name).withColumn("first_", first), subjects, "name_").withColumnsRenamed({"matches": "m1_", "owner": "o1_"}), subjects, "first_")
        pick = lambda m, o: F.when(F.col(m) == 1, F.array(F.col(o).cast("string"))).when(F.col(m) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(""), F.lit("?")))
        rows = rows.withColumn("ids_", F.array_union(pick("m1_", "o1_"), pick("matches", "owner"))).drop("name_", "first_", "m1_", "o1_", "matches", "owner")
    return rows.withColumn("matches", F.size("ids_").cast("long")).withColumn("owner", F.when(F.col("matches") == 0, "source").when(F.col("matches") == 1, F.col("ids_")[0])).drop("ids_")


def delivery_violations(files: DataFrame, owned_files: DataFrame, subjects: DataFrame, question: str = QUESTION, rubric: str = RUBRIC) -> DataFrame:
    """(entity, key, rule): tasks (task, path) without question or rubric, files of several subjects, and (task, subject)
    pairs without a delivery."""
    tasks = files.groupBy("task").agg(F.max(F.col("path") == question).alias("q"), F.max(F.col("path") == rubric).alias("r"))
    found = violations(tasks, "task", F.col("task"), {"no question": ~F.col("q"), "no rubric": ~F.col("r")})
    several = violations(owned_files, "file", F.concat_ws("/", "task", "path"), {"several subjects": F.col("matches") > 1})
    had = owned_files.where("matches = 1").groupBy("task").agg(F.collect_set("owner").alias("had"))
    # Subjects are few by rule: they go to every task as one array, made from one row.
    names = subjects.agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("names"))
    grid = tasks.join(F.broadcast(names)).join(had, "task", "left")
    due = grid.select("task", F.explode(F.array_except("names", F.coalesce("had", F.array().cast("array<string>")))).alias("subject"))
    return found.unionByName(several).unionByName(due.select(F.lit("task").alias("entity"), F.concat_ws("/", "task", "subject").alias("key"), F.lit("no delivery").alias("rule")))


def task_order(task: Column, dimensions: list[str] = ()) -> list[Column]:
    """Sort columns of tasks d.n: dimensions in the order in which a configuration names them (by their number), others by it."""
    part = lambda i: F.split(task, r"\.").getItem(i).cast("long")
    order = {int(m[0]): i for i, d in enumerate(dimensions) if (m := re.search(r"\d+", d))}
    place = F.create_map(*(F.lit(x).cast("long") for pair in order.items() for x in pair)) if order else None
    return [F.coalesce(F.try_element_at(place, part(0)), part(0)) if place is not None else part(0), part(1)]
