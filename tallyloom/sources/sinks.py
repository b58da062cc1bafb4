"""Sinks: result tables, logs, ledgers and Markdown reports, made from DataFrames and written by Spark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import display
from tallyloom.functions.text import markdown_safe
from tallyloom.operators.ordered import chunks


def write_results(results: DataFrame, path: str, fresh: bool = True) -> None:
    """Result documents by task and subject, as JSON; a run replaces the results of a former one."""
    results.write.mode("overwrite" if fresh else "errorifexists").partitionBy("task", "subject").json(path)


def write_changed(results: DataFrame, path: str) -> bool:
    """Result documents, written only if what is there differs; whether they were."""
    spark = results.sparkSession
    try:
        held = spark.read.schema(results.schema).json(path).select(results.columns)
        if results.exceptAll(held).isEmpty() and held.exceptAll(results).isEmpty():
            return False
    except AnalysisException:  # nothing there yet
        pass
    write_results(results, path)
    return True


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def unused_path(path: str, taken: set[str]) -> str:
    """``path``, or with the first number after its stem that isn't taken."""
    stem, dot, suffix = path.rpartition(".") if "." in path.rsplit("/", 1)[-1] else (path, "", "")
    n, name = 2, path
    while name in taken:
        name = f"{stem}-{n}{dot}{suffix}" if dot else f"{path}-{n}"
        n += 1
    return name


def score_lines(scores: DataFrame) -> DataFrame:
    """Markdown rows of a score table: task, pos, line; one row per metric with a cell per subject, in order."""
    cells = scores.groupBy("task", "metric", "metric_pos").agg(F.array_sort(F.collect_list(F.struct("subject_pos", display(F.col("final")).alias("shown")))).alias("c"))
    line = F.concat(F.lit("| "), markdown_safe(F.col("metric")), F.lit(" | "), F.array_join(F.transform("c", lambda x: x["shown"]), " | "), F.lit(" |"))
    return cells.select("task", F.col("metric_pos").alias("pos"), line.alias("line"))


def task_markdown(lines: DataFrame) -> DataFrame:
    """Documents from lines (task, section, pos, line): one row per task with its whole text, sections in order."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "pos", "line")))
    return lines.groupBy("task").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def chart_ledger(values: DataFrame, keys: list[str], order: list[str], rows: int = 15) -> DataFrame:
    """Chart data in pages of ``rows``, with the offset of each page's first row."""
    return chunks(values, rows, keys, order).withColumn("offset", F.col("chunk") * rows)
