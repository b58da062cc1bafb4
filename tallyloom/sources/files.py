"""Directory layouts, process records and event logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.repair import mended_objects, mended_values
from tallyloom.functions.text import stripped

NUMERALS = "一二三四五六七八九十"


def numeral(c: Column) -> Column:
    """A number from digits or a Chinese numeral up to ten."""
    return F.coalesce(c.try_cast("int"), F.nullif(F.position(c, F.lit(NUMERALS)), F.lit(0)))


def discover(files: DataFrame, dimension: str = r"([一二三四五六七八九十\d]+)[、.．-]?([^/]*)", task: str = r"(\d+)[、.．-]?([^/]*)") -> DataFrame:
    """(path, dimension, dimension_name, question, task_name, task, rest) of files two levels below a root.

    ``files`` has ``path`` relative to the root. Temporary files (``~$``) go; order is by dimension, then question.
    """
    pattern = rf"^{dimension}/{task}/(.+)$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    rows = files.where(F.col("path").rlike(pattern) & ~F.element_at(F.split("path", "/"), -1).startswith("~$"))
    rows = rows.select("path", numeral(part(1)).alias("dimension"), part(2).alias("dimension_name"), part(3).cast("int").alias("question"), part(4).alias("task_name"), part(5).alias("rest"))
    return rows.withColumn("task", F.concat_ws(".", "dimension", "question"))


def process_records(cells: DataFrame, columns: dict[str, str], first_row: int, last_row: int, labels: DataFrame) -> DataFrame:
    """Records of a sheet range: task_label, task, runtime, status, row. ``columns`` names letters; ``labels`` maps label to task.

    Rows without any value are dropped; a label of the form d.n is its own task.
    """
    from tallyloom.sources.office import column_number

    part = cells.where(F.col("row").between(first_row, last_row))
    pick = [F.max(F.when(F.col("col") == column_number(letter), F.col("value"))).alias(name) for name, letter in columns.items()]
    rows = part.groupBy("row").agg(*pick).where(F.coalesce(*columns).isNotNull())
    named = labels.select(F.col("label").alias("task_label"), F.col("task").alias("mapped"))
    return rows.join(named, "task_label", "left").withColumn("task", F.coalesce("mapped", F.nullif(F.regexp_extract("task_label", r"^\d+\.\d+$", 0), F.lit("")))).drop("mapped")


def repeated_tasks(records: DataFrame) -> DataFrame:
    return records.where("task is not null and (runtime is not null or status is not null)").groupBy("task").agg(F.count("*").alias("n")).where("n > 1")


def event_lines(lines: DataFrame) -> DataFrame:
    """Events of JSON lines (file, pos, line): type, session, text, tool, status, error; broken lines are dropped."""
    event = F.try_parse_json("line")
    get = lambda path: F.try_variant_get(event, path, "string")
    return lines.where(event.isNotNull() & get("$.type").isNotNull()).select("file", "pos", get("$.type").alias("type"), F.coalesce(F.nullif(get("$.sessionID"), F.lit("")), get("$.part.sessionID")).alias("session"), get("$.part.text").alias("text"), get("$.part.tool").alias("tool"), get("$.part.state.status").alias("status"), get("$.error").alias("error"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return event_lines(text.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line")))


def log_summary(events: DataFrame) -> DataFrame:
    """Per file: texts in order, the last error, the last session, whether a read completed."""
    parts = F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("pos", "text"))))
    return events.groupBy("file").agg(
        stripped(F.array_join(F.transform(parts, lambda x: x["text"]), "\n")).alias("text"),
        F.max_by(F.left("error", F.lit(1000)), F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"),
        F.max_by("session", F.when(F.col("session").isNotNull(), F.col("pos"))).alias("session"),
        F.coalesce(F.bool_or((F.col("tool") == "read") & (F.col("status") == "completed")), F.lit(False)).alias("used_read"),
    )


# The lines between which an answer's document stands.
BEGIN, END = "BEGIN_JUDGMENT", "END_JUDGMENT"


def block_text(c: Column) -> Column:
    """Where an answer's document stands: between marker lines, else between markers anywhere, else the whole text; without its code fence."""
    lines = F.nullif(F.regexp_extract(c, rf"(?ms)^[ \t]*{BEGIN}[ \t]*\r?\n(.*?)^[ \t]*{END}[ \t]*\r?$", 1), F.lit(""))
    anywhere = F.nullif(F.regexp_extract(c, rf"(?s){BEGIN}\s*(.*?)\s*{END}", 1), F.lit(""))
    return F.regexp_replace(stripped(F.coalesce(lines, anywhere, c)), r"(?i)^```(?:json)?\s*|\s*```$", "")


def json_block(c: Column, lists: bool = False) -> Column:
    """The JSON document of an answer, or null: an object, or a list too where ``lists`` allows one."""
    found = F.try_parse_json(block_text(c))
    kind = F.schema_of_variant(found)
    return F.when(kind.startswith("OBJECT") | (kind.startswith("ARRAY") if lists else F.lit(False)), found)


def mended_block(c: Column, lists: bool = False) -> Column:
    """json and mended of an answer whose document may be damaged: see ``functions.repair``."""
    return (mended_values if lists else mended_objects)(block_text(c))


def newest(files: DataFrame, keys: list[str], k: int) -> DataFrame:
    return files.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("modified_at"), "file"))).where(F.col("nth") <= k).drop("nth")
