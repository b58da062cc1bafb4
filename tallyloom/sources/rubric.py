"""Rubrics in Markdown as tables of atoms and error rules: one pass of ordered windows over the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import stripped, table_cells

# Metrics in the order of their sections, and the labels that ceilings name them by.
METRICS = ["completion", "coverage", "accuracy", "format", "structure", "hallucination"]
LABELS = ["任务完成率", "内容覆盖度", "准确率·忠实度", "格式合规度", "结构完整度", "幻觉／自洽性"]
# The formats of section headings, table rows, kinds and ceilings.
SECTION_COMPLETION, SECTION_QUALITY, SECTION_ERRORS, SECTION_OTHER = r"^## 6\.", r"^### 7\.([1-5])", r"^## 8\.", r"^## [79]\."
ATOM_ID, ERROR_ID, KIND = r"^[TCAFSH]\d+$", r"^E\d+$", r"\*\*(BIN|RATIO|COUNT|CLAIM-RATIO)\*\*"
NO_CAP, CAP = r"^\s*(.+?)：(?:无额外上限|无上限|不另设上限)\s*$", r"^\s*(.+?)：上限\s*([\d.]+)"
SCOPE, RESTRICTED = r"^\s*原子\s+[A-Z]\d+(?:\s*[、,，]\s*[A-Z]\d+)*\s*$", "封顶范围仅限|未列入本条封顶范围"


def rubric_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of Markdown files, whole files read so that lines keep their order; a byte order mark goes."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def _rows(lines: DataFrame) -> DataFrame:
    section = (
        F.when(F.col("line").rlike(SECTION_COMPLETION), F.lit("completion"))
        .when(F.col("line").rlike(SECTION_QUALITY), F.element_at(F.array(*(F.lit(m) for m in METRICS[1:])), F.regexp_extract("line", SECTION_QUALITY, 1).try_cast("int")))
        .when(F.col("line").rlike(SECTION_ERRORS), F.lit("errors"))
        .when(F.col("line").rlike(SECTION_OTHER), F.lit("none"))
    )
    carried = F.last(section, ignorenulls=True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("section", carried).where(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|\s*---"))
    # Exploded, so that conditions on cells are tried on what is made here once, and not pushed below it.
    return rows.select("*", F.explode(F.array(table_cells(F.col("line")))).alias("c"))


def atoms(lines: DataFrame) -> DataFrame:
    """Atoms of the metric sections: id, metric, layer, weight, purpose, rule, evidence, provenance, kind, pos."""
    rows = _rows(lines).where((F.size("c") >= 7) & F.col("c")[0].rlike(ATOM_ID) & F.col("section").isin(*METRICS))
    cell = lambda i: F.col("c")[i]
    return rows.select("file", "pos", "section", "c").select(
        "file", "pos", cell(0).alias("id"), F.col("section").alias("metric"), cell(1).alias("layer"), cell(2).try_cast("decimal(9,4)").alias("weight"), cell(3).alias("purpose"), cell(4).alias("rule"),
        cell(5).alias("evidence"), cell(6).alias("provenance"), F.nullif(F.regexp_extract(cell(4), KIND, 1), F.lit("")).alias("kind"),
    )


def rules(lines: DataFrame) -> DataFrame:
    """Error rules, with or without ceilings: file, id, trigger, effects."""
    rows = _rows(lines).where((F.col("section") == "errors") & (F.size("c") >= 3) & F.col("c")[0].rlike(ERROR_ID))
    return rows.select("file", F.col("c")[0].alias("id"), F.col("c")[1].alias("trigger"), F.col("c")[2].alias("effects"))


def _parts(lines: DataFrame) -> DataFrame:
    """Parts of each rule's effects in order: what they are (cap, open or scope), their label, metric, cap and atoms.

    ``of`` is the metric and ceiling that the part belongs to: those of the last part that names a label, none after a
    part that sets no ceiling.
    """
    named = F.create_map(*(F.lit(x) for kv in zip(LABELS, METRICS, strict=True) for x in kv))
    part = rules(lines).select("file", "id", "trigger", "effects", F.posexplode(F.split("effects", "[；;]")).alias("part", "text"))
    part = part.withColumn("open_", stripped(F.regexp_extract("text", NO_CAP, 1))).withColumn("cap_", stripped(F.regexp_extract("text", CAP, 1)))
    part = part.withColumn("kind", F.when(F.col("open_") != "", "open").when(F.col("cap_") != "", "cap").when(F.col("text").rlike(SCOPE), "scope"))
    part = part.withColumn("metric", F.try_element_at(named, F.coalesce(F.nullif("open_", F.lit("")), F.nullif("cap_", F.lit("")), F.lit(""))))
    part = part.withColumn("cap", F.when(F.col("kind") == "cap", F.regexp_extract("text", CAP, 2).try_cast("decimal(9,4)")))
    atoms_ = F.when((F.col("kind") == "scope") & F.col("trigger").rlike(RESTRICTED), F.regexp_extract_all("text", F.lit(r"[A-Z]\d+"), F.lit(0)))
    upto = Window.partitionBy("file", "id", "trigger", "effects").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    of = F.last(F.when(F.col("kind").isin("open", "cap"), F.struct(F.when(F.col("kind") == "cap", F.col("metric")).alias("metric"), "cap")), ignorenulls=True)
    return part.withColumn("atoms", atoms_).withColumn("of", of.over(upto)).drop("open_", "cap_")


def error_rules(lines: DataFrame) -> DataFrame:
    """One row per metric that a rule speaks of: file, id, trigger, metric, cap (null: none set), scope (atoms it is held to).

    Where a rule names a metric twice the last ceiling counts, and of scopes the last.
    """
    part = _parts(lines)
    # Each part as what it says of its own metric and of the one it belongs to: one pass for ceilings and scopes.
    cap = F.when(F.col("kind").isin("cap", "open"), F.struct("part", "cap"))
    scope = F.when(F.col("atoms").isNotNull(), F.struct("part", "atoms"))
    own = F.struct(F.col("metric"), cap.alias("cap_"), F.lit(None).cast("struct<part: int, atoms: array<string>>").alias("scope_"))
    upper = F.struct(F.col("of.metric").alias("metric"), F.lit(None).cast("struct<part: int, cap: decimal(9,4)>").alias("cap_"), scope.alias("scope_"))
    said = part.select("file", "id", "trigger", F.explode(F.array(own, upper)).alias("s")).select("file", "id", "trigger", "s.*").where("metric is not null")
    found = said.groupBy("file", "id", "trigger", "metric").agg(F.max("cap_").alias("cap_"), F.max("scope_").alias("scope_"))
    last = F.max("scope_").over(Window.partitionBy("file", "id", "metric"))
    rows = found.withColumn("scope_", last).where("cap_ is not null")
    return rows.select("file", "id", "trigger", "metric", F.col("cap_.cap").alias("cap"), F.coalesce("scope_.atoms", F.array().cast("array<string>")).alias("scope"))


def rubric_violations(atom_rows: DataFrame) -> DataFrame:
    """(file, rule, detail) of atoms: metrics missing, ids repeated, weights that don't sum to 100, kinds missing."""
    sums = atom_rows.groupBy("file", "metric").agg(F.sum("weight").alias("total")).where("total is null or total <> 100").select("file", F.lit("weight").alias("rule"), "metric")
    twice = atom_rows.groupBy("file", "id").agg(F.count("*").alias("n")).where("n > 1").select("file", F.lit("repeated id"), F.col("id").cast("string"))
    kind = atom_rows.where("kind is null").select("file", F.lit("kind"), F.col("id").cast("string"))
    there = atom_rows.groupBy("file").agg(F.collect_set("metric").alias("m")).select("file", F.lit("missing metric"), F.explode(F.array_except(F.array(*(F.lit(m) for m in METRICS)), "m")))
    return sums.union(twice).union(kind).union(there).toDF("file", "rule", "detail")


def ceiling_violations(lines: DataFrame) -> DataFrame:
    """(file, rule, detail) of error rules: texts whose ceilings can't all be read, unknown metrics, scopes of other atoms."""
    part = _parts(lines)
    read_ = part.groupBy("file", "id", "effects").agg(
        F.collect_set(F.when((F.col("kind") == "cap") & F.col("cap").isNotNull(), F.col("metric"))).alias("caps"),
        F.collect_set(F.when(F.col("kind") == "open", F.col("metric"))).alias("opens"),
    )
    named = F.size(F.regexp_extract_all("effects", F.lit("上限"), F.lit(0)))
    unread = read_.where((named != F.size("caps") + F.size("opens")) | F.arrays_overlap("caps", "opens")).select("file", F.lit("unread ceiling").alias("rule"), "id")
    unknown = part.where("kind = 'open' and metric is null").select("file", F.lit("unknown metric"), "id")
    held = error_rules(lines).select("file", "id", "metric", F.explode("scope").alias("atom"))
    known = atoms(lines).select("file", "metric", F.col("id").alias("atom")).distinct()
    stray = held.join(known, ["file", "metric", "atom"], "left_anti").select("file", F.lit("scope"), F.concat_ws(" ", "id", "atom"))
    return unread.union(unknown).union(stray).distinct().toDF("file", "rule", "detail")


def all_violations(lines: DataFrame) -> DataFrame:
    """Everything that makes a rubric unfit, files without any atom included."""
    found = atoms(lines)
    none = lines.select("file").distinct().join(found.select("file").distinct(), "file", "left_anti").select("file", F.lit("no atoms").alias("rule"), F.lit("").alias("detail"))
    return rubric_violations(found).unionByName(ceiling_violations(lines)).unionByName(none)
