"""Questions about the materials of a workspace: a request names a file that the manifest allows, and becomes a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.items import json_page
from tallyloom.functions.text import html_evidence, text_page
from tallyloom.operators.inspect import inspect
from tallyloom.sources import office
from tallyloom.sources.config import allowed

# Fixed value: suffixes of materials that text questions may be asked of.
TEXT = (".txt", ".md", ".json", ".csv", ".html", ".css", ".js", ".ts", ".py", ".go", ".sql", ".yaml", ".yml", ".toml", ".xml", ".sh", ".ps1")

# What is said of a script that holds no JSON.
NO_JSON = ": holds no JSON that can be read"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(file, category) of a workspace's manifest."""
    return spark.read.json(f"{root}/manifest.json", multiLine=True).select(F.explode("files").alias("f")).select("f.file", "f.category")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))


def ask(spark: SparkSession, root: str, request: dict) -> DataFrame:
    """The answer to a request: file, operation (summary, rows, stats, correlation, group, duplicates, cells, json, text, xml,
    package) and what the operation takes (sheet, header_row, range, columns, x, y, group_by, filters, path, part, offset, limit)."""
    name, operation = request["file"], request.get("operation", "summary")
    if allowed(spark.createDataFrame([(name,)], "file string"), manifest(spark, root)).isEmpty():
        raise ValueError("the file is no material of this workspace")
    path, suffix = f"{root}/{name}", "." + name.rsplit(".", 1)[-1].lower()
    offset = int(request.get("offset", 0))
    if operation == "json":
        if suffix != ".json":
            raise ValueError("json questions need a .json material")
        return _whole(spark, path).select(json_page(F.col("value"), request.get("path", []), offset, int(request.get("limit", 25))).alias("p")).select("p.*")
    if operation == "text":
        if suffix not in TEXT:
            raise ValueError("text questions need a text material")
        return _whole(spark, path).select(text_page(F.col("value"), offset, int(request.get("limit", 8000))).alias("p")).select("p.*")
    if operation == "xml":
        return office.xml_page(spark, path, request["part"], offset, int(request.get("limit", 200)))
    if operation == "package" or suffix in (".docx", ".pptx"):
        return office.package_features(spark, path)
    if suffix != ".xlsx":
        raise ValueError("questions about tables need an .xlsx material")
    cells = office.read_cells(spark, path)
    if operation == "summary" and "sheet" not in request:
        return office.sheets(spark, path).drop("place")
    title = request.get("sheet") or office.first_sheet(spark, path)
    cells = cells.where(F.col("sheet") == title)
    if operation == "cells":
        found = office.cell_range(cells, request.get("range", "A1:J20"))
        return found.select("row", "col", F.coalesce("formula", "value").alias("value_or_formula"), "format")
    sheet = office.worksheet(cells, int(request.get("header_row", 1)))
    return inspect(sheet, request, ["_row"], [c for c in sheet.columns if c != "_row"])


def evidence(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """(keys, kind, locator, text, target, limitation) of links and JSON scripts of pages; a script that is no JSON is a limitation.

    An inventory, not a finding: empty values stay as they are.
    """
    e = F.col("e")
    rows = pages.select(*keys, F.explode(html_evidence(F.col(html_col))).alias("e"))
    broken = (e["kind"] == "data") & F.try_parse_json(e["text"]).isNull()
    return rows.select(*keys, "e.kind", "e.locator", F.when(~broken, e["text"]).alias("text"), "e.target", F.when(broken, F.concat(e["locator"], F.lit(NO_JSON))).alias("limitation"))
