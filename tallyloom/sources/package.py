"""Office packages as graphs: parts are nodes, the entries of their relationship parts edges.

Everything that a package shows hangs on its root by such edges; what no edge leads to is an orphan. Order is the order in
which the owning part lists its relationship ids, as slides of a presentation and sheets of a workbook are.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.relate import closure
from tallyloom.operators.scans import Write

#: Kinds of parts that a reader sees as pages of their own.
PAGES = ("slide", "worksheet", "chartsheet", "officeDocument")


def local(tag: str) -> str:
    """A tag or attribute without its namespace."""
    return tag.rpartition("}")[2]


@dataclass(frozen=True)
class Edge:
    """A relationship: its id in the source part ("" is the package), the last word of its type, and the part it leads to."""

    source: str
    id: str
    kind: str
    target: str
    external: bool = False
    place: int | None = field(default=None, compare=False)


class Package:
    """A package's parts and relationships; parts are read when they are asked for."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.parts = sorted(n for n in self.zip.namelist() if not n.endswith("/"))

    def tree(self, part: str) -> ET.Element:
        return ET.fromstring(self.zip.read(part))

    def _listed(self, part: str) -> dict[str, int]:
        """Relationship ids in the order in which a part's own text names them."""
        if part not in self.parts or not part.endswith(".xml"):
            return {}
        ids = [v for e in self.tree(part).iter() for k, v in e.attrib.items() if k.startswith("{") and local(k) in ("id", "embed", "link")]
        return {v: n for n, v in enumerate(dict.fromkeys(ids), 1)}

    @cached_property
    def edges(self) -> list[Edge]:
        out = []
        for name in self.parts:
            folder, file = posixpath.split(name)
            if not folder.endswith("_rels") or not file.endswith(".rels"):
                continue
            base = posixpath.dirname(folder)
            source = posixpath.join(base, file.removesuffix(".rels")) if file != ".rels" else ""
            places = self._listed(source)
            for r in self.tree(name):
                outside, target = r.get("TargetMode") == "External", r.get("Target") or ""
                target = target if outside else posixpath.normpath(posixpath.join("/" + base, target.partition("#")[0])).lstrip("/")
                out.append(Edge(source, r.get("Id") or "", (r.get("Type") or "").rpartition("/")[2], target, outside, places.get(r.get("Id") or "")))
        return sorted(out, key=lambda e: (e.source, e.place is None, e.place or 0, e.id))

    def out_of(self, source: str, kind: str) -> list[Edge]:
        """A part's relationships of one kind, in its own order."""
        return [e for e in self.edges if e.source == source and e.kind == kind]

    @cached_property
    def document(self) -> str:
        """The part that holds the document itself."""
        found = self.out_of("", "officeDocument")
        return found[0].target if found else next((p for p in ("word/document.xml", "ppt/presentation.xml", "xl/workbook.xml") if p in self.parts), "")

    def pages(self, kind: str) -> list[str]:
        """Slides or sheets in the order shown; parts that only lie in the package aren't among them."""
        return [e.target for e in self.out_of(self.document, kind) if e.place is not None and e.target in self.parts]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,pptx,xlsx}").load(path).select(F.col("path").alias("file"), "content")


def parts_and_edges(spark: SparkSession, path: str, write: Write) -> tuple[DataFrame, DataFrame]:
    """(file, part) and (file, source, id, kind, target, external, place) of all office packages below a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["file"], frame["content"], strict=True):
                try:
                    package = Package(data)
                    rows = [(name, p, None, None, None, None, None, None) for p in package.parts] + [(name, None, e.source, e.id, e.kind, e.target, e.external, e.place) for e in package.edges]
                except (zipfile.BadZipFile, ET.ParseError):
                    rows = []  # no package: it has neither parts nor edges
                yield pd.DataFrame(rows, columns=["file", "part", "source", "id", "kind", "target", "external", "place"]).astype({"place": "Int64", "external": "boolean"})

    both = write(_files(spark, path).mapInPandas(run, "file string, part string, source string, id string, kind string, target string, external boolean, place long"))
    return both.where("part is not null").select("file", "part"), both.where("part is null").drop("part")


def _node(file: Column, part: Column) -> Column:
    return F.concat(file, F.lit("\n"), part)


def reached(spark: SparkSession, edges: DataFrame, write: Write, starts: DataFrame | None = None) -> DataFrame:
    """(file, start, part): the parts that each start (file, start; the package's root if none are given) leads to.

    Only pairs found in the last round are extended. Edges between pages, as from a slide to another, aren't followed.
    """
    inner = edges.where(~F.col("external") & (F.col("target") != F.col("source"))).select("file", "source", "target", "kind")
    if starts is not None:
        # Up to a page's own parts, and not on to other pages or what all share.
        inner = inner.where(~F.col("kind").isin(*PAGES, "slideLayout", "slideMaster", "theme", "notesMaster", "styles", "sharedStrings"))
    steps = inner.select(_node(F.col("file"), F.col("source")).alias("start"), _node(F.col("file"), F.col("target")).alias("node"))
    found = closure(spark, steps, write)
    wanted = edges.select("file", F.lit("").alias("start")).distinct() if starts is None else starts.select("file", "start").distinct()
    wanted = wanted.withColumn("key_", _node(F.col("file"), F.col("start")))
    return wanted.join(found.withColumnRenamed("start", "key_"), "key_").select("file", "start", F.substring_index("node", "\n", -1).alias("part"))


def orphans(spark: SparkSession, parts: DataFrame, edges: DataFrame, write: Write) -> DataFrame:
    """(file, part) that no chain of relationships leads to from the package's root."""
    known = parts.where(~F.col("part").endswith(".rels") & (F.col("part") != "[Content_Types].xml"))
    return known.join(reached(spark, edges, write).select("file", "part"), ["file", "part"], "left_anti")


def shown_parts(spark: SparkSession, edges: DataFrame, write: Write, kind: str = "chart") -> DataFrame:
    """(file, part, page, page_kind, place): each chart (or part of another kind) with the slides or sheets that show it."""
    pages = edges.where(F.col("kind").isin("slide", "worksheet", "chartsheet") & F.col("place").isNotNull())
    pages = pages.select("file", F.col("target").alias("start"), F.col("kind").alias("page_kind"), "place").distinct()
    targets = edges.where((F.col("kind") == kind) & ~F.col("external")).select("file", F.col("target").alias("part")).distinct()
    led = reached(spark, edges, write, pages).join(targets, ["file", "part"])
    out = targets.join(led, ["file", "part"], "left").join(pages, ["file", "start"], "left")
    return out.select("file", "part", F.col("start").alias("page"), "page_kind", "place").distinct()
