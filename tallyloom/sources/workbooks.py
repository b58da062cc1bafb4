"""A data source for workbooks: ``spark.read.format("xlsx")``, a partition for each range of rows of each sheet.

Filters on sheet and row are pushed into the source: they choose the sheets and ranges that are read at all, and a task
stops at its last row. Paths are those of a file system that driver and executors mount alike; where only Spark's own
readers reach the files, ``office.read_cells`` reads the same cells, a workbook a task.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tallyloom.sources.office import Workbook, letters

CELLS = T.StructType([T.StructField(c, T.StringType()) for c in ("file", "sheet", "state")] + [T.StructField(c, T.LongType()) for c in ("row", "col")] + [T.StructField(c, T.StringType()) for c in ("kind", "value", "formula", "format")])
RANGE_ROWS = 50_000
BATCH_ROWS = 2000
ENDLESS = 1 << 62


def _local(path: str) -> list[str]:
    """Workbooks at a path, below a folder or by a pattern."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{parsed.scheme}: files are read by office.read_cells")
    path = unquote(parsed.path) if parsed.scheme else path
    if os.path.isdir(path):
        return sorted(glob.glob(f"{glob.escape(path)}/**/*.xlsx", recursive=True))
    return sorted(glob.glob(path)) or [path]


@lru_cache(maxsize=2)
def _book(path: str, changed: float) -> Workbook:
    """A workbook, kept for the ranges that one worker reads of it in a row."""
    with open(path, "rb") as f:
        return Workbook(f.read())


def book(path: str) -> Workbook:
    return _book(path, os.path.getmtime(path))


@dataclass
class Range(InputPartition):
    """Rows ``first`` to ``last`` of a sheet."""

    file: str
    sheet: str
    state: str
    first: int
    last: int


@dataclass(frozen=True)
class Bounds:
    """What options and pushed filters leave: rows between two, and named sheets (all if None)."""

    first: int = 1
    last: int = ENDLESS
    sheets: frozenset[str] | None = None

    def narrowed(self, f: Filter, row: str) -> Bounds | None:
        """The bounds with a filter in them; None if the filter says more than bounds can."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
        if name == row and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            above = {GreaterThan: f.value + 1, GreaterThanOrEqual: f.value, EqualTo: f.value}.get(type(f), self.first)
            below = {LessThan: f.value - 1, LessThanOrEqual: f.value, EqualTo: f.value}.get(type(f), self.last)
            return replace(self, first=max(self.first, above), last=min(self.last, below))
        if name == "sheet" and isinstance(f, (EqualTo, In)):
            named = frozenset(f.value if isinstance(f, In) else (f.value,))
            return replace(self, sheets=named if self.sheets is None else self.sheets & named)
        return None


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.rows = "col" not in schema.names
        self.header = int(options.get("header_row", 1))
        sheet = options.get("sheet")
        self.bounds = Bounds(int(options.get("first_row", 1)), int(options.get("last_row", ENDLESS)), frozenset([sheet]) if sheet else None)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            bounds = self.bounds.narrowed(f, "_row" if self.rows else "row")
            if bounds is None:
                yield f
            else:
                self.bounds = bounds

    def partitions(self) -> Sequence[Range]:
        out, step = [], int(self.options.get("range_rows", RANGE_ROWS))
        for file in _local(self.options["path"]):
            held = book(file)
            sheets = [s for s in held.sheets if self.bounds.sheets is None or s in self.bounds.sheets]
            if self.rows:
                sheets = [s for s in held.sheets if s == _chosen(held, self.options)][: 1 if self.bounds.sheets is None or sheets else 0]
            for sheet in sheets:
                first = max(self.bounds.first, self.header + 1 if self.rows else 1)
                last = min(self.bounds.last, held.extent(sheet)[0])
                out += [Range(file, sheet, held.sheets[sheet][1], a, min(a + step - 1, last)) for a in range(first, last + 1, step)]
        return out or [Range("", "", "", 1, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.last < partition.first:
            return
        cells = _between(book(partition.file), partition)
        yield from self._tables(cells, partition) if self.rows else self._cells(cells, partition)

    def _cells(self, cells: Iterator[tuple], at: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for cell in cells:
            held.append((at.file, at.sheet, at.state, *cell))
            if len(held) == BATCH_ROWS:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _tables(self, cells: Iterator[tuple], at: Range) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for row, col, _, value, *_ in cells:
            if value is None or col > len(self.schema) - 1:
                continue
            if not held or held[-1][0] != row:
                if len(held) == BATCH_ROWS:
                    yield self._batch(held)
                    held = []
                held.append([row, *[None] * (len(self.schema) - 1)])
            held[-1][col] = value
        if held:
            yield self._batch(held)

    def _batch(self, rows: list) -> pa.RecordBatch:
        kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in self.schema]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=self.schema.names)


def _between(held: Workbook, at: Range) -> Iterator[tuple]:
    for cell in held.cells(at.sheet):
        if cell[0] > at.last:
            return
        if cell[0] >= at.first:
            yield cell


def _chosen(held: Workbook, options: dict[str, str]) -> str:
    name = options.get("sheet") or next(iter(held.sheets))
    if name not in held.sheets:
        raise ValueError(f"no sheet {name!r}; there are {', '.join(held.sheets)}")
    return name


class WorkbookSource(DataSource):
    """Options: path (a workbook, a folder or a pattern), as "cells" (all sheets of all files) or "rows" (one sheet with a
    header), sheet, header_row, first_row, last_row, range_rows.

    Rows: _row, the sheet's own row number, then a text column for each header; one without a name is called by its
    letter, a repeated one by name and letter. Rows without any value don't come.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> T.StructType:
        if self.options.get("as", "rows") == "cells":
            return CELLS
        header = int(self.options.get("header_row", 1))
        if header < 1:
            raise ValueError("rows are counted from 1, the header's too")
        held = book(_local(self.options["path"])[0])
        sheet = _chosen(held, self.options)
        given = {c[1]: c[3] for c in _between(held, Range("", sheet, "", header, header))}
        names: list[str] = ["_row"]
        for col in range(1, max([held.extent(sheet)[1], *given], default=0) + 1):
            name = given.get(col) or letters(col)
            names.append(name if name not in names else f"{name}_{letters(col)}")
        return T.StructType([T.StructField("_row", T.LongType()), *(T.StructField(n, T.StringType()) for n in names[1:])])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``format("xlsx")`` known, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)

