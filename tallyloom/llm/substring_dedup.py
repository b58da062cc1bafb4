"""Substring dedup by sliding sentence spans: every run of several consecutive sentences is hashed and joined globally."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import by_bytes, stored, table, unused
from tallyloom.llm.hashing import mix64

RUN = 2
MIN_CHARS = 100
LONG_SENTENCE = 90
SLICE_BYTES = 4 << 20
_END = re.compile(r"\n\s*|(?<=[.!?…])\s+|(?<=[。！？])\s*")
_CLAUSE = re.compile(r"(?<=[,;:])\s+|(?<=[，；：、])\s*")


def sentences(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of a text's sentences (with the text's length last), 128-bit hashes (two columns) and lengths in characters.

    A sentence ends at a line end, after a full stop, question or exclamation mark before white space, and right after
    a CJK one. One of over ``LONG_SENTENCE`` characters counts as the clauses that its commas, semicolons and colons
    part. Case and amounts of white space don't count; what is white space only belongs to the sentence before.
    """
    starts, digests, sizes = [], [], []

    def add(a: int, b: int) -> None:
        norm = " ".join(text[a:b].lower().split())
        if norm:
            starts.append(a), sizes.append(len(norm)), digests.append(xxhash.xxh3_128_digest(norm))

    start = 0
    for end, after in [*(m.span() for m in _END.finditer(text)), (len(text), len(text))]:
        if end - start > LONG_SENTENCE:
            for m in _CLAUSE.finditer(text, start, end):
                add(start, m.start())
                start = m.end()
        add(start, end)
        start = after
    starts.append(len(text))
    return np.array(starts, np.int64), np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64), np.array(sizes, np.int64)


def spans(text: str, run: int = RUN, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence starts, first and last sentence of every span, and the spans' hashes (two columns).

    A span is a run of ``run`` sentences, or of as many more as it takes to ``min_chars`` characters. One goes from each
    sentence and one ends at each: together they cover any longer run to both of its ends, so what repeats of all runs
    of at least that size repeats in these. Each is there once, in order of place.
    """
    starts, digest, size = sentences(text)
    n, total, at = len(size), np.concatenate([[0], np.cumsum(size)]), np.arange(len(size))
    last = np.maximum(np.searchsorted(total, total[:-1] + min_chars) - 1, at + run - 1)
    first = np.minimum(np.searchsorted(total, total[1:] - min_chars, side="right") - 1, at - run + 1)
    pair = np.unique(np.concatenate([(at * n + last)[last < n], (first * n + at)[first >= 0]]))
    first, last = np.divmod(pair, max(n, 1))
    hashes = np.zeros((len(first), 2), np.uint64)
    live = np.arange(len(first))
    step = 0
    while len(live):
        hashes[live] = mix64(hashes[live] * np.uint64(0x9E3779B97F4A7C15) + digest[first[live] + step])
        step += 1
        live = live[first[live] + step <= last[live]]
    return starts, first, last, hashes


def _emit(src: DataFrame, run: int, min_chars: int) -> DataFrame:
    """Distinct spans of each row: h1, h2, the row's key and again (it holds the span more than once)."""
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), src.schema["key"], T.StructField("again", T.BooleanType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            rows, parts, agains = [], [np.zeros((0, 2), np.uint64)], [np.zeros(0, bool)]
            for i, text in enumerate(batch.column("text").to_pylist()):
                hashes = spans(text, run, min_chars)[3]
                first, n = np.unique(hashes[:, 0], return_index=True, return_counts=True)[1:]
                rows.append(np.full(len(first), i)), parts.append(hashes[first]), agains.append(n > 1)
            row, both = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate(parts).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column("key").take(pa.array(row)), pa.array(np.concatenate(agains))], names=schema.names)

    return src.mapInArrow(each, schema)


def cut(text: str, marked: dict[int, bool], run: int = RUN, min_chars: int = MIN_CHARS) -> tuple[str, int]:
    """The text without sentences that a non-first span covers, and how many those are.

    ``marked``: by a span's first hash, whether an earlier document has it; else only its repeats here are non-first.
    """
    starts, first, last, hashes = spans(text, run, min_chars)
    cover = np.zeros(len(starts) + 1, np.int64)
    seen: set[int] = set()
    for a, b, h in zip(first.tolist(), last.tolist(), hashes[:, 0].view(np.int64).tolist(), strict=True):
        if h in marked and (marked[h] or h in seen):
            cover[a] += 1
            cover[b + 1] -= 1
        seen.add(h)
    gone = np.cumsum(cover)[: len(starts) - 1] > 0
    if not gone.any():
        return text, 0
    kept = [text[: starts[0]], *(text[starts[i] : starts[i + 1]] for i in np.flatnonzero(~gone).tolist())]
    return "".join(kept).rstrip(), int(gone.sum())


#: Keys of rows whose id cannot order them lie from here on.
UNORDERED = 1 << 62


def _keyed(spark: SparkSession, docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """``docs`` with a long ``key`` for each row, no two alike, that orders them.

    Rows with an id of their own come first, in its order (an id that is no whole number counts as its hash). Rows whose
    id is null, shared with other rows or from 2**62 on come after them; they are written once, numbered as they come.
    """
    kind = docs.schema[id_col].dataType
    order = F.col(id_col).cast("long") if isinstance(kind, T.IntegralType) else F.shiftrightunsigned(F.xxhash64(id_col), 2)
    docs = docs.withColumn(key, F.when(F.col(id_col).isNotNull(), order))
    shared = stored(spark, docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("shared")).agg(F.count("*").alias("n")).where(f"n > 1 or shared >= {UNORDERED}").select("shared"), "shared")
    unnamed = docs.where(F.col(key).isNull())
    if shared.isEmpty() and unnamed.isEmpty():
        return docs
    rest = unnamed.unionByName(docs.join(shared, F.col(key) == F.col("shared"), "left_semi"))
    rest = stored(spark, rest.withColumn(key, F.monotonically_increasing_id() + F.lit(UNORDERED)), "unordered")
    return docs.where(F.col(key).isNotNull()).join(shared, F.col(key) == F.col("shared"), "left_anti").unionByName(rest)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, run: int = RUN, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with the same rows and columns, in ``text_col`` no sentence that lies in a repeated span's later occurrence.

    Occurrences are ordered by document id, then place. Ids may be of any type that can be compared; rows without an id
    of their own (null, or shared by several rows) come after all others, each row a document, so copies among them go
    but for the first. Null texts stay null; a text that goes whole becomes empty. Texts without repeats stay as they
    are, to the byte. ``removed_col`` adds the number of removed sentences. Columns may have any names. An empty table
    gives no rows.
    """
    key, marked, marks = unused(docs, "row_key", "marked_key", "marks")
    keyed = _keyed(spark, docs, id_col, key)
    held = stored(spark, _emit(keyed.where(F.col(text_col).isNotNull()).select(F.col(key).alias("key"), F.col(text_col).cast("string").alias("text")), run, min_chars), "spans")
    # Only minima are gathered of a hot span, before the shuffle already; the join back can be split by rows.
    repeated = held.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.max("again").alias("any_again")).where("least < most or any_again").select("h1", "h2", "least")
    found = held.join(repeated, ["h1", "h2"]).where("key > least or again")
    found = found.groupBy(F.col("key").alias(marked)).agg(F.collect_list(F.struct("h1", (F.col("key") > F.col("least")).alias("later"))).alias(marks))
    at, width = docs.columns.index(text_col), len(docs.columns)
    out = T.StructType([*docs.schema.fields, *([T.StructField(removed_col, T.LongType())] if removed_col else [])])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col, SLICE_BYTES):
            columns, n = list(batch.columns[:width]), []
            old, new = columns[at].to_pylist(), []
            for text, spans_ in zip(old, batch.column(width).to_pylist(), strict=True):
                done, gone = cut(text, {m["h1"]: m["later"] for m in spans_}, run, min_chars) if spans_ and text else (text, 0)
                new.append(done), n.append(gone)
            columns[at] = pa.array(new, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(n, pa.int64())] if removed_col else [])], names=out.names)

    joined = keyed.join(found, F.col(key) == F.col(marked), "left")
    return joined.select(*docs.columns, marks).mapInArrow(rewrite, out)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_spans(spark, docs, removed_col="n_removed").withColumn("changed", F.col("n_removed") > 0)
