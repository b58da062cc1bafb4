"""Vector codes: each part of a vector by its nearest codebook entry, found along a lexicographic trie of distinct parts.

Parts are whole numbers, so distances are exact. Distinct parts are sorted and walked depth first as a trie: the vector
of distances from a prefix to all entries is accumulated once per prefix and shared by all parts below it. Small
subtrees are walked level by level over all their prefixes at once. A leaf takes the least distance, and its part,
weighted by how often it stands in the table, goes into its entry's sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import discard, spread_join, stored, table
from tallyloom.llm.exact import LIMBS, fits, joined, limbs, number_rows, numbers, packed_rows, summed, unpacked_rows

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Parts of a subtree that is walked level by level: its distances to 256 entries take half a megabyte.
SUBTREE = 256
_EXACT = 1 << 53


def sorted_distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the first column in which each differs from the one before (0 for the first), and where each given row is."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    held = parts[order]
    differs = held[1:] != held[:-1]
    new = np.r_[True, differs.any(axis=1)][: len(held)]
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(new) - 1
    depth = np.r_[0, differs.argmax(axis=1)] if parts.shape[1] else np.zeros(len(held), np.int64)
    return held[new], depth[: len(held)][new], place


class Trie:
    """Nearest entries of sorted distinct parts."""

    def __init__(self, entries: np.ndarray, subtree: int = SUBTREE):
        self.entries, self.subtree = entries, subtree
        self.most = max(int(entries.max(initial=0)), -int(entries.min(initial=0)))

    def nearest(self, parts: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Each part's entry, the lowest of the nearest, and its squared distance."""
        n, length = parts.shape
        codes, errors = np.zeros(n, np.int64), [0] * n
        most = self.most + max(int(parts.max(initial=0)), -int(parts.min(initial=0)))
        exact = length * most * most < _EXACT
        # Sums of squares below 2^53 are exact as doubles; beyond, doubles only tell which entries come into question.
        columns = self.entries.T.astype(np.float64) if exact else self.entries.T
        values = parts.astype(np.float64) if exact else parts

        def square(level: int, at) -> np.ndarray:
            d = (np.atleast_1d(values[at, level])[:, None] - columns[level]).astype(np.float64, copy=False)
            d *= d
            return d

        def leaves(lo: int, hi: int, level: int, far: np.ndarray) -> None:
            heads = np.array([lo])
            for k in range(level, length):
                below = lo + np.flatnonzero(depth[lo:hi] <= k)
                below = below if len(below) and below[0] == lo else np.r_[lo, below]
                parents = np.searchsorted(heads, below, side="right") - 1
                step = square(k, below)
                step += far[parents]
                heads, far = below, step
            best = far.argmin(axis=1)
            if exact:
                codes[lo:hi], errors[lo:hi] = best, far[np.arange(hi - lo), best].astype(np.int64).tolist()
                return
            near = far <= far.min(axis=1, keepdims=True) * (1 + 1e-9)
            for i in range(hi - lo):
                part = parts[lo + i].tolist()
                errors[lo + i], codes[lo + i] = min((sum((a - b) ** 2 for a, b in zip(part, self.entries[e].tolist(), strict=True)), e) for e in np.flatnonzero(near[i]).tolist())

        stack = [(0, n, 0, np.zeros((1, len(self.entries))))] if n else []
        while stack:
            lo, hi, level, far = stack.pop()
            if hi - lo <= self.subtree or level == length:
                leaves(lo, hi, level, far)
                continue
            cuts = lo + 1 + np.flatnonzero(depth[lo + 1 : hi] == level)
            # Consecutive small children are walked together; a large one goes on from its own distances.
            first = lo
            for a, b in zip(np.r_[lo, cuts].tolist(), np.r_[cuts, hi].tolist(), strict=True):
                large = b - a > self.subtree
                if first < a and (large or b - first > self.subtree):
                    leaves(first, a, level, far)
                    first = a
                if large:
                    stack.append((a, b, level + 1, far + square(level, a)))
                    first = b
            if first < hi:
                leaves(first, hi, level, far)
        return codes, errors


def cut(dim: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts lie: equal ones if their number divides the length, else each a component longer or shorter."""
    return [(dim * k // parts, dim * (k + 1) // parts) for k in range(parts)]


def _split(rows: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in numbers(batch):
                for k, (a, b) in enumerate(cut(dim, parts)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, np.int32)), pa.array(np.full(len(x), k, np.int32)), pa.array(packed_rows(x[:, a:b]), pa.binary())], names=["dim", "position", "part"])

    found = rows.mapInArrow(run, "dim int, position int, part binary").groupBy("dim", "position", "part").agg(F.count("*").alias("times"))
    # Neighbours in a task's sorted range share long prefixes.
    return found.repartitionByRange("dim", "position", "part").sortWithinPartitions("dim", "position", "part")


Codebooks = dict[int, list[np.ndarray]]


def _start(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the first rows by id, which Spark takes from each task's first before they meet."""
    window = Window.partitionBy("dim").orderBy(F.col("id").asc_nulls_last(), "x")
    first = rows.select("id", "dim", "x", F.row_number().over(window).alias("nth")).where(F.col("nth") <= entries).select("dim", "nth", "x").collect()
    held: dict[int, list] = {}
    for r in sorted(first, key=lambda r: (r["dim"], r["nth"])):
        held.setdefault(r["dim"], []).append(bytes(r["x"]))
    return {dim: [np.ascontiguousarray(unpacked_rows(x, dim)[:, a:b]) for a, b in cut(dim, parts)] for dim, x in held.items()}


def _moved(parts: DataFrame, books: Codebooks, number: int) -> Codebooks:
    """The codebooks after one round: each entry is the floor of the mean of the parts nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims, positions = batch.column("dim").to_numpy(), batch.column("position").to_numpy()
            for dim, k in np.unique(np.stack([dims, positions], axis=1), axis=0).tolist():
                part = batch.filter(pa.array((dims == dim) & (positions == k)))
                a, b = cut(dim, number)[k]
                x, times = unpacked_rows(part.column("part").to_pylist(), b - a), part.column("times").to_numpy()
                x, depth, place = sorted_distinct(x)
                weight = np.zeros(len(x), np.int64)
                np.add.at(weight, place, times)
                codes, _ = Trie(books[dim][k]).nearest(x, depth)
                most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
                kind = np.int64 if fits(most * int(weight.sum())) else object
                sums = np.zeros((len(books[dim][k]), b - a + 1), kind)
                np.add.at(sums, codes, np.c_[weight[:, None], x].astype(kind) * np.c_[np.ones_like(weight)[:, None], np.repeat(weight[:, None], b - a, axis=1)].astype(kind))
                held = totals.get((dim, k))
                totals[dim, k] = sums.astype(object) + (0 if held is None else held)
        for (dim, k), sums in totals.items():
            entry, at = np.nonzero(np.broadcast_to((sums[:, :1] != 0).astype(bool), sums.shape))
            size = len(entry)
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in (np.full(size, dim), np.full(size, k), entry, at)), *map(pa.array, limbs(sums[entry, at]))], names=["dim", "position", "entry", "at", *LIMBS])

    found = summed(parts.mapInArrow(run, "dim int, position int, entry int, at int, p0 long, p1 long, p2 long, p3 long"), ["dim", "position", "entry", "at"])
    sums = {tuple(r[:4]): joined(r[4:]) for r in found.select("dim", "position", "entry", "at", *LIMBS).collect()}
    out = {dim: [book.copy() for book in own] for dim, own in books.items()}
    for (dim, k, entry, at), total in sums.items():
        if at:
            out[dim][k][entry, at - 1] = total // sums[dim, k, entry, 0]
    return out


def digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for part in book for v in part.ravel().tolist()).encode()).hexdigest()


def compress(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256.

    Each component x becomes floor(scale * x); a vector is cut into ``parts`` consecutive parts, equal ones where their
    number divides the length. A part's codebook begins as that part of the first ``entries`` rows by id, then in
    ``rounds`` rounds each entry becomes the floor of the mean of the parts nearest to it (ties: the lower index);
    entries without parts stay. A code is two hex digits a part; error is the squared distance to what it stands for,
    label_error its sum over rows of the same label, those without one together.

    Rows whose vector is null or holds null or non-finite components are dropped. Vectors of each length have codebooks
    of their own; empty ones get code 00 for each part and no error. Equal rows get equal codes and each counts; rows of
    one id are taken in the order of their components, null ids last. Fewer rows than entries make shorter codebooks; an
    empty table gives none; other columns aren't read. Numbers beyond 2^62 are taken as 2^62; an error that doesn't
    fit into a long is null, and so is a label's sum of such. At most 256 entries.

    The driver holds codebooks only; their size follows from the dimension, never from the rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits names 1 to 256 entries")
    rows = stored(spark, number_rows(vectors, vector_col, {"id": id_col, "label": label_col}, scale), "numbers")
    books = _start(rows, parts, entries)
    distinct = stored(spark, _split(rows, parts), "parts")
    for _ in range(rounds):
        books = _moved(distinct, books, parts)
    digests = {dim: digest(book) for dim, book in books.items()}
    schema = T.StructType([T.StructField("vec_id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in numbers(batch):
                names, total = [""] * len(x), [0] * len(x)
                for (a, b), book in zip(cut(dim, parts), books[dim], strict=True):
                    held, depth, place = sorted_distinct(x[:, a:b])
                    codes, errors = Trie(book).nearest(held, depth)
                    each = [f"{c:02x}" for c in codes.tolist()]
                    for i, p in enumerate(place.tolist()):
                        names[i] += each[p]
                        total[i] += errors[p]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(names, pa.string()), pa.array([t if t < 1 << 63 else None for t in total], pa.int64()), pa.array([digests[dim]] * len(x), pa.string())], names=schema.names)

    # A label as a text that is never null, so that rows without one come together too.
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = stored(spark, rows.mapInArrow(assign, schema).withColumn("label_key", key), "coded")
    discard(spark, distinct)
    by_label = coded.groupBy("label_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("error").alias("known"), F.count("*").alias("many"))
    by_label = by_label.select("label_key", "many", F.when(F.col("known") == F.col("many"), F.expr("try_cast(total as long)")).alias("label_error"))
    by_label = stored(spark, by_label, "label_errors")
    return spread_join(coded, by_label, "label_key", "many", coded.count()).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark, table(spark, sf_dir, "embeddings"))
