"""Vectors of whole numbers: read from components, packed into sortable bytes, and summed without rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers stay within this, so that differences of two fit into 64 bits; components beyond it are taken as it.
LARGEST = 1 << 62
_BITS = 44
_MASK = (1 << _BITS) - 1
_WIDTHS = (1, 2, 4, 8)


def usable(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix of doubles) of a batch's vectors without null or non-finite components."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    good = (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])
    for length in np.unique(lengths[good]).tolist():
        at = np.flatnonzero(good & (lengths == length))
        yield length, at, values[(ends[at] - length)[:, None] + np.arange(length)]


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers, within ``LARGEST``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -float(LARGEST), float(LARGEST)).astype(np.int64)


def packed_rows(x: np.ndarray) -> list[bytes]:
    """Each row's numbers as bytes, in the fewest that hold all of them; equal rows are equal, order is kept within a width."""
    out: list[bytes] = [b""] * len(x)
    most = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
    kinds = np.searchsorted([(1 << 8 * w - 1) - 1 for w in _WIDTHS], most)
    for kind in np.unique(kinds).tolist():
        width, at = _WIDTHS[kind], np.flatnonzero(kinds == kind)
        shifted = (x[at].astype(np.uint64) ^ np.uint64(1 << 63)) - np.uint64((1 << 63) - (1 << 8 * width - 1))
        data = np.ascontiguousarray(shifted.astype(f">u{width}")).tobytes()
        step = width * x.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = bytes((width,)) + data[k * step : (k + 1) * step]
    return out


def unpacked_rows(rows: list[bytes], length: int) -> np.ndarray:
    out = np.zeros((len(rows), length), np.int64)
    widths = np.array([r[0] for r in rows])
    for width in np.unique(widths).tolist() if length else ():
        at = np.flatnonzero(widths == width)
        data = np.frombuffer(b"".join(rows[i][1:] for i in at.tolist()), f">u{width}").reshape(-1, length)
        out[at] = (data.astype(np.uint64) + np.uint64((1 << 63) - (1 << 8 * width - 1)) ^ np.uint64(1 << 63)).astype(np.int64)
    return out


def number_rows(df: DataFrame, vector_col: str, kept: dict[str, str], scale: float) -> DataFrame:
    """The columns ``kept`` (new name: old name), dim and x: floor(scale * component) of usable vectors, packed."""
    src = df.select(*(F.col(old).alias(new) for new, old in kept.items()), F.col(vector_col).cast("array<double>").alias("v"))
    schema = T.StructType([*(src.schema[c] for c in kept), T.StructField("dim", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, at, values in usable(batch.column("v")):
                part = batch.take(pa.array(at))
                packed = pa.array(packed_rows(whole(values, scale)), pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(np.full(len(at), length, np.int32)), packed], names=schema.names)

    return src.mapInArrow(run, schema)


def numbers(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dim, rows, numbers) of a batch with columns dim and x."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield dim, part, unpacked_rows(part.column("x").to_pylist(), dim)


def fits(bound: int) -> bool:
    return bound < LARGEST


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Four 64-bit parts of each number, whose sums over many tasks don't overflow."""
    if x.dtype != object:
        zero = np.zeros(x.shape, np.int64)
        return [x & _MASK, x >> _BITS, zero, zero]
    parts = [x & _MASK, (x >> _BITS) & _MASK, (x >> 2 * _BITS) & _MASK, x >> 3 * _BITS]
    return [np.array(p, dtype=np.int64) for p in parts]


def joined(parts: list[int]) -> int:
    return sum(int(p) << _BITS * i for i, p in enumerate(parts))


LIMBS = ("p0", "p1", "p2", "p3")


def summed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.sum(p).alias(p) for p in LIMBS))


def squares(d: np.ndarray) -> list[int]:
    """The sum of each row's squares as whole numbers."""
    most = max(int(d.max(initial=0)), -int(d.min(initial=0)))
    if d.dtype == object:
        return [sum(v * v for v in row) for row in d.tolist()]
    if fits(max(1, d.shape[1]) * most * most):
        return (d * d).sum(axis=1).tolist()
    # Products of halves stay below 2^62, and sums of their halves far below.
    half = (1 << 31) - 1
    low, high = np.abs(d) & half, np.abs(d) >> 31
    total = [0] * len(d)
    for product, shift in ((low * low, 0), (low * high, 32), (high * high, 62)):
        above, below = (product >> 31).sum(axis=1).tolist(), (product & half).sum(axis=1).tolist()
        total = [t + (((a << 31) + b) << shift) for t, a, b in zip(total, above, below, strict=True)]
    return total
