"""Embedding whitening by bit-sliced scatter: cross-products of whole numbers as weighted popcounts of ANDed bit planes.

Components become whole numbers. Each dimension of a block of rows is shifted to begin at zero and cut into bit planes,
each plane packed into 64-bit words across the rows. The cross-product of two dimensions is the sum over their pairs of
planes of 2^(a+b) times the popcount of the planes' AND: exact. Blocks' sums are added up in Spark as whole numbers,
centred as whole numbers, and only then become the doubles whose eigenvectors whiten.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import stored, table
from tallyloom.llm.exact import LIMBS, fits, joined, limbs, number_rows, numbers, squares, summed

#: Components become floor(64 * c). An offset added to all of them, as of 1,000,000, cancels in everything that is returned.
SCALE = 64
COMPONENTS = 16
#: Bytes of bit planes, and of their AND, that a block of rows takes at most, about.
BLOCK_BYTES = 2 << 20


def planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (planes x words) of rows of numbers from zero, with each plane's dimension and bit, in order of both."""
    words = -(-len(u) // 64)
    bits = [int(m).bit_length() for m in u.max(axis=0).tolist()]
    owner = np.repeat(np.arange(u.shape[1]), bits)
    bit = np.concatenate([np.arange(b) for b in bits] or [np.zeros(0, np.int64)])
    out = np.zeros((len(owner), words * 8), np.uint8)
    for b in range(max(bits, default=0)):
        at = np.flatnonzero(bit == b)
        packed = np.packbits(((u[:, owner[at]] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0)
        out[at, : len(packed)] = packed.T
    return out.view(np.uint64), owner, bit


def shifted_products(u: np.ndarray) -> np.ndarray:
    """Sums over the rows of u_i * u_j for i <= j, by popcounts."""
    words, owner, bit = planes(u)
    dim = u.shape[1]
    wide = not fits(len(u) << 2 * (int(bit.max(initial=0)) + 1))
    out = np.zeros((dim, dim), object if wide else np.int64)
    starts = np.searchsorted(owner, np.arange(dim + 1))
    step = max(1, BLOCK_BYTES // max(1, words.shape[1] * 8))
    weights = np.array([1 << int(b) for b in bit], object) if wide else np.int64(1) << bit
    for p in range(len(words)):
        i, first = int(owner[p]), int(starts[owner[p]])
        counts = np.concatenate([np.bitwise_count(words[p] & words[a : a + step]).sum(axis=1, dtype=np.int64) for a in range(first, len(words), step)])
        held = owner[first:]
        cuts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        out[i, held[cuts]] += np.add.reduceat(counts * weights[first:], cuts) * weights[p]
    return out


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x_i, and of x_i * x_j for i <= j, over a block of rows."""
    low = x.min(axis=0)
    u = (x - low).astype(np.uint64)
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    kind = np.int64 if fits(4 * len(x) * most * most) else object
    part, low = shifted_products(u).astype(kind), low.astype(kind)
    sums = u.astype(kind).sum(axis=0)
    products = part + np.outer(low, sums) + np.outer(sums, low) + len(x) * np.outer(low, low)
    return sums + len(x) * low, np.triu(products)


@dataclass
class Whitening:
    """What is learned of vectors of one length: their number and sums, projections, shares of variance and the error."""

    n: int
    sums: np.ndarray
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if fits(2 * self.n * most) and all(fits(2 * abs(s)) for s in self.sums):
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64) @ self.projection


def _totals(fit: DataFrame, block_bytes: int) -> dict[int, dict[tuple[int, int], int]]:
    """By length: sums of products under (i, j), of numbers under (-1, j), and the number of vectors under (-1, -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        totals: dict[int, list] = {}

        def close(dim: int) -> None:
            rows = np.concatenate(held.pop(dim))
            sums, products = scatter(rows)
            n, s, p = totals.get(dim, (0, 0, 0))
            totals[dim] = [n + len(rows), s + sums.astype(object), p + products.astype(object)]

        for batch in batches:
            for dim, _, x in numbers(batch):
                if dim:
                    limit = max(64, block_bytes // dim)
                    for at in range(0, len(x), limit):
                        held.setdefault(dim, []).append(x[at : at + limit])
                        if sum(map(len, held[dim])) >= limit:
                            close(dim)
        for dim in list(held):
            close(dim)
        for dim, (n, sums, products) in totals.items():
            i, j = np.triu_indices(dim)
            rows, columns = np.r_[np.full(dim + 1, -1), i], np.r_[np.arange(dim), -1, j]
            parts = limbs(np.concatenate([sums, np.array([n], object), products[i, j]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), *(pa.array(c.astype(np.int32)) for c in (rows, columns)), *map(pa.array, parts)], names=["dim", "i", "j", *LIMBS])

    found = summed(fit.mapInArrow(run, "dim int, i int, j int, p0 long, p1 long, p2 long, p3 long"), ["dim", "i", "j"])
    out: dict[int, dict[tuple[int, int], int]] = {}
    for batch in found.toArrow().to_batches():
        for dim, i, j, *parts in zip(*(batch.column(c).to_pylist() for c in ("dim", "i", "j", *LIMBS)), strict=True):
            out.setdefault(dim, {})[i, j] = joined(parts)
    return out


def _model(dim: int, totals: dict[tuple[int, int], int], components: int) -> Whitening:
    n, sums = totals[-1, -1], [totals[-1, j] for j in range(dim)]
    cov = np.zeros((dim, dim))
    for (i, j), value in totals.items():
        if i >= 0:
            cov[i, j] = cov[j, i] = (n * value - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = math.fsum(cov.diagonal())
    # Below this an eigenvalue is rounding: the vectors don't vary that way, and nothing can be scaled to variance one.
    real = int((values > dim * np.finfo(float).eps * max(values[0], 0)).sum()) if trace > 0 else 0
    k = min(components, real)
    return Whitening(n, np.array(sums, object), vectors[:, :k] / np.sqrt(values[:k]), values[:k] / trace if k else values[:0])


def _errors(fit: DataFrame, models: dict[int, Whitening]) -> None:
    """Sets each model's error: the covariance of the whitened fit list, as it comes out, against the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in numbers(batch):
                if dim in models and models[dim].projection.shape[1]:
                    z = models[dim].whitened(models[dim].deviations(x))
                    z = np.c_[z, np.ones(len(z))]
                    totals[dim] = totals.get(dim, 0) + z.T @ z
        for dim, m in totals.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["dim", "i", "j", "v"])

    found = fit.mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect()
    sums: dict[int, np.ndarray] = {dim: np.zeros((m.projection.shape[1] + 1,) * 2) for dim, m in models.items()}
    for r in found:
        sums[r["dim"]][r["i"], r["j"]] = r["v"]
    for dim, m in sums.items():
        k, n = len(m) - 1, models[dim].n
        # The last column holds the sums; vectors were centred before they were projected, so these are rounding.
        mean = m[:k, k] / n
        gap = np.triu(m[:k, :k] / n - np.outer(mean, mean)) - np.eye(k)
        models[dim].identity_error = float(np.abs(gap).max(initial=0.0))


def whiten(spark: SparkSession, vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Each component c becomes x = floor(scale * c); the fit list is each distinct x vector once. Rows whose
    vector is null or holds null or non-finite components are dropped, and so are empty vectors: they have no
    components. Vectors of each length have a fit list, covariance and numbering of their own. Components whose
    eigenvalue is zero, or rounding beside the largest, are left out, so equal vectors alone give no rows. Null and
    repeated ids give rows like any other; an empty table gives none; other columns aren't read. Numbers beyond 2^62 are
    taken as 2^62; a deviation that doesn't fit into a long is null there and whole in ``deviation_text``.

    The driver holds one covariance per length: its size follows from the dimension, never from the rows.
    """
    rows = stored(spark, number_rows(vectors, vector_col, {"vec_id": id_col}, scale), "whole")
    fit = stored(spark, rows.where("dim > 0").select("dim", "x").distinct(), "fit")
    models = {dim: _model(dim, totals, components) for dim, totals in _totals(fit, block_bytes).items()}
    _errors(fit, models)
    schema = T.StructType([rows.schema["vec_id"], *(T.StructField(c, t) for c, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()), ("deviation_text", T.StringType())))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in numbers(batch):
                model = models.get(dim)
                k = model.projection.shape[1] if model else 0
                if not k:
                    continue
                d = model.deviations(x)
                each, totals = np.repeat(np.arange(len(x)), k), squares(d)
                held = pa.array([t if t < 1 << 63 else None for t in totals], pa.int64()).take(pa.array(each))
                texts = pa.array(map(str, totals), pa.string()).take(pa.array(each))
                columns = [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)), held, pa.array(model.whitened(d).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(each), model.identity_error)), texts]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(project, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark, table(spark, sf_dir, "embeddings"))
