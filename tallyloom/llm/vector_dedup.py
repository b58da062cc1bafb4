"""Embedding near-dedup by spherical-cap filters: a random product code, list-decoded, joined on filters and verified.

A filter is a direction put together from one codeword per block of dimensions; a vector belongs to all filters whose
inner product with it exceeds a bound. Vectors closer than the threshold share filters with high probability, others
seldom. The code's size and the bound follow from the number of vectors, so that a filter holds about as many vectors
at any scale and a pair at the threshold shares about ``COMMON`` of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import discard, spread_join, stored, table
from tallyloom.llm.components import components

PER_FILTER = 48
COMMON = 9
AT_LEAST = 24
SLICE_ROWS = 512
BIN_ROWS = 20_000
SEED = 20


def _joint(bound: float, cosine: float) -> float:
    """Chance that a unit vector exceeds ``bound`` (in standard deviations) if one at ``cosine`` from it does."""
    normal, x = NormalDist(), np.linspace(bound, bound + 8, 4000)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    beyond = np.array([1 - normal.cdf((bound - cosine * v) / math.sqrt(1 - cosine * cosine)) for v in x[::20]])
    return float(np.trapezoid(density * np.interp(x, x[::20], beyond), x) / (1 - normal.cdf(bound)))


class ProductCode:
    """Filters of one dimension: rotation, codewords of each block, and the bound."""

    def __init__(self, dim: int, n: int, cosine: float):
        share = min(0.05, PER_FILTER / max(1, n))
        bound = NormalDist().inv_cdf(1 - share)
        filters = COMMON / (share * _joint(bound, cosine))
        self.blocks = max(1, min(dim, 2 if filters <= 1 << 20 else 3 if filters <= 1 << 30 else 4))
        words = max(2, math.ceil(filters ** (1 / self.blocks)))
        rng = np.random.default_rng([SEED, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.bounds = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.bounds, self.bounds[1:], strict=False):
            code = rng.standard_normal((words, b - a))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) * math.sqrt((b - a) / dim))
        self.words, self.least = words, bound / math.sqrt(dim)

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """All filters that each unit vector exceeds, and its ``AT_LEAST`` best where those are more.

        A product code's scores vary by block, so some vectors exceed few filters; their neighbours' best ones are theirs.
        """
        turned = units @ self.rotation
        scores = [turned[:, a:b] @ code.T for a, b, code in zip(self.bounds, self.bounds[1:], self.codes, strict=False)]
        best = np.stack([s.max(axis=1) for s in scores])
        out = []
        for i in range(len(units)):
            top = np.zeros(1)
            for s in scores:
                top = np.sort((top[:, None] + np.sort(s[i])[None, -AT_LEAST:]).ravel())[-AT_LEAST:]
            least = min(self.least, top[0] - 1e-12)
            total, name = np.zeros(1), np.zeros(1, np.int64)
            for k, s in enumerate(scores):
                # Partial sums that even the best later codewords cannot lift over the bound are dropped.
                rest = best[k + 1 :, i].sum()
                word = np.flatnonzero(s[i] + total.max() + rest >= least)
                sums = total[:, None] + s[i][word][None, :]
                row, column = np.nonzero(sums + rest >= least)
                total, name = sums[row, column], name[row] * self.words + word[column]
            out.append(np.sort(name))
        return out


def _nodes(src: DataFrame) -> DataFrame:
    """vec_id and, for usable vectors, node (128-bit hash of the components) and the components as bytes of doubles."""
    schema = T.StructType([src.schema["vec_id"], T.StructField("node", T.BinaryType()), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, data = [], []
            for v in batch.column("v").to_pylist():
                x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    node.append(None), data.append(None)
                else:
                    data.append(x.tobytes())
                    node.append(xxhash.xxh3_128_digest(data[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(node, pa.binary()), pa.array(data, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def unit(data: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component goes first out, so that squares neither overflow nor vanish."""
    data = data / np.abs(data).max(axis=1, keepdims=True)
    return data / np.linalg.norm(data, axis=1, keepdims=True)


def link_block(left: np.ndarray, right: np.ndarray | None, filters: list[np.ndarray], here: int, cosine: float, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between two slices of a filter (or within one, if ``right`` is None), counted in the lowest common filter.

    Returns for each row its links, copies of the other node included, and the first row of its part of the block.
    """
    n = len(left)
    whole = left if right is None else np.concatenate([left, right])
    close = left @ whole.T >= cosine if right is None else left @ right.T >= cosine
    if right is None:
        np.fill_diagonal(close, False)
    rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    sides = (filters[:n], filters if right is None else filters[n:])
    lower = [[f[f < here] for f in (side[i] for i in at)] for side, at in zip(sides, (rows, columns), strict=True)]
    if len(rows):
        known = np.unique(np.concatenate([*lower[0], *lower[1]]))
        marks = []
        for part in lower:
            mark = np.zeros((len(part), len(known)), np.float32)
            for i, f in enumerate(part):
                mark[i, np.searchsorted(known, f)] = 1
            marks.append(mark)
        close[np.ix_(rows, columns)] &= marks[0] @ marks[1].T < 0.5
    links, first = np.zeros(len(whole), np.int64), np.arange(len(whole))
    if right is None:
        links[:] = close @ times
    else:
        links[:n], links[n:] = close @ times[n:], close.T @ times[:n]
    off = 0 if right is None else n
    while len(rows):
        new = first.copy()
        new[rows] = np.minimum(first[rows], np.where(close[rows], first[off : off + close.shape[1]][None, :], len(whole)).min(axis=1))
        new[columns + off] = np.minimum(new[columns + off], np.where(close[:, columns], new[:n][:, None], len(whole)).min(axis=0))
        if (new == first).all():
            break
        first = new
    return links, first


def link_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is ``cosine`` or more. Null, empty and zero vectors and those
    with null or non-finite components link with nothing; vectors of different lengths don't link. Equal vectors are
    one node: each copy counts as a link of the others and of all that the node links with. A row with a null id links
    like any other, but names no component; where no row reachable has an id, component_id is null and all are kept.
    Repeated rows give a row each; an empty table gives none; other columns are not read. Pairs are found with high probability (see the recall test), never reported below the threshold.
    """
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    rows = stored(spark, _nodes(src), "vectors")
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("data").alias("data"), F.min("vec_id").alias("own"), F.count("*").alias("times"))
    nodes = stored(spark, nodes.withColumn("dim", (F.length("data") / 8).cast("int")), "nodes")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()}
    codes = {dim: ProductCode(dim, n, cosine) for dim, n in sizes.items()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                found = codes[dim].decode(unit(np.frombuffer(b"".join(part.column("data").to_pylist())).reshape(-1, dim)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "dim", "data", "times")), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], names=["node", "dim", "data", "times", "filters"])

    decoded = stored(spark, nodes.select("node", "dim", "data", "times").mapInArrow(decode, "node binary, dim int, data binary, times long, filters array<long>"), "decoded")
    member = decoded.select("node", "dim", F.explode("filters").alias("filter"))
    # A filter with many vectors is cut into slices, and every two slices meet in a task of their own.
    full = member.groupBy("dim", "filter").agg(F.count("*").alias("n")).where("n > 1").withColumn("slices", F.ceil(F.col("n") / SLICE_ROWS))
    full = stored(spark, full, "filters")
    # Each row of a filter meets each of its slices; the bins follow from how many rows that makes.
    meetings = full.agg(F.sum(F.col("n") * F.col("slices")).alias("n")).first()["n"] or 0
    member = member.join(full, ["dim", "filter"]).withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    meet = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    member = member.select("node", "dim", "filter", "slice", meet.alias("other")).select("node", "dim", "filter", "slice", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"))
    bins = max(1, math.ceil(meetings / BIN_ROWS))
    work = member.join(decoded.drop("dim"), "node").withColumn("bin", F.pmod(F.xxhash64("dim", "filter", "low", "high"), F.lit(bins)))

    def compare(group: pa.Table) -> pa.Table:
        keys = np.stack([group.column(c).to_numpy() for c in ("dim", "filter", "low", "high", "slice")])
        order = np.lexsort(keys[::-1])
        keys = keys[:, order]
        cuts = np.flatnonzero(np.r_[True, (keys[:4, 1:] != keys[:4, :-1]).any(axis=0)])
        group = group.take(pa.array(order))
        data, filters, names = group.column("data").to_pylist(), group.column("filters"), group.column("node").to_pylist()
        times = group.column("times").to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), keys.shape[1]], strict=True):
            dim, here, low, high = keys[:4, a].tolist()
            x = unit(np.frombuffer(b"".join(data[a:b])).reshape(-1, dim))
            split = b - a if low == high else int((keys[4, a:b] == low).sum())
            if b - a < 2 or split == 0 or low != high and split == b - a:
                continue
            lists = [np.array(f, np.int64) for f in filters[a:b].to_pylist()]
            links, first = link_block(x[:split], None if low == high else x[split:], lists, here, cosine, times[a:b])
            for i in np.flatnonzero(links).tolist():
                out[0].append(names[a + i]), out[1].append(int(links[i])), out[2].append(names[a + int(first[i])])
        return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["node", "links", "first"])

    found = stored(spark, work.groupBy("bin").applyInArrow(compare, "node binary, links long, first binary"), "found")
    discard(spark, decoded, full)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(spark, found.select(F.col("node").alias("a"), F.col("first").alias("b"))).select("node", "label")
    nodes = nodes.select("node", "own", "times").join(links, "node", "left").join(labels, "node", "left")
    nodes = stored(spark, nodes.withColumn("comp", F.coalesce("label", "node")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("times") - 1).drop("label", "links"), "linked")
    total = rows.count()
    least = stored(spark, nodes.groupBy("comp").agg(F.min("own").alias("least"), F.count("*").alias("members")), "least")
    named = stored(spark, spread_join(nodes, least, "comp", "members", total).select("node", "n_links", "least", "times"), "named")
    out = spread_join(rows.select("vec_id", "node"), named, "node", "times", total).withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.expr("vec_id <=> component_id").alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark, table(spark, sf_dir, "embeddings"))
