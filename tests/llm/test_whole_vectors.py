"""Whitening and codes of vectors against plain computations over the whole table, exact where whole numbers are."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm.exact import joined, limbs, packed_rows, squares, unpacked_rows, usable, whole
from tallyloom.llm.vector_codes import Trie, compress, op12_vector_code_compression, sorted_distinct
from tallyloom.llm.whitening import op11_embedding_whitening, scatter, whiten

D = "/root/testdata/sf0.01"
ODD = "vec_id long, embedding array<float>, label int, x string, dim int, error long, n int, part int"


def odd(spark):
    """Null, non-finite, empty, short, repeated and enormous vectors, null ids, and columns with clashing names."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist(), i % 3) for i in range(40)]
    rows += [(i, rows[i - 100][1], 7) for i in range(100, 110)] + [rows[3], (None, rng.standard_normal(8).tolist(), None)]
    rows += [(200, None, 1), (201, [1.0, None] * 4, 1), (202, [math.nan] * 8, 1), (203, [math.inf] * 8, None), (204, [], 1), (205, [0.5, -0.5, 0.25], None), (206, [0.5, 0.5, 0.25], None)]
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], ODD)


def table(spark, d=D):
    rows = sorted((r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect())
    return [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], np.float64)


@pytest.mark.parametrize("size", [1, 30, 10**4, 10**9, 10**15, 10**18])
def test_numbers(size):
    rng = np.random.default_rng(size)
    x = (rng.standard_normal((70, 5)) * size).clip(-(2.0**61), 2.0**61).astype(np.int64)
    exact = x.astype(object)
    assert (unpacked_rows(packed_rows(x), 5) == x).all()
    sums, products = scatter(x)
    assert (sums == exact.sum(axis=0)).all() and (products == np.triu(exact.T @ exact)).all()
    assert squares(x) == [sum(v * v for v in r) for r in x.tolist()]
    assert [joined(p) for p in zip(*(a.ravel().tolist() for a in limbs(products)), strict=True)] == products.ravel().tolist()
    narrow = (x % 100 - 50).astype(np.int64)
    assert sorted(packed_rows(narrow)) == packed_rows(np.array(sorted(narrow.tolist())))


def test_many_rows():
    x = np.random.default_rng(1).integers(-40, 40, (5000, 12))
    sums, products = scatter(x)
    assert (products == np.triu(x.T @ x)).all() and (sums == x.sum(axis=0)).all()


def test_usable():
    import pyarrow as pa

    column = pa.array([[1.0, 2.0], None, [3.0, None], [], [4.0, math.inf], [5.0, 6.0]], pa.list_(pa.float64()))
    found = {length: (at.tolist(), x.tolist()) for length, at, x in usable(column.slice(1))}
    assert found == {0: ([2], [[]]), 2: ([4], [[5.0, 6.0]])}
    assert whole(np.array([[-0.01, 1e300]]), 64).tolist() == [[-1, 1 << 62]]


def held_against(rows, ids, vectors):
    """What whitening says of vectors of one length, against rational sums and numpy's eigenvectors."""
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    cov = np.array([[float(Fraction(int(n * (fit[:, i] * fit[:, j]).sum() - sums[i] * sums[j]), n * n)) for j in range(fit.shape[1])] for i in range(fit.shape[1])])
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    k = min(16, fit.shape[1])
    rows = sorted(rows, key=lambda r: (str(r["vec_id"]), r["component"], r["deviation"]))
    order = sorted(range(len(ids)), key=lambda i: str(ids[i]))
    assert [r["vec_id"] for r in rows[::k]] == [ids[i] for i in order] and len(rows) == k * len(ids)
    assert {r["n"] for r in rows} == {n}
    assert [r["deviation"] for r in rows[::k]] == [int(((n * x[i] - sums) ** 2).sum()) for i in order]
    assert np.allclose([r["explained"] for r in rows[:k]], values[:k] / np.trace(cov), rtol=1e-9)
    got = np.array([r["whitened"] for r in rows]).reshape(-1, k)
    want = ((x - sums / n) @ vectors_[:, :k] / np.sqrt(values[:k]))[order]
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, atol=1e-6)
    assert {r["identity_error"] for r in rows}.pop() < 1e-9
    seen = {tuple(x[i]): got[at] for at, i in enumerate(order)}
    z = np.array(list(seen.values()))
    assert np.allclose(z.T @ z / n, np.eye(k), atol=1e-9)


def test_whitening_of_the_table(spark):
    ids, _, vectors = table(spark)
    held_against(op11_embedding_whitening(spark, D).collect(), ids, vectors)


def test_whitening_in_small_blocks(spark):
    ids, _, vectors = table(spark, "/root/testdata/sf0.001")
    held_against(whiten(spark, spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(7), block_bytes=64 * 70).collect(), ids, vectors)


def test_whitening_of_odd_rows(spark):
    df = odd(spark)
    rows = whiten(spark, df).collect()
    eight = [r for r in df.collect() if r["embedding"] and len(r["embedding"]) == 8 and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    # A repeated id twice: compare without it, but it counts once in the fit anyway.
    repeated = [r for r in rows if r["vec_id"] == 3]
    assert len(repeated) == 16 and len({(r["component"], r["whitened"]) for r in repeated}) == 8
    once = {r["vec_id"]: r["embedding"] for r in eight}
    big = [r for r in rows if r["vec_id"] not in (3, 205, 206)] + [r for c in range(1, 9) for r in [next(r for r in repeated if r["component"] == c)]]
    held_against(big, list(once), np.array(list(once.values()), np.float64))
    # Two vectors vary in one direction only, so there is one component.
    assert sorted((r["vec_id"], r["component"], r["n"], round(abs(r["whitened"]), 9), r["explained"]) for r in rows if r["vec_id"] in (205, 206)) == [(205, 1, 2, 1.0, 1.0), (206, 1, 2, 1.0, 1.0)]
    assert whiten(spark, df.limit(0)).count() == 0
    assert whiten(spark, df.where("vec_id = 3")).count() == 0, "equal vectors don't vary"


def test_whitening_of_wide_numbers(spark):
    rows = [(i, [1e10 * (i % 5), 3.0 * i * i, -1e14 * i]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[math.floor(64 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in whiten(spark, df).where("component = 1").collect():
        exact = sum((30 * c - s) ** 2 for c, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["deviation_text"] == str(exact) and r["deviation"] == (exact if exact < 1 << 63 else None)


def plain_codes(vectors, entries=256, rounds=4):
    """Codebooks, codes and errors the plain way, for vectors in the order of their ids."""
    x = np.floor(1024 * vectors).astype(np.int64)
    cuts = [(x.shape[1] * k // 4, x.shape[1] * (k + 1) // 4) for k in range(4)]
    codes, error, text = [], np.zeros(len(x), np.int64), []
    for a, b in cuts:
        part, book = x[:, a:b], x[:entries, a:b].copy()

        def near(part=part, book=book):
            return ((part[:, None] - book[None]) ** 2).sum(axis=2)

        for _ in range(rounds):
            own = near().argmin(axis=1)
            for e in np.unique(own):
                book[e] = part[own == e].sum(axis=0) // (own == e).sum()
        far = near()
        codes.append(far.argmin(axis=1))
        error += far.min(axis=1)
        text += [str(v) for v in book.ravel().tolist()]
    return ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(x))], error.tolist(), hashlib.sha256(",".join(text).encode()).hexdigest()


def test_codes_of_the_table(spark):
    ids, labels, vectors = table(spark)
    codes, errors, sha = plain_codes(vectors)
    by_label = {}
    for label, e in zip(labels, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    got = sorted(tuple(r) for r in op12_vector_code_compression(spark, D).collect())
    assert got == [(i, c, e, by_label[label], sha) for i, c, e, label in zip(ids, codes, errors, labels, strict=True)]


def test_codes_of_odd_rows(spark):
    df = odd(spark)
    got = compress(spark, df, entries=8).collect()
    eight = sorted(((r["vec_id"], r["embedding"], r["label"]) for r in df.collect() if r["embedding"] and len(r["embedding"]) == 8 and all(c is not None and math.isfinite(c) for c in r["embedding"])), key=lambda r: (r[0] is None, r[0], r[1]))
    codes, errors, sha = plain_codes(np.array([r[1] for r in eight], np.float64), 8)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["codebooks_sha256"]) for r in got if r["vec_id"] not in (204, 205, 206)), key=str) == sorted(((r[0], c, e, sha) for r, c, e in zip(eight, codes, errors, strict=True)), key=str)
    assert {(r["vec_id"], r["code"][:2], r["error"]) for r in got if r["vec_id"] in (204, 205, 206)} == {(204, "00", 0), (205, "00", 0), (206, "00", 0)}
    none = [r for r in got if r["vec_id"] in (None, 205)]
    assert len(none) == 2 and len({r["label_error"] for r in none}) == 1, "rows without a label together"
    assert compress(spark, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        compress(spark, df, entries=300)


def test_codes_of_enormous_numbers(spark):
    vectors = [[1e14, 1.0, 2.0, 3.0], [1e14 + 1, 1.0, 2.0, 3.0], [-1e14, 1.0, 2.0, 3.0], [1e30, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame([(i, v, "a") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["code"], r["error"]) for r in compress(spark, df, entries=1, rounds=0).collect()}
    assert got[0] == ("00000000", 0) and got[1] == ("00000000", 1024 * 1024) and got[2] == ("00000000", None)


@pytest.mark.parametrize(("width", "subtree"), [(1, 4), (3, 1), (6, 16), (6, 10_000)])
def test_trie(width, subtree):
    x = np.random.default_rng(width).integers(-2, 3, (1500, width))
    held, depth, place = sorted_distinct(x)
    assert (held[place] == x).all() and sorted(map(tuple, held.tolist())) == list(map(tuple, held.tolist()))
    codes, errors = Trie(x[:60].copy(), subtree).nearest(held, depth)
    far = ((held[:, None] - x[:60][None]) ** 2).sum(axis=2)
    assert (far.argmin(axis=1) == codes).all() and far.min(axis=1).tolist() == errors
