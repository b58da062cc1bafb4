import numpy as np

from tallyloom.llm import vector_dedup as v


def brute(rows, cosine=0.9):
    usable = [x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x) and any(x) for _, x in rows]
    n = [0] * len(rows)
    label = list(range(len(rows)))
    unit = {i: np.array(x) / np.linalg.norm(x) for i, (_, x) in enumerate(rows) if usable[i]}
    pairs = []
    for i in unit:
        for j in unit:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i], n[j] = n[i] + 1, n[j] + 1
                pairs.append((i, j))
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[label[i]] = min(name, least.get(label[i], name))
    return [(name, n[i], least.get(label[i], name), name == least.get(label[i], name)) for i, (name, _) in enumerate(rows)]


def sample():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(40):
        base = rng.standard_normal(32)
        rows += [(len(rows) * 13 % 5000 + k, (base + rng.standard_normal(32) * 0.2 * k / 3).tolist()) for k in range(5)]
    hot = rng.standard_normal(32)
    rows += [(6000 + i, (hot + rng.standard_normal(32) * 0.05).tolist()) for i in range(150)]
    rows += [(7000 + i, hot.tolist()) for i in range(20)]
    rows += [(8000, None), (8001, []), (8002, [0.0] * 32), (8003, [float("nan")] + [1.0] * 31), (8004, [None] + [1.0] * 31), (8005, [1.0, 2.0]), (8006, [2.0, 4.0]), (None, hot.tolist()), (8007, (hot * 1e200).tolist()), (8008, [float("inf")] * 32)]
    return [*list({r[0]: r for r in rows}.values()), (7003, hot.tolist()), (8000, None), (8000, None)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(v, "SLICE_ROWS", 40)
    rows = sample()
    safe = [(i, [c / 1e200 for c in x] if i == 8007 else x) for i, x in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in v.link_vectors(spark, df).collect()), key=str)
    want = sorted(brute(safe), key=str)
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 0.02 * len(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert v.link_vectors(spark, df.limit(0)).count() == 0


def test_a_hot_cluster_is_compared_in_bins_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(v, "SLICE_ROWS", 32)
    monkeypatch.setattr(v, "BIN_ROWS", 500)
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(16)
    rows = [(i, (hot + rng.standard_normal(16) * 0.03).tolist()) for i in range(400)] + [(1000 + i, rng.standard_normal(16).tolist()) for i in range(100)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in v.link_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = sorted(brute(rows))
    assert got[:400] == want[:400] and got[0][1] == 399


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = v.unit(rng.standard_normal((800, 64)))
    r = rng.standard_normal(a.shape)
    r = v.unit(r - (r * a).sum(axis=1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * r
    for n in (1_000, 50_000, 1_000_000):
        code = v.ProductCode(64, n, 0.9)
        met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(code.decode(a), code.decode(b), strict=True)]
        assert np.mean(met) >= 0.97


def test_query_on_embeddings(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in v.op9_embedding_near_dedup(spark, d).collect()]
    assert sorted(got) == sorted(brute(rows))
