import random
import re

from tallyloom.llm import near_dedup as n

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = []
    for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)):
        low = least.get(find(i))
        # Of rows without any id in reach one stays; which one is left open here.
        out.append((doc, len(s), low, doc == low if doc is not None else None, find(i)))
    return out


def compare(df, rows):
    key = lambda r: tuple(str(x) for x in r)
    got = df.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, None if r.doc_id is None else r.kept) for r in got), key=key) == sorted((r[:4] for r in brute(rows)), key=key)
    unnamed = {r[4] for r in brute(rows) if r[2] is None and r[1]}
    texts = {t for (i, t), r in zip(rows, brute(rows), strict=True) if r[4] in unnamed}
    assert sum(r.kept for r in got if r.doc_id is None and r.n_shingles) <= max(len(texts), len(unnamed))
    assert all(r.kept for r in got if not r.n_shingles and r.component_id == r.doc_id)



def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(6):
        base = rng.choices(vocab, k=rng.randint(60, 140))
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 1000, " ".join(words)))
    rows += [(2000 + i, " ".join(rng.choices(vocab, k=50))) for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "A b"), (3004, "a  B"), (3005, "a b c"), (None, rows[0][1]), (3006, rows[0][1].upper()), rows[1], (3007, "x " * 20000), (3008, "x " * 9)]
    docs = spark.createDataFrame([(*r, 1, "f", 1, 2, 3, 4, "k") for r in rows], "doc_id long, text string, node int, fp string, n_shingles int, kept_id int, kept_key int, nth_ int, row_key string")
    compare(n.near_duplicates(spark, docs), rows)
    assert n.near_duplicates(spark, docs.limit(0)).count() == 0
    kept = n.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    full = brute(rows)
    want = {(r[0], t) for r, (_, t) in zip(full, rows, strict=True) if r[3] or r[0] is None and not r[1]}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rows_without_ids_and_repeated_rows(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    near = a + " more"
    rows = [(None, a, 1), (None, near, 2), (None, b, 3), (None, b, 4), (7, b + " more", 5), (9, a + " and", 6), (None, "only one here", 7), (None, "only one here", 8), (None, "only one here", 7), (None, None, 9), (None, " ", 9), (4, "same id", 1), (4, "same id", 2), (4, "same id", 2), (4, "another text of that id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = {(r.doc_id, r.text, r.extra) for r in n.drop_near_duplicates(spark, docs).collect()}
    assert n.drop_near_duplicates(spark, docs).count() == len(got)
    assert {r[:2] for r in got} == {(7, b + " more"), (9, a + " and"), (None, "only one here"), (None, None), (None, " "), (4, "same id"), (4, "another text of that id")}
    alone = [(None, a, 1), (None, near, 2)]
    assert n.drop_near_duplicates(spark, spark.createDataFrame(alone, "doc_id long, text string, extra int")).count() == 1
    marks = n.near_duplicates(spark, spark.createDataFrame(alone, "doc_id long, text string, extra int")).collect()
    assert [r.component_id for r in marks] == [None, None] and sum(r.kept for r in marks) == 1
    strings = spark.createDataFrame([("b", a), ("a", near), (None, a), ("c", b)], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in n.near_duplicates(spark, strings).collect()) == [("None", "a", False), ("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_hot_copies_are_joined_by_broadcast_and_the_rest_by_shuffle(spark, monkeypatch):
    from tallyloom.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 4)
    hot = " ".join(f"w{i}" for i in range(30))
    rows = [(i, hot if i % 2 else " ".join(f"u{i // 6}x{j}" for j in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(n.near_duplicates(spark, docs), rows)
    assert sorted(r.doc_id for r in n.drop_near_duplicates(spark, docs.union(docs)).collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_blocks_reach_members_that_their_leader_misses(spark, monkeypatch):
    monkeypatch.setattr(n, "SLICE_ROWS", 4)
    base = [f"w{i}" for i in range(100)]
    # A chain: each text differs a little from the one before, far ones a lot.
    rows = [(i, " ".join([f"x{j}" for j in range(2 * i)] + base[2 * i :])) for i in range(30)]
    compare(n.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    df = n.op7_minhash_near_dedup(spark, d)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    compare(df, rows)
