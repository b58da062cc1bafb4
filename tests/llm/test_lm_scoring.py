import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import lm_scoring as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")) + [None]


def brute(rows):
    docs = [(i, split(t), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, bool((t or "").encode().strip()) and zlib.crc32((t or "").encode()) % lm.DEV == 0) for i, t in rows]

    def ngrams(chosen):
        one, two = Counter(), Counter()
        for _, w, _, _ in chosen:
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
        return one, two

    one, two = ngrams([d for d in docs if not d[2]])
    n, v = sum(one.values()), len(one)
    bucket = lambda c: 1 + int(math.log2(c)) if c > 0 else 0
    # The weights are learned on one fold of training documents, from the counts of all others.
    one_, two_ = ngrams([d for d in docs if not d[2] and not d[3]])
    dev = ngrams([d for d in docs if not d[2] and d[3]])[1]
    n_ = sum(one_.values())
    weights = {b: np.full(3, 1 / 3) if n_ and dev else np.array([0, 0.5, 0.5] if n else [0, 0, 1.0]) for b in range(64)}
    before = -math.inf
    for _ in range(lm.MAX_ROUNDS if n_ and dev else 0):
        sums, gain, many = {}, 0.0, 0
        for (a, b), times in dev.items():
            c = one_[a]
            p = weights[bucket(c)] * np.array([two_[a, b] / max(c, 1), one_[b] / n_, 1 / (v + 1)])
            sums[bucket(c)] = sums.get(bucket(c), 0) + times * p / p.sum()
            gain, many = gain + times * math.log(p.sum()), many + times
        seen = sorted(sums)
        for k in weights:
            low = [s for s in seen if s <= k]
            weights[k] = sums[low[-1]] / sums[low[-1]].sum() if low else np.array([0, 0.5, 0.5])
        if gain / many - before < lm.ENOUGH:
            break
        before = gain / many
    out = []
    for i, w, held, _ in docs:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(weights[bucket(one[a])] @ np.array([two[a, b] / max(one[a], 1), one[b] / max(n, 1), 1 / (v + 1)])) for a, b in zip([None, *w[:-1]], w, strict=True))
        out.append((i, held, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def compare(df, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in df.collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    df = lm.op6_lm_scoring(spark, d)
    compare(df, rows)
    held = [r for r in df.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


ROWS = [(1, "The cat sat"), (2, "the CAT ran on the mat"), (3, None), (4, ""), (None, "the dog"), (5, "a " * 3000), (5, "a " * 3000), (6, "cat\x0bsat\x85x")] + [(i, f"the cat {i % 5} sat") for i in range(10, 60)]


@pytest.mark.parametrize("chunk_bytes,ranges,group,fan", [(64, 3, 4, 2), (64, 5, 1, 3), (256, 1024, 1024, 64), (6 << 20, 1024, 1024, 64)])
def test_edges(spark, monkeypatch, chunk_bytes, ranges, group, fan):
    # Small groups of chunks make the sums climb a tree of several levels.
    for name, value in (("CHUNK_BYTES", chunk_bytes), ("RANGES", ranges), ("GROUP", group), ("FAN", fan)):
        monkeypatch.setattr(lm, name, value)
    rows = ROWS + [(i, f"one {i % 11} two {i % 3}") for i in range(100, 130)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, chunk int, times int, row_key int")
    compare(lm.score_documents(spark, docs), rows)


def test_empty_tables_and_tables_without_a_fold(spark):
    docs = spark.createDataFrame(ROWS[:1], "doc_id long, text string")
    assert lm.score_documents(spark, docs.limit(0)).count() == 0
    compare(lm.score_documents(spark, docs), ROWS[:1])
    compare(lm.score_documents(spark, spark.createDataFrame([(9, None)], "doc_id long, text string")), [(9, None)])


def test_many_empty_texts_teach_nothing(spark):
    words = [(i, "word " * 50 + f"{i % 3}") for i in range(40)]
    rows = [(i + 1000, None if i % 2 else " ") for i in range(400)] + words
    df = lm.score_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    compare(df, rows)
    assert all(r.score > r.base_score for r in df.where("doc_id < 1000").collect())


def test_one_very_long_word_and_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 4096)
    rows = [(1, "x" * 300_000), (2, "y " + "z" * 100_000)] + [(None, "same text in a third of all rows")] * 40 + [(i, f"text {i} of others") for i in range(10, 60)]
    df = lm.score_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    compare(df, rows)


def test_a_fold_of_documents_keeps_copies_on_one_side():
    # With the copy of a text among the counts the bigrams would explain it; the fold goes by the text itself.
    assert len({lm.is_dev(b"a text that occurs often") for _ in range(9)}) == 1
    assert not lm.is_dev(b"") and not any(lm.is_dev(b" " * i + b"\n") for i in range(99))
    assert 50 < sum(lm.is_dev(str(i).encode()) for i in range(1000)) < 250
