import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import packing, pretokens, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "A", "é", "É", "É", "İ", "Σ", "ß", "²", "1", "'s", "'ll", " ", "\t", "\x85", "\xa0", "漢字", "!", "'", "<|endoftext|>", "<|", "\x1c", "\x00", "𝔸", "🙂", "ªº", "Ǆ", "\n", "the", "aaaa"]


def library_ids(text):
    return pretokens.library(PATH).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ALPHABET), st.text(max_size=3)), max_size=40).map("".join))
def test_counts_and_ids_are_the_library_s(text):
    want = library_ids(text)
    assert token_counts.count_batch([text], PATH)[0] == [len(want)]
    assert packing.token_ids([text], PATH)[0].tolist() == want


def test_long_words():
    for text in ("a" * 4000, "ab" * 3000, "!" * 999, "thethe" * 500):
        assert token_counts.count_batch([text], PATH)[0] == [len(library_ids(text))]


def test_a_very_long_word_takes_time_by_its_length():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "x" * 100_001, "aab" * 2777, "".join(rng.choice(["the", "ing", "tion", "a", "aa"]) for _ in range(4000))]
    start = time.process_time()
    got = token_counts.count_batch(words, PATH)[0]
    assert time.process_time() - start < 10
    assert got == [len(library_ids(w)) for w in words]
    assert [len(x) for x in packing.token_ids(words, PATH)] == got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "the", "in", "g", "é", "ion"]), min_size=1, max_size=60).map("".join))
def test_long_and_short_words_are_merged_alike(word):
    merger = token_counts.merger(PATH)
    assert merger.long_count(word.encode()) == len(library_ids(word))


ROWS = [(1, "Hello there, world", "x"), (2, None, "x"), (3, "", None), (None, "same text", "y"), (5, "the " * 9000, "y"), (5, "the " * 9000, "y")]
SCHEMA = "doc_id long, text string, length string"


def test_token_counts_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = token_counts.token_counts(docs, PATH).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((len((t or "").encode()), len(library_ids(t or "")), len(library_ids(t or "")) > 2048) for _, t, _ in ROWS)
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0


def check_packing(rows, texts, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for doc, text in texts:
        ids = [*library_ids(text or ""), 1]
        for k, i in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[i : i + capacity], "<u4")
            want.append((doc or -1, k, i, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    return len(sequences)


def test_packing_round_trip(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    n = check_packing(packing.pack(spark, docs, PATH).collect(), [(a, b) for a, b, _ in ROWS], 4096)
    assert n == 5
    assert packing.pack(spark, docs.limit(0), PATH).count() == 0


def test_packing_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 16)
    docs = [(None, None)] * 300 + [(3, "same text")] * 200 + [(i, f"text {i}") for i in range(10)] + [(99, "y" * 120_000)]
    rows = packing.pack(spark, spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()
    check_packing(rows, docs, 4096)


def test_packing_of_documents_is_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(spark, docs, PATH).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 2


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, [65, 40, 30, 64][seed], 700), return_counts=True)), strict=True))
    left = dict(lengths)
    for times, parts in packing.plan(lengths, 64):
        assert times > 0 and sum(a * n for a, n in parts) <= 64
        for a, n in parts:
            left[a] -= n * times
    assert not any(left.values())
    total = sum(a * n for a, n in lengths.items())
    assert sum(t for t, _ in packing.plan(lengths, 64)) <= total / 64 * 1.3 + 2


def test_complement_index_prefers_exact_fills():
    assert packing.plan({5: 2, 3: 1, 2: 3, 1: 1}, 10) == [(1, [(5, 2)]), (1, [(3, 1), (2, 3), (1, 1)])]
