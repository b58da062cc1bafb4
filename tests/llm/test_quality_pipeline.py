import math
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyloom.llm import quality as q

NICE = "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were".split()


def text(rng, n=60, extra=()):
    words = [rng.choice(NICE) if rng.random() < 0.5 else "".join(rng.choices("aeioubcdlmnprst", k=rng.randint(3, 8))) for _ in range(n)]
    for w in extra:
        words[rng.randrange(n)] = w
    return " ".join(words) + "."


def corpus():
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(300):
        kind = i % 10
        if kind == 8:
            t = "%% ".join(text(rng).split()) + "%%"
        elif kind == 9:
            t = text(rng, extra=rng.sample(["zorgly", "idiot", "blarfs"], 2))
        else:
            t = text(rng)
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        if i % 2 == 0 or kind == 9:
            labels.append((i, 0 if kind == 8 else 1, 1 if kind == 9 else 0))
    docs += [(1000, None, "en", "s", 0), (1001, "", None, None, None), (None, text(rng), "en", "s", 1), (1002, docs[9][1], "en", "s", 1), (1002, docs[9][1], "en", "s", 1), (1003, docs[8][1] * 200, "xx", "s", 1), (1004, "Is.", "en", "s", 3)]
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def test_toxic_and_junk_go_and_clean_ones_stay(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*labels, labels[0], (None, 0, 1)], LABELS)
    got = q.classify(d, lab).collect()
    assert len(got) == len(docs)
    wrong = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.kept != (r.doc_id % 10 < 8)]
    assert len(wrong) <= 3
    assert all(not r.kept for r in got if r.doc_id in (1002, 1003)) and all(r.kept for r in got if r.doc_id in (1000, 1001, 1004, None))
    kept = q.keep_good(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in got)
    assert q.classify(d.limit(0), lab).count() == 0
    assert q.classify(d, lab.limit(0)).count() == len(docs)


def test_label_model_finds_good_and_bad_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    patterns = {}
    for t in truth:
        vote = lambda right: int(t) if rng.random() < right else 1 - int(t)
        key = (vote(0.9), vote(0.85), vote(0.5), q.NONE if rng.random() < 0.9 else int(t))
        patterns[key] = patterns.get(key, 0) + 1
    post = q.label_model(patterns, 3)
    assert post[1, 1, 0, q.NONE] > 0.9 and post[0, 0, 1, q.NONE] < 0.1


def brute_em(docs, given):
    """The label model by plain loops over documents, a document at a time."""
    voters, beliefs = len(docs[0]), []
    for votes in docs:
        x = sum((4.0 if v == given else 0.7) * (2.0 if votes[v] == 1 else -0.5 if votes[v] == 0 else 0.0) for v in range(voters))
        beliefs.append(min(0.98, max(0.02, 1 / (1 + math.exp(-x)))))
    for _ in range(100):
        prior = (sum(beliefs) + 1) / (len(docs) + 2)
        chance = []
        for v in range(voters):
            right, wrong = (3, 0.5) if v == given else (0.5, 0.5)
            table = []
            for answer in (0, 1):
                add = [wrong, right] if answer else [right, wrong]
                mass = [add[x] + sum(b if answer else 1 - b for b, votes in zip(beliefs, docs, strict=True) if votes[v] == x) for x in (0, 1)]
                table.append([m / sum(mass) for m in mass])
            chance.append(table)
        new = []
        for votes in docs:
            odds = [1 - prior, prior]
            for v, x in enumerate(votes):
                if x != q.NONE:
                    odds = [odds[a] * chance[v][a][x] for a in (0, 1)]
            new.append(odds[1] / sum(odds))
        moved, beliefs = max(abs(a - b) for a, b in zip(new, beliefs, strict=True)), new
        if moved < 1e-6:
            break
    return beliefs


def simulated(n, accuracy, given_share, given_right, seed):
    rng = np.random.default_rng(seed)
    truth, docs = rng.random(n) < 0.3, []
    for t in truth:
        vote = lambda right: int(t) if rng.random() < right else 1 - int(t)
        docs.append((*(q.NONE if rng.random() < 0.2 else vote(a) for a in accuracy), vote(given_right) if rng.random() < given_share else q.NONE))
    return truth, docs


def test_label_model_equals_plain_loops():
    _, docs = simulated(500, (0.9, 0.8, 0.6), 0.3, 0.9, 1)
    post = q.label_model(Counter(docs), 3)
    assert np.allclose([post[d] for d in docs], brute_em(docs, 3), atol=1e-5)


def test_posteriors_are_better_than_few_and_partly_wrong_labels():
    truth, docs = simulated(4000, (0.9, 0.88, 0.85, 0.8), 0.1, 0.75, 2)
    post = q.label_model(Counter(docs), 4)
    given = [(d[4], post[d] >= 0.5, t) for d, t in zip(docs, truth, strict=True) if d[4] != q.NONE]
    labels_right, posterior_right = np.mean([g == t for g, _, t in given]), np.mean([p == t for _, p, t in given])
    assert labels_right < 0.8 and posterior_right > labels_right + 0.1
    assert np.mean([(post[d] >= 0.5) == t for d, t in zip(docs, truth, strict=True)]) > 0.9


def test_without_the_label_model_the_scorer_is_worse(spark, monkeypatch):
    # A tenth of the documents has a label, a quarter of these labels is wrong: weights taught by the labels alone follow them.
    rng = random.Random(4)
    docs, labels, truth = [], [], {}
    for i in range(600):
        truth[i] = i % 4 == 0
        docs.append((i, "%% ".join(text(rng).split()) + "%%" if truth[i] else text(rng)))
        if i % 10 < 2:
            labels.append((i, int(truth[i]) if rng.random() < 0.25 else 1 - int(truth[i]), 0))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    right = lambda: np.mean([(r.p_junk >= 0.5) == truth[r.doc_id] for r in q.classify(d, lab).collect()])
    with_model = right()
    monkeypatch.setattr(q, "label_model", lambda patterns, given: {k: 0.5 if k[given] == q.NONE else float(k[given]) for k in patterns})
    without = right()
    assert with_model > 0.97 and without < with_model - 0.05, (with_model, without)


def test_clashing_columns_long_texts_and_hot_ids(spark):
    docs, labels = corpus()
    rows = [(*d, 1, 2, "w") for d in docs] + [(2, docs[2][1], "en", "s", 1, 1, 2, "w")] * 200 + [(None, "x " * 200_000, "en", "s", 1, 1, 2, "w")] * 2 + [(5000, "z" * 300_000, "en", "s", 1, 1, 2, "w")]
    d = spark.createDataFrame(rows, DOCS + ", quality int, toxic int, row_key string")
    lab = spark.createDataFrame([(*x, "y") for x in labels], LABELS + ", text string")
    got = q.classify(d, lab).collect()
    assert len(got) == len(rows) and len({(r.p_junk, r.kept) for r in got if r.doc_id == 2}) == 1
    kept = q.keep_good(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in got)


@pytest.mark.parametrize("size", ["sf0.01"])
def test_held_out_accuracy(spark, size):
    d = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    known = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    got = {r.doc_id: r.kept for r in q.classify(docs, labels.where("doc_id % 3 > 0")).collect()}
    held = [i for i in known if i % 3 == 0]
    assert np.mean([got[i] == known[i] for i in held]) >= 0.9


def test_pipeline_keeps_its_promises(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    frames, now = {}, docs
    from tallyloom.llm.common import stored

    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(spark, stage(spark, now, d), "test")
        assert now.columns == docs.columns
        frames[name] = {r.doc_id: r.text for r in now.collect()}
    from tests.llm.test_contamination import brute as contaminated
    from tests.llm.test_near_dedup import brute as near
    from tests.llm.test_substring_dedup import brute as repeats
    from tests.llm.test_substring_dedup import least_runs

    kept = sorted(frames["quality_classifier"].items())
    one = {r[0] for r in near(kept) if r[3]}
    assert set(frames["minhash_near_dedup"]) == one
    want = {i: t for i, t, _ in repeats(sorted(frames["minhash_near_dedup"].items()), least_runs)}
    assert frames["substring_dedup"] == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    before = {r[0]: r[5] for r in contaminated(sorted(want.items()), items)}
    assert not any(r[5] for r in contaminated(sorted(frames["benchmark_decontamination"].items()), items))
    assert all(frames["benchmark_decontamination"][i] == t for i, t in want.items() if not before[i])
    from tests.llm.test_tokens_packing import check_packing

    check_packing(corpus_pipeline.packing(spark, now, d).collect(), sorted(frames["benchmark_decontamination"].items()), 4096)


def test_without_the_pipeline_files_the_entry_still_imports():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()


def test_stages_on_odd_rows(spark, tmp_path):
    docs, labels = corpus()
    passage = "This is a passage that many of the rows have in common with others. It has two sentences, both of some length, and more words than that. "
    item = "zero one two three four five six seven eight nine ten"
    docs += [(2000 + i, f"{text(random.Random(i))} {passage}", "en", "s", 1) for i in range(3)] + [(2010, f"{text(random.Random(77))} {item} {text(random.Random(78))}", "en", "s", 1), (None, None, None, None, None), (None, None, None, None, None), (2011, "w" * 50_000, "en", "s", 1)]
    extra = ", quality int, text_ string, row_key string, key string, touched int, n_shingles int, marks string"
    frame = spark.createDataFrame([(*d, 1, "t", "r", "k", 2, 3, "m") for d in docs], DOCS + extra)
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (frame, frame.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            path = str(tmp_path / f"{name}-{start is frame}")
            stage(spark, now, str(tmp_path)).write.parquet(path)
            now = spark.read.parquet(path)
            assert now.columns == frame.columns, name
        packed = corpus_pipeline.packing(spark, now, str(tmp_path))
        rows = now.collect()
        assert packed.select("doc_id").count() >= len(rows)
        if start is not frame:
            assert not rows and packed.count() == 0
            continue
        texts = [r.text for r in rows if r.text]
        assert sum(passage.strip() in t for t in texts) == 1 and not any(item in t for t in texts)
        assert sum(r.text is None for r in rows) == 3 and [r.doc_id for r in rows if r.doc_id == 2011] == [2011]
        assert not [r for r in rows if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 10 == 8]
