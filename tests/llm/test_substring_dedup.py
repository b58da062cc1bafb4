"""Substring dedup against a brute force that parts sentences, builds all runs and compares them by itself."""

import random

import pytest

from tallyloom.llm import substring_dedup as s

SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def cut_after(text, marks, tight):
    """Pieces of a text, each with the white space after it: cut behind marks before white space, and behind tight ones."""
    out, piece, i = [], "", 0
    while i < len(text):
        piece += text[i]
        i += 1
        if piece[-1] in marks and text[i : i + 1] in SPACE and i < len(text) or piece[-1] in tight:
            while i < len(text) and text[i] in SPACE:
                piece += text[i]
                i += 1
            out.append(piece)
            piece = ""
    return [*out, piece]


def pieces(text):
    """Sentences, long ones clause by clause, as (text with the white space after it, normal form)."""
    out = []
    for line in (text + "\0").replace("\n", "\n\0").split("\0")[:-1]:
        for sentence in cut_after(line, ".!?…", "。！？"):
            parts = [sentence]
            if len(sentence.rstrip(SPACE)) > s.LONG_SENTENCE:
                parts = cut_after(sentence, ",;:", "，；：、")
            for p in parts:
                out.append([p, " ".join(p.lower().split())])
    # White space alone belongs to the piece before.
    merged = []
    for p, norm in out:
        if norm or not merged:
            merged.append([p, norm])
        else:
            merged[-1][0] += p
    return merged


def runs(norms):
    for a in range(len(norms)):
        for b in range(a + s.RUN - 1, len(norms)):
            if sum(map(len, norms[a : b + 1])) >= s.MIN_CHARS:
                yield a, b, tuple(norms[a : b + 1])


def least_runs(norms):
    """Of all runs those that hold no other of the same first or last sentence; they cover what all cover."""
    for a, b, run in [x for i in range(len(norms)) for x in (shortest(norms, i, 1), shortest(norms, i, -1)) if x]:
        yield a, b, run


def shortest(norms, at, step):
    end, size, n = at, 0, 0
    while 0 <= end < len(norms):
        size, n = size + len(norms[end]), n + 1
        if n >= s.RUN and size >= s.MIN_CHARS:
            a, b = min(at, end), max(at, end)
            return a, b, tuple(norms[a : b + 1])
        end += step
    return None


def brute(rows, runs=runs):
    """Texts of ordered (id, text) rows without the sentences of any run that an earlier row or place has."""
    seen, out = set(), []
    for i, text in rows:
        gone, parts = set(), pieces(text or "")
        head = parts[0][0] if parts and not parts[0][1] else ""
        parts = [p for p in parts if p[1]]
        for a, b, run in sorted(set(runs([p[1] for p in parts]))):
            if run in seen:
                gone |= set(range(a, b + 1))
            seen.add(run)
        new = (head + "".join(p for k, (p, _) in enumerate(parts) if k not in gone)).rstrip() if gone else text
        out.append((i, new, len(gone)))
    return out


def sentence(rng, least=4, most=14, alphabet="abcdefgh"):
    return ", ".join(" ".join("".join(rng.choices(alphabet, k=rng.randint(2, 9))) for _ in range(rng.randint(least, most) // 2 + 1)) for _ in range(rng.randint(1, 2))).capitalize() + rng.choice([". ", "! ", "?\n"])


def sample():
    rng = random.Random(2)
    passage = "".join(sentence(rng) for _ in range(8))
    docs = [(i, "".join(sentence(rng) for _ in range(rng.randint(0, 9))) + (passage if i % 3 == 0 else "") + "".join(sentence(rng) for _ in range(4))) for i in range(40)]
    long = "".join(sentence(rng) for _ in range(60))
    return docs + [(50, None), (51, ""), (53, "word " * 4000), (54, long), (55, long.upper()), (56, " \n  " + docs[3][1])], passage


def removed(spark, rows, schema="doc_id long, text string"):
    return s.drop_repeated_spans(spark, spark.createDataFrame(rows, schema), removed_col="gone")


def test_equals_brute_force(spark):
    rows, passage = sample()
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], "doc_id long, text string, key string, h1 int, key_ string, marks_ string, ROW_KEY int")
    out = s.drop_repeated_spans(spark, docs, removed_col="gone")
    assert out.columns == [*docs.columns, "gone"]
    got = sorted((r.doc_id, r.text, r.gone) for r in out.collect() if r.text is not None)
    want = brute(rows)
    assert got == sorted(w for w in want if w[1] is not None)
    assert sum(w[2] > 0 for w in want) > 12
    assert [r[0] for r in got if passage.strip()[40:-40] in r[1]] == [0]
    assert all(r[2] == 0 for r in got if r[0] < 40 and r[0] % 3)
    assert s.drop_repeated_spans(spark, docs.limit(0)).count() == 0


def test_all_runs_of_many_mixed_passages(spark):
    rng = random.Random(5)
    passages = ["".join(sentence(rng, 1, 9) for _ in range(rng.randint(3, 12))) for _ in range(30)]
    docs = [(i, "".join(rng.choice(passages) if rng.random() < 0.4 else sentence(rng, 1, 9) for _ in range(8))) for i in range(60)]
    want = brute(docs)
    assert sum(w[2] > 0 for w in want) > 20
    assert sorted((r.doc_id, r.text, r.gone) for r in removed(spark, docs).collect()) == want


def test_short_last_sentences_of_a_passage_go(spark):
    passage = "A first sentence that is long enough to stand alone in here. " + "Another one that is of much the same length as the first. " + "And then a short ending."
    docs = [(1, passage + "\nOnly in the first."), (2, passage + "\nOnly in the second.")]
    assert {r.doc_id: r.text for r in removed(spark, docs).collect()} == {1: docs[0][1], 2: "Only in the second."}


def test_only_whole_sentences_and_clauses_go(spark):
    short = "Here is one sentence of the passage, as long as it has to be. And here is the second one that everybody quotes. "
    long = "Here is one sentence of the other passage, which is a good deal longer than it would have to be, so that it is read clause by clause. And here is the second one. "
    docs = [(1, short + long + "End of it."), (2, "Somebody wrote down without a stop " + short + "End of the matter."), (3, "Somebody else wrote down without a stop " + long + "End of the matter."), (4, "New. " + short + "Last.")]
    got = {r.doc_id: r.text for r in removed(spark, docs).collect()}
    assert got[2] == docs[1][1]
    assert got[3] == "Somebody else wrote down without a stop Here is one sentence of the other passage, End of the matter."
    assert got[4] == "New. Last."


def test_cjk_sentences(spark):
    same = "".join(f"第{i}条规定的内容应当在所有文件中保持完全一致并且可以追溯到原始材料以便复核。" for i in range(6))
    docs = [(7, "甲方独有的开头内容在这里单独写明并且不与其他任何文件相同也不会重复出现。" + same), (8, "乙方独有的开头内容在另外的地方写明同样不与其他任何文件相同也不会重复。" + same)]
    got = {r.doc_id: r.text for r in removed(spark, docs).collect()}
    assert got == {7: docs[0][1], 8: "乙方独有的开头内容在另外的地方写明同样不与其他任何文件相同也不会重复。"}


@pytest.mark.parametrize("ids", [[None, None, None, None], [5, 5, 5, 5], [None, 5, 5, 2**62 + 1]])
def test_rows_without_an_id_of_their_own_are_ordered_by_row(spark, ids):
    passage = "This is a passage that many of the rows have in common with others. It has two sentences, both of some length. "
    rows = [(3, "Alone. " + passage), *((i, f"Row {n} here. " + passage) for n, i in enumerate(ids))]
    got = removed(spark, rows).collect()
    assert len(got) == 5 and sum(passage.strip() in r.text for r in got) == 1
    assert next(r.gone for r in got if r.doc_id == 3) == 0
    same = removed(spark, [(i, passage) for i in ids]).collect()
    assert sorted(r.text for r in same) == ["", "", "", passage]


@pytest.mark.parametrize("kind,ids", [("string", ["b-1", "a-2", "a-2", None]), ("decimal(20,2)", [1, 2, 2, None])])
def test_ids_of_other_types(spark, kind, ids):
    import decimal

    ids = [decimal.Decimal(i) if isinstance(i, int) else i for i in ids]
    passage = "This is a passage that many of the rows have in common with others. It has two sentences, both of some length."
    got = removed(spark, [(i, passage) for i in ids], f"doc_id {kind}, text string").collect()
    assert sorted(r.text for r in got) == ["", "", "", passage]
    assert next(r.text for r in got if r.doc_id == ids[0]) == passage


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    small = [r for r in rows if len(r[1] or "") < 6000]
    ids = {i for i, _ in small}
    docs = spark.read.parquet(f"{d}/documents.parquet").where(f"doc_id in ({','.join(map(str, ids))})")
    got = sorted((r.doc_id, r.text, r.gone) for r in s.drop_repeated_spans(spark, docs, removed_col="gone").collect())
    assert got == brute(small)
    assert got == brute(small, least_runs)
    full = {r.doc_id: r for r in s.op1_substring_dedup(spark, d).collect()}
    assert len(full) == len(rows)
    # Nothing but whole pieces goes, and what stays has no repeat left between different documents' kept copies.
    for i, text in rows:
        have = [p for p in pieces(text or "") if p[1]]
        assert len(have) >= full[i].n_removed
        if not full[i].n_removed:
            assert full[i].text == text
