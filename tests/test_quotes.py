import html
import random

from tallyloom.operators.quotes import contained
from tallyloom.plans import texts
from tallyloom.plans.base import writer


def whole(x):
    return "".join(html.unescape(x).split())


def brute(docs, items):
    return sorted({(d, i) for d, text in docs for i, quote in items if text and quote and whole(quote) and whole(quote) in whole(text)}, key=str)


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 8))) for _ in range(60)] + ["数据", "引用。", "a&amp;b", "😀", "x\u0085y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 200)))) for i in range(60)]
    items = []
    for i in range(120):
        text = rng.choice(docs)[1]
        at = rng.randrange(len(text))
        items.append((f"q{i}", text[at : at + rng.choice([1, 2, 3, 5, 9, 20, 33, 63, 64, 65, 128, 500])]))
    same = "An opening that many share, of well over forty characters. "
    docs += [(100, same + "Then one end."), (101, None), (102, ""), (None, items[0][1]), (103, items[1][1]), (103, items[2][1])]
    items += [("own", same + "Then another end."), ("mid", "any share, of well over forty chara"), ("none", None), ("empty", " \n"), ("mid", "Then one end."), ("stop", "No. 5. Then")]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = contained(spark, frame(docs, "doc_id long, text string"), frame(items, "item_id string, text string"), writer(spark))
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    assert sorted(got, key=str) == brute(docs, items)
    assert (100, "own") not in got and (100, "mid") in got


def test_query_on_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{d}/{name}.parquet").collect()]
    got = sorted((tuple(r) for r in texts.quote_containment(spark, d).collect()), key=str)
    assert got == brute(rows("documents", "doc_id"), rows("benchmark", "item_id"))
