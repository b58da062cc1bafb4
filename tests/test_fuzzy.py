import difflib
import random

import pytest

from tallyloom.functions import text
from tallyloom.plans import texts


def brute(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@pytest.mark.parametrize("cells", [text.RUN_CELLS, 500])
def test_ratio_equals_difflib_over_all_characters(monkeypatch, cells):
    monkeypatch.setattr(text, "RUN_CELLS", cells)
    rng = random.Random(1)
    assert text.whole_ratio("", "") == 1.0 and text.whole_ratio("a", "") == 0.0
    for _ in range(60):
        a = "".join(rng.choices("abcdé数😀"[: rng.randint(1, 7)], k=rng.randint(0, 300)))
        b = a[rng.randint(0, 40) :] if rng.random() < 0.4 else "".join(rng.choices("abcdé数😀", k=rng.randint(0, 300)))
        assert text.whole_ratio(a, b) == brute(a, b)


def test_whole_turns_are_compared(spark, tmp_path):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    same = word(130)
    turns = {1: (same + word(400), same + word(300)), 2: (word(130) + same * 3, word(130) + same * 3), 3: (word(700), None)}
    rows = [(k, i, role, x) for k, pair in turns.items() for i, (role, x) in enumerate(zip(("user", "assistant"), pair, strict=True))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.ratio for r in texts.fuzzy_match(spark, str(tmp_path)).collect()}
    assert got == {k: round(brute(*turns[k]), 6) for k in (1, 2)}
    assert got[1] < 1.0
