"""Anchor expansion against the base patterns run as patterns, and spans that anchors add."""

import hashlib
import random
import re

import pytest

from tallyloom.llm.personal import BASE, Scan, op13_personal_data, personal_digest, personal_spans, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def check_digit(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and check_digit(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def by_patterns(text):
    return [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if holds(kind, m[0])]


def by_anchors(text):
    return [s for s in Scan(text).found() if s[0] in BASE]


def test_random_texts():
    rng = random.Random(3)
    pieces = ["@", ".", "-", "+", " ", "(", ")", "a", "Z", "_", "%", "ü", "0", "7", "255", "256", "1.2.3.4", "a@b.c", "+1 ", "4111 1111 1111 1111", "4111111111111111", "\n", "::", "٣", "x.y", "00000000000000", "tel:", "IBAN ", "://", "[at]", '"']
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 25)))
        assert by_anchors(text) == by_patterns(text), text


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op13_personal_data(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        base = by_patterns(docs[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in base) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"].startswith(joined) and (r["spans"] == joined) == (r["n_added"] == 0)
    assert sum(r["n_added"] > 0 for r in got) <= 0.01 * len(got), "the given texts hold nothing but base kinds"


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("an müller@exämple.de.", "email_wide", "müller@exämple.de"),
        ("an müller@example.de.", "email_wide", "müller@example.de"),
        ('to "jane doe"@example.org now', "email_wide", '"jane doe"@example.org'),
        ("jane.doe [at] mail [dot] example [dot] org", "email_wide", "jane.doe [at] mail [dot] example [dot] org"),
        ("jane(AT)example.org", "email_wide", "jane(AT)example.org"),
        ("see ftp://jane:pw@files.example.org/x", "address", "ftp://jane:pw@files.example.org"),
        ("see (http://10.0.0.7:8080).", "address", "http://10.0.0.7:8080"),
        ("http://[2001:db8::1]/", "address", "http://[2001:db8::1]"),
        ("IBAN: DE89 3704 0044 0532 0130 00 BITTE", "account", "DE89 3704 0044 0532 0130 00"),
        ("Account no. 12-345-678,", "account", "12-345-678"),
        ("Telefon: (030) 123 45 67.", "phone_wide", "(030) 123 45 67"),
        ("tel:555-0199-22", "phone_wide", "555-0199-22"),
    ],
)
def test_added(text, kind, found):
    spans = [(k, text[a:b]) for k, a, b in Scan(text).found() if k not in BASE]
    assert spans == [(kind, found)]


@pytest.mark.parametrize("text", ["http://example.org/a", "me@home", "IBAN DE88 3704 0044 0532 0130 00", "accountant 1234567", "discount 1234567", "account 12345", "a [at] b", "x://", "http://999.0.0.1", "Tel: 12", "1.2.3.256", "+12345", "4111 1111 1111 1112", "ü@.de", '"@a.de', "tel:", "iban", "konto:"])
def test_clean(text):
    assert Scan(text).found() == []


def test_odd_rows(spark):
    long = "a" * 400_000 + "@" + "b" * 400_000 + " " + "1" * 200_000 + "." + "+1" + " " * 300_000 + "1.2.3.4"
    rows = [(1, "x@y.zz", 5), (1, "x@y.zz", 5), (None, "x@y.zz", 6), (2, None, 7), (3, "", 8), (4, long, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["spans"]) for r in personal_digest(docs).collect()), key=str)
    assert got[:4] == [(1, 1, 0, "email:0:6"), (1, 1, 0, "email:0:6"), (2, 0, 0, ""), (3, 0, 0, "")]
    assert got[4][:3] == (4, 0, 1) and got[5] == (None, 1, 0, "email:0:6")
    short = "a" * 300 + "@" + "b" * 300 + " " + "1" * 300 + ".+1" + " " * 300 + "1.2.3.4"
    assert by_anchors(short) == by_patterns(short)
    assert personal_digest(docs.limit(0)).count() == 0
    named = docs.select(docs.doc_id.cast("string").alias("name"), docs.text.alias("body"))
    spans = {r["doc_id"]: r["spans"] for r in personal_spans(named, "name", "body").collect()}
    assert [tuple(s) for s in spans["1"]] == [("email", 0, 6)] and spans["2"] == []


def test_redact(spark):
    docs = spark.createDataFrame([(1, "an müller@example.de, 1.2.3.4 und +49 (30) 1234567!"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in redact(docs).collect()}
    assert got == {1: ("an [EMAIL], [IP] und [PHONE]!", 3), 2: ("", 0)}
    assert redact(docs, ("ip",)).first()["text"] == "an müller@example.de, [IP] und +49 (30) 1234567!"
    with pytest.raises(ValueError):
        redact(docs, ("name",))
