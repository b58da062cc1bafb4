"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, schemes, cues and joined digits, and a parser
of its own for each kind reads left and right from there and decides where the span begins, ends and whether it holds.

No text is searched for a whole pattern: a parser looks only at the characters around an anchor, and goes on behind what
the last one of its kind has read, so that the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import by_bytes, table, texts

#: Kinds in the order in which spans are listed; the first four are the base, the others what anchors add to it.
BASE = ("email", "ip", "card", "phone")
ADDED = ("email_wide", "phone_wide", "address", "account")
KINDS = BASE + ADDED
BATCH_BYTES = 4 << 20

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WIDE_DOMAIN = re.compile(r"(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)+")
_SPELLED_DOMAIN = re.compile(r"\s{0,3}((?:[^\W_]|-)+(?:(?:\s?[\[(]dot[\])]\s?|\.)(?:[^\W_]|-)+)+)", re.I)
_DOT = re.compile(r"\s?[\[(]dot[\])]\s?", re.I)
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIALLED = re.compile(r"[ ().0-9-]+")
_AUTHORITY = re.compile(r"[^\s/?#\"'<>\\,;]+")
_NUMBER = re.compile(r"[0-9](?:[ ./-]?[0-9])+")
_TO_NUMBER = re.compile(r"(?: ?(?:number|no|nr|num|núm|numéro|id)\b\.?)?\s{0,3}[:#=]?\s{0,3}(?=[+(0-9])", re.I)
_TO_IBAN = re.compile(r"(?: ?(?:number|no|nr)\b\.?)?\s{0,3}[:#=]?\s{0,3}", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")

#: Words that announce a number.
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport", "reisepass", "pasaporte", "passeport", "ssn", "social security")
PHONE_CUES = ("tel:", "phone", "telephone", "telefon", "teléfono", "téléphone", "mobile", "fax")
SPELLED_AT = ("[at]", "(at)")
_WORDS = {"account": ACCOUNT_CUES, "dial": PHONE_CUES, "spelled": SPELLED_AT, "iban": ("iban",)}


@cache
def anchors() -> ahocorasick.Automaton:
    """The automaton: every anchor gives (parser, length)."""
    found = ahocorasick.Automaton()
    for name, words in {"at": ("@",), "scheme": ("://",)}.items():
        for word in words:
            found.add_word(word, (name, len(word)))
    for name, words in _WORDS.items():
        for word in words:
            for form in (word, word.capitalize(), word.upper()):
                found.add_word(form, (name, len(form)))
    for a in _DIGITS:
        found.add_word("+" + a, ("plus", 2))
        for b in _DIGITS:
            found.add_word(f"{a}.{b}", ("dotted", 3))
            for between in ("", " ", "-"):
                found.add_word(a + between + b, ("digits", 2 + len(between)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _host(host: str) -> bool:
    """Whether a name of two or more labels could stand in the domain name system."""
    labels = host.split(".")
    return len(host) <= 253 and len(labels) > 1 and all(0 < len(x) <= 63 and x[0] != "-" != x[-1] for x in labels) and len(labels[-1]) > 1 and labels[-1].isalpha()


def _mailbox(local: str) -> bool:
    return 0 < len(local) <= 64 and "." not in (local[0], local[-1]) and ".." not in local


class Scan:
    """The spans of one text; parsers are called with the first and last character of their anchors, from left to right."""

    def __init__(self, text: str):
        self.text = text
        self.spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        self.done = dict.fromkeys(("at", "dotted", "digits"), 0)
        for end, (parser, length) in anchors().iter(text):
            getattr(self, parser)(end + 1 - length, end)

    def _left(self, at: int, least: int, good: Callable[[str], bool]) -> int:
        while at > least and good(self.text[at - 1]):
            at -= 1
        return at

    def at(self, start: int, _: int) -> None:
        """An at-sign: the mailbox to its left, not before the last address's end, and the domain to its right."""
        text, least = self.text, self.done["at"]
        first, domain = self._left(start, least, _LOCAL.__contains__), _DOMAIN.match(text, start + 1)
        plain = (first, domain.end()) if domain and first < start else None
        if plain:
            self.spans["email"].append(plain)
            self.done["at"] = plain[1]
        # The same with letters of any script, and with a quoted mailbox.
        wide = _WIDE_DOMAIN.match(text, start + 1)
        if not wide or not _host(wide[0]):
            return
        begin = self._left(start, least, lambda c: c.isalnum() or c in _LOCAL)
        good = begin < start and _mailbox(text[begin:start])
        if text[start - 1 : start] == '"' and start - 1 > least:
            begin = text.rfind('"', max(least, start - 66), start - 1)
            good = 0 <= begin < start - 2 and "\n" not in text[begin:start]
        if good and (begin, wide.end()) != plain:
            self.spans["email_wide"].append((begin, wide.end()))

    def spelled(self, start: int, end: int) -> None:
        """name [at] host [dot] org"""
        text = self.text
        right = _SPELLED_DOMAIN.match(text, end + 1)
        stop = self._left(start, max(0, start - 3), str.isspace)
        begin = self._left(stop, max(0, stop - 65), _LOCAL.__contains__)
        if right and _mailbox(text[begin:stop]) and _host(_DOT.sub(".", right[1])):
            self.spans["email_wide"].append((begin, right.end()))

    def dotted(self, start: int, _: int) -> None:
        """Numbers joined by dots: four at a time are an address."""
        if start < self.done["dotted"]:
            return
        run = _DOTTED.match(self.text, self._left(start, self.done["dotted"], _DIGITS.__contains__))
        self.done["dotted"] = run.end()
        parts = run[0].split(".")
        ends = run.start() - 1 + np.cumsum([len(p) + 1 for p in parts])
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                self.spans["ip"].append((int(ends[i]) - len(parts[i]), int(ends[i + 3])))

    def digits(self, start: int, _: int) -> None:
        """Digits with single spaces or hyphens between them: a card's, if their number and check digit are."""
        if start < self.done["digits"]:
            return
        run = _SPACED.match(self.text, start)
        self.done["digits"] = run.end()
        digits = run[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            self.spans["card"].append(run.span())

    def plus(self, start: int, _: int) -> None:
        """A plus sign and a digit: a number dialled from abroad."""
        rest = _DIALLED.match(self.text, start + 2)
        rest = rest[0].rstrip(" ().-") if rest else ""
        if len(rest) > 1 and 9 <= 1 + sum(map(str.isdigit, rest)) <= 15:
            self.spans["phone"].append((start, start + 2 + len(rest)))

    def _after(self, start: int, end: int, lead: re.Pattern) -> int | None:
        """Where what a cue announces begins; None if the cue is only part of a word."""
        before, lead_in = self.text[start - 1 : start] if start else "", lead.match(self.text, end + 1)
        return lead_in.end() if lead_in and not before.isalnum() else None

    def dial(self, start: int, end: int) -> None:
        at = self._after(start, end, _TO_NUMBER)
        run = at is not None and self.text[at] != "+" and _DIALLED.match(self.text, at)
        if run:
            number = run[0].rstrip(" ().-")
            if 7 <= sum(map(str.isdigit, number)) <= 15 and not self.text[at + len(number) : at + len(number) + 1].isalnum():
                self.spans["phone_wide"].append((at, at + len(number)))

    def account(self, start: int, end: int) -> None:
        at = self._after(start, end, _TO_NUMBER)
        run = at is not None and _NUMBER.match(self.text, at)
        if run and 6 <= sum(map(str.isdigit, run[0])) <= 20 and not self.text[run.end() : run.end() + 1].isalnum():
            self.spans["account"].append(run.span())

    def iban(self, start: int, end: int) -> None:
        at = self._after(start, end, _TO_IBAN)
        run = at is not None and _IBAN.match(self.text, at)
        # Words in capitals may follow: the longest beginning with the right check digits, at the end of a group, counts.
        for stop in range(run.end(), run.start() + 14, -1) if run else ():
            if self.text[stop - 1] != " " and not self.text[stop : stop + 1].isalnum():
                plain = self.text[at:stop].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                    self.spans["account"].append((at, stop))
                    return

    def scheme(self, start: int, end: int) -> None:
        """scheme://host: an address that names a user, or a single machine by number."""
        text = self.text
        begin = self._left(start, max(0, start - 32), lambda c: c.isascii() and (c.isalnum() or c in "+-."))
        while begin < start and not text[begin].isalpha():
            begin += 1
        authority = _AUTHORITY.match(text, end + 1)
        if begin == start or not authority:
            return
        user, _, place = authority[0].rstrip(".:)]" if "[" not in authority[0] else ".:)").rpartition("@")
        inside = re.fullmatch(r"\[(.*)\](?::([0-9]+))?|([^\[\]:]+)(?::([0-9]+))?", place)
        if not inside or int((inside[2] or inside[4] or "0")[:6]) > 65535:
            return
        try:
            numeric = bool(ipaddress.ip_address(inside[1] or inside[3]))
        except ValueError:
            numeric = False
        if numeric or user and inside[3] and _host(inside[3]):
            self.spans["address"].append((begin, end + 1 + len(user) + bool(user) + len(place)))

    def found(self) -> list[tuple[str, int, int]]:
        """All spans by kind as listed, then start; a span found from two anchors of a kind once."""
        return [(kind, a, b) for kind, spans in self.spans.items() for a, b in (spans if kind in BASE else sorted(set(spans)))]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _mapped(docs: DataFrame, id_col: str, text_col: str, each: Callable[[str], tuple], fields: list[T.StructField]) -> DataFrame:
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            columns = list(zip(*map(each, texts(batch)), strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, _ARROW[f.dataType.typeName()]) for c, f in zip(columns, fields, strict=True))], names=schema.names)

    return src.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "array": pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))}
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and spans (kind, start, end), code points, end exclusive, by kind as listed, then start.

    Kinds email, ip, card and phone are the base; email_wide (mailboxes and hosts in letters of any script, quoted or
    spelled out), phone_wide and account (numbers after a cue; IBANs with right check digits) and address (scheme://
    with a user or a host's number) are added to it and leave it as it is. Spans of different kinds may overlap. A null
    text is an empty one and has none; null and repeated ids give a row each; an empty table gives none; other columns
    aren't read. Texts of any length are read whole, in one pass.
    """
    return _mapped(docs, id_col, text_col, lambda text: ([dict(zip(("kind", "start", "end"), s, strict=True)) for s in Scan(text).found()],), [T.StructField("spans", _SPANS)])


def _redact(text: str, kinds: frozenset[str]) -> tuple[str, int]:
    spans = sorted((a, -b, k) for k, a, b in Scan(text).found() if k in kinds)
    out, end, n = [], 0, 0
    for a, b, kind in spans:
        if -b <= end:
            continue
        if a >= end:
            out += [text[end:a], f"[{kind.removesuffix('_wide').upper()}]"]
            n += 1
        end = -b
    return "".join(out) + text[end:], n


def redact(docs: DataFrame, kinds: tuple[str, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with each span replaced by its kind in brackets, and n_replaced. Spans that overlap become one, named
    by the first, or the longest from there. Null texts become empty ones; otherwise as ``personal_spans``."""
    if unknown := set(kinds) - set(KINDS):
        raise ValueError(f"no such kinds: {sorted(unknown)}")
    chosen = frozenset(kinds)
    return _mapped(docs, id_col, text_col, lambda text: _redact(text, chosen), [T.StructField("text", T.StringType()), T.StructField("n_replaced", T.LongType())])


def _digest(text: str) -> tuple:
    found = Scan(text).found()
    base = [s for s in found if s[0] in BASE]
    counts = [sum(k == kind for k, _, _ in found) for kind in BASE]
    return *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(found), len(found) - len(base)


def personal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, all spans as text and n_added; see ``personal_spans``."""
    kinds = [*((f"n_{k}", T.LongType()) for k in BASE), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_added", T.LongType())]
    return _mapped(docs, id_col, text_col, _digest, [T.StructField(*k) for k in kinds])


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(table(spark, sf_dir, "documents"))
