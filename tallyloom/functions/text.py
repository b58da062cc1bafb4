"""Column functions over text: verdicts, durations, cleaning, splitting, numbers in prose and page text."""

from __future__ import annotations

import difflib
import html
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prefixes that name an outcome, tried in this order.
ZH_NEGATIVE = "不满足|不一致|不支持|无支撑|未覆盖|缺失|错误|冲突|矛盾"
ZH_POSITIVE = "满足|一致|支持|有支撑|已覆盖|正确|可追溯|非虚构|无问题|无冲突"
EN_POSITIVE = "satisfied|supported|consistent|correct|traceable|pass|present|yes"
EN_NEGATIVE = "not satisfied|unsatisfied|unsupported|inconsistent|incorrect|fail|missing|absent|no"


# What a reason leaves out, the kind it begins with and operands in it.
KIND_PREFIX, OPERANDS = r"^(?:BIN|RATIO|CLAIM-RATIO|COUNT)(?:规则|判据)?[：:]\s*", r"(?i)(?:numerator|denominator|state)\s*=\s*[\d.]+[，,、;；]?"


# Fixed value: what counts as white space at the ends of a text.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE_RANGES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """A text without white space at its ends: tabs, line ends and wide blanks too, which ``trim`` leaves."""
    return F.btrim(c, F.lit(SPACES))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it."""
    return F.transform(F.array(c), f)[0]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that only these are held as Python's texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def verdict(c: Column) -> Column:
    """True, false or null for a free-text outcome; the first matching prefix decides."""
    s = F.lower(stripped(F.coalesce(c, F.lit(""))))
    # One expression finds the word, so that the text is made once; alternatives are tried in this order.
    words = {w: value for said, value in ((ZH_NEGATIVE, False), (ZH_POSITIVE, True), (EN_POSITIVE, True), (EN_NEGATIVE, False), ("1|true", True), ("0|false", False)) for w in said.split("|")}
    found = F.regexp_extract(s, rf"^(?:{ZH_NEGATIVE}|{ZH_POSITIVE}|{EN_POSITIVE}|{EN_NEGATIVE}|(?:1|true|0|false)\z)", 0)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in words.items() for x in pair)), found)


def duration_seconds(c: Column) -> Column:
    """Seconds of ``1h2m3s``, any part optional but one; null for other text."""
    s = F.lower(stripped(c))
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(s, rf"(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return F.when(s.rlike(r"^(?=\d)(?:\d+h)?(?:\d+m)?(?:\d+s)?$"), part("h") * 3600 + part("m") * 60 + part("s"))


def is_source_url(c: Column) -> Column:
    """An http or https address with a host."""
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(F.try_parse_url(c, F.lit("HOST"))) > 0), F.lit(False))


def is_empty(c: Column) -> Column:
    return c.isNull() | (stripped(c.cast("string")) == "")


def markdown_safe(c: Column) -> Column:
    """Text that can stand in a Markdown table cell."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("\n", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def table_cells(c: Column) -> Column:
    """Cells of a Markdown table row: split at bars that no backslash escapes, trimmed, unescaped."""
    inner = F.regexp_replace(stripped(c), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(stripped(x), F.lit("\\|"), F.lit("|")))


def short_reason(c: Column, limit: int = 145, least: int = 65) -> Column:
    """White space collapsed; a long text ends after the last full stop or semicolon past ``least``, else with an ellipsis."""
    s = stripped(F.regexp_replace(c, r"\s+", " "))
    s = F.regexp_replace(F.regexp_replace(s, KIND_PREFIX, ""), OPERANDS, "")

    def cut(s: Column) -> Column:
        head = F.substring(s, 1, limit)
        end = F.length(F.regexp_extract(head, r"(?s)^(.*[。；])", 1))
        return F.when(F.length(s) <= limit, s).when(end > least + 1, F.left(head, end)).otherwise(F.concat(F.regexp_replace(head, r"[，、；。 ]+$", ""), F.lit("……")))

    return once(s, cut)


# Fixed value: traces of how a run went, in prose.
RUN_TRACE = r"(?i)process-record\.json[^\n；;]*(?:runtime|status)\s*=[^\n；;]*[；;]?"


def summary_text(c: Column) -> Column:
    return stripped(F.regexp_replace(c, RUN_TRACE, ""))


def locate_lines(c: Column) -> Column:
    """``L1: ...`` before every line."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), x)), "\n")


def text_page(c: Column, offset: int, limit: int) -> Column:
    """A page of a text: its characters, the total, the line it starts in and the next offset."""
    if offset < 0 or not 1 <= limit <= 20_000:
        raise ValueError("a page begins at 0 or later and holds 1 to 20,000 characters")
    head, total = F.substring(c, 1, offset), F.length(c)
    return F.struct(
        F.substring(c, offset + 1, limit).alias("text"),
        total.cast("long").alias("total_characters"),
        (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("starting_line"),
        F.when(total > offset + limit, F.lit(offset + limit).cast("long")).alias("next_offset"),
    )


def clean_path(c: Column) -> Column:
    """A relative path with forward slashes and without ``.`` parts; null if absolute, with a drive or a ``..``."""
    s = F.replace(c, F.lit("\\"), F.lit("/"))
    return F.when(~(s.rlike("^/|^[A-Za-z]:") | F.array_contains(F.split(s, "/"), "..")), F.array_join(F.array_remove(F.split(s, "/"), "."), "/"))


def number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def signed_numbers(c: Column) -> Column:
    """Signed numbers, groups of three digits joined; commas elsewhere part values."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\d.])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?![\d.])"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))


def logical_name(c: Column, prefix: str, code: str) -> Column:
    """A file's name without the subject's confirmed prefix and the task's code, in lower case."""
    s = F.lower(c)
    for cut in (prefix.lower(), code.lower()):
        s = F.when(s.startswith(cut), F.regexp_replace(F.substring(s, len(cut) + 1, 1 << 30), r"^[-_ ]+", "")).otherwise(s)
    return s


@F.pandas_udf(T.StringType())
def label_key(s: pd.Series) -> pd.Series:
    """Labels that differ in width, case, spaces or punctuation have one key."""

    def key(x):
        return None if x is None else "".join(ch for ch in unicodedata.normalize("NFKC", x).lower() if ch.isalnum())

    return s.map(key)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


# Cells of a table of common runs that one task holds at a time.
RUN_CELLS = 16 << 20


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The longest common run, the earliest in ``a`` and then in ``b``, row by row."""
    run, best = np.zeros(len(b) + 1, np.int32), (0, 0, 0)
    for i, x in enumerate(a.tolist()):
        run[1:] = np.where(b == x, run[:-1] + 1, 0)
        j = int(run.argmax())
        if run[j] > best[2]:
            best = (i + 1 - int(run[j]), j - int(run[j]), int(run[j]))
    return best


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Characters in common runs, the longest first, then left and right of it."""
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        if (i1 - i0) * (j1 - j0) > RUN_CELLS:
            i, j, n = _longest(a[i0:i1], b[j0:j1])
            if n:
                total += n
                todo += [(i0, i0 + i, j0, j0 + j), (i0 + i + n, i1, j0 + j + n, j1)]
            continue
        x, y = a[i0:i1], b[j0:j1]
        runs = np.zeros((len(x) + 1, len(y) + 1), np.int32)
        for i in range(len(x) - 1, -1, -1):
            runs[i, :-1] = np.where(y == x[i], runs[i + 1, 1:] + 1, 0)
        inner = [(0, len(x), 0, len(y))]
        while inner:
            p0, p1, q0, q1 = inner.pop()
            if p0 >= p1 or q0 >= q1:
                continue
            part = np.minimum(np.minimum(runs[p0:p1, q0:q1], np.arange(p1 - p0, 0, -1, dtype=np.int32)[:, None]), np.arange(q1 - q0, 0, -1, dtype=np.int32))
            p, q = divmod(int(part.argmax()), q1 - q0)
            n = int(part[p, q])
            if n:
                total += n
                inner += [(p0, p0 + p, q0, q0 + q), (p0 + p + n, p1, q0 + q + n, q1)]
    return total


def whole_ratio(a: str, b: str) -> float:
    """``difflib``'s ratio over all characters: its heuristic that passes over frequent ones from 200 on is off."""
    if a == b or not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") for s in (a, b))
    return 2.0 * _common(x, y) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def whole_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else whole_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def _resolved(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def plain(c: Column) -> Column:
    """Character references resolved, white space removed: the form in which quotes are compared.

    Only texts that can hold a reference go through Python.
    """
    text = F.coalesce(_resolved(F.when(F.contains(c, F.lit("&")), c)), c)
    for frequent in " \n":
        text = F.replace(text, F.lit(frequent), F.lit(""))
    return F.regexp_replace(text, f"[{SPACE_RANGES}]+", "")


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.data, self.scripts = [], [], [], []
        self.skip, self.anchor, self.script, self.anchors, self.nth = 0, None, None, 0, 0

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
            kind, name = (found.get("type") or "").lower(), found.get("id") or ""
            self.nth += tag == "script"
            self.name = f"script #{self.nth} id={name}"
            self.script = [] if tag == "script" and (kind in ("application/json", "application/ld+json") or name.endswith("-data")) else None
        elif tag == "a" and found.get("href") is not None:
            self.anchor = [found["href"], []]

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
            if self.script is not None:
                self.data.append("".join(self.script))
                self.scripts.append((self.name, self.data[-1]))
            self.script = None
        elif tag == "a" and self.anchor:
            self.links.append((self.anchor[0], " ".join("".join(self.anchor[1]).split())))
            self.anchor = None

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        if not self.skip:
            if data.strip():
                self.parts.append(data.strip())
            if self.anchor:
                self.anchor[1].append(data)


def read_html(text: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(text or "")
    reader.close()
    return reader


def page_inventory(text: str) -> dict[str, list]:
    """Links and JSON scripts of a page, each with its place, and what of them can't be read."""
    reader = read_html(text)
    out: dict[str, list] = {"links": [{"locator": f"a[href] #{n}", "text": said, "target": target} for n, (target, said) in enumerate(reader.links, 1)], "structured_data": [], "limitations": []}
    for place, script in reader.scripts:
        try:
            out["structured_data"].append({"locator": place, "data": json.loads(script)})
        except ValueError:
            out["limitations"].append(f"{place}: holds no JSON that can be read")
    return out


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Text nodes outside scripts and styles, a line each."""
    return s.map(lambda x: "\n".join(read_html(x).parts))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("target", T.StringType()), T.StructField("text", T.StringType())])))
def html_links(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"target": a, "text": b} for a, b in read_html(x).links])


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_data(s: pd.Series) -> pd.Series:
    """JSON documents that scripts of a page carry."""
    return s.map(lambda x: read_html(x).data)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "locator", "text", "target")])))
def html_evidence(s: pd.Series) -> pd.Series:
    """What a page holds beside its text, in order: links by their number, JSON scripts by theirs."""

    def found(page):
        reader = read_html(page)
        links = [{"kind": "link", "locator": f"a[href] #{i}", "text": text, "target": target} for i, (target, text) in enumerate(reader.links, 1)]
        return links + [{"kind": "data", "locator": name, "text": data, "target": None} for name, data in reader.scripts]

    return s.map(found)
