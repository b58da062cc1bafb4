"""JSON as it was meant: a stack automaton that reads on over what is missing, left over or written otherwise, and says so.

What it mends: missing and extra commas, missing colons, single quotes and curly ones, names and words without quotes,
comments, line ends and unescaped quotes inside strings, brackets that are never closed or closed by the other kind, and
words around the document. What it can't make out is left out, never guessed.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)+", re.S)
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?![\w.])")
_BARE = re.compile(r"[^\s,:\[\]{}\"']+")
#: Opening quotes with what closes them.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"', "'": "'"}
_CLOSED = {"{": "}", "[": "]"}


class _Mender:
    """Reads one value; ``said`` names what had to be mended, each kind once."""

    def __init__(self, text: str):
        self.text, self.at, self.said = text, 0, dict[str, None]()

    def note(self, what: str) -> None:
        self.said[what] = None

    def space(self) -> str:
        """Skips white space and comments; the next character, "" at the end."""
        m = _SPACE.match(self.text, self.at)
        if m:
            if m[0].strip():
                self.note("comment")
            self.at = m.end()
        return self.text[self.at : self.at + 1]

    def value(self) -> object:
        """A value; the open lists and objects around the place lie on a stack, so depth has no bound but memory."""
        stack: list[tuple[str, object, str | None]] = []  # opening, what it holds, the name that waits for its value
        while True:
            c = self.space()
            if c and c in _CLOSED:
                self.at += 1
                stack.append((c, {} if c == "{" else [], None))
                done = self._next(stack)
            else:
                found = self._scalar(c, stack)
                if not stack:
                    return found
                self._put(stack, found)
                done = self._next(stack)
            if done:
                return done[0]

    def _put(self, stack: list, found: object) -> None:
        opening, held, name = stack[-1]
        if opening == "[":
            held.append(found)
        else:
            held[name] = found
            stack[-1] = (opening, held, None)

    def _next(self, stack: list) -> list | None:
        """Goes on to where the next value begins, closing what closes; the whole value in a list once the outermost is closed."""
        fresh = True
        while True:
            opening, held, _ = stack[-1]
            c = self.space()
            comma = False
            while c == ",":
                if comma or not held:
                    self.note("extra comma")
                comma, self.at = True, self.at + 1
                c = self.space()
            if c in ("]", "}") or not c:
                if comma and held:
                    self.note("extra comma")
                if not c:
                    self.note("bracket left open")
                elif c == _CLOSED[opening]:
                    self.at += 1
                elif any(_CLOSED[o] == c for o, *_ in stack):
                    self.note("bracket left open")  # what closes is one further out
                else:
                    self.at += 1
                    self.note("bracket of the other kind" if fresh or held else "bracket left over")
                stack.pop()
                if not stack:
                    return [held]
                self._put(stack, held)
                fresh = False
                continue
            if held and not comma:
                self.note("missing comma")
            if opening == "[":
                return None
            if self._name(stack, c):
                return None

    def _name(self, stack: list, c: str) -> bool:
        """Reads a name and its colon; whether there was one."""
        opening, held, _ = stack[-1]
        if c in QUOTES:
            name = self._string(c, True)
        else:
            m = _BARE.match(self.text, self.at)
            if not m:
                self.at += 1
                self.note("left out")
                return False
            name, self.at = m[0], m.end()
            self.note("name without quotes")
        c = self.space()
        if c == ":":
            self.at += 1
            c = self.space()
        else:
            self.note("missing colon")
        if not c or c in ",}":
            self.note("missing value")
            held[name] = None
            return False
        stack[-1] = (opening, held, name)
        return True

    def _scalar(self, c: str, stack: list) -> object:
        if c in QUOTES and c:
            return self._string(c)
        m = _NUMBER.match(self.text, self.at)
        if m:
            self.at = m.end()
            return int(m[0]) if re.fullmatch("-?[0-9]+", m[0]) else float(m[0])
        m = _BARE.match(self.text, self.at)
        if not m:
            self.at += 1
            self.note("left out")
            return None
        word, self.at = m[0], m.end()
        if word in _WORDS:
            if word[0].isupper():
                self.note("word of another language")
            return _WORDS[word]
        # Words without quotes go on to the comma or bracket.
        rest = re.compile(r"[^,\[\]{}\n]*").match(self.text, self.at)
        self.at = rest.end()
        self.note("text without quotes")
        return (word + rest[0]).strip()

    def _string(self, opening: str, name: bool = False) -> str:
        """A string; a quote inside that no comma, colon, bracket or end follows belongs to it. A name may lack its colon."""
        if opening != '"':
            self.note("other quotes")
        closing, out = QUOTES[opening], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\":
                c = self.text[self.at : self.at + 1]
                self.at += 1
                code = self.text[self.at : self.at + 4]
                if c == "u" and re.fullmatch("[0-9a-fA-F]{4}", code):
                    out.append("\\u" + code)
                    self.at += 4
                elif c in _ESCAPES:
                    out.append(json.dumps(_ESCAPES[c])[1:-1])
                else:
                    self.note("escape that is none")
                    out.append(json.dumps(c)[1:-1])
            elif c == closing:
                m = _SPACE.match(self.text, self.at)
                after = self.text[m.end() if m else self.at :][:1]
                if not after or after in ",:]}" or m and "\n" in m[0] or after in QUOTES or name and after in "-0123456789{[":
                    return json.loads('"' + "".join(out) + '"', strict=False)
                self.note("quote inside a string")
                out.append(json.dumps(c)[1:-1])
            else:
                if c == "\n":
                    self.note("line end inside a string")
                out.append(json.dumps(c, ensure_ascii=False)[1:-1])
        self.note("string left open")
        return json.loads('"' + "".join(out) + '"', strict=False)


def mended(text: str | None, lists: bool = False) -> tuple[str | None, list[str]]:
    """(JSON text, what was mended) of the document in a text; (null, []) if there is none.

    A document is an object, or a list too if ``lists`` is true. JSON that is whole is given as it stands.
    """
    if text is None:
        return None, []
    kinds = (dict, list) if lists else dict
    try:
        if isinstance(json.loads(text), kinds):
            return text.strip(), []
    except (ValueError, RecursionError):
        pass
    begin = min((i for i in (text.find(c) for c in ("{[" if lists else "{")) if i >= 0), default=-1)
    if begin < 0:
        return None, []
    mender = _Mender(text)
    mender.at = begin
    if text[:begin].strip():
        mender.note("words before")
    try:
        found = mender.value()
        if text[mender.at :].strip():
            mender.note("words behind")
        return (json.dumps(found, ensure_ascii=False), list(mender.said)) if isinstance(found, kinds) else (None, [])
    except RecursionError:
        return None, []


MENDED = T.StructType([T.StructField("json", T.StringType()), T.StructField("mended", T.ArrayType(T.StringType()))])


@F.pandas_udf(MENDED)
def mended_objects(s: pd.Series) -> pd.DataFrame:
    """json and mended of texts that should hold an object."""
    return pd.DataFrame([mended(x) for x in s], columns=["json", "mended"])


@F.pandas_udf(MENDED)
def mended_values(s: pd.Series) -> pd.DataFrame:
    """json and mended of texts that should hold an object or a list."""
    return pd.DataFrame([mended(x, True) for x in s], columns=["json", "mended"])
