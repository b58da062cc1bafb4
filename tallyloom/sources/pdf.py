"""Text and links of PDF files: cross-reference tables and streams, object streams, page content and font maps.

What this reader doesn't know (encryption, filters other than Flate and hex, fonts without a map to Unicode beyond
one-byte Latin) is said as a limitation; it never guesses.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

_SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)+")
_TOKEN = re.compile(rb"<<|>>|[\[\]{}]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_OBJECT = re.compile(rb"(?<![0-9])([0-9]+)[\x00\t\n\x0c\r ]+([0-9]+)[\x00\t\n\x0c\r ]+obj\b")
#: Objects that lead to each other may go in circles; no file needs chains as long as this.
DEEPEST = 64


class PdfError(ValueError):
    """What can't be read of a file."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass(frozen=True)
class Word:
    """An operator, or a word of a file's own structure."""

    text: bytes


@dataclass
class Stream:
    head: dict
    raw: bytes


class Syntax:
    """Values one after another: names are str with a slash, strings bytes, references Ref."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def space(self) -> None:
        m = _SPACE.match(self.data, self.at)
        self.at = m.end() if m else self.at

    def value(self) -> object:
        """The next value; a Word for an operator; raises StopIteration at the end."""
        self.space()
        c = self.data[self.at : self.at + 1]
        if not c:
            raise StopIteration
        if c == b"(":
            return self._string()
        if c == b"<" and self.data[self.at + 1 : self.at + 2] != b"<":
            end = self.data.find(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
            self.at = end + 1 if end >= 0 else len(self.data)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        m = _TOKEN.match(self.data, self.at)
        if not m:
            self.at += 1
            return Word(c)
        self.at, token = m.end(), m[0]
        if token == b"<<":
            items = self._until(b">>")
            return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, str)}
        if token == b"[":
            return self._until(b"]")
        if token.startswith(b"/"):
            return re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes.fromhex(h[1].decode()), token).decode("latin-1")
        if re.fullmatch(rb"[-+]?[0-9]+", token):
            ahead = re.compile(rb"[\x00\t\n\x0c\r ]+[0-9]+[\x00\t\n\x0c\r ]+R\b").match(self.data, self.at)
            if ahead:
                self.at = ahead.end()
                return Ref(int(token))
            return int(token)
        if re.fullmatch(rb"[-+]?[0-9]*\.[0-9]*", token) and token.strip(b"+-.") != b"":
            return float(token)
        return {b"true": True, b"false": False, b"null": None}.get(token, Word(token))

    def _until(self, closing: bytes) -> list:
        out = []
        while True:
            try:
                v = self.value()
            except StopIteration:
                return out
            if v == Word(closing):
                return out
            out.append(v)

    def _string(self) -> bytes:
        out, depth = bytearray(), 0
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                e = self.data[self.at : self.at + 1]
                octal = re.compile(rb"[0-7]{1,3}").match(self.data, self.at)
                self.at += len(octal[0]) if octal else 1
                if octal:
                    out.append(int(octal[0], 8) & 255)
                elif e == b"\r" and self.data[self.at : self.at + 1] == b"\n":
                    self.at += 1
                elif e not in b"\r\n":
                    out += _ESCAPED.get(e, e)
                continue
            depth += (c == b"(") - (c == b")")
            if c == b")" and depth == 0:
                return bytes(out)
            if c != b"(" or depth > 1:
                out += c
        return bytes(out)


def unfiltered(stream: Stream, resolve=lambda x: x) -> bytes:
    """A stream's data without its filters."""
    data, names = stream.raw, resolve(stream.head.get("/Filter")) or []
    given = resolve(stream.head.get("/DecodeParms")) or {}
    names, given = (x if isinstance(x, list) else [x] for x in (names, given))
    for i, name in enumerate(map(resolve, names)):
        if name in ("/FlateDecode", "/Fl"):
            unpack = zlib.decompressobj()
            try:
                data = unpack.decompress(data)
            except zlib.error as error:
                raise PdfError(f"a stream can't be unpacked: {error}") from error
        elif name in ("/ASCIIHexDecode", "/AHx"):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
            data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            raise PdfError(f"filter {name}")
        parms = resolve(given[i]) if i < len(given) else {}
        if parms and parms.get("/Predictor", 1) >= 10:
            data = _rows(data, parms.get("/Columns", 1) * max(1, parms.get("/Colors", 1) * parms.get("/BitsPerComponent", 8) // 8))
    return data


def _rows(data: bytes, width: int) -> bytes:
    """Rows behind a byte each that says how they were written: as they are, or less what stands left of or above them."""
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        if kind == 2:
            row = bytearray((a + b) & 255 for a, b in zip(row, above, strict=True))
        elif kind == 1:
            for i in range(1, width):
                row[i] = (row[i] + row[i - 1]) & 255
        elif kind:
            raise PdfError(f"predictor {kind}")
        out += row
        above = row
    return bytes(out)


class Pdf:
    """Objects of a file by number, and its pages in order."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise PdfError("no PDF header")
        self.data, self.known, self.trailer = data, {}, {}
        self.places: dict[int, tuple] = {}
        try:
            self._references()
            if not isinstance(self.resolve(self.trailer.get("/Root")), dict):
                raise PdfError("no root")
        except (PdfError, StopIteration, IndexError, ValueError, TypeError):
            self._scan()
        if "/Encrypt" in self.trailer:
            raise PdfError("encrypted")

    def _references(self) -> None:
        """Where objects lie, from the newest table or stream back to the oldest; newer ones count."""
        begin = self.data.rfind(b"startxref")
        at, seen = Syntax(self.data, begin + 9).value(), set()
        while isinstance(at, int) and at not in seen:
            seen.add(at)
            syntax = Syntax(self.data, at)
            if syntax.value() == Word(b"xref"):
                head = self._table(syntax)
            else:
                stream = self._object_at(at)
                if not isinstance(stream, Stream):
                    raise PdfError("no cross-reference")
                head = stream.head
                self._stream(stream)
            self.trailer = {**head, **self.trailer}
            if isinstance(head.get("/XRefStm"), int):
                self._stream(self._object_at(head["/XRefStm"]))
            at = head.get("/Prev")
        if begin < 0 or not seen:
            raise PdfError("no cross-reference")

    def _table(self, syntax: Syntax) -> dict:
        while True:
            first = syntax.value()
            if first == Word(b"trailer"):
                return syntax.value()
            for number in range(first, first + syntax.value()):
                offset, _, kind = syntax.value(), syntax.value(), syntax.value()
                if kind == Word(b"n"):
                    self.places.setdefault(number, ("at", offset))

    def _stream(self, stream: Stream) -> None:
        data, widths = unfiltered(stream), stream.head["/W"]
        index = stream.head.get("/Index") or [0, stream.head["/Size"]]
        numbers = [n for a, b in zip(index[::2], index[1::2], strict=True) for n in range(a, a + b)]
        size = sum(widths)
        for i, number in enumerate(numbers):
            row, fields, at = data[i * size : (i + 1) * size], [], 0
            for k, w in enumerate(widths):
                fields.append(int.from_bytes(row[at : at + w]) if w else int(k == 0))
                at += w
            if fields[0] in (1, 2):
                self.places.setdefault(number, ("at", fields[1]) if fields[0] == 1 else ("in", fields[1], fields[2]))

    def _scan(self) -> None:
        """For files whose table is broken: every object that begins somewhere, the last of a number counts."""
        self.known.clear()
        self.places = {int(m[1]): ("at", m.start()) for m in _OBJECT.finditer(self.data)}
        for m in re.finditer(rb"trailer", self.data):
            head = Syntax(self.data, m.end()).value()
            self.trailer.update(head if isinstance(head, dict) else {})
        for number in list(self.places):
            held = self.resolve(Ref(number))
            if isinstance(held, Stream) and held.head.get("/Type") == "/ObjStm":
                listed = Syntax(unfiltered(held, self.resolve))
                for i in range(self.resolve(held.head.get("/N")) or 0):
                    inner, _ = listed.value(), listed.value()
                    self.places.setdefault(inner, ("in", number, i))
            elif isinstance(held, Stream) and held.head.get("/Type") == "/XRef":
                self.trailer = {**held.head, **self.trailer}
            elif isinstance(held, dict) and held.get("/Type") == "/Catalog":
                self.trailer["/Root"] = Ref(number)

    def _object_at(self, at: int) -> object:
        m = _OBJECT.match(self.data, _SPACE.match(self.data, at).end() if _SPACE.match(self.data, at) else at)
        if not m:
            raise PdfError("no object where one is said to be")
        syntax = Syntax(self.data, m.end())
        held = syntax.value()
        syntax.space()
        if isinstance(held, dict) and self.data.startswith(b"stream", syntax.at):
            begin = syntax.at + 6
            begin += 2 if self.data[begin : begin + 2] == b"\r\n" else 1
            size = held.get("/Length")
            size = self.resolve(size) if isinstance(size, Ref) else size
            if not isinstance(size, int) or not self.data[begin + size : begin + size + 20].lstrip().startswith(b"endstream"):
                size = self.data.find(b"endstream", begin) - begin
            return Stream(held, self.data[begin : begin + max(0, size)])
        return held

    def resolve(self, value: object, depth: int = 0) -> object:
        """What a reference leads to; null where it leads to nothing."""
        if not isinstance(value, Ref):
            return value
        if value.number not in self.known:
            if depth > DEEPEST:
                raise PdfError("references in a circle")
            self.known[value.number] = None
            kind, *place = self.places.get(value.number, ("",))
            if kind == "at":
                self.known[value.number] = self._object_at(place[0])
            elif kind == "in":
                box = self.resolve(Ref(place[0]), depth + 1)
                inside, first = unfiltered(box, self.resolve), self.resolve(box.head["/First"])
                listed = Syntax(inside)
                starts = [(listed.value(), listed.value())[1] for _ in range(self.resolve(box.head["/N"]))]
                self.known[value.number] = Syntax(inside, first + starts[place[1]]).value()
        return self.resolve(self.known[value.number], depth + 1)

    def pages(self) -> list[dict]:
        """Pages in order, each with the resources that it inherits."""
        out: list[dict] = []
        root = self.resolve(self.trailer.get("/Root")) or {}
        stack, seen = [(root.get("/Pages"), {})], set()
        while stack:
            ref, above = stack.pop()
            node = self.resolve(ref)
            if not isinstance(node, dict) or ref in seen:
                continue
            seen.add(ref) if isinstance(ref, Ref) else None
            held = {**above, **{k: node[k] for k in ("/Resources",) if k in node}}
            if "/Kids" in node:
                stack += [(kid, held) for kid in reversed(self.resolve(node["/Kids"]) or [])]
            else:
                out.append({**held, **node})
        return out

    def _font(self, font: dict) -> tuple[int, dict[int, str]]:
        """Bytes of a code, and its map to Unicode; without one, one-byte codes are Latin."""
        held = self.resolve(font.get("/ToUnicode"))
        if not isinstance(held, Stream):
            return (2 if font.get("/Subtype") == "/Type0" else 1), {}
        table: dict[int, str] = {}
        width, syntax, seen = 1, Syntax(unfiltered(held, self.resolve)), []
        text = lambda b: b.decode("utf-16-be", "replace")
        while True:
            try:
                v = syntax.value()
            except StopIteration:
                return width, table
            if not isinstance(v, Word):
                seen.append(v)
                continue
            if v.text == b"endcodespacerange":
                width = max([len(x) for x in seen if isinstance(x, bytes)], default=1)
            elif v.text == b"endbfchar":
                table |= {int.from_bytes(a): text(b) for a, b in zip(seen[::2], seen[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif v.text == b"endbfrange":
                for a, b, to in zip(seen[::3], seen[1::3], seen[2::3], strict=False):
                    codes = range(int.from_bytes(a), min(int.from_bytes(b), int.from_bytes(a) + 0xFFFF) + 1)
                    if isinstance(to, list):
                        table |= {c: text(x) for c, x in zip(codes, to, strict=False)}
                    else:
                        last = int.from_bytes(to[-2:])
                        table |= {c: text(to[:-2] + ((last + i) & 0xFFFF).to_bytes(2)) for i, c in enumerate(codes)}
            seen = []

    def text(self, page: dict) -> str:
        """A page's text in the order of its content, a line for each line that it sets."""
        contents = self.resolve(page.get("/Contents"))
        streams = [self.resolve(c) for c in (contents if isinstance(contents, list) else [contents])]
        data = b"\n".join(unfiltered(s, self.resolve) for s in streams if isinstance(s, Stream))
        fonts = self.resolve((self.resolve(page.get("/Resources")) or {}).get("/Font")) or {}
        maps = {name: self._font(self.resolve(f) or {}) for name, f in fonts.items()}
        out, operands, font, syntax = [""], [], (1, {}), Syntax(data)

        def shown(x: bytes) -> str:
            width, table = font
            codes = [int.from_bytes(x[i : i + width]) for i in range(0, len(x), width)]
            return "".join(table.get(c, bytes((c,)).decode("cp1252", "replace") if width == 1 else "�") for c in codes)

        while True:
            try:
                v = syntax.value()
            except StopIteration:
                break
            if not isinstance(v, Word):
                operands.append(v)
                continue
            op = v.text
            if op in (b"Td", b"TD") and len(operands) == 2 and operands[1] or op in (b"T*", b"'", b'"', b"Tm", b"ET"):
                out.append("")
            if op == b"Tf" and operands:
                font = maps.get(operands[0], (1, {}))
            elif op in (b"Tj", b"'", b'"') and operands and isinstance(operands[-1], bytes):
                out[-1] += shown(operands[-1])
            elif op == b"TJ" and operands and isinstance(operands[-1], list):
                # A gap of a fifth of the font's size is a blank between words.
                out[-1] += "".join(shown(x) if isinstance(x, bytes) else " " if isinstance(x, (int, float)) and x < -200 else "" for x in operands[-1])
            elif op == b"BI":
                end = data.find(b"EI", syntax.at)
                syntax.at = end + 2 if end >= 0 else len(data)
            operands = []
        return "\n".join(line.strip() for line in out if line.strip())

    def links(self, page: dict) -> list[tuple[int, str]]:
        """(number of the annotation on its page, address)"""
        out = []
        for n, ref in enumerate(self.resolve(page.get("/Annots")) or [], 1):
            action = self.resolve((self.resolve(ref) or {}).get("/A"))
            target = self.resolve(action.get("/URI")) if isinstance(action, dict) else None
            if isinstance(target, bytes) and target:
                out.append((n, target.decode("utf-8", "replace")))
        return out


def read_pdf(data: bytes) -> tuple[str, dict[str, list]]:
    """(text by page behind [page n], inventory of links and of what can't be read)"""
    pdf = Pdf(data)
    parts, inventory = [], {"links": [], "structured_data": [], "limitations": []}
    for n, page in enumerate(pdf.pages(), 1):
        try:
            text = pdf.text(page)
        except (PdfError, StopIteration, TypeError, AttributeError, KeyError, ValueError) as error:
            text = ""
            inventory["limitations"].append(f"page {n}: {error or type(error).__name__}")
        parts.append(f"[page {n}]\n{text}")
        inventory["links"] += [{"locator": f"page {n} annotation {k}", "text": "", "target": target} for k, target in pdf.links(page)]
    return "\n".join(parts), inventory
