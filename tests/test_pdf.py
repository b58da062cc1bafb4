"""PDF files written here, with tables or streams of references, whole, damaged and encrypted."""

import json
import random
import zlib

import pytest

from tallyloom.sources import office
from tallyloom.sources.pdf import Pdf, PdfError, Syntax, read_pdf

CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <6F22> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0058> <0059005A>] endbfrange"


def stream(data, extra=b"", pack=True):
    data = zlib.compress(data) if pack else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if pack else b"", extra, data)


def objects():
    first = rb"BT /F1 12 Tf 10 700 Td (One \(line\) ) Tj (of te\170t) Tj 0 -14 Td [(Wor) -20 (d) -300 (two)] TJ T* (third) Tj ET"
    second = b"BT /F2 9 Tf <0001001000110012> Tj <00200021> ' ET q BI /W 1 ID \x00(no)\xff EI Q BT /F1 9 Tf (caf\xe9) Tj ET"
    return {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 9 0 R] /Count 3 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R 12 0 R] /Annots [8 0 R << /Subtype /Text >> << /A << /URI (https://b.c/\\(x\\)) >> >>] >>",
        4: stream(first),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>",
        7: stream(CMAP),
        8: b"<< /Subtype /Link /A 13 0 R >>",
        9: b"<< /Type /Pages /Kids [10 0 R 2 0 R] >>",
        10: b"<< /Type /Page /Contents 11 0 R >>",
        11: stream(second, pack=False),
        12: stream(b"BT 0 -20 Td (next stream) Tj ET"),
        13: b"<< /S /URI /URI (http://a.b/c) >>",
    }


def table_file(held, trailer=b""):
    out, places = b"%PDF-1.4\n%\xe2\xe3\n", {}
    for n, body in held.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (max(held) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in range(1, max(held) + 1))
    return out + b"trailer\n<< /Size %d /Root 1 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (max(held) + 1, trailer, at)


def stream_file(held, predictor=True):
    """Everything without a stream of its own in an object stream, references in a stream written with differences."""
    inside = {n: b for n, b in held.items() if b"endstream" not in b}
    heads, bodies = b"", b""
    for n, body in inside.items():
        heads += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
    box, table = max(held) + 1, max(held) + 2
    out, rows = b"%PDF-1.5\n", {n: (2, box, i) for i, n in enumerate(inside)}
    for n, body in {**{n: b for n, b in held.items() if n not in inside}, box: stream(heads + bodies, b"/Type /ObjStm /N %d /First %d" % (len(inside), len(heads)))}.items():
        rows[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    rows[table] = (1, at, 0)
    lines = [bytes((k,)) + a.to_bytes(4) + b.to_bytes(1) for k, a, b in (rows.get(n, (0, 0, 0)) for n in range(table + 1))]
    data, above = b"", bytes(6)
    for line in lines:
        data += b"\x02" + bytes((x - y) & 255 for x, y in zip(line, above, strict=True)) if predictor else line
        above = line
    parms = b"/DecodeParms << /Predictor 12 /Columns 6 >>" if predictor else b""
    return out + b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (table, stream(data, b"/Type /XRef /Size %d /W [1 4 1] /Root 1 0 R %s" % (table + 1, parms)), at)


TEXT = "[page 1]\nOne (line) of text\nWord two\nthird\nnext stream\n[page 2]\n漢abc\nXYZ\ncafé"
LINKS = [("page 1 annotation 1", "http://a.b/c"), ("page 1 annotation 3", "https://b.c/(x)")]


@pytest.mark.parametrize("data", [table_file(objects()), stream_file(objects()), stream_file(objects(), False), table_file(objects()).replace(b"startxref\n", b"startxref\n9"), stream_file(objects()).replace(b"startxref\n", b"startxref\n9"), table_file(objects()).replace(b"xref\n0", b"xxxx\n0", 1)], ids=["table", "stream", "plain stream", "lost table", "lost stream", "broken table"])
def test_text_and_links(data):
    text, inventory = read_pdf(data)
    assert text == TEXT
    assert [(x["locator"], x["target"]) for x in inventory["links"]] == LINKS and inventory["limitations"] == []


def test_an_update_counts():
    old = table_file(objects())
    start = int(old.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    at = len(old) + 1
    body = b"12 0 obj\n" + stream(b"BT (newer) Tj ET") + b"\nendobj\n"
    new = old + b"\n" + body + b"xref\n12 1\n%010d 00000 n \ntrailer\n<< /Size 14 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, start, at + len(body))
    assert read_pdf(new)[0] == TEXT.replace("next stream", "newer")


def test_what_cannot_be_read_is_said():
    assert office.extract("a.pdf", table_file(objects(), b"/Encrypt 5 0 R"))[1] == "PdfError: encrypted"
    assert office.extract("a.pdf", b"no")[1].startswith("PdfError") and office.extract("a.pdf", b"")[0] == ""
    odd = objects() | {12: b"<< /Length 3 /Filter /LZWDecode >>\nstream\nabc\nendstream"}
    text, _, inventory = office.extract("a.pdf", table_file(odd))[0].partition(f"\n{office.INVENTORY}\n")
    assert text.startswith("[page 1]\n\n[page 2]\n漢") and json.loads(inventory)["limitations"] == ["page 1: filter /LZWDecode"]
    bare = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page >>"}
    assert office.extract("a.pdf", table_file(bare)) == ("[page 1]\n", None)


def test_damage_never_breaks_the_reader():
    rng = random.Random(8)
    data = table_file(objects())
    for _ in range(400):
        at = rng.randrange(len(data))
        damaged = data[:at] + rng.randbytes(rng.randrange(4)) + data[at + rng.randrange(30) :]
        text, limit = office.extract("a.pdf", damaged)
        assert isinstance(text, str) and (limit is None or text == "")


def test_syntax():
    syntax = Syntax(rb"<< /A#20b [1 -2.5 (a\(b\)\051\n\
c) <48 65 6> true null 3 0 R] >> % comment")
    assert str(syntax.value()) == "{'/A b': [1, -2.5, b'a(b))\\nc', b'He`', True, None, Ref(number=3)]}"
    with pytest.raises(PdfError):
        Pdf(b"%PDF-1.4 nothing").resolve(None) or Pdf(b"x")


def test_as_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(stream_file(objects()))
    row = office.documents(spark, str(tmp_path)).first()
    assert row.text.startswith(TEXT) and row.limitation is None
