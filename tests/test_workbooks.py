"""Workbooks as a data source, packages as graphs and extracted text, on files written here."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.plans.base import writer
from tallyloom.sources import office, package, workbooks

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
A, P = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
CHART = f'<c:chartSpace xmlns:c="{office.CHART}" xmlns:a="{A}"><c:barChart><c:f>S!A1</c:f><c:v>5</c:v></c:barChart><a:t>Title</a:t></c:chartSpace>'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def rels(**targets):
    """A relationship part: id = kind and target, a target with a scheme is external."""
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{t}"{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in t else ""}/>' for i, (kind, t) in targets.items()) + "</Relationships>"


def cell(ref, value):
    return f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>' if isinstance(value, str) else f'<c r="{ref}"><v>{value}</v></c>'


def sheet(rows, dimension="", more=""):
    body = "".join(f'<row r="{r}">' + "".join(cell(f"{office.letters(c)}{r}", v) for c, v in enumerate(row, 1) if v is not None) + "</row>" for r, row in rows.items())
    return f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}">{dimension}<sheetData>{body}</sheetData>{more}</worksheet>'


def workbook():
    rows = {1: ["name", "n", "name", None], 2: ["a", 1, "x", None], **{r: [f"k{r}", r, None, None] for r in range(4, 40)}, 50: [None, 7, None, "far"]}
    names = [("Data", "visible", "r1"), ("Empty", "hidden", "r2"), ("Other", "visible", "r3")]
    return zipped(
        {
            "_rels/.rels": rels(d=("officeDocument", "xl/workbook.xml")),
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" state="{s}" sheetId="{i}" r:id="{r}"/>' for i, (n, s, r) in enumerate(names, 1)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": rels(r3=("worksheet", "/xl/worksheets/other.xml"), r1=("worksheet", "worksheets/sheet2.xml"), r2=("worksheet", "worksheets/sheet1.xml")),
            "xl/worksheets/sheet2.xml": sheet(rows, '<dimension ref="A1:D50"/>', '<drawing r:id="d1"/>'),
            "xl/worksheets/sheet1.xml": sheet({}),
            "xl/worksheets/other.xml": sheet({1: ["h"], 3: ["v"]}),
            "xl/worksheets/_rels/sheet2.xml.rels": rels(d1=("drawing", "../drawings/drawing1.xml"), h=("hyperlink", "https://a.b/c")),
            "xl/drawings/drawing1.xml": f'<x xmlns:r="{REL}"><y r:id="c1"/></x>',
            "xl/drawings/_rels/drawing1.xml.rels": rels(c1=("chart", "../charts/chart7.xml")),
            "xl/charts/chart7.xml": CHART,
            "xl/charts/chart9.xml": CHART,
        }
    )


def deck():
    slide = lambda text: f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:sp><a:p><a:t>{text}</a:t></a:p></p:sp><p:sp><a:p/></p:sp></p:sld>'
    return zipped(
        {
            "_rels/.rels": rels(d=("officeDocument", "ppt/presentation.xml")),
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{REL}"><p:sldIdLst><p:sldId id="1" r:id="s3"/><p:sldId id="2" r:id="s1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": rels(s1=("slide", "slides/slide1.xml"), s2=("slide", "slides/slide2.xml"), s3=("slide", "slides/slide3.xml")),
            **{f"ppt/slides/slide{n}.xml": slide(f"text {n}") for n in (1, 2, 3)},
            "ppt/slides/_rels/slide1.xml.rels": rels(c=("chart", "../charts/chart1.xml"), s=("slide", "slide3.xml")),
            "ppt/charts/chart1.xml": CHART,
            "ppt/media/lost.png": b"x",
        }
    )


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "a.xlsx").write_bytes(workbook())
    (folder / "deck.pptx").write_bytes(deck())
    (folder / "bad.pptx").write_bytes(b"no package")
    workbooks.register(spark)
    return str(folder)


def read(spark, root, **options):
    return spark.read.format("xlsx").options(**options).load(f"{root}/a.xlsx")


def test_rows(spark, root):
    df = read(spark, root, range_rows=10)
    assert df.columns == ["_row", "name", "n", "name_C", "D"] and df.rdd.getNumPartitions() == 5
    got = {r["_row"]: (r["name"], r["n"], r["name_C"], r["D"]) for r in df.collect()}
    assert got == {2: ("a", "1", "x", None), **{r: (f"k{r}", str(r), None, None) for r in range(4, 40)}, 50: (None, "7", None, "far")}
    assert {r["_row"] for r in read(spark, root, first_row=5, last_row=7).collect()} == {5, 6, 7}
    assert read(spark, root, sheet="Empty").count() == 0
    assert [tuple(r) for r in read(spark, root, sheet="Other").collect()] == [(3, "v")]
    assert read(spark, root, header_row=4).columns[:3] == ["_row", "k4", "4"] and read(spark, root, header_row=4).agg(F.min("_row")).first()[0] == 5
    with pytest.raises(Exception, match="no sheet"):
        read(spark, root, sheet="None").count()
    with pytest.raises(Exception, match="counted from 1"):
        read(spark, root, header_row=0).count()


def test_filters_are_pushed(spark, root, capsys):
    df = read(spark, root, range_rows=10).where("_row >= 12 and _row < 15 and n > '12'")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "GreaterThanOrEqual" in plan and "_row" in plan.split("PushedFilters")[1]
    assert {r["_row"] for r in df.collect()} == {13, 14} and df.rdd.getNumPartitions() == 1
    cells = spark.read.format("xlsx").option("as", "cells").load(root)
    assert cells.where("sheet = 'Other'").rdd.getNumPartitions() == 1
    assert sorted((r["row"], r["value"]) for r in cells.where("sheet in ('Other', 'Empty') and row = 3").collect()) == [(3, "v")]
    assert cells.where("row > 100").count() == 0


def test_cells_as_the_other_reader(spark, root):
    ours = spark.read.format("xlsx").option("as", "cells").option("range_rows", 7).load(root).drop("file")
    theirs = office.read_cells(spark, root).drop("file")
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(map(tuple, theirs.collect()), key=str)
    assert ours.count() == 3 + 3 + 2 * 36 + 2 + 2


def test_sheets(spark, root):
    got = [tuple(r)[1:] for r in office.sheets(spark, root).orderBy("place").collect()]
    assert got == [("Data", "visible", 50, 4, 1), ("Empty", "hidden", 0, 0, 2), ("Other", "visible", 3, 1, 3)]
    assert office.first_sheet(spark, f"{root}/a.xlsx") == "Data"


def test_graph(spark, root):
    write = writer(spark)
    parts, edges = package.parts_and_edges(spark, root, write)
    short = lambda r: (r["file"].rsplit("/", 1)[1], r["part"])
    shown = {(*short(r), r["page"], r["page_kind"], r["place"]) for r in package.shown_parts(spark, edges, write).collect()}
    assert shown == {("a.xlsx", "xl/charts/chart7.xml", "xl/worksheets/sheet2.xml", "worksheet", 1), ("deck.pptx", "ppt/charts/chart1.xml", "ppt/slides/slide1.xml", "slide", 2)}
    assert {short(r) for r in package.orphans(spark, parts, edges, write).collect()} == {("a.xlsx", "xl/charts/chart9.xml"), ("deck.pptx", "ppt/media/lost.png")}
    links = edges.where("external").collect()
    assert [(r["source"], r["target"]) for r in links] == [("xl/worksheets/sheet2.xml", "https://a.b/c")]
    assert {r["file"].rsplit("/", 1)[1] for r in parts.select("file").distinct().collect()} == {"a.xlsx", "deck.pptx"}
    assert ("chart", "xl/charts/chart9.xml") in office.package_parts(workbook()) and ("xml", "xl/charts/chart9.xml") in office.package_parts(workbook())


def test_extracted_text():
    assert office.extract("d.pptx", deck()) == ("Slide1: text 3\nSlide2: text 1", None)
    lines = office.extract("a.xlsx", workbook())[0].split("\n")
    assert lines[:3] == ["[Data] A1=name | B1=n | C1=name", "[Data] A2=a | B2=1 | C2=x", "[Data] A4=k4 | B4=4"] and lines[-2:] == ["[Other] A1=h", "[Other] A3=v"]
    assert office.extract("a.jsonl", b"\xef\xbb\xbfa\xff\nb") == ("L1: a�\nL2: b", None)
    assert office.extract("a.json", b'{"a": 1}')[0] == 'L1: {\nL2:   "a": 1\nL3: }'
    assert office.extract("a.json", b"{")[1] and office.extract("a.svg", b"<svg/>")[1].startswith("unsupported")
    page = '<h1>One</h1><p>two <a href="/x">three</a></p><script type="application/json">{"k": 1}</script><script id="b-data">{</script><script>var x</script>'
    text, _, inventory = office.extract("p.html", page.encode())[0].partition(f"\n{office.INVENTORY}\n")
    assert text == "L1: One\nL2: two\nL3: three"
    assert json.loads(inventory) == {"links": [{"locator": "a[href] #1", "text": "three", "target": "/x"}], "structured_data": [{"locator": "script #1 id=", "data": {"k": 1}}], "limitations": ["script #2 id=b-data: holds no JSON that can be read"]}
    assert office.extract("p.html", b"<p>plain</p>")[0] == "L1: plain"


def test_xml_lines():
    total, lines = office.xml_lines(workbook(), "xl/charts/chart7.xml", 1, 3)
    assert (total, lines) == (7, [(2, "  <barChart>"), (3, "    <f>S!A1</f>"), (4, "    <v>5</v>")])
    assert office.chart(workbook(), "xl/charts/chart7.xml") == (["barChart"], ["Title"], ["S!A1"], ["5"])
    for part in ("xl/none.xml", "[Content_Types].xml"):
        with pytest.raises(ValueError, match="XML part"):
            office.xml_lines(workbook(), part)
