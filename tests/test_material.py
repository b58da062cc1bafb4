import io
import json
import zipfile

import pytest

from tallyloom.sources import material, office
from tests.test_sources import MAIN, xlsx

CHART = f'<c:chartSpace xmlns:c="{office.CHART}" xmlns:a="{office.DRAWING}"><c:barChart><c:f>S!A1</c:f><c:v>5</c:v></c:barChart><a:t>Title</a:t></c:chartSpace>'


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("workspace")
    book = io.BytesIO(xlsx())
    with zipfile.ZipFile(book, "a") as z:
        z.writestr("xl/charts/chart1.xml", CHART)
        z.writestr("xl/media/image1.png", b"x")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="10"/></cellXfs></styleSheet>')
    files = {"t.xlsx": book.getvalue(), "d.json": json.dumps({"b": [1, {"x": 2}], "a": 1}).encode(), "n.md": "﻿one\ntwo\nthree".encode(), "secret.md": b"no"}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    (folder / "manifest.json").write_text(json.dumps({"files": [{"file": n, "category": "events" if n == "secret.md" else "deliveries"} for n in files]}))
    return str(folder)


def ask(spark, root, name, **request):
    return material.ask(spark, root, {"file": name, **request})


def test_text_and_json(spark, root):
    assert tuple(ask(spark, root, "n.md", operation="text", offset=4, limit=3).first()) == ("two", 13, 2, 7)
    assert ask(spark, root, "d.json", operation="json").first()[:3] == (["b", "a"], ['[1,{"x":2}]', "1"], 2)
    assert ask(spark, root, "d.json", operation="json", path=["b", 1, "x"]).first()["values"] == ["2"]
    for name, operation in (("secret.md", "text"), ("../n.md", "text"), ("zz.md", "text"), ("n.md", "json"), ("t.xlsx", "text"), ("n.md", "rows")):
        with pytest.raises(ValueError):
            ask(spark, root, name, operation=operation)


def test_packages(spark, root):
    parts = {r.part: r for r in ask(spark, root, "t.xlsx", operation="package").where("kind <> 'xml'").collect()}
    chart = parts["xl/charts/chart1.xml"]
    assert (chart.kind, chart.types, chart.texts, chart.references, chart.cached_values) == ("chart", ["barChart"], ["Title"], ["S!A1"], ["5"]) and parts["xl/media/image1.png"].kind == "image"
    lines = ask(spark, root, "t.xlsx", operation="xml", part="xl/workbook.xml", limit=2).collect()
    assert [r.line for r in lines] == [1, 2] and lines[0].next_offset == 2 and lines[0].total > 2
    with pytest.raises(Exception, match="XML part"):
        ask(spark, root, "t.xlsx", operation="xml", part="xl/none.xml").collect()


def test_tables(spark, root):
    assert [tuple(r)[1:] for r in ask(spark, root, "t.xlsx").collect()] == [("S", "visible", 4, 3)]
    cells = {(r.row, r.col): (r.value_or_formula, r.format) for r in ask(spark, root, "t.xlsx", operation="cells", range="B3:C4").collect()}
    assert cells == {(3, 2): ("1", "0.00%"), (4, 2): ("3", "0.00%"), (4, 3): ("=SUM(B2:B4)", "0.00%")}
    rows = ask(spark, root, "t.xlsx", operation="rows", sheet="S", limit=2).collect()
    assert [r._row for r in rows] == [2, 3] and (rows[0].total_rows, rows[0].next_offset) == (3, 2)
    late = ask(spark, root, "t.xlsx", operation="rows", header_row=3, filters=[{"column": 2, "op": "gt", "value": 1}]).collect()
    assert [r._row for r in late] == [4] and late[0].next_offset is None
    assert {r.name: r.numeric_count for r in ask(spark, root, "t.xlsx", operation="stats", columns=["value"]).collect()} == {"value": 3}
