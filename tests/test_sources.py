import io
import json
import zipfile

from pyspark.sql import functions as F

from tallyloom.sources import files, office, rubric
from tallyloom.streaming import events

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def xlsx() -> bytes:
    rows = [["项目", "value", "sum"], ["x", 1, None], ["x", 1, None], ["y", 3, "=SUM(B2:B4)"]]
    body = ""
    for r, row in enumerate(rows, 1):
        cells = ""
        for c, v in enumerate(row):
            ref = f"{'ABC'[c]}{r}"
            if isinstance(v, str) and v.startswith("="):
                cells += f'<c r="{ref}"><f>{v[1:]}</f><v>5</v></c>'
            elif isinstance(v, str):
                cells += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
            elif v is not None:
                cells += f'<c r="{ref}"><v>{v}</v></c>'
        body += f'<row r="{r}">{cells}</row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def test_worksheets(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx())
    cells = office.read_cells(spark, str(tmp_path))
    assert cells.where("formula is not null").select("row", "col", "formula").first() == (4, 3, "=SUM(B2:B4)")
    sheet = office.worksheet(cells.where("sheet = 'S'"))
    assert [tuple(r) for r in sheet.orderBy("_row").collect()] == [(2, "x", "1", None), (3, "x", "1", None), (4, "y", "3", "5")]
    assert office.cell_range(cells, "A2:B3").count() == 4
    text, limit = office.extract("a.xlsx", xlsx())
    assert "[S] A4=y | B4=3 | C4=5" in text and limit is None
    assert office.extract("a.bin", b"")[1].startswith("unsupported") and office.extract("a.docx", b"no")[0] == ""
    assert office.extract("a.txt", b"\xef\xbb\xbfone\ntwo") == ("L1: one\nL2: two", None)
    total, lines = office.xml_lines(xlsx(), "xl/workbook.xml", 0, 2)
    assert total >= 3 and len(lines) == 2 and lines[0][0] == 1
    assert ("xml", "xl/workbook.xml") in office.package_parts(xlsx())
    docs = office.documents(spark, str(tmp_path)).first()
    assert docs.limitation is None and "A1=项目" in docs.text


RUBRIC = "\ufeff# r\n## 6. completion\n| id | layer | w | purpose | rule | ev | prov |\n| --- | --- | --- | --- | --- | --- | --- |\n| T01 | base | 40 | p | **BIN** a \\| b | e | x |\n| T02 | base | 60 | p | **RATIO** n/d | e | x |\n## 7. quality\n### 7.1 coverage\n| C01 | base | 90 | p | **BIN** | e | x |\n## 8. errors\n| E1 | 封顶范围仅限 T01 | 任务完成率：上限 0；原子 T01；内容覆盖度：无上限；原子 C01 |\n| E2 | any | 内容覆盖度：上限 1.5；原子 C01 |\n| E4 | 未列入本条封顶范围的不计 | 准确率·忠实度：上限2；原子 A01、T01；幻觉／自洽性：上限 3 |\n| E5 | x | 完成度：上限 50 |\n| E6 | x | 格式：无上限 |\n| E7 | x | none |\n## 9. end\n| E3 | x | 内容覆盖度：上限 1 |\n"


def test_rubrics(spark, tmp_path):
    (tmp_path / "r.md").write_text(RUBRIC, encoding="utf-8")
    lines = rubric.rubric_lines(spark, str(tmp_path))
    atoms = {r.id: r for r in rubric.atoms(lines).collect()}
    assert set(atoms) == {"T01", "T02", "C01"} and atoms["T01"].rule == "**BIN** a | b" and atoms["C01"].metric == "coverage" and atoms["T02"].kind == "RATIO"
    rules = {(r.id, r.metric): (None if r.cap is None else float(r.cap), r.scope) for r in rubric.error_rules(lines).collect()}
    assert rules == {("E1", "completion"): (0.0, ["T01"]), ("E1", "coverage"): (None, []), ("E2", "coverage"): (1.5, []), ("E4", "accuracy"): (2.0, ["A01", "T01"]), ("E4", "hallucination"): (3.0, [])}
    assert {r.id for r in rubric.rules(lines).collect()} == {"E1", "E2", "E4", "E5", "E6", "E7"}
    lost = {(r.rule, r.detail) for r in rubric.ceiling_violations(lines).collect()}
    assert lost == {("unread ceiling", "E5"), ("unread ceiling", "E6"), ("unknown metric", "E6"), ("scope", "E4 A01"), ("scope", "E4 T01")}
    empty = spark.createDataFrame([("f", 0, "no rubric")], "file string, pos int, line string")
    assert [r.rule for r in rubric.all_violations(empty).collect()] == ["no atoms"] and rubric.all_violations(lines).count() > len(lost)
    bad = {(r.rule, r.detail) for r in rubric.rubric_violations(rubric.atoms(lines)).collect()}
    assert ("weight", "coverage") in bad and ("missing metric", "format") in bad and ("weight", "completion") not in bad


def test_layout_and_records(spark):
    paths = ["一、alpha/2.task/a.txt", "一、alpha/10.other/b/c.txt", "2.beta/1.t/~$d.txt", "readme.md"]
    got = files.discover(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {(r.task, r.rest) for r in got} == {("1.2", "a.txt"), ("1.10", "b/c.txt")}
    cells = spark.createDataFrame([(2, 1, "W1"), (2, 2, "3m"), (2, 3, "success"), (3, 1, "2.1"), (3, 2, "4m"), (4, 1, "1.1")], "row long, col long, value string")
    records = files.process_records(cells, {"task_label": "A", "runtime": "B", "status": "C"}, 2, 9, spark.createDataFrame([("W1", "1.1")], "label string, task string"))
    assert {(r.task_label, r.task, r.runtime) for r in records.collect()} == {("W1", "1.1", "3m"), ("2.1", "2.1", "4m"), ("1.1", "1.1", None)}
    assert files.repeated_tasks(records).count() == 0


def test_event_logs(spark, tmp_path):
    log = [{"type": "text", "sessionID": "s1", "part": {"text": "a"}}, {"type": "tool", "part": {"tool": "read", "state": {"status": "completed"}}}, {"type": "text", "sessionID": "s2", "part": {"text": "b"}}, {"type": "error", "error": "boom"}]
    (tmp_path / "l.jsonl").write_text("\n".join([json.dumps(log[0]), "broken {", *map(json.dumps, log[1:])]))
    r = files.log_summary(files.read_log(spark, str(tmp_path))).first()
    assert (r.text, r.error, r.session, r.used_read) == ("a\nb", "boom", "s2", True)
    answers = spark.createDataFrame([("x BEGIN_JUDGMENT {\"a\": 1} END_JUDGMENT y",), ("```json\n{\"a\": 2}\n```",), ("{\"a\": 3}",), ("none",), ("say BEGIN_JUDGMENT and END_JUDGMENT\nBEGIN_JUDGMENT\n```json\n{\"a\": 4}\n```\nEND_JUDGMENT\n",)], "x string")
    got = [r.a for r in answers.select(F.try_variant_get(files.json_block(F.col("x")), "$.a", "int").alias("a")).collect()]
    assert got == [1, 2, 3, None, 4]
    odd = spark.createDataFrame([("[1]",), ("BEGIN_JUDGMENT {'a': [1 2] END_JUDGMENT",)], "x string").select(files.json_block(F.col("x")).isNull().alias("none"), files.json_block(F.col("x"), True).isNull().alias("no_list"), files.mended_block(F.col("x"))["json"].alias("m")).collect()
    assert [tuple(r) for r in odd] == [(True, False, None), (True, True, '{"a": [1, 2]}')]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "l.jsonl").write_text('{"type": "text", "part": {"text": "key secret"}}\nbroken\n')
    query = events.log_stream(spark, str(tmp_path / "in"), ["secret"]).writeStream.format("memory").queryName("log").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.text for r in spark.table("log").collect()] == ["key ***"]
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(str(tmp_path / "events"))
    stream = events.tumbling(events.event_stream(spark, str(tmp_path / "events"), table.schema), "1 day")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = events.tumbling(table, "1 day")
    assert spark.table("days").agg(F.sum("n")).first()[0] == table.count() and spark.table("days").count() == batch.count()
    done = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1)], "k string, member int")
    assert [r.k for r in events.complete_groups(done, spark.createDataFrame([("g", 2), ("h", 2)], "k string, expected int"), ["k"]).collect()] == ["g"]
