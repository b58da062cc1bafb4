import pytest
from pyspark.sql import functions as F

from tallyloom.functions import items, numbers
from tallyloom.operators import relate, resolve, results, scopes, validate
from tallyloom.sources import config
from tests.test_operators import EVIDENCE, ITEMS, SCHEMA, decision


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, x string")
    return [r.y for r in df.select("n", f(F.col("x")).alias("y")).orderBy("n").collect()]


def test_labels_and_verdicts(spark):
    assert column(spark, ['{"claim": "", "element": "e", "statement": "s"}', '{"statement": 0, "checkpoint": "c"}', '{"location": "x"}', '{"name": "n", "subject": "s"}'], items.claim_label) == ["e", "c", "", "s"]
    assert column(spark, ['{"entry": "e", "name": "n"}', '{"id": 7}', '{"checkpoint": "c"}', None], items.item_label) == ["e", "7", "", ""]
    said = ['{"supported": true, "verdict": "no"}', '{"supported": "true", "verdict": "unsupported"}', '{"verdict": " Satisfied now"}', '{"result": "不满足：x"}', '{"supported": "Yes"}', '{"verdict": "unclear"}', "{}"]
    assert column(spark, said, items.supported) == [True, False, True, False, True, None, None]
    assert column(spark, ["Consistent with x", "无支撑", "一致", None], items.source_positive) == [True, False, True, False]
    assert column(spark, ['{"verdict": "not satisfied", "result": "yes"}', '{"result": "yes"}'], items.item_passed) == [False, True]


def test_envelopes_pages_and_digests(spark):
    shapes = ['[{"id": "A"}, {"id": "B"}]', '{"atoms": [{"id": "A", "state": "1"}]}', '{"atom": {"id": "A", "state": "1"}}', '{"id": "A", "state": 0}', '{"id": "A"}', '{"atoms": {}}', "no json", None]
    assert column(spark, shapes, lambda c: F.size(items.atom_records(c))) == [2, 1, 1, 1, 0, 0, 0, 0]
    doc = '{"z": {"b": 1, "a": [10, {"k": "v"}, 30]}, "y": "s"}'
    page = lambda path, offset=0, limit=25: column(spark, [doc], lambda c: items.json_page(c, path, offset, limit))[0]
    assert page([], 0, 1)[:] == (["z"], ['{"b":1,"a":[10,{"k":"v"},30]}'], 2, 1)
    assert page(["z", "a"], 1)[:] == (None, ['{"k":"v"}', "30"], 3, None) and page(["z", "a", 1, "k"])[:] == (None, ["v"], None, None)
    with pytest.raises(ValueError):
        items.json_page(F.col("x"), [], -1)
    a, b, c = column(spark, ['{"b": 1, "a": {"d": 2, "c": 3}}', '{ "a":{"c":3,"d":2},"b":1 }', '{"b": 2}'], items.json_digest)
    assert a == b != c
    assert column(spark, ['{"checks": 1, "x": 2}'], lambda x: items.unknown_fields(x, ["checks"])) == [["x"]]
    same, alone, differ = column(spark, ['{"a": [1], "b": [1]}', '{"b": [2]}', '{"a": 1, "b": 2}'], lambda x: items.reconciled(x, "a", "b"))
    assert (tuple(same), tuple(alone), differ.conflict) == (("[1]", False), ("[2]", False), True)


def test_counting_notes(spark):
    rows = [(["{}", '{"included": false}'], 1), (["{}", '{"result": "排除（重复）"}', "{}"], 1), (["{}"] * 3, 3), (["{}"], 200), (['{"result": "N/A"}'], 0), (["{}"] * 4, 2)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, items array<string>, d int")
    got = [r.y for r in df.select("n", items.counting_note(F.col("items"), F.col("d")).alias("y")).orderBy("n").collect()]
    assert [bool(x) for x in got] == [False, True, False, False, False, True] and got[5].startswith("展示清单 4 条，计分对象 2 项")


def test_numbers_as_ratios(spark):
    got = column(spark, ["1.5/3", "2 / 3", "1/0", "abc", "0.67", "1e-3", " 7 "], lambda c: numbers.state(c).cast("double"))
    assert got == [0.5, pytest.approx(2 / 3), None, None, 0.67, 0.001, 7.0]


def test_nulls_and_ids_of_decisions(spark):
    good, null = decision("ok", "0.67", 2, 3), decision("null", "0.67", 2, 3)
    null = (*null[:6], None, None, *null[8:])
    rows = [good, null, decision("abc", "abc", 2, 3), decision("nostate", None, 2, 3), decision("twice", "1", 1, 1), decision("twice", "1", 1, 1), (*decision("noitems", "1", 1, 1)[:9], None), decision("noratio", "1", None, 1), decision("binary", None, None, None, kind="BIN")]
    df, files = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("f.txt",)], "file string")
    atoms = spark.createDataFrame([(x,) for x in ("ok", "null", "abc", "nostate", "twice", "noitems", "noratio", "binary", "gone")], "id string")
    got = {(r.key, r.rule) for r in validate.decision_violations(df, files, atoms).collect()}
    assert got == {("null", "vague"), ("abc", "state"), ("nostate", "state"), ("twice", "repeated"), ("noitems", "no items"), ("noratio", "no ratio"), ("binary", "binary"), ("gone", "missing")}
    seen = [("f.png", "p", None, "visual", "eight characters"), ("f.zip", "p", None, "visual", "eight characters"), ("f.png", "p", None, "visual", "short"), ("f.png", "p", "q", None, None)]
    df = spark.createDataFrame([(s,) for s in seen], f"e {EVIDENCE[6:-1]}")
    assert [r.y for r in df.select(validate.has_content(F.col("e")).alias("y")).collect()] == [True, False, False, True]
    assert ITEMS


def test_prefixes_of_rows_with_nulls_and_repeats(spark):
    subjects = spark.createDataFrame([("a", "x-"), ("b", "X-1"), ("c", "y")], "id string, prefix string")
    files = spark.createDataFrame([("x-0", None), ("x-10", "n"), ("x-0", None), ("Yes", None), (None, "n"), ("zz", None)], "name string, note string")
    got = sorted(((r.name, r.owner, r.matches) for r in relate.owners_by_prefix(files, subjects).collect()), key=str)
    assert got == sorted([("x-0", "a", 1), ("x-0", "a", 1), ("x-10", None, 2), ("Yes", "c", 1), (None, "source", 0), ("zz", "source", 0)], key=str)


def test_fingerprints_change_with_any_part(spark):
    make = lambda rows: {r.k: r.digest for r in relate.fingerprints(spark.createDataFrame(rows, "k string, id long, part string"), ["k"], 4).collect()}
    rows = [("a", i, f"p{i}") for i in range(100)] + [("b", 0, "x")]
    one = make(rows)
    assert one == make(rows[::-1]) and one["a"] != make([*rows[:50], ("a", 50, "other"), *rows[51:]])["a"] and one["b"] == make(rows[-1:])["b"]


def test_stored_scores_and_ceilings(spark):
    atoms = spark.createDataFrame([("t", "completion", "T1", 60, 1), ("t", "completion", "T2", 40, 0), ("t", "format", "F1", 50, 1), ("t", "format", "F2", 50, 1)], "task string, metric string, atom string, weight int, state int")
    caps = spark.createDataFrame([("t", "completion", 50.0)], "task string, metric string, cap double")
    scopes_ = spark.createDataFrame([("t", "format", "F2")], "task string, metric string, atom string")
    again = results.recomputed(atoms, caps, scopes_, ["task"])
    assert {r.metric: (r.raw, r.final) for r in again.collect()} == {"completion": (60.0, 50.0), "format": (5.0, 2.5)}
    stored = spark.createDataFrame([("t", "completion", 60.0, 60.0), ("t", "coverage", 1.0, 1.0), ("t", "format", 5.0, 2.5)], "task string, metric string, raw double, final double")
    assert {r.metric for r in results.score_mismatches(stored, again, ["task"]).collect()} == {"completion", "coverage"}
    rules = spark.createDataFrame([("E1", 0.0, ["A"]), ("E2", 1.0, ["A"]), ("E3", 1.0, [])], "id string, cap double, scope array<string>")
    assert [r.key for r in results.scoped_violations(rules).collect()] == ["E2"]


def test_shared_samples(spark):
    atoms = spark.createDataFrame([("A1", "RATIO", "x"), ("H1", "CLAIM-RATIO", "核验全集 同 A1"), ("H2", "RATIO", "核验全集同A1/B1"), ("H3", "BIN", "核验全集同 A1"), ("H4", "RATIO", "抽样规则同 A1")], "id string, kind string, rule string")
    done = spark.createDataFrame([(t, i, 2, 3 if t == "s" else 1) for t in "stu" for i in ("A1", "H1", "H2", "H3", "H4")], "task string, id string, denominator int, review_version int")
    labels = {"s": ["甲 10 亿元", "one claim"], "t": ["甲 10 亿元", "something else"], "u": ["甲 10 亿元"]}
    rows = [(t, "A1", i, x) for t in "stu" for i, x in enumerate(labels["s"])] + [(t, "H1", i, x.upper()) for t in "stu" for i, x in enumerate(labels[t])]
    got = {(r.task, r.id, r.rule) for r in results.shared_sample_violations(atoms, done, spark.createDataFrame(rows, "task string, id string, pos int, label string"), ["task"]).collect()}
    assert got == {("t", "H1", "labels differ"), ("u", "H1", "counts differ"), ("t", "H2", "several samples without their review"), ("u", "H2", "several samples without their review")}


def test_reports(spark):
    item = "array<struct<label:string,passed:boolean,source:string>>"
    kind = f"struct<items:{item},state:string,observation:string,reason:string>"
    told = lambda left, right: spark.createDataFrame([(left, right)], f"l {kind}, r {kind}").select(results.difference_sentence(F.col("l"), F.col("r"), F.lit("X"), F.lit("Y")).alias("y")).first().y
    left = [("a|", True, None), ("b", False, None), ("c", True, None), ("d", True, None), ("e", None, None)]
    right = [("a|", True, None), ("\ta|\n", False, None), ("b", True, None), ("c", False, None), ("e", True, None)]
    assert told((left, "0", "", ""), (right, "0", "", "")) == "a\\|：X满足，Y未满足；b：Y满足，X未满足；另有 1 个同项差异见逐项依据"
    assert told(([("a", False, None), ("\n", False, "s"), ("", False, None)], "0", "o", "r"), (None, "1", "", "")) == "X：3项未通过，如a、s；Y：本项满足规则。"
    assert told((left[:1], "1/1", "seen", "r"), (left[:1], "0.5", "o", "why")) == "X：seen；Y：why。具体核验清单和判定见下文。"
    assert told((None, "0", None, None), ([], None, "o", None)) == "X：；Y：o。"
    scores = spark.createDataFrame([("1.1", "s|", "completion", 66.666), ("1.1", "s|", "format", 2.345)], "task string, subject string, metric string, final double")
    assert [r.line for r in results.summary_lines(scores, ["completion", "coverage", "format"], ["task", "subject"], percent="completion").collect()] == ["| 1.1 | s\\| | 66.67% |  | 2.35 |"]
    notes = spark.createDataFrame([("A", "CLAIM-RATIO", "x process-record.json: runtime=3m；y"), ("B", "BIN", "z")], "id string, kind string, observation string")
    assert [(r.id, r.scope_note) for r in results.verification_scope(notes).collect()] == [("A", "x y")]


def test_tasks_and_their_records(spark):
    tasks, subjects = spark.createDataFrame([("1.1",), ("1.2",)], "task string"), spark.createDataFrame([("a",), ("b",)], "subject string")
    process = spark.createDataFrame([("1.1", "a", "3m", None), ("1.2", "a", None, "2024"), ("1.2", "b", None, None)], "task string, subject string, runtime string, executed_at string")
    assert [tuple(r) for r in results.missing_process(tasks, subjects, process).collect()] == [("1.1", "b")]
    later = spark.createDataFrame([("1.1", "a", "2023"), ("1.2", "a", "2023")], "task string, subject string, executed_at string")
    got = {(r.task, r.subject): r.executed_at for r in results.with_process(process.select("task", "subject"), process, ["task", "subject"], later).collect()}
    assert got == {("1.1", "a"): "2023", ("1.2", "a"): "2024", ("1.2", "b"): None}
    pool, chosen = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int"), spark.createDataFrame([("y", 0), ("x", 1)], "id string, pos int")
    assert [r.id for r in results.selected(pool, chosen).collect()] == ["y", "x"]
    assert results.in_scope(spark.createDataFrame([(1, "1.1"), (2, "2.1")], "dimension int, task string"), [2]).count() == 1


def test_resolutions(spark):
    long = "an explanation that is long enough"
    findings = spark.createDataFrame([("A", long), ("A", long), ("B", "short"), ("X", long)], "id string, resolution string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    errors = spark.createDataFrame([("E1", True), ("E2", True), ("E3", False)], "id string, triggered boolean")
    got = {(r.entity, r.key, r.rule) for r in resolve.resolution_violations(findings, ids("A", "B", "C"), ids("A", "C"), errors, ids("E1")).collect()}
    assert got == {("resolution", "A", "repeated"), ("resolution", "B", "not explained"), ("resolution", "X", "unknown"), ("resolution", "C", "unresolved"), ("error", "E2", "new severe error")}
    fields = "id string, state string, numerator int, denominator int, reason string, observation string, evidence array<string>"
    old = spark.createDataFrame([("A", "0.5", 1, 2, "old reason", "old observation", ["e"]), ("B", "0.5", 1, 2, "o", "o", ["e"])], fields)
    new = spark.createDataFrame([("A", "1/2", 1, 2, "n", "n", [], "Unchanged: fine", None), ("B", "1", 2, 2, "n", "n", ["e"], None, True), ("C", "1", 1, 1, "short reason", "an observation that says more", ["e"], None, None), ("D", "1", 1, 1, "a reason that is long enough to stand", "brief", ["e"], None, None)], fields + ", change string, unchanged boolean")
    got = {r.id: (r.retained, r.reason, r.observation, r.note) for r in resolve.completed(new, old).collect()}
    assert got["A"] == (True, "old reason", "old observation", "former record kept") and got["B"][:2] == (False, "n")
    assert got["C"][1] == "short reason 判定依据：an observation that says more" and got["D"][2] == "brief 具体观察：a reason that is long enough to stand"


def test_inventories_keep_what_is_unresolved(spark):
    side = "struct<value:string,unit:string,quote:string>"
    q = lambda v, u="a": (v, u, f"is {v}")
    rows = [("1", "gt", q("2"), q("1"), "asserted", "s", "p"), ("2", "gt", q("2"), q("1", "b"), "asserted", "s", "p"), ("3", "gt", q("2"), q("1"), "guessed", "s", "p"), ("4", "ne", q("2"), q("1"), "asserted", " ", "p")]
    checked, lost = resolve.inventory(spark.createDataFrame([("t", *r) for r in rows], f"task string, id string, operator string, left {side}, right {side}, kind string, subject string, scope string"), ["task"])
    assert {r.id: r.holds for r in checked.collect()} == {"1": True, "2": None}
    assert [(r.number, r.id) for r in lost.orderBy("number").collect()] == [("U001", "2"), ("U002", "3"), ("U003", "4")]


def test_prose_is_held_to_its_facts(spark):
    facts = spark.createDataFrame([("1234",), ("2.345",), ("0.125",), ("12345678901234567890123456",)], "value string")
    parts = spark.createDataFrame([("summary", "1234 and 1234.0, 2.35 or 2.3 and 2.345, 0.13 but 0.12; 2 and 12345678901234567890123456 in all"), ("risks", "short")], "part string, text string")
    assert {r.token for r in resolve.unsupported_numbers(parts, facts).collect()} == {"0.12", "2"}
    got = {(r.key, r.rule) for r in resolve.narrative_violations(parts, ["summary", "risks", "outlook"], facts).collect()}
    assert got == {("risks", "incomplete"), ("outlook", "incomplete"), ("0.12", "number without a fact"), ("2", "number without a fact")}


def test_ids_are_held_to_the_expected_ones(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    for parts in (None, 8):
        got = validate.id_violations("x", ids("a", "b", "b", "d", None, None), ids("a", "a", "b", "c", None), parts)
        assert sorted((r.key, r.rule) for r in got.collect()) == [("b", "repeated"), ("c", "missing"), ("d", "unknown"), ("null", "missing"), ("null", "repeated"), ("null", "unknown")]


def test_prose_and_facts_are_gone_through_once(spark):
    facts = spark.createDataFrame([("1.005",), ("9.995",), ("12.3",), (None,)], "value string").select(F.col("value").cast("decimal(20,3)"))
    parts = spark.createDataFrame([("1.01 and 1.005, 1.0050 or 1.0; 10.00 but 10.0 and 10, 12.300 and 12.30 and 12, 007 and 0",), (None,)], "text string")
    spark.sparkContext.setJobGroup("prose", "planning alone")
    out = resolve.unsupported_numbers(parts, facts)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("prose")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # 1.0 and 10.0 are 1.005 and 9.995 to one place, 10.00 is 9.995 to two; 10 has no places to round to.
    assert {r.token for r in out.collect()} == {"10", "12", "007", "0"}
    assert {r.token for r in resolve.unsupported_numbers(parts, facts.select(F.col("value").cast("string"))).collect()} == {"10", "12", "007", "0"}


def test_resumed_and_silent_runs(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    saved = spark.createDataFrame([("a", 1, "f", "p", sha("p")), ("b", 2, "f", "p", sha("p")), ("c", 1, "f", "p", sha("q")), ("d", 1, "old", "p", sha("p"))], "k string, version int, fingerprint string, payload string, payload_digest string")
    now = spark.createDataFrame([(k, "f") for k in "abcd"], "k string, fingerprint string")
    assert [r.k for r in resolve.resumable(saved, now, ["k"]).collect()] == ["a"]
    runs = spark.createDataFrame([(k,) for k in "abcde"], "k string").withColumn("started_at", F.timestamp_seconds(F.lit(0)))
    events = spark.createDataFrame([("a", 5, False), ("a", 50, True), ("b", 20, False), ("c", 5, False), ("e", 5, False), ("e", 500, True)], "k string, s int, done boolean").select("k", F.timestamp_seconds("s").alias("at"), "done")
    assert {r.k: r.state for r in resolve.timeouts(runs, events, ["k"], 10, 100, F.timestamp_seconds(F.lit(60))).collect()} == {"a": "done", "b": "silent", "c": "running", "d": "silent", "e": "overdue"}


def test_configurations(spark):
    rows = [("c1", "a", "A-"), ("c1", "b", "a-"), ("c2", "a", "x"), ("c2", "a", "y")] + [("c3", str(i), str(i)) for i in range(4)] + [("ok", "a", "p"), ("ok", "b", "q")]
    got = {(r.key, r.rule) for r in config.subject_violations(spark.createDataFrame(rows, "config string, id string, prefix string")).collect()}
    assert got == {("c1", "repeated prefix"), ("c2", "repeated id"), ("c3", "number of subjects")}
    assert column(spark, ["0", "2", "2.1", "true", "nan", None], config.is_temperature) == [True, True, False, False, False, False]
    codes = config.task_codes(spark.createDataFrame([("1.1",), ("1.2",)], "task string"), spark.createDataFrame([("W1", "1.1"), ("V1", "1.1"), ("Z", "9.9")], "label string, task string"))
    assert {r.task: r.codes for r in codes.collect()} == {"1.1": ["1.1", "V1", "W1"], "1.2": ["1.2"]}
    manifest = spark.createDataFrame([("a.txt", "sources"), ("b.txt", "events"), ("../c.txt", "sources")], "file string, category string")
    asked = spark.createDataFrame([("a.txt",), ("b.txt",), ("../c.txt",), ("d.txt",)], "file string")
    assert [r.file for r in config.allowed(asked, manifest).collect()] == ["a.txt"]


def test_scopes_in_halves():
    text = "\n".join(["x" * 99] * 100)
    (a, b), (c, d) = scopes.halves(text, 0, 8000)
    assert (a, d) == (0, 8000) and b == c and text[b - 1] == "\n" and 3900 < b <= 4000
    assert scopes.halves(text, 0, 1500) == [(0, 1500)]
