"""Accounts of items and the whole review contract, each rule broken by itself."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import numbers, text
from tallyloom.operators import contract, validate
from tallyloom.operators import inspect as ins

EVIDENCE = "array<struct<file:string,locator:string,quote:string,kind:string,description:string>>"
ITEM = "struct<label:string,result:string,members:array<string>,count:string,method:string,scope:string,location:string>"
RECORD = f"review string, id string, kind string, rule string, state string, numerator string, denominator string, reason string, observation string, evidence {EVIDENCE}, items array<{ITEM}>"
SEEN = [("f.txt", "L1", "q", "text", None)]
PLAIN = ("x", None, None, None, None, None, None)


def record(name, state="0", items=(PLAIN,), denominator="1", kind="RATIO", rule="r"):
    return ("v", name, kind, rule, state, state, denominator, "a reason that is long enough", "seen there", SEEN, list(items))


def inspected(count, method=validate.INSPECTED, location="l"):
    return ("x", None, None, count, method, "s", location)


@pytest.mark.parametrize(
    ("items", "denominator", "kind", "rule", "accounted", "problem"),
    [
        ([PLAIN], "1", "RATIO", "r", 1, None),
        ([PLAIN], "3", "RATIO", "r", 1, "items don't make up the denominator"),
        ([inspected("3")], "3", "RATIO", "r", 3, None),
        ([inspected(" 3\n")], "3", "CLAIM-RATIO", "min(n/3, 1)", 3, None),
        ([inspected("3", "other")], "3", "RATIO", "r", 1, "items don't make up the denominator"),
        ([inspected("3", location="")], "3", "RATIO", "r", 1, "items don't make up the denominator"),
        ([inspected("0")], "3", "RATIO", "r", None, "a count below one"),
        ([inspected("many"), inspected("0")], "3", "RATIO", "r", None, "no whole count"),
        ([inspected(None)], "2", "RATIO", "r", None, "no whole count"),
        ([inspected("0")], "1", "RATIO", "r", 1, None),
        ([("x", None, ["a", "b"], "9", None, None, None), PLAIN], "3", "RATIO", "r", 3, None),
        ([None], "3", "RATIO", "r", None, "an item without fields"),
        ([PLAIN], "3", "BIN", "r", None, None),
        ([PLAIN], "3", "RATIO", "min(n/3, 1)", None, None),
        ([PLAIN], "0", "RATIO", "r", None, None),
        ([], "2", "RATIO", "r", 0, "items don't make up the denominator"),
    ],
)
def test_accounts(spark, items, denominator, kind, rule, accounted, problem):
    r = validate.accounting(spark.createDataFrame([record("a", items=items, denominator=denominator, kind=kind, rule=rule)], RECORD)).first()
    assert (r.accounted, r.problem, r.agrees) == (accounted, problem, problem is None)


GOOD = {
    "reviews": [("v",)],
    "checks": [("v", c, "looked at") for c in contract.CHECKS],
    "records": [record("A1"), record("A2"), record("A3", "1")],
    "corrections": [record("A2")],
    "defects": [("v", "D1", "they differ", SEEN)],
    "owners": [("v", "D1", "A1", "m", "points are lost")],
    "atoms": [("v", "A1", "m"), ("v", "A2", "m"), ("v", "A3", "n")],
    "known_files": [("f.txt",)],
    "witnesses": [("v", "R1", "asserted", False), ("v", "R2", "asserted", False), ("v", "R3", "conditional", False), ("v", "R4", "asserted", True)],
    "unresolved": [("v", "U1")],
    "findings": [("v", "R1", "why", "confirmed_defect", "D1", None), ("v", "R2", "why", "excluded", None, "A3"), ("v", "U1", "why", "excluded", None, "A1")],
}
KINDS = {
    "reviews": "review string",
    "checks": "review string, name string, text string",
    "records": RECORD,
    "corrections": RECORD,
    "defects": f"review string, id string, description string, evidence {EVIDENCE}",
    "owners": "review string, defect string, atom_id string, metric string, consequence string",
    "atoms": "review string, id string, metric string",
    "known_files": "file string",
    "witnesses": "review string, id string, kind string, holds boolean",
    "unresolved": "review string, id string",
    "findings": "review string, id string, reason string, decision string, defect_id string, rule_id string",
}


def found(spark, **changed):
    frames = {k: spark.createDataFrame(changed.get(k, rows), KINDS[k]) for k, rows in GOOD.items()}
    return {tuple(r) for r in contract.review_violations(**frames).collect()}


D, O, R = GOOD["defects"], GOOD["owners"], GOOD["findings"]
BROKEN = [
    ({}, set()),
    ({"checks": [*GOOD["checks"][1:], ("v", "file_coverage", "\n\t")]}, {("check", "v/file_coverage", "not explained")}),
    ({"checks": GOOD["checks"][:3]}, {("check", "v/internal_consistency", "not explained")}),
    ({"corrections": [record("A2"), record("A2")]}, {("correction", "A2", "repeated")}),
    ({"corrections": [record("B9")]}, {("correction", "B9", "unknown")}),
    ({"corrections": [record("A2", items=[PLAIN, PLAIN, PLAIN])]}, {("record", "A2", "items don't make up the denominator")}),
    ({"defects": [*D, *D]}, {("defect", "v/D1", "repeated")}),
    ({"defects": [*D, ("v", None, "x", SEEN)]}, {("defect", "v/", "no id"), ("defect", "v/", "no owner")}),
    ({"defects": [("v", "D1", "\t", SEEN)]}, {("defect", "v/D1", "no description")}),
    ({"defects": [("v", "D1", "x", [])]}, {("defect", "v/D1", "no evidence")}),
    ({"defects": [("v", "D1", "x", [("f.txt", "", "q", "text", None)])]}, {("defect", "v/D1", "evidence without place or content")}),
    ({"defects": [("v", "D1", "x", [("g.txt", "L1", "q", "text", None)])]}, {("defect", "v/D1", "unknown file")}),
    ({"defects": [*D, ("v", "D2", "x", SEEN)]}, {("defect", "v/D2", "no owner")}),
    ({"owners": [("v", "D1", "A1", "n", "lost")]}, {("owner", "v/D1/n", "no atom of its metric")}),
    ({"owners": [*O, ("v", "D1", "A2", "m", "lost")]}, {("owner", "v/D1/m", "metric owned twice")}),
    ({"owners": [("v", "D1", "A1", "m", " \n")]}, {("owner", "v/D1/m", "no consequence")}),
    ({"findings": [*R, R[0]]}, {("finding", "v/R1", "repeated")}),
    ({"findings": [*R, ("v", "R9", "why", "excluded", None, "A1")]}, {("finding", "v/R9", "unknown")}),
    ({"findings": [R[0], ("v", "R2", None, "excluded", None, "A3")]}, {("finding", "v/R2", "no reason")}),
    ({"findings": [R[0], ("v", "R2", "why", "perhaps", None, "A3")]}, {("finding", "v/R2", "undecided")}),
    ({"findings": [R[0], ("v", "R2", "why", None, None, "A3")]}, {("finding", "v/R2", "undecided")}),
    ({"findings": [R[0], ("v", "R2", "why", "excluded", None, "A9")]}, {("finding", "v/R2", "excluded without a rule")}),
    ({"findings": [("v", "R1", "why", "confirmed_defect", "D9", None), R[1]]}, {("finding", "v/R1", "confirmed without a defect that cost points")}),
    ({"owners": [*O, ("v", "D1", "A3", "n", "lost")]}, {("finding", "v/R1", "confirmed without a defect that cost points")}),
    ({"findings": R[1:]}, {("witness", "v/R1", "passed over")}),
    ({"records": [record("A1", "1"), *GOOD["records"][1:]], "corrections": [record("A1"), record("A2")]}, set()),
]


@pytest.mark.parametrize(("changed", "want"), BROKEN)
def test_each_rule_by_itself(spark, changed, want):
    assert found(spark, **changed) == want


def test_patches(spark):
    rows = [("a", ["checks"], [("A1",), ("A2",)]), ("b", ["checks", "scores"], None), ("c", ["corrections"], [("A1",), ("A1",)]), ("d", ["corrections"], [(None,)]), ("e", None, [])]
    got = {(r.key, r.rule) for r in contract.patch_violations(spark.createDataFrame(rows, "review string, fields array<string>, corrections array<struct<id:string>>")).collect()}
    assert got == {("b", "unknown field"), ("c", "repeated correction"), ("d", "correction without an id")}
    kind = "review string, id string, pos int, state string"
    draft = spark.createDataFrame([("a", "A1", 0, "0"), ("a", "A2", 1, "0"), ("b", "A1", 0, "0")], kind)
    patch = spark.createDataFrame([("a", "A9", 0, "1"), ("a", "A2", 1, "1"), ("c", "A1", 0, "1")], kind)
    assert sorted(map(tuple, contract.patched(draft, patch).collect())) == [("a", "A1", 0, "0"), ("a", "A2", 1, "1"), ("a", "A9", 2, "1"), ("b", "A1", 0, "0"), ("c", "A1", 0, "1")]


def test_white_space(spark):
    df = spark.createDataFrame([("\n",), ("\t ",), ("　",), (" 满足\n",), ("\t1h",), ("\n2.5\t",), ("\n1/2 ",), (None,)], "x string")
    x = F.col("x")
    got = df.select(ins.condition(x, "empty", None).alias("bare"), text.verdict(x).alias("v"), text.duration_seconds(x).alias("s"), numbers.numeric(x).alias("n"), numbers.state(x).cast("double").alias("r"), numbers.scalar(x).cast("double").alias("k")).collect()
    assert [r.bare for r in got] == [True, True, True, False, False, False, False, True]
    assert [r.v for r in got] == [None, None, None, True, None, None, None, None]
    assert [(r.s, r.n, r.r, r.k) for r in got[4:7]] == [(3600, None, None, None), (None, 2.5, 2.5, 2.5), (None, None, 0.5, None)]
    assert {r["name"]: (r["nonempty"], r["empty"], r["distinct_values"]) for r in ins.profile(df, ["x"]).collect()} == {"x": (4, 4, 4)}
