"""The whole review contract as one table of violations: checks, corrections, accounts, defects with their owners, and
the chain from each comparison that doesn't hold to the defect or the rule that answers for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import numbers
from tallyloom.functions.text import is_source_url, stripped
from tallyloom.operators.relate import violations
from tallyloom.operators.validate import accounting, decision_violations, has_content

#: What a review must explain, whatever it finds, and what may become of a witness.
CHECKS = ("file_coverage", "item_accounting", "ownership", "internal_consistency")
CONFIRMED, EXCLUDED = "confirmed_defect", "excluded"


def _bare(c: str | Column) -> Column:
    return stripped(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def _times(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with how often their keys stand in the table; those without a key are left out."""
    return df.dropna(subset=keys).withColumn("times_", F.count("*").over(Window.partitionBy(*keys)))


def _named(review: str, *parts: str) -> Column:
    return F.concat_ws("/", *(F.coalesce(F.col(p).cast("string"), F.lit("null")) for p in (review, *parts)))


def check_violations(reviews: DataFrame, checks: DataFrame) -> DataFrame:
    """Of each review (review), the named checks (review, name, text) that aren't explained."""
    grid = reviews.select("review", F.explode(F.array(*map(F.lit, CHECKS))).alias("name"))
    told = checks.groupBy("review", "name").agg(F.max(~_bare("text")).alias("told"))
    return violations(grid.join(told, ["review", "name"], "left"), "check", _named("review", "name"), {"not explained": ~F.coalesce("told", F.lit(False))})


def final_records(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """Records as they stand after the review: a corrected one in the place of the former."""
    return records.join(corrections.select("id"), "id", "left_anti").unionByName(corrections, allowMissingColumns=True)


def defect_violations(defects: DataFrame, owners: DataFrame, atoms: DataFrame, known_files: DataFrame) -> DataFrame:
    """Defects (review, id, description, evidence) and their owners (review, defect, atom_id, metric, consequence)."""
    own = owners.groupBy("review", F.col("defect").alias("id")).agg(F.count("*").alias("owned"))
    rows = _times(defects.withColumn("id", F.coalesce("id", F.lit(""))), ["review", "id"]).join(own, ["review", "id"], "left")
    rules = {
        "no id": _bare("id"),
        "repeated": F.col("times_") > 1,
        "no description": _bare("description"),
        "no evidence": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
        "evidence without place or content": F.exists("evidence", lambda e: ~F.coalesce((F.length(e["locator"]) > 0) & has_content(e), F.lit(False))),
        "no owner": F.col("owned").isNull(),
    }
    found = violations(rows, "defect", _named("review", "id"), rules)
    cited = defects.select("review", "id", F.explode("evidence").alias("e")).select("review", "id", F.col("e.file").alias("file")).where(~is_source_url(F.coalesce("file", F.lit(""))))
    lost = cited.join(known_files.select("file"), "file", "left_anti").select(F.lit("defect").alias("entity"), _named("review", "id").alias("key"), F.lit("unknown file").alias("rule"))
    known = atoms.select("review", F.col("id").alias("atom_id"), "metric", F.lit(True).alias("known_"))
    held = _times(owners, ["review", "defect", "metric"]).join(known, ["review", "atom_id", "metric"], "left")
    of_owners = violations(held, "owner", _named("review", "defect", "metric"), {"no atom of its metric": F.col("known_").isNull(), "metric owned twice": F.col("times_") > 1, "no consequence": _bare("consequence")})
    return found.unionByName(lost.distinct()).unionByName(of_owners.distinct())


def relation_violations(witnesses: DataFrame, unresolved: DataFrame, findings: DataFrame, defects: DataFrame, owners: DataFrame, final: DataFrame, atoms: DataFrame) -> DataFrame:
    """Findings (review, id, reason, decision, defect_id, rule_id) on witnesses (review, id, kind, holds) and unresolved
    ones (review, id): each known and found on once; what was asserted and doesn't hold is confirmed by a defect all of whose
    owners lost points, or excluded by an atom's rule."""
    known = witnesses.select("review", "id").unionByName(unresolved.select("review", "id")).where("id is not null").distinct().withColumn("known_", F.lit(True))
    state = final.select("review", F.col("id").alias("atom_id"), numbers.state(F.col("state").cast("string")).alias("state"))
    scored = owners.join(state, ["review", "atom_id"], "left").groupBy("review", F.col("defect").alias("defect_id")).agg(F.every(F.coalesce(F.col("state") < 1, F.lit(False))).alias("scored_"))
    there = defects.select("review", F.col("id").alias("defect_id")).distinct().join(scored, ["review", "defect_id"]).select("review", "defect_id", "scored_")
    rule = atoms.select("review", F.col("id").alias("rule_id"), F.lit(True).alias("ruled_")).distinct()
    rows = _times(findings.withColumn("id", F.coalesce("id", F.lit(""))), ["review", "id"]).join(known, ["review", "id"], "left").join(there, ["review", "defect_id"], "left").join(rule, ["review", "rule_id"], "left")
    confirmed, out = F.coalesce(F.col("decision") == CONFIRMED, F.lit(False)), F.coalesce(F.col("decision") == EXCLUDED, F.lit(False))
    rules = {
        "unknown": F.col("known_").isNull(),
        "repeated": F.col("times_") > 1,
        "no reason": _bare("reason"),
        "undecided": ~confirmed & ~out,
        "confirmed without a defect that cost points": confirmed & ~F.coalesce("scored_", F.lit(False)),
        "excluded without a rule": out & F.col("ruled_").isNull(),
    }
    found = violations(rows, "finding", _named("review", "id"), rules).distinct()
    due = witnesses.where("kind = 'asserted' and not holds").join(findings.select("review", "id"), ["review", "id"], "left_anti")
    return found.unionByName(due.select(F.lit("witness").alias("entity"), _named("review", "id").alias("key"), F.lit("passed over").alias("rule")).distinct())


def review_violations(reviews: DataFrame, checks: DataFrame, records: DataFrame, corrections: DataFrame, defects: DataFrame, owners: DataFrame, atoms: DataFrame, known_files: DataFrame, witnesses: DataFrame | None = None, unresolved: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """(entity, key, rule) of whole reviews; none means that a review may be taken as it is.

    Ids of records, corrections and atoms are those of one table (review and atom together, say); review and defect name
    a defect, review and witness a witness. ``records`` and ``corrections`` are decisions as ``decision_violations`` takes
    them, with review and with members, count, method, scope and location in their items; ``atoms``: review, id, metric.
    Witnesses come with their findings or not at all. What is null is missing wherever a rule needs it.
    """
    times = _times(corrections, ["id"]).join(atoms.select("id", F.lit(True).alias("known_")).distinct(), "id", "left")
    parts = [
        check_violations(reviews, checks),
        violations(times, "correction", F.col("id"), {"unknown": F.col("known_").isNull(), "repeated": F.col("times_") > 1}).distinct(),
        decision_violations(corrections, known_files).withColumn("entity", F.lit("correction")),
    ]
    final = final_records(records, corrections)
    parts.append(accounting(final).where("not agrees").select(F.lit("record").alias("entity"), F.col("id").cast("string").alias("key"), F.col("problem").alias("rule")))
    parts.append(defect_violations(defects, owners, atoms, known_files))
    if witnesses is not None:
        parts.append(relation_violations(witnesses, witnesses.limit(0) if unresolved is None else unresolved, findings, defects, owners, final, atoms))
    return reduce(DataFrame.unionByName, parts)


#: The fields of a review that a patch may change, and those of them that are merged by id.
FIELDS = ("checks", "defects", "corrections", "relation_findings")


def patch_violations(patches: DataFrame) -> DataFrame:
    """Patches (review, fields, corrections) that name other fields than a review's, or correct an atom twice or without an id."""
    ids = F.transform("corrections", lambda c: c["id"])
    rules = {
        "unknown field": F.exists("fields", lambda f: ~F.coalesce(f.isin(*FIELDS), F.lit(False))),
        "correction without an id": F.exists(ids, lambda i: i.isNull()),
        "repeated correction": F.size(F.array_distinct(ids)) < F.size(ids),
    }
    return violations(patches, "patch", F.col("review"), rules)


def patched(draft: DataFrame, patch: DataFrame) -> DataFrame:
    """Corrections (review, id, pos, ...) of a draft with those of a patch: replaced in their place, new ones behind."""
    keys = ["review", "id"]
    last = draft.groupBy("review").agg(F.max("pos").alias("last_"))
    at = draft.select(*keys, F.col("pos").alias("at_"))
    moved = patch.join(at, keys, "left").join(last, "review", "left").withColumn("pos", F.coalesce("at_", F.col("pos") + F.coalesce(F.col("last_") + 1, F.lit(0)))).select(*patch.columns)
    return draft.join(patch.select(*keys), keys, "left_anti").unionByName(moved)
