"""Decision validation: each rule a condition over one joined table, violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import numbers
from tallyloom.functions.text import is_source_url, stripped
from tallyloom.operators.relate import violations

#: What a decision's explanation must have at least.
REASON_LEAST, OBSERVATION_LEAST, TOLERANCE = 20, 8, "0.005"
# The two formulas of a saturating count, the words of an audited sample, of a passed check, and the
# suffixes of files that a visual finding can come from.
TARGET = r"(\d+(?:\.\d+)?|[A-Za-z_]\w*)"
DIVIDED, CLIPPED = rf"(?i)\bmin\s*\([^\n]*?/\s*{TARGET}\s*[,，]\s*1(?:\.0+)?\s*\)", rf"(?i)\bmin\s*\([^\n]*[,，]\s*{TARGET}\s*\)\s*/\s*{TARGET}"
AUDITED, PASSED = r"(?:实际核验|核验的)\s*(\d+)\s*条", "^(?:非虚构|无问题|satisfied|supported|consistent|correct|有效|通过)"
VISUAL = r"(?i)\.(?:png|jpg|jpeg|webp|gif|bmp|html|htm|pptx|docx|pdf|xlsx)$"


def count_target(rule: Column) -> Column:
    """The target of ``min(n / target, 1)`` or ``min(n, target) / target``; null for any other rule."""
    divided = F.nullif(F.regexp_extract(rule, DIVIDED, 1), F.lit(""))
    a, b = F.regexp_extract(rule, CLIPPED, 1), F.regexp_extract(rule, CLIPPED, 2)
    return F.coalesce(divided, F.when((a != "") & (a == b), a))


def corrected(decisions: DataFrame) -> DataFrame:
    """Audited samples: where a sampling rule is met in full, fewer items are listed than counted, all pass and the text
    gives their number as audited, that number replaces numerator and denominator; the originals stay."""
    said = F.regexp_extract_all(F.concat_ws(" ", "observation", "reason"), F.lit(AUDITED), F.lit(1))
    listed = F.size("items")
    n, d = (numbers.state(F.col(c)) for c in ("numerator", "denominator"))
    passed = F.forall("items", lambda x: F.coalesce(F.lower(x["result"]).rlike(PASSED), F.lit(False)))
    proven = F.contains("rule", F.lit("抽样")) & (n == d) & (d > listed) & (listed > 0) & F.array_contains(said, listed.cast("string")) & passed & (numbers.state(F.col("state")) == 1)
    now = lambda value: F.when(F.coalesce(proven, F.lit(False)), listed.cast(numbers.PART)).otherwise(value.try_cast(numbers.PART))
    return decisions.withColumns({"original_numerator": F.col("numerator"), "original_denominator": F.col("denominator"), "numerator": now(n), "denominator": now(d)})


def computed(decisions: DataFrame) -> DataFrame:
    """Decisions with their state from first principles, and whether their count is capped at a target."""
    fixed = corrected(decisions).withColumn("target", F.when(F.col("kind") != "CLAIM-RATIO", count_target(F.col("rule"))))
    empty = F.contains("rule", F.lit("空集合状态=1")) | (F.contains("rule", F.lit("空集")) & F.contains("rule", F.lit("状态=1")))
    ratio = numbers.ratio_state(F.col("numerator"), F.col("denominator"), F.col("target").isNotNull(), empty)
    return fixed.withColumn("given", numbers.state(F.col("state"))).withColumn("computed", F.when(F.col("kind") == "BIN", F.col("given")).otherwise(ratio))


def has_content(e: Column) -> Column:
    """Whether a piece of evidence has a quote, or is visual, described and of a file that can be looked at."""
    seen = (e["kind"] == "visual") & (F.length(stripped(e["description"])) >= 8) & e["file"].rlike(VISUAL)
    return (F.length(F.coalesce(e["quote"], F.lit(""))) > 0) | F.coalesce(seen, F.lit(False))


def id_violations(entity: str, given: DataFrame, expected: DataFrame, parts: int | None = None) -> DataFrame:
    """(entity, key, rule) where ids aren't exactly the expected ones, each once; a null id is none of them.

    Both sides are counted in one grouping, over ``parts`` partitions where that is given.
    """
    both = given.select("id", F.lit(1).alias("given"), F.lit(0).alias("expected")).unionByName(expected.select("id", F.lit(0).alias("given"), F.lit(1).alias("expected")))
    both = both.repartition(parts, "id") if parts else both
    side = F.when(F.col("id").isNull(), F.col("given")).alias("side")
    grid = both.groupBy("id", side).agg(F.sum("given").alias("n"), F.max("expected").alias("expected"))
    return violations(grid, entity, F.coalesce(F.col("id").cast("string"), F.lit("null")), {"missing": F.col("n") == 0, "unknown": F.col("expected") == 0, "repeated": F.col("n") > 1})


def decision_violations(decisions: DataFrame, known_files: DataFrame, atoms: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(entity, key, rule) of decisions joined with their atoms: id, kind, rule, state, numerator, denominator, reason,
    observation, evidence (file, locator, quote, kind, description) and items (label, result).

    What is null or can't be read is a violation wherever the rule needs it. With ``atoms`` (id), ids must be exactly
    theirs, each once. What needs a shuffle is dealt over ``parts`` partitions where that is given.
    """
    rows = computed(decisions)
    target = F.col("target").try_cast(numbers.PART)
    n, d, ratio = F.col("numerator"), F.col("denominator"), F.coalesce(F.col("kind") != "BIN", F.lit(True))
    shorter = lambda c, least: F.length(stripped(F.coalesce(c, F.lit("")))) < least
    apart = F.abs(F.col("computed") - F.col("given")) > F.lit(TOLERANCE).cast("decimal(4,3)")
    rules = {
        "vague": shorter("reason", REASON_LEAST) | shorter("observation", OBSERVATION_LEAST),
        "no evidence": F.coalesce(F.size("evidence"), F.lit(0)) <= 0,
        "evidence without place or content": F.exists("evidence", lambda e: ~F.coalesce((F.length(e["file"]) > 0) & (F.length(e["locator"]) > 0) & has_content(e), F.lit(False))),
        "binary": ~ratio & ~F.coalesce(F.col("given").isin(0, 1), F.lit(False)),
        "no ratio": ratio & (n.isNull() | d.isNull()),
        "target": ratio & target.isNotNull() & (d != target),
        "bounds": ratio & ((n < 0) | (d < 0) | ((n > d) & F.col("target").isNull())),
        "state": ratio & n.isNotNull() & d.isNotNull() & F.coalesce(apart, F.lit(True)),
        "no items": ratio & (F.col("items").isNull() | ((d > 0) & (F.size("items") <= 0))),
    }
    own = violations(rows, "decision", F.col("id"), rules)
    cited = rows.select("id", F.explode("evidence").alias("e")).select("id", F.col("e.file").alias("file")).where(F.col("file").isNotNull() & ~is_source_url(F.col("file")))
    # A join by sorting takes its number of partitions from the files' side, which is the small one.
    files = known_files.select("file").repartition(parts, "file") if parts else known_files.select("file")
    lost = cited.join(files, "file", "left_anti").select(F.lit("decision").alias("entity"), F.col("id").cast("string").alias("key"), F.lit("unknown file").alias("rule"))
    found = own.unionByName((lost.repartition(parts, "key") if parts else lost).distinct())
    return found if atoms is None else found.unionByName(id_violations("decision", decisions, atoms, parts))


def accepted(decisions: DataFrame, broken: DataFrame) -> DataFrame:
    """Decisions without a violation: the tolerant mode; the strict one asks that ``broken`` be empty."""
    return decisions.join(broken.select(F.col("key").alias("id")), "id", "left_anti")


def error_violations(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """Error decisions: each rule decided once, with a reason, with evidence where triggered."""
    untold = F.length(stripped(F.coalesce("reason", F.lit("")))) == 0
    told = violations(decisions, "error", F.col("id"), {"untyped": F.col("triggered").isNull(), "no reason": untold, "no evidence": F.col("triggered") & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0)})
    return id_violations("error", decisions, rules).unionByName(told)


def lowered(before: DataFrame, after: DataFrame) -> DataFrame:
    """Review corrections that lower a state: never allowed."""
    old = before.select("id", numbers.state(F.col("state")).alias("old"))
    return after.join(old, "id").where(numbers.state(F.col("state")) < F.col("old")).select("id", "old", "state")


#: Fixed value: the method that stands for items which a count alone names.
INSPECTED = "material_inspector"
UNNAMED, UNCOUNTED, TOO_FEW = -1, -2, -3


def _accounted(x: Column) -> Column:
    """How many things an item stands for: its members, what an inspector counted at a place, else itself; a negative
    number says why it can't be told."""
    place = (x["method"] == INSPECTED) & (F.coalesce(x["scope"], F.lit("")) != "") & (F.coalesce(x["location"], F.lit("")) != "")
    count = F.when(stripped(x["count"].cast("string")).rlike("^[-+]?[0-9]+$"), stripped(x["count"].cast("string")).try_cast("long"))
    counted = F.when(count.isNull(), UNCOUNTED).when(count < 1, TOO_FEW).otherwise(count)
    return F.when(x.isNull(), UNNAMED).when(F.size(x["members"]) > 0, F.size(x["members"])).when(F.coalesce(place, F.lit(False)), counted).otherwise(1).cast("long")


def accounting(decisions: DataFrame) -> DataFrame:
    """(id, accounted, denominator, problem, agrees): what a ratio's items stand for, beside the denominator they make up.

    ``decisions``: id, kind, rule, denominator, items (members, count, method, scope, location). Other kinds, ratios
    without a denominator and those whose denominator is a target need no account; as many items as the denominator are
    one. accounted is null where an item can't be counted: it has no fields, or its count is no whole number from 1.
    """
    rows = decisions.withColumn("whole_", F.floor(F.col("denominator").cast("decimal(38,9)")).cast("long")).withColumn("each_", F.transform(F.coalesce("items", F.array().cast(decisions.schema["items"].dataType)), _accounted))
    target = (F.col("kind") != "CLAIM-RATIO") & count_target(F.coalesce("rule", F.lit(""))).isNotNull()
    asked = F.coalesce(F.col("kind").isin("RATIO", "CLAIM-RATIO") & (F.col("denominator").cast("double") != 0) & ~target, F.lit(False))
    wrong = F.try_element_at(F.filter("each_", lambda n: n < 0), F.lit(1))
    total = F.when(wrong.isNull(), F.aggregate("each_", F.lit(0).cast("long"), lambda s, n: s + n))
    open_ = asked & (F.size("each_") != F.col("whole_"))
    problem = F.when(open_, F.when(wrong == UNNAMED, "an item without fields").when(wrong == UNCOUNTED, "no whole count").when(wrong == TOO_FEW, "a count below one").when(total != F.col("whole_"), "items don't make up the denominator"))
    return rows.select("id", F.when(asked, F.when(open_, total).otherwise(F.col("whole_"))).alias("accounted"), F.col("whole_").alias("denominator"), problem.alias("problem"), problem.isNull().alias("agrees"))
