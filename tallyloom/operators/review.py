"""Reviews of decisions: affected findings, allowed corrections, locked samples, owners, witnesses and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import numbers
from tallyloom.functions.text import label_key, plain, signed_numbers, similarity, stripped
from tallyloom.operators.relate import positional_pairs, violations


def affected_metrics(errors: DataFrame, rules: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct (task, metric) that ceilings of triggered errors touch, dealt over ``parts`` partitions where that is given;
    ``rules`` are a literal table, few errors, so that a shuffle by error would leave a task or two with all rows."""
    touched = errors.where("triggered").join(F.broadcast(rules), "error").select("task", "metric")
    return (touched.repartition(parts, "task", "metric") if parts else touched).distinct()


def eligible(decisions: DataFrame, affected: DataFrame) -> DataFrame:
    """Findings that cost points in an affected metric: what a critical review may correct."""
    return decisions.where("state < 1").join(affected, ["task", "metric"], "left_semi")


def mentioned(text: Column) -> Column:
    """All atom ids that stand in a text, whatever is said of them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])([A-Z]+\d+)(?![A-Za-z0-9])"), F.lit(1)))


# The words before ids that a rule refers to, and before ids whose sample it shares.
SAME, SHARED = "同", "(?:核验全集|核验集合与抽样清单)\\s*同"


def _after(rule: Column, words: str) -> Column:
    listed = F.regexp_extract(rule, rf"{words}\s*([A-Z]\d+(?:\s*/\s*[A-Z]\d+)*)", 1)
    return F.regexp_extract_all(listed, F.lit(r"[A-Z]\d+"), F.lit(0))


def references(rule: Column) -> Column:
    """Atom ids of the first list (ids parted by slashes) that a rule calls the same as its own."""
    return _after(rule, SAME)


def shared_references(rule: Column) -> Column:
    """Atom ids whose whole review set, and not only its way of sampling, a rule shares."""
    return _after(rule, SHARED)


def reference_edges(atoms: DataFrame) -> DataFrame:
    """(start, node): atoms and the known atoms that their rules mention: what a review's context grows along."""
    named = atoms.select(F.col("id").alias("start"), F.explode(mentioned(F.col("rule"))).alias("node"))
    return named.join(atoms.select(F.col("id").alias("node")), "node", "left_semi").select("start", "node")

def correction_violations(before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """(entity, key, rule) of corrections outside the eligible findings, that lower a state, or come twice."""
    old = before.select("id", F.col("state").alias("old"))
    count = after.groupBy("id").agg(F.count("*").alias("times"))
    joined = after.join(old, "id", "left").join(count, "id").join(allowed.select("id", F.lit(True).alias("ok")), "id", "left")
    return violations(joined, "correction", F.col("id"), {"unknown": F.col("old").isNull(), "not eligible": F.col("ok").isNull(), "lowers the state": F.col("state") < F.col("old"), "repeated": F.col("times") > 1})


def locked_samples(before: DataFrame, after: DataFrame, least: float = 0.85) -> DataFrame:
    """(id, same, first_mismatch): whether a claim sample (id, pos, label) kept its claims, place by place and nearly word by word."""
    pairs = positional_pairs(before.withColumn("key", label_key("label")), after.withColumn("key", label_key("label")), ["id"], "pos", "key")
    alike = F.coalesce((F.length("left_value") > 0) & (F.length("right_value") > 0) & (similarity("left_value", "right_value") >= least), F.lit(False))
    return pairs.withColumn("alike", alike).groupBy("id").agg(F.every("alike").alias("same"), F.min(F.when(~F.col("alike"), F.col("nth"))).alias("first_mismatch"))


def corrected_records(records: DataFrame, corrections: DataFrame, values: list[str]) -> DataFrame:
    """Records in their order, with corrected values where there are some."""
    patch = corrections.select("id", *(F.col(v).alias(f"{v}_new") for v in values))
    kept = [F.coalesce(f"{c}_new", c).alias(c) if c in values else F.col(c) for c in records.columns]
    return records.join(patch, "id", "left").select(*kept)


def owner_violations(owners: DataFrame, atoms: DataFrame) -> DataFrame:
    """Defect owners that name no atom of their metric, and metrics that own a defect twice."""
    known = owners.join(atoms.select(F.col("id").alias("atom_id"), "metric", F.lit(True).alias("known")), ["atom_id", "metric"], "left")
    twice = owners.groupBy("defect", "metric").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("defect").alias("entity"), F.col("defect").cast("string").alias("key"), F.lit("two owners in a metric").alias("rule"))
    return violations(known, "defect", F.col("defect"), {"unknown owner": F.col("known").isNull()}).unionByName(twice)


def witness_check(witnesses: DataFrame) -> DataFrame:
    """Comparison witnesses with their truth and what is wrong with them.

    Needs id, operator, left and right (value, unit, quote). A scalar must stand in its own quote, in full or rounded
    half up; ranges and unlike units get no truth. Broken ones are for the unresolved list, the rest stay.
    """

    def in_quote(side: str) -> Column:
        value = numbers.scalar(F.col(f"{side}.value"))
        places = F.length(F.regexp_extract(F.col(f"{side}.value"), r"\.(\d+)\s*$", 1))
        found = F.transform(signed_numbers(F.col(f"{side}.quote")), lambda x: x.try_cast(numbers.DECIMAL))
        rounded = lambda x: F.try_element_at(F.array(*(F.round(x, p).cast(numbers.DECIMAL) for p in range(13))), places + 1)
        near = lambda x: (x == value) | F.coalesce(rounded(x) == value, F.lit(False))
        return value.isNull() | F.exists(found, lambda x: F.coalesce(near(x), F.lit(False)))

    truth = numbers.relation_holds(F.col("left.value"), F.col("operator"), F.col("right.value"), F.col("left.unit"), F.col("right.unit"))
    return witnesses.dropna(subset=["id"]).withColumn("times", F.count("*").over(Window.partitionBy("id"))).select(
        "*",
        truth.alias("holds"),
        F.array_compact(
            F.array(
                F.when(F.col("times") > 1, "repeated id"),
                F.when(~F.coalesce(F.col("operator").isin("gt", "lt", "ge", "le", "eq"), F.lit(False)), "operator"),
                F.when(~in_quote("left"), "left not in its quote"),
                F.when(~in_quote("right"), "right not in its quote"),
                F.when(F.col("left.unit").isNull() | F.col("right.unit").isNull(), "no unit"),
            )
        ).alias("broken"),
    )


def unfounded_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes (id, file, quote) that don't occur in their file's text, white space and references aside."""
    joined = quotes.join(texts.select("file", "text"), "file", "left")
    inside = F.contains(plain(F.col("text")), plain(F.col("quote")))
    return joined.where(~F.coalesce(inside, F.lit(False))).select("id", "file", "quote")


def uncovered(required: DataFrame, *found: DataFrame, key: str = "id") -> DataFrame:
    """Required keys that none of the reviews covers."""
    for f in found:
        required = required.join(f.select(key), key, "left_anti")
    return required


def supported_share(items: DataFrame, keys: list[str]) -> DataFrame:
    """Supported items, all items and their ratio."""
    return items.groupBy(*keys).agg(F.count_if(F.coalesce("supported", F.lit(False))).alias("numerator"), F.count("*").alias("denominator")).withColumn("state", F.try_divide("numerator", "denominator"))


def wrong_scope(returned: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Returned ids that weren't asked for, and asked ones that didn't come: (keys, problem)."""
    extra = returned.join(asked, keys, "left_anti").select(*keys, F.lit("not asked for").alias("problem"))
    return extra.unionByName(asked.join(returned, keys, "left_anti").select(*keys, F.lit("missing").alias("problem")))


def is_permanent(messages: Column, markers: list[str]) -> Column:
    """Whether any message of a failure holds a marker, case aside."""
    return F.exists(messages, lambda m: F.coalesce(F.lower(m).rlike("|".join(f"\\Q{x.lower()}\\E" for x in markers)), F.lit(False)))


def needs_time_review(kind: Column, state: Column, rule: Column, executed_at: Column) -> Column:
    """A failed binary check on when something ran, without a known time of running."""
    known = F.length(stripped(F.coalesce(executed_at.cast("string"), F.lit("")))) > 0
    return F.coalesce((kind == "BIN") & (state == 0) & rule.contains("实际执行") & rule.contains("截止"), F.lit(False)) & ~known


def shallow_files(files: DataFrame, keys: list[str], k: int = 12, budget: int = 3000) -> DataFrame:
    """The ``k`` shallowest files of each category, by depth and path, while their names fit a budget of characters."""
    order = Window.partitionBy(*keys).orderBy("depth", "file")
    depth = F.length("file") - F.length(F.replace("file", F.lit("/"), F.lit("")))
    top = files.withColumn("depth", depth).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return top.withColumn("used", F.sum(F.length("file")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= budget)
