"""Stored results against what they follow from, and reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import numbers
from tallyloom.functions.text import label_key, markdown_safe, short_reason, similarity, stripped, summary_text
from tallyloom.operators import score
from tallyloom.operators.relate import positional_pairs, violations
from tallyloom.operators.review import shared_references

# The words of a sentence on differences, and of one on subjects that differ in no item.
MEETS, FAILS, MORE_DIFFERENCES = "满足，", "未满足", "；另有 %d 个同项差异见逐项依据"
NOT_PASSED, SATISFIED, UNNAMED, SEE_BELOW = "%d项未通过，如", "本项满足规则", "核验项", "。具体核验清单和判定见下文。"


def recomputed(contributions: DataFrame, caps: DataFrame, scopes: DataFrame, keys: list[str], whole: str | None = "completion") -> DataFrame:
    """raw and final per key and metric: weighted sums, atoms of scoped zero ceilings taken out, then the other ceilings.

    ``caps`` has keys, metric and cap without scope, ``scopes`` keys, metric and atom of scoped ceilings. raw counts all atoms.
    """
    raw = score.metric_scores(contributions, keys, whole=whole)
    left = score.metric_scores(score.zero_scoped(contributions, scopes, [*keys, "metric", "atom"]), keys, whole=whole)
    final = score.apply_caps(left, caps, [*keys, "metric"]).select(*keys, "metric", "final")
    return raw.join(final, [*keys, "metric"])


def score_mismatches(stored: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Stored scores (keys, metric, raw, final) that differ from those computed again, or that only one side has."""
    new = again.select(*keys, "metric", F.col("raw").alias("raw_again"), F.col("final").alias("final_again"))
    both = stored.withColumn("there", F.lit(True)).join(new, [*keys, "metric"], "full_outer")
    same = F.coalesce("there", F.lit(False)) & F.col("raw").eqNullSafe(F.col("raw_again")) & F.col("final").eqNullSafe(F.col("final_again"))
    return both.where(~same).drop("there")


def scoped_violations(rules: DataFrame) -> DataFrame:
    """(entity, key, rule) of ceilings held to some atoms that aren't zero: they would need a formula of their own."""
    return violations(rules, "ceiling", F.col("id"), {"scoped ceiling isn't zero": (F.size("scope") > 0) & (F.col("cap") != 0)})


def shared_sample_violations(atoms: DataFrame, decisions: DataFrame, items: DataFrame, keys: list[str], least: float = 0.85, version: int = 3) -> DataFrame:
    """(keys, id, source, rule) of findings that should share another's sample and don't.

    ``atoms``: id, kind, rule. ``decisions``: keys, id, denominator, review_version. ``items``: keys, id, pos, label. A ratio
    that shares one known atom's sample has as many items, as many as that one's denominator, and the same labels place by
    place; one that shares several must come from a review of at least ``version``.
    """
    shared = atoms.select("id", "kind", shared_references(F.col("rule")).alias("of"))
    many = decisions.join(shared.where(F.size("of") > 1), "id").where(F.coalesce(F.col("review_version") < version, F.lit(True)))
    many = many.select(*keys, "id", F.array_join("of", "/").alias("source"), F.lit("several samples without their review").alias("rule"))
    edge = shared.where((F.size("of") == 1) & F.col("kind").isin("RATIO", "CLAIM-RATIO")).select("id", F.col("of")[0].alias("source"))
    sized = decisions.join(items.groupBy(*keys, "id").agg(F.count("*").alias("n")), [*keys, "id"], "left").select(*keys, "id", "denominator", F.coalesce("n", F.lit(0)).alias("n"))
    source = sized.select(*keys, F.col("id").alias("source"), F.col("denominator").alias("required"), F.col("n").alias("source_n"))
    pairs = sized.join(edge, "id").join(source, [*keys, "source"])
    pair_keys = [*keys, "id", "source"]
    left = pairs.select(*pair_keys).join(items.select(*keys, F.col("id").alias("source"), "pos", label_key("label").alias("key")), [*keys, "source"])
    right = pairs.select(*pair_keys).join(items.select(*keys, "id", "pos", label_key("label").alias("key")), [*keys, "id"])
    zipped = positional_pairs(left, right, pair_keys, "pos", "key")
    alike = F.coalesce((F.length("left_value") > 0) & (F.length("right_value") > 0) & (similarity("left_value", "right_value") >= least), F.lit(False))
    matched = zipped.groupBy(*pair_keys).agg(F.every(alike).alias("same"))
    told = pairs.join(matched, pair_keys, "left")
    counts = (F.col("denominator") != F.col("required")) | (F.col("n") != F.col("required")) | (F.col("source_n") != F.col("required"))
    rule = F.when(F.coalesce(counts, F.lit(True)), "counts differ").when(~F.coalesce("same", F.lit(True)), "labels differ")
    return told.select(*pair_keys, rule.alias("rule")).where("rule is not null").unionByName(many)


def _alone(items: Column, state: Column, observation: Column, reason: Column, name: Column, shown: int) -> Column:
    """What is said of one subject where no item differs: its failed items, or what was seen, or why it lost."""
    failed = F.filter(items, lambda x: F.coalesce(~x["passed"], F.lit(False)))
    named = F.transform(F.slice(failed, 1, shown), lambda x: markdown_safe(F.coalesce(F.nullif(stripped(x["label"]), F.lit("")), F.nullif(x["source"], F.lit("")), F.lit(UNNAMED))))
    full = F.coalesce(F.nullif(observation, F.lit("")), F.nullif(reason, F.lit("")), F.lit(SATISFIED))
    lost = F.coalesce(F.nullif(reason, F.lit("")), observation, F.lit(""))
    told = F.when(F.coalesce(F.size(failed) > 0, F.lit(False)), F.concat(F.format_string(NOT_PASSED, F.size(failed)), F.array_join(named, "、")))
    return F.concat(markdown_safe(name), F.lit("："), F.coalesce(told, markdown_safe(short_reason(F.when(numbers.state(state.cast("string")) == 1, full).otherwise(lost)))))


def difference_sentence(left: Column, right: Column, left_name: Column, right_name: Column, shown: int = 2) -> Column:
    """What two subjects' records (items, state, observation, reason) of one finding differ in.

    Items (label, passed, source) of one label are compared; of a label's repeats on the right the last counts. Where none
    differs, each subject's failed items are named, or its observation or reason.
    """
    ours, theirs = (F.coalesce(side["items"], F.filter(other["items"], lambda x: F.lit(False))) for side, other in ((left, right), (right, left)))
    partner = lambda x: F.try_element_at(F.filter(theirs, lambda y: stripped(y["label"]) == stripped(x["label"])), F.lit(-1))
    found = F.filter(ours, lambda x: F.coalesce((stripped(x["label"]) != "") & (x["passed"] != partner(x)["passed"]), F.lit(False)))
    a, b = markdown_safe(left_name), markdown_safe(right_name)
    told = F.transform(F.slice(found, 1, shown), lambda x: F.concat(markdown_safe(stripped(x["label"])), F.lit("："), F.when(x["passed"], a).otherwise(b), F.lit(MEETS), F.when(x["passed"], b).otherwise(a), F.lit(FAILS)))
    more = F.when(F.size(found) > shown, F.format_string(MORE_DIFFERENCES, F.size(found) - shown)).otherwise("")
    each = [_alone(side["items"], side["state"], side["observation"], side["reason"], name, shown) for side, name in ((left, left_name), (right, right_name))]
    listed = (F.size(left["items"]) > 0) & (F.size(right["items"]) > 0)
    alike = F.concat(each[0], F.lit("；"), each[1], F.when(F.coalesce(listed, F.lit(False)), F.lit(SEE_BELOW)).otherwise("。"))
    return F.when(F.coalesce(F.size(found) > 0, F.lit(False)), F.concat(F.array_join(told, "；"), more)).otherwise(alike)


def summary_lines(scores: DataFrame, metrics: list[str], keys: list[str], value: str = "final", percent: str | None = None) -> DataFrame:
    """(keys, line): rows of a Markdown table with a cell per metric, two decimals half up, ``percent`` names one in per cent."""
    cell = lambda m: F.max(F.when(F.col("metric") == m, F.concat(numbers.display(F.col(value)), F.lit("%" if m == percent else ""))))
    wide = scores.groupBy(*keys).agg(*(cell(m).alias(f"cell_{i}") for i, m in enumerate(metrics)))
    cells = [F.coalesce(f"cell_{i}", F.lit("")) for i in range(len(metrics))]
    return wide.select(*keys, F.concat(F.lit("| "), F.concat_ws(" | ", *(markdown_safe(F.col(k).cast("string")) for k in keys), *cells), F.lit(" |")).alias("line"))


def verification_scope(decisions: DataFrame, limit: int = 500) -> DataFrame:
    """Claim ratios with what was looked at, shortened; operational traces are left out."""
    return decisions.where("kind = 'CLAIM-RATIO'").withColumn("scope_note", short_reason(summary_text(F.col("observation")), limit)).drop("observation")


def facts(results: DataFrame, dropped: tuple[str, ...] = ("process", "process_stats")) -> DataFrame:
    """Results without what says how a run went."""
    return results.drop(*dropped)


def with_process(tasks: DataFrame, process: DataFrame, keys: list[str], fallback: DataFrame | None = None) -> DataFrame:
    """Tasks with their process record; without one, its columns are null. A time of running that the record lacks comes
    from ``fallback`` (keys, executed_at)."""
    out = tasks.join(process, keys, "left")
    if fallback is not None:
        out = out.join(fallback.select(*keys, F.col("executed_at").alias("executed_at_")), keys, "left").withColumn("executed_at", F.coalesce("executed_at", "executed_at_")).drop("executed_at_")
    return out


def missing_process(tasks: DataFrame, subjects: DataFrame, process: DataFrame) -> DataFrame:
    """(task, subject) pairs without a process record; subjects, one to three by rule, go to every task as an array."""
    names = subjects.agg(F.array_sort(F.collect_set("subject")).alias("names"))
    grid = tasks.select("task").join(F.broadcast(names)).select("task", F.explode("names").alias("subject"))
    return grid.join(process.select("task", "subject"), ["task", "subject"], "left_anti")


def selected(pool: DataFrame, selection: DataFrame, key: str = "id") -> DataFrame:
    """Entries of a pool in the order of their selection (key, pos); ids that the pool lacks are left out."""
    return selection.join(pool, key).orderBy("pos")


def selection_violations(pool: DataFrame, selection: DataFrame, key: str = "id") -> DataFrame:
    """(entity, key, rule): ids chosen twice or that the pool lacks."""
    times = selection.groupBy(key).agg(F.count("*").alias("times"))
    known = times.join(pool.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    return violations(known, "selection", F.col(key), {"unknown": F.col("known").isNull(), "repeated": F.col("times") > 1})


def marked_lines(lines: DataFrame, markers: list[str], keys: list[str], k: int = 5) -> DataFrame:
    """The first ``k`` lines of each text (keys, pos, line) that hold a marker, trimmed."""
    held = lines.where(F.col("line").rlike("|".join(f"\\Q{m}\\E" for m in markers)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    return held.withColumn("nth", nth).where(F.col("nth") <= k).withColumn("line", stripped("line"))


def in_scope(tasks: DataFrame, dimensions: list | None = None, ids: list | None = None) -> DataFrame:
    """Tasks of the configured dimensions and ids; an empty list keeps all."""
    if dimensions:
        tasks = tasks.where(F.col("dimension").isin(*dimensions))
    return tasks.where(F.col("task").isin(*ids)) if ids else tasks
