"""The lines of a task's report beside its score table: ceilings, differences, items, corrections and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.numbers import display
from tallyloom.functions.text import markdown_safe, stripped
from tallyloom.operators.results import UNNAMED, difference_sentence

# The words of these lines.
TRIGGERED, AND, SEE_RECORD = "：触发 ", "；", "。具体依据见该对象的关键错误与封顶记录。"
ONLY_FOR, LOCAL_CEILING = "仅对 ", " 应用局部上限 "
PASSED, NOT_PASSED, PLACE, GROUND, QUOTE = "通过", "未通过", "；位置：", "；依据：", "；摘录："
LEFT_OUT = "- 其余 %d 条核验项见完整 JSON；此处未省略已识别的未通过项。"
EVIDENCE, SEEN = "- 证据：`", "视觉观察："
CORRECTED, FORMER, AUDITED, CHANGED, TO, END = "- 记录修正：", " 原分母 ", "，实际计分样本 ", " 判定由 ", " 改为 ", "。"

_CHANGES = "array<struct<kind:int,order:bigint,nth:int,text:string>>"


def _filled(*columns: Column) -> Column:
    """The first text that isn't null or empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def ceiling_notes(scores: DataFrame, errors: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(task, subject, line) of results with triggered errors: which they are, and what they did to which metric.

    ``scores``: task, subject, name, metric, raw, final, capped, scoped (atoms, ceiling); ``errors``: task, subject, pos, id,
    triggered; ``labels``: metrics in order with their names. First whole ceilings by metric, then those of some atoms.
    """
    keys = ["task", "subject"]
    said = errors.where("triggered").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("e"))
    said = said.select(*keys, F.array_join(F.transform("e", lambda x: x["id"]), "、").alias("ids"))
    order = F.array_position(F.array(*map(F.lit, labels)), F.col("metric"))
    label = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[F.col("metric")]
    lists = F.coalesce("scoped", F.array().cast(scores.schema["scoped"].dataType))
    whole = F.when(F.coalesce("capped", F.lit(False)) | (F.size(lists) > 0), F.array(F.struct(F.lit(0).alias("kind"), order.alias("order"), F.lit(0).alias("nth"), F.concat(label, F.lit(" "), display(F.col("raw")), F.lit(" → "), display(F.col("final"))).alias("text"))))
    local = F.transform(lists, lambda x, i: F.struct(F.lit(1).alias("kind"), order.alias("order"), i.alias("nth"), F.concat(label, F.lit(ONLY_FOR), F.array_join(x["atoms"], "、"), F.lit(LOCAL_CEILING), x["ceiling"].cast("string")).alias("text")))
    none = F.array().cast(_CHANGES)
    parts = scores.select(*keys, "name", F.concat(F.coalesce(whole.cast(_CHANGES), none), local.cast(_CHANGES)).alias("c"))
    changes = parts.groupBy(*keys).agg(F.max("name").alias("name"), F.array_sort(F.flatten(F.collect_list("c"))).alias("c"))
    line = F.concat(F.lit("- "), markdown_safe(F.col("name")), F.lit(TRIGGERED), F.col("ids"), F.lit(AND), F.array_join(F.transform("c", lambda x: x["text"]), AND), F.lit(SEE_RECORD))
    return said.join(changes, keys).select(*keys, line.alias("line"))


def difference_rows(records: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(task, pos, line): rows of the table of differences, of atoms whose states, as shown, aren't all the same.

    ``records``: task, id, metric, pos, subject_pos, name, state, items (label, passed, source), observation, reason. Each
    subject whose state isn't the first one's is compared with it.
    """
    one = F.struct("subject_pos", "name", F.col("state").cast("string").alias("state"), "items", "observation", "reason")
    rows = records.groupBy("task", "id", "metric", "pos").agg(F.array_sort(F.collect_list(F.struct("subject_pos", one.alias("r")))).alias("all_"))
    rows = rows.withColumn("all_", F.transform("all_", lambda x: x["r"]))
    shown = F.transform("all_", lambda x: display(x["state"].try_cast("decimal(38,18)")))
    first = F.col("all_")[0]
    value = lambda x: x["state"].try_cast("decimal(38,18)")
    others = F.filter(F.slice(F.col("all_"), 2, 1 << 20), lambda x: value(x) != value(first))
    told = F.array_join(F.transform(others, lambda x: difference_sentence(first, x, first["name"], x["name"])), AND)
    label = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[F.col("metric")]
    line = F.concat(F.lit("| "), F.col("id"), F.lit("（"), label, F.lit("） | "), F.array_join(shown, " / "), F.lit(" | "), told, F.lit(" |"))
    return rows.where(F.size(F.array_distinct(shown)) > 1).select("task", "pos", line.alias("line"))


def item_line(x: Column) -> Column:
    """A checked item (label, source, result, verdict, passed, location, locator, scope, reason, explanation, note, basis, quote)."""
    outcome = F.when(x["passed"], PASSED).when(~x["passed"], NOT_PASSED).otherwise(_filled(x["result"], x["verdict"]))
    place, note = _filled(x["location"], x["locator"], x["scope"]), _filled(x["reason"], x["explanation"], x["note"], x["basis"])
    part = lambda word, text: F.when(text != "", F.concat(F.lit(word), text)).otherwise("")
    name = F.coalesce(F.nullif(stripped(x["label"]), F.lit("")), F.nullif(x["source"], F.lit("")), F.lit(UNNAMED))
    return F.concat(F.lit("- "), markdown_safe(F.concat(name, F.lit(" — "), outcome, part(PLACE, place), part(GROUND, note), part(QUOTE, _filled(x["quote"])))))


def item_lines(items: Column, few: int = 10, shown: int = 2) -> Column:
    """Lines of a finding's items: all of up to ``few``; of more every one that isn't passed and the first ``shown`` that are,
    then how many are left out."""
    passed = F.transform(items, lambda x: F.coalesce(x["passed"], F.lit(False)))
    nth = F.transform(items, lambda _, i: F.size(F.filter(F.slice(passed, 1, i + 1), lambda p: p)))
    kept = F.filter(items, lambda x, i: (F.size(items) <= few) | ~F.coalesce(x["passed"], F.lit(False)) | (F.get(nth, i) <= shown))
    left = F.size(items) - F.size(kept)
    return F.concat(F.transform(kept, item_line), F.when(left > 0, F.array(F.format_string(LEFT_OUT, left))).otherwise(F.array().cast("array<string>")))


def correction_line(c: Column) -> Column:
    """A correction (reason, original_denominator, audited_count, from, to) of a record."""
    both = lambda a, b, text: F.when(a.isNotNull() & b.isNotNull(), text).otherwise("")
    counted = both(c["original_denominator"], c["audited_count"], F.concat(F.lit(FORMER), c["original_denominator"].cast("string"), F.lit(AUDITED), c["audited_count"].cast("string"), F.lit(END)))
    judged = both(c["from"], c["to"], F.concat(F.lit(CHANGED), c["from"].cast("string"), F.lit(TO), c["to"].cast("string"), F.lit(END)))
    return F.concat(F.lit(CORRECTED), markdown_safe(F.concat(_filled(c["reason"]), counted, judged)))


def evidence_line(e: Column) -> Column:
    """A piece of evidence (file, locator, kind, quote, description): what it shows, or its quote."""
    seen = (e["kind"] == "visual") & (_filled(e["description"]) != "")
    content = F.when(F.coalesce(seen, F.lit(False)), F.concat(F.lit(SEEN), e["description"])).otherwise(_filled(e["quote"]))
    safe = lambda c: markdown_safe(_filled(c))
    return F.concat(F.lit(EVIDENCE), safe(e["file"]), F.lit("` · "), safe(e["locator"]), F.lit(" · "), markdown_safe(content))
