"""Column functions over model answers as JSON text: labels by their aliases, verdicts, envelopes, pages and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import once, short_reason, stripped, summary_text, verdict

# The fields that may hold a claim, and those that name an item in reports, in the order in which they are tried.
CLAIM_FIELDS = ("claim", "element", "statement", "subject", "item", "name", "claim_group", "checkpoint")
LABEL_FIELDS = ("claim", "element", "statement", "entry", "name", "id")
# Beginnings of words that support a claim, that deny it, that make a source fact positive, and that leave an item out.
SUPPORTED = "supported|satisfied|yes|true|有支撑|满足"
UNSUPPORTED = "unsupported|not satisfied|no|false|无支撑|不满足"
POSITIVE = "supported|consistent|correct|satisfied|有支撑|一致|正确|满足"
EXCLUDED = r"excluded\b|not_applicable\b|not applicable\b|n/a\b|排除(?:[（(:：]|$)|剔除(?:[（(:：]|$)|不计入(?:[（(:：]|$)"
# The note on counts that differ, and the end of a list that shows only its first items.
COUNTS_DIFFER, MORE_FAILED = "展示清单 %d 条，计分对象 %d 项；分组、排除等对应关系见本项计数依据和核验范围。", "；另有 %d 项，详见逐题结果"


def _field(c: Column, name: str) -> Column:
    return F.get_json_object(c, f"$.{name}")


def _filled(c: Column) -> Column:
    """Null for what counts as empty: no text, zero, false, an empty list or object."""
    return once(c, lambda x: F.when(~x.isin("", "0", "0.0", "false", "[]", "{}"), x))


def claim_label(c: Column) -> Column:
    """The claim of an item, by the first field that has one; empty if none does. A JSON null counts as absent."""
    return F.coalesce(*(_filled(_field(c, f)) for f in CLAIM_FIELDS), F.lit(""))


def item_label(c: Column) -> Column:
    """The name of an item in reports."""
    return F.coalesce(*(_filled(_field(c, f)) for f in LABEL_FIELDS), F.lit(""))


def _outcome(c: Column) -> Column:
    return F.coalesce(_field(c, "verdict"), _field(c, "result"))


def item_passed(c: Column) -> Column:
    return verdict(_outcome(c))


def supported(c: Column) -> Column:
    """True, false or null: the field ``supported`` if it is a boolean, else what verdict or result begin with."""
    value = F.try_variant_get(F.try_parse_json(c), "$.supported", "variant")
    flag = F.when(F.schema_of_variant(value) == "BOOLEAN", _field(c, "supported") == "true")
    word = F.lower(stripped(F.coalesce(_outcome(c), _field(c, "supported"), F.lit(""))))
    return F.coalesce(flag, F.when(word.rlike(f"^(?:{SUPPORTED})"), True).when(word.rlike(f"^(?:{UNSUPPORTED})"), False))


def source_positive(result: Column) -> Column:
    """Whether a source's verified fact is positive, and thereby supported wherever it is used."""
    return F.coalesce(F.lower(stripped(result)).rlike(f"^(?:{POSITIVE})"), F.lit(False))


def excluded(c: Column) -> Column:
    """Whether an item is listed without being counted."""
    word = F.lower(stripped(F.coalesce(_filled(_field(c, "result")), _field(c, "verdict"), F.lit(""))))
    return (F.coalesce(_field(c, "included"), F.lit("")) == "false") | (F.coalesce(_field(c, "applicable"), F.lit("")) == "false") | word.rlike(f"^(?:{EXCLUDED})")


def counting_note(items: Column, denominator: Column) -> Column:
    """A note where the items of a finding (JSON texts), counted without excluded ones, aren't as many as its denominator."""
    d, n = denominator.cast("decimal(38,9)"), F.size(items)
    counts = F.size(F.filter(items, lambda x: ~excluded(x)))
    odd = (d > 0) & (d <= 100) & (d == F.floor(d)) & (n != d) & (counts != d)
    return F.when(odd, F.format_string(COUNTS_DIFFER, n, d.cast("int")))


# What is said of a failed item without a note, by the beginning of its outcome, and of one without a name.
UNREACHED, UNSOURCED, UNLIKE, UNNAMED = "页面无法取得，来源及内容未获证实", "缺少可识别的来源支撑", "与已核来源不一致", "核验项"


def failed_item(c: Column) -> Column:
    """A failed item as prose: its name, its place unless that is a file of the workspace, and its note or what its outcome says."""
    name = F.coalesce(*(_filled(_field(c, f)) for f in ("claim", "element", "source", "id")), F.lit(UNNAMED))
    outcome = F.lower(stripped(F.coalesce(_outcome(c), F.lit(""))))
    said = once(outcome, lambda x: F.when(x.startswith("not satisfied"), UNREACHED).when(x.startswith("unsupported"), UNSOURCED).otherwise(UNLIKE))
    note = F.coalesce(_filled(_field(c, "note")), _filled(_field(c, "reason")), said)
    place = F.coalesce(_filled(_field(c, "location")), _filled(_field(c, "scope")), F.lit(""))
    place = once(place, lambda x: F.when((x == "") | x.rlike("^(?:extracted|deliveries)/"), "").otherwise(F.concat(F.lit("（"), x, F.lit("）"))))
    return F.concat(name, place, F.lit("："), short_reason(note, 85))


def loss_brief(items: Column, numerator: Column, denominator: Column, reason: Column, shown: int = 2) -> Column:
    """A loss in a sentence: its ratio, then its first failed items (JSON texts) and how many more there are, or its whole reason."""
    ratio = F.when(denominator.isNotNull(), F.concat(numerator.cast("string"), F.lit("/"), denominator.cast("string"), F.lit("；"))).otherwise("")

    def told(failed: Column) -> Column:
        more = F.when(F.size(failed) > shown, F.format_string(MORE_FAILED, F.size(failed) - shown)).otherwise("")
        said = F.concat(F.array_join(F.transform(F.slice(failed, 1, shown), failed_item), "；"), more, F.lit("。"))
        return F.when(F.size(failed) > 0, said).otherwise(summary_text(reason))

    failed = F.filter(items, lambda x: F.coalesce(~item_passed(x), F.lit(False)))
    return F.concat(ratio, once(failed, told))


def _list(c: Column) -> Column:
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>"))


def atom_records(c: Column) -> Column:
    """Records of an answer, as JSON texts: a list, the list under ``atoms``, the record under ``atom``, or the answer itself if it is one."""
    one = F.coalesce(_field(c, "atom"), c)
    single = F.when(F.ltrim(one).startswith("{") & _field(one, "id").isNotNull() & _field(one, "state").isNotNull(), F.array(one))
    return F.coalesce(_list(c), _list(_field(c, "atoms")), single, F.array().cast("array<string>"))


def json_at(c: Column, path: list) -> Column:
    """What stands at a path of keys and whole numbers, as JSON text."""
    steps = "".join(f"[{p}]" if isinstance(p, int) and not isinstance(p, bool) else f"['{p}']" for p in path)
    return F.get_json_object(c, "$" + steps) if path else c


def json_page(c: Column, path: list, offset: int = 0, limit: int = 25) -> Column:
    """A page of the list or object at a path: keys (null for lists) and values as JSON text, the total and the next offset.

    An object's entries come in the text's order. Of a single value the total is null and the page holds it alone.
    """
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("a page begins at entry 0 or later and holds 1 to 100 entries")
    here = json_at(c, path)
    is_object = F.ltrim(here).startswith("{")
    keys = F.when(is_object, F.json_object_keys(here))
    held = F.from_json(here, "map<string,string>")
    values = F.when(is_object, F.transform(keys, lambda k: F.try_element_at(held, k))).when(F.ltrim(here).startswith("["), F.from_json(here, "array<string>"))
    total = F.size(values)
    return F.struct(
        F.when(is_object, F.slice(keys, offset + 1, limit)).alias("keys"),
        F.when(values.isNull(), F.array(here)).otherwise(F.slice(values, offset + 1, limit)).alias("values"),
        F.when(values.isNotNull(), total.cast("long")).alias("total"),
        F.when(values.isNotNull() & (total > offset + limit), F.lit(offset + limit).cast("long")).alias("next_offset"),
    )


def json_digest(c: Column) -> Column:
    """A digest of a JSON document that the order of its keys and its white space don't change."""
    return F.sha2(F.to_json(F.try_parse_json(c)), 256)


def unknown_fields(c: Column, allowed: list[str]) -> Column:
    return F.array_except(F.json_object_keys(c), F.array(*(F.lit(a) for a in allowed)))


def reconciled(c: Column, name: str, alias: str) -> Column:
    """(value, conflict) of a field that may come under two names; both, unless they say the same, conflict."""
    a, b = _field(c, name), _field(c, alias)
    return F.struct(F.coalesce(a, b).alias("value"), F.coalesce(json_digest(a) != json_digest(b), F.lit(False)).alias("conflict"))
