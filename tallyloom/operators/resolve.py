"""Resolutions of disagreements, inventories that keep what is unresolved, prose held to its facts, patches and resumed work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallyloom.functions import numbers
from tallyloom.functions.text import SPACES, stripped
from tallyloom.operators.ordered import numbered
from tallyloom.operators.relate import violations
from tallyloom.operators.review import witness_check

#: What a resolution and a part of a report must have at least, and how a correction says that nothing changed.
LEAST, UNCHANGED = 20, "^(?:维持|保留|不变|unchanged|retain)"
#: What stands between a short reason and the observation that lengthens it, and the other way round.
GROUNDS, SEEN = " 判定依据：", " 具体观察："
#: How numbers are compared: as this decimal, whole (or, where they don't fit it, as text) or rounded to so many places.
EXACT, WHOLE, AS_TEXT = "decimal(38,12)", -1, -2


def resolution_violations(findings: DataFrame, known: DataFrame, contested: DataFrame, errors: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(entity, key, rule) of a resolution: contested ids each resolved, known ids once, with an explanation, and no error
    triggered that isn't ``allowed``. ``findings``: id, resolution; ``errors``: id, triggered."""
    times = findings.groupBy("id").agg(F.count("*").alias("times"))
    rows = findings.join(times, "id", "left").join(known.select("id").distinct().withColumn("known", F.lit(True)), "id", "left")
    short = F.length(stripped(F.coalesce("resolution", F.lit("")))) < LEAST
    told = violations(rows, "resolution", F.col("id"), {"unknown": F.col("known").isNull(), "repeated": F.col("times") > 1, "not explained": short}).distinct()
    open_ = contested.select("id").distinct().join(findings.select("id"), "id", "left_anti")
    out = told.unionByName(open_.select(F.lit("resolution").alias("entity"), F.col("id").cast("string").alias("key"), F.lit("unresolved").alias("rule")))
    if errors is not None and allowed is not None:
        new = errors.where("triggered").select("id").distinct().join(allowed.select("id"), "id", "left_anti")
        out = out.unionByName(new.select(F.lit("error").alias("entity"), F.col("id").cast("string").alias("key"), F.lit("new severe error").alias("rule")))
    return out


def completed(corrections: DataFrame, records: DataFrame, spaces: str = SPACES) -> DataFrame:
    """Corrections made whole: id, state, numerator, denominator, reason, observation, evidence, retained, note.

    One that says it changes nothing, and has the former state and operands, is replaced by the former record. A short
    reason or observation is lengthened by the other where both together say enough and there is evidence. ``spaces``
    don't count at the ends of the two.
    """
    old = records.select("id", *(F.col(c).alias(f"{c}_old") for c in ("state", "numerator", "denominator", "reason", "observation", "evidence")))
    joined = corrections.join(old, "id", "left")
    says = F.lower(stripped(F.coalesce("change", F.lit("")))).rlike(UNCHANGED) | F.coalesce("unchanged", F.lit(False))
    near = F.abs(numbers.state(F.col("state").cast("string")) - numbers.state(F.col("state_old").cast("string"))) <= F.lit("0.000001").cast("decimal(7,6)")
    retained = says & F.coalesce(near, F.lit(False)) & F.col("numerator").eqNullSafe(F.col("numerator_old")) & F.col("denominator").eqNullSafe(F.col("denominator_old"))
    reason, observation = (F.btrim(F.coalesce(c, F.lit("")), F.lit(spaces)) for c in ("reason", "observation"))
    enough = (reason != "") & (observation != "") & (F.length(reason) + F.length(observation) >= 28) & (F.size("evidence") > 0)
    enough = F.coalesce(enough, F.lit(False))
    longer = {"reason": F.when(enough & (F.length(reason) < 20), F.concat(reason, F.lit(GROUNDS), observation)), "observation": F.when(enough & (F.length(observation) < 8), F.concat(observation, F.lit(SEEN), reason))}
    value = lambda c: F.when(retained, F.col(f"{c}_old")).otherwise(F.coalesce(longer[c], F.col(c)) if c in longer else F.col(c)).alias(c)
    note = F.when(retained, "former record kept").when(longer["reason"].isNotNull(), "reason lengthened").when(longer["observation"].isNotNull(), "observation lengthened")
    return joined.select("id", *(value(c) for c in ("state", "numerator", "denominator", "reason", "observation", "evidence")), retained.alias("retained"), note.alias("note"))


def inspected(witnesses: DataFrame) -> DataFrame:
    """Comparison witnesses with their truth (holds), all that is wrong with them (broken), and why they stay unresolved
    (reason, else null). Needs what ``inventory`` needs."""
    rows = witness_check(witnesses)
    bare = lambda c: F.length(stripped(F.coalesce(c, F.lit("")))) == 0
    more = F.array_compact(F.array(F.when(~F.coalesce(F.col("kind").isin("asserted", "conditional"), F.lit(False)), "kind"), F.when(bare("subject") | bare("scope"), "not bound to a subject and scope")))
    rows = rows.withColumn("broken", F.concat("broken", more))
    return rows.withColumn("reason", F.when(F.size("broken") > 0, F.array_join("broken", "; ")).when(F.col("holds").isNull(), "no scalars of one unit"))


def inventory(witnesses: DataFrame, keys: list[str], tolerant: bool = True) -> tuple[DataFrame, DataFrame]:
    """(checked, unresolved) comparison witnesses: broken ones, and whole ones without a verdict, are unresolved.

    Needs what ``witness_check`` needs, and kind, subject and scope. Strict use asks that no row be broken. Whole rows
    without a verdict are checked, with a null verdict, and unresolved too. Unresolved ones are numbered U001 and so on
    for each of ``keys``, those of one delivery.
    """
    rows = inspected(witnesses)
    checked = rows.where(F.size("broken") == 0 if tolerant else F.lit(True)).drop("reason")
    lost = rows.where("reason is not null")
    return checked, numbered(lost, ["id", "reason"], keys, "U%03d", "number").select(*keys, "id", "number", "reason")


def unsupported_numbers(prose: DataFrame, authorised: DataFrame, text_col: str = "text", value_col: str = "value", places: int = 6) -> DataFrame:
    """(token): numbers in prose that are no authorised number, nor one of them rounded half up to as many decimals.

    Tokens meet the authorised numbers, and each of their roundings, by equality. Numbers with 24 or more digits before
    the point can only match as text. Prose and numbers are each gone through once.
    """
    number = lambda c: F.when(F.length(F.substring_index(c, ".", 1)) < 24, c.try_cast(EXACT))
    key = lambda places, number, text: F.struct(F.lit(places).alias("places"), number.alias("number"), text.alias("text"))
    none, zero = F.lit(""), F.lit(0).cast(EXACT)
    value, kind = F.col("value"), authorised.schema[value_col].dataType
    if isinstance(kind, DecimalType) and kind.precision - kind.scale < 24:
        given, finer = authorised.select(F.col(value_col).cast(EXACT).alias("value"), none.alias("text")), kind.scale
    else:
        given, finer = authorised.select(number(F.col(value_col).cast("string")).alias("value"), F.col(value_col).cast("string").alias("text")), places + 1
    # To as many places as a number has, or more, its rounding is the number itself.
    rounded = lambda p: F.round(value, p).cast(EXACT)
    shades = [F.when(rounded(p) != value, key(p, rounded(p), none)) for p in range(1, min(places + 1, finer))]
    whole = F.when(value.isNotNull(), key(WHOLE, value, none)).otherwise(key(AS_TEXT, zero, F.col("text")))
    shades = given.where("value is not null or text <> ''").select(F.explode(F.array(whole, *shades)).alias("s")).where("s is not null").select("s.*").distinct()
    token = prose.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))).alias("token")).distinct()
    decimals, own = F.length(F.regexp_extract("token", r"\.(\d+)$", 1)), number(F.col("token"))
    keys = F.array(F.when(own.isNotNull(), key(WHOLE, own, none)).otherwise(key(AS_TEXT, zero, F.col("token"))), F.when(own.isNotNull() & decimals.between(1, places), key(decimals, own, none)))
    tried = token.select("token", F.explode(keys).alias("s")).where("s is not null").select("token", "s.*")
    met = tried.join(shades.withColumn("met", F.lit(True)), ["places", "number", "text"], "left")
    return met.groupBy("token").agg(F.max("met").alias("met")).where("met is null").select("token")


def narrative_violations(parts: DataFrame, required: list[str], authorised: DataFrame) -> DataFrame:
    """(entity, key, rule) of a report's parts (part, text): required parts missing or short, numbers that no fact has."""
    names = parts.sparkSession.createDataFrame([(r,) for r in required], "part string")
    there = names.join(parts.groupBy("part").agg(F.max(F.length(stripped("text"))).alias("n")), "part", "left")
    short = violations(there, "report", F.col("part"), {"incomplete": F.coalesce("n", F.lit(0)) < LEAST})
    return short.unionByName(unsupported_numbers(parts, authorised).select(F.lit("report").alias("entity"), F.col("token").alias("key"), F.lit("number without a fact").alias("rule")))


def resumable(saved: DataFrame, current: DataFrame, keys: list[str], version: int = 1) -> DataFrame:
    """Saved states to go on from: of this version, for the input as it is now, whole by their own digest.

    ``saved``: keys, version, fingerprint, payload, payload_digest; ``current``: keys, fingerprint.
    """
    sound = saved.where((F.col("version") == version) & (F.sha2("payload", 256) == F.col("payload_digest")))
    return sound.join(current.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_semi")


def timeouts(runs: DataFrame, events: DataFrame, keys: list[str], first: int, total: int, now: Column) -> DataFrame:
    """Runs (keys, started_at) with their state: done, silent (no event within ``first`` seconds), overdue (not done within
    ``total``) or running. ``events``: keys, at, done. ``now`` is when they are looked at."""
    seen = events.groupBy(*keys).agg(F.min("at").alias("first_at"), F.min(F.when(F.col("done"), F.col("at"))).alias("done_at"))
    after = lambda c: F.unix_timestamp(c) - F.unix_timestamp("started_at")
    late = F.coalesce(F.col("done_at"), now)
    state = F.when(after(F.coalesce(F.col("first_at"), now)) > first, "silent").when(after(late) > total, "overdue").when(F.col("done_at").isNotNull(), "done").otherwise("running")
    return runs.join(seen, keys, "left").withColumn("state", state)
