"""Joins and sets: ownership by prefix, cascading resolution, positional pairs, overlaps, upserts, subsets, closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def owners_by_prefix(files: DataFrame, subjects: DataFrame, name: str = "name") -> DataFrame:
    """Each file's owner by case-insensitive prefix: the one subject that matches, ``source`` without any, null (ambiguous) with more.

    For each length that prefixes have, files meet the prefixes of that length by equality, so no file row is multiplied
    and none is joined back; rows may repeat and hold nulls. There are no more lengths than the longest prefix has characters.
    """
    held = subjects.groupBy(F.lower("prefix").alias("prefix_")).agg(F.collect_set("id").alias("ids_"))
    sizes = sorted(r["n"] for r in held.select(F.length("prefix_").alias("n")).distinct().collect())
    out = files
    for size in sizes:
        side = held.where(F.length("prefix_") == size).select(F.col("prefix_").alias(f"prefix_{size}_"), F.col("ids_").alias(f"ids_{size}_"))
        out = out.join(side, F.lower(F.substring(F.col(name), 1, size)) == F.col(f"prefix_{size}_"), "left")
    none = F.array().cast(held.schema["ids_"].dataType)
    out = out.withColumn("ids_", F.array_distinct(F.concat(none, *(F.coalesce(f"ids_{n}_", none) for n in sizes)))).withColumn("matches", F.size("ids_").cast("long"))
    return out.withColumn("owner", F.when(F.col("matches") == 0, "source").when(F.col("matches") == 1, F.col("ids_")[0])).select(*files.columns, "matches", "owner")

def resolve_paths(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(given, file): the known file that a spelling names: exact, else cleaned, else the only one with that base name."""
    from tallyloom.functions.text import clean_path

    base = F.element_at(F.split("file", "/"), -1)
    names = known.select("file", base.alias("base")).union(known.where("file like 'extracted/%.txt'").select("file", F.regexp_replace(base, r"\.txt$", ""))).distinct()
    alone = names.groupBy("base").agg(F.count("*").alias("n"), F.min("file").alias("named")).where("n = 1").select("base", "named")
    tried = wanted.withColumn("clean_", clean_path(F.col("given")))
    exact, cleaned = known.select(F.col("file").alias("exact_")), known.select(F.col("file").alias("cleaned_"))
    tried = tried.join(exact, F.col("given") == F.col("exact_"), "left").join(cleaned, F.col("clean_") == F.col("cleaned_"), "left").join(alone, (F.col("clean_") == F.col("base")) & ~F.contains("clean_", F.lit("/")), "left")
    return tried.withColumn("file", F.coalesce("exact_", "cleaned_", "named")).drop("clean_", "exact_", "cleaned_", "base", "named")


def positional_pairs(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The n-th value of the left beside the n-th of the right, per key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    side = lambda df, name: df.withColumn("nth", nth).select(*keys, "nth", F.col(value).alias(name))
    return side(left, "left_value").join(side(right, "right_value"), [*keys, "nth"], "full_outer")


def label_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Items of one label whose verdicts differ; of a label's repeats on the right the last counts."""
    last = right.groupBy(*keys, "label").agg(F.max_by("passed", "pos").alias("right_passed"))
    return left.join(last, [*keys, "label"]).where(~F.col("passed").eqNullSafe(F.col("right_passed")))


def overlaps(boxes: DataFrame, group: str, least: float = 0.4) -> DataFrame:
    """Pairs of boxes of one group whose common area is more than ``least`` of the smaller one.

    A box's level is the power of two that its longer side fits into. On the plane of each level there are cells of that
    size, so that a box lies in four at most; it lies once among the boxes of its own level, and once for each of the
    group's higher levels among those that these may meet. So a large box makes no large cells for small ones. A pair
    counts on the higher level of the two, in the cell that holds the first corner of its common area.
    """
    level = F.ceil(F.log2(F.greatest("width", "height"))).cast("int")
    sized = boxes.where("width > 0 and height > 0").withColumn("level_", level)
    levels = sized.groupBy(F.col(group).alias("group_")).agg(F.array_sort(F.collect_set("level_")).alias("levels_"))

    def placed(df: DataFrame, at: str, name: str) -> DataFrame:
        size = F.pow(F.lit(2.0), F.col(at))
        cells = lambda start, length: F.explode(F.sequence(F.floor(F.col(start) / size).cast("long"), F.floor((F.col(start) + F.col(length)) / size).cast("long")))
        laid = df.withColumn("x_", cells("left", "width")).withColumn("y_", cells("top", "height"))
        return laid.select(F.struct("id", "left", "top", "width", "height", "level_").alias(name), F.col(group).alias("g_"), F.col(at).alias("at_"), "x_", "y_")

    own = placed(sized, "level_", "a")
    # At most as many levels as sizes have binary orders.
    lower = sized.join(levels, F.col(group).eqNullSafe(F.col("group_"))).withColumn("at_", F.explode(F.filter("levels_", lambda x: x >= F.col("level_")))).drop("levels_", "group_")
    both = own.join(placed(lower, "at_", "b"), ["g_", "at_", "x_", "y_"]).where((F.col("b.level_") < F.col("a.level_")) | (F.col("a.id") < F.col("b.id")))
    start = lambda c: F.greatest(F.col(f"a.{c}"), F.col(f"b.{c}"))
    side = lambda c, size: F.greatest(F.lit(0.0), F.least(F.col(f"a.{c}") + F.col(f"a.{size}"), F.col(f"b.{c}") + F.col(f"b.{size}")) - start(c))
    area = lambda x: F.col(f"{x}.width") * F.col(f"{x}.height")
    corner = lambda c, cell: F.floor(start(c) / F.pow(F.lit(2.0), F.col("at_"))).cast("long") == F.col(cell)
    share = F.try_divide(side("left", "width") * side("top", "height"), F.least(area("a"), area("b")))
    found = both.where(corner("left", "x_") & corner("top", "y_")).select(F.col("g_").alias(group), F.least("a.id", "b.id").alias("first"), F.greatest("a.id", "b.id").alias("second"), share.alias("share"))
    return found.where(F.col("share") > least)


def upsert(records: DataFrame, patches: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Records with the values of patches where those have some; patches without a record are added."""
    patch = patches.select(*keys, *(F.col(v).alias(f"{v}_new") for v in values))
    return records.join(patch, keys, "full_outer").select(*keys, *(F.coalesce(f"{v}_new", v).alias(v) for v in values))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, each with the side, and keys that a side holds more than once: two equal sets give no rows."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit(side))
    again = lambda a, side: a.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").select(key, F.lit(f"{side} repeated").alias("side"))
    return only(left, right, "left").unionByName(only(right, left, "right")).unionByName(again(left, "left")).unionByName(again(right, "right"))


def union_distinct(frames: list[DataFrame], content: list[str], key: str) -> DataFrame:
    """Rows of all frames, each content once, under the least key; keys don't count as content."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole.groupBy(*content).agg(F.min(key).alias(key))


def _doubled(pairs: DataFrame, write) -> DataFrame:
    """The closure of chains: pairs of up to 2^k steps, extended by leaps of 2^k steps, until none is new."""
    rounds, leap = [pairs], pairs
    while True:
        found = reduce(DataFrame.unionByName, rounds)
        on = leap.select(F.col("start").alias("node"), F.col("node").alias("next"))
        fresh = write(found.join(on, "node").select("start", F.col("next").alias("node")).distinct().join(found, ["start", "node"], "left_anti"))
        if fresh.isEmpty():
            return found
        rounds.append(fresh)
        leap = write(leap.join(on, "node").select("start", F.col("next").alias("node")))


def closure(spark: SparkSession, edges: DataFrame, write) -> DataFrame:
    """(start, node): all nodes reachable from each start. ``write`` stores a frame and reads it back each round.

    Only pairs found in the last round are extended, so that the work is that of the new pairs; cycles end by themselves.
    Where each start leads to one node alone, rounds double the steps.
    """
    rounds = [write(edges.select("start", "node").distinct())]
    if rounds[0].groupBy("start").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _doubled(rounds[0], write)
    step = edges.select(F.col("start").alias("node"), F.col("node").alias("next"))
    while True:
        # Each round's pairs are written once; what is known is the union of all rounds.
        found = reduce(DataFrame.unionByName, rounds)
        fresh = write(rounds[-1].join(step, "node").select("start", F.col("next").alias("node")).distinct().join(found, ["start", "node"], "left_anti"))
        if fresh.isEmpty():
            return found
        rounds.append(fresh)


def fingerprints(parts: DataFrame, keys: list[str], fan: int = 1024) -> DataFrame:
    """(keys, digest): a digest over all of a key's parts (keys, id, part) in order of id and part.

    Parts of ``fan`` consecutive ids have a digest, ``fan`` of these another, and those one: a group holds what its ids
    allow, and only digests of ranges come together, whatever a key's size.
    """
    level = parts
    for last in (False, False, True):
        group = [] if last else [F.expr(f"id div {fan}").alias("next")]
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "part"))), lambda x: x["part"]), ",")
        level = level.groupBy(*keys, *group).agg(F.sha2(joined, 256).alias("part"))
        if not last:
            level = level.withColumnRenamed("next", "id")
    return level.withColumnRenamed("part", "digest")


def violations(df: DataFrame, entity: str, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(entity, key, rule) for every rule that a row breaks; a rule is a condition that holds for bad rows."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return df.select(F.lit(entity).alias("entity"), key.cast("string").alias("key"), F.explode(broken).alias("rule"))
