"""Tabular inspector: filters, pages, profiles, groups, correlations and duplicate counts over any DataFrame.

A request is a dict (operation, filters, columns, x, y, group_by, offset, limit) and becomes one declarative plan. Rows
carry a total order in ``order_cols``; every answer that depends on order uses it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.numbers import numeric
from tallyloom.functions.text import is_empty


def resolve(key: str | int, headers: list[str]) -> str:
    """A column by 1-based number, exact name, name as text, or spreadsheet letter."""
    if isinstance(key, int) and not isinstance(key, bool):
        if not 1 <= key <= len(headers):
            raise ValueError("column numbers start at 1 and end with the table")
        return headers[key - 1]
    if str(key) in headers:
        return str(key)
    if not re.fullmatch("[A-Za-z]{1,3}", str(key)):
        raise ValueError(f"unknown column {key!r}")
    at = reduce(lambda n, ch: 26 * n + ord(ch) - 64, str(key).upper(), 0)
    if at > len(headers):
        raise ValueError("column is outside the table")
    return headers[at - 1]


def condition(c: Column, op: str, value: object) -> Column:
    """One filter. Null equals null; a null contains nothing (it has no text to search)."""
    if op in ("eq", "ne"):
        same = c.eqNullSafe(F.lit(value))
        return same if op == "eq" else ~same
    if op in ("empty", "not_empty"):
        return is_empty(c) if op == "empty" else ~is_empty(c)
    if op == "contains":
        return F.coalesce(F.contains(c.cast("string"), F.lit(str(value))), F.lit(False))
    if op in ("lt", "gt"):
        n, limit = numeric(c), numeric(F.lit(str(value)))
        return F.coalesce(n < limit if op == "lt" else n > limit, F.lit(False))
    raise ValueError(f"unsupported filter operation {op!r}")


def where(df: DataFrame, filters: list[dict], headers: list[str] | None = None) -> DataFrame:
    for f in filters:
        df = df.where(condition(F.col(resolve(f["column"], headers or df.columns)), f.get("op", "eq"), f.get("value")))
    return df


def drop_blank(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(*(F.col(c).cast("string") for c in df.columns)).isNotNull())


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: nonempty, empty, distinct, duplicates, numeric and non-integer counts, sum, mean, min, max."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns))).alias("cell")).select("cell.*")
    cells = cells.withColumn("present", ~is_empty(F.col("v"))).withColumn("n", numeric(F.col("v")))
    # Counting values first leaves one row per distinct value: no expansion for the distinct count. Of long ones, none of
    # which is a number, their digest is enough.
    cells = cells.withColumn("v", F.when((F.length("v") > 64) & F.col("n").isNull(), F.concat(F.lit("#"), F.sha2("v", 256))).otherwise(F.col("v")))
    values = cells.groupBy("name", "v", "present", "n").agg(F.count("*").alias("times"))
    many = F.when(F.col("n").isNotNull(), F.col("times"))
    out = values.groupBy("name").agg(
        F.coalesce(F.sum(F.when(F.col("present"), F.col("times"))), F.lit(0)).alias("nonempty"),
        F.coalesce(F.sum(F.when(~F.col("present"), F.col("times"))), F.lit(0)).alias("empty"),
        F.count_if("present").alias("distinct_values"),
        F.coalesce(F.sum(many), F.lit(0)).alias("numeric_count"),
        F.coalesce(F.sum(F.when(F.col("n") != F.floor("n"), F.col("times"))), F.lit(0)).alias("noninteger_count"),
        F.sum(F.col("n") * many).alias("sum_value"),
        F.min("n").alias("min_value"),
        F.max("n").alias("max_value"),
    )
    # A table without rows has its columns too.
    names = df.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(columns)], "name string")
    out = names.join(out, "name", "left").fillna(0, ["nonempty", "empty", "distinct_values", "numeric_count", "noninteger_count"])
    out = out.withColumn("duplicate_nonempty", F.col("nonempty") - F.col("distinct_values"))
    return out.withColumn("mean_value", F.try_divide("sum_value", "numeric_count"))


def top_values(df: DataFrame, column: str, order_cols: list[str], k: int = 25) -> DataFrame:
    """The ``k`` most frequent values; of equally frequent ones the first met comes first."""
    first = F.min(F.struct(*order_cols)).alias("first")
    return df.where(~is_empty(F.col(column))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), first).orderBy(F.desc("n"), "first").limit(k).drop("first")


def top_lists(df: DataFrame, columns: list[str], order_cols: list[str], k: int = 25) -> DataFrame:
    """(name, top_values): of each column its ``k`` most frequent nonempty values as text with their counts, as ``top_values``.

    Values meet by value, their counts in a window that each task begins with its own ``k``.
    """
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("cell"), F.struct(*order_cols).alias("at")).select("cell.*", "at")
    counted = cells.where(~is_empty(F.col("value"))).groupBy("name", "value").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "first", "value"))
    best = counted.withColumn("place", place).where(F.col("place") <= k).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("best"))
    return best.select("name", F.transform("best", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_values"))


def group_stats(df: DataFrame, key: str, columns: list[str], order_cols: list[str] = ()) -> DataFrame:
    """Per group (null is one): rows, and of each column the numeric count, sum (0 of none) and mean (null of none).

    With ``order_cols``, groups come in the order in which they first appear.
    """
    aggs = [F.count("*").alias("row_count")]
    for c in columns:
        n = numeric(F.col(c))
        aggs += [F.count(n).alias(f"{c}_count"), F.coalesce(F.sum(n), F.lit(0.0)).alias(f"{c}_sum"), F.avg(n).alias(f"{c}_mean")]
    if not order_cols:
        return df.groupBy(key).agg(*aggs)
    return df.groupBy(key).agg(*aggs, F.min(F.struct(*order_cols)).alias("first_")).orderBy("first_").drop("first_")


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs of numbers and their Pearson correlation; null for fewer than two pairs or a constant column."""
    pairs = df.select(numeric(F.col(x)).alias("a"), numeric(F.col(y)).alias("b")).where("a is not null and b is not null")
    return pairs.agg(F.count("*").alias("pair_count"), F.when(F.count("*") > 1, F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))).alias("pearson"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, and how many of them repeat another (nulls are equal)."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("n_"))
    return counted.agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("selected_rows"), (F.coalesce(F.sum("n_"), F.lit(0)) - F.count("*")).alias("duplicate_rows"))


def page(df: DataFrame, order_cols: list[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the total order: a top-k, not a sort of the table."""
    if offset < 0 or not 1 <= limit <= 200:
        raise ValueError("a page begins at row 0 or later and holds 1 to 200 rows")
    return df.orderBy(*order_cols).offset(offset).limit(limit)


def paged(df: DataFrame, order_cols: list[str], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of rows with the total and the next offset, null after the last page."""
    total = df.agg(F.count("*").alias("total_rows"))
    after = F.when(F.col("total_rows") > offset + limit, F.lit(offset + limit).cast("long"))
    return page(df, order_cols, offset, limit).join(F.broadcast(total)).withColumn("next_offset", after)


def inspect(df: DataFrame, request: dict, order_cols: list[str], headers: list[str] | None = None) -> DataFrame:
    """The answer to a request as a DataFrame; ``headers`` are the columns that it can name, all if not given."""
    operation, headers = request.get("operation", "summary"), headers or df.columns
    rows = where(df, request.get("filters", []), headers)
    names = lambda cols: [resolve(c, headers) for c in cols]
    if operation == "rows":
        return paged(rows, order_cols, int(request.get("offset", 0)), int(request.get("limit", 100)))
    if operation in ("summary", "stats"):
        columns = names(request.get("columns", headers))
        best = top_lists(rows, columns, order_cols)
        return profile(rows, columns).join(best, "name", "left").withColumn("top_values", F.coalesce("top_values", F.array().cast(best.schema["top_values"].dataType)))
    if operation == "correlation":
        return correlation(rows, *names([request["x"], request["y"]]))
    if operation == "group":
        return group_stats(rows, *names([request["group_by"]]), names(request.get("columns", [])), order_cols)
    if operation == "duplicates":
        return duplicate_rows(rows.select(*headers))
    raise ValueError(f"unsupported operation {operation!r}")


def answer(df: DataFrame, request: dict, order_cols: list[str], headers: list[str] | None = None, header_row: int = 1) -> DataFrame:
    """One row: headers, header_row, selected_rows and duplicate_rows (among the header's columns), which every answer
    begins with, and ``result``, the rows of ``inspect`` as structs in their order.

    Columns of a profile come in the order of the request, groups in that of their first rows, rows in that of the page.
    """
    headers = headers or df.columns
    selected = duplicate_rows(where(df, request.get("filters", []), headers).select(*headers))
    found = inspect(df, request, order_cols, headers)
    operation = request.get("operation", "summary")
    if operation in ("summary", "stats"):
        wanted = [resolve(c, headers) for c in request.get("columns", headers)]
        at = F.array_position(F.array(*map(F.lit, wanted)), F.col("name"))
    elif operation == "group":
        first = where(df, request.get("filters", []), headers).groupBy(resolve(request["group_by"], headers)).agg(F.min(F.struct(*order_cols)).alias("first_"))
        key = resolve(request["group_by"], headers)
        found = found.join(first.withColumnRenamed(key, "key_"), F.col(key).eqNullSafe(F.col("key_"))).drop("key_")
        at = F.col("first_")
    else:
        at = F.struct(*order_cols) if operation == "rows" else F.lit(0)
    shown = [c for c in found.columns if c not in ("first_", "total_rows")]
    # An answer is a page, a column's or a group's line each: what a reader can take in, gathered in one row.
    whole = found.agg(F.array_sort(F.collect_list(F.struct(at.alias("at_"), F.struct(*shown).alias("row_")))).alias("r")).select(F.transform("r", lambda x: x["row_"]).alias("result"))
    return selected.join(F.broadcast(whole)).select(F.array(*map(F.lit, headers)).alias("headers"), F.lit(header_row).alias("header_row"), "selected_rows", "duplicate_rows", "result")
