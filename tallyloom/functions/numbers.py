"""Column functions over numbers: guarded casts, ratios, comparisons and overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import stripped

DECIMAL = "decimal(38,18)"
#: Operands of ratios; a quotient of two then keeps 18 places.
PART = "decimal(20,8)"
_FLOAT = r"^[-+]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][-+]?\d+)?$"


def numeric(c: Column) -> Column:
    """A finite number as double, or null; only plain decimal notation counts."""
    s = stripped(c.cast("string"))
    value = F.when(s.rlike(_FLOAT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def state(c: Column) -> Column:
    """``0.67`` or ``2/3`` as a decimal; null where it is neither, or divides by zero. Parts of a ratio have up to 8 places."""
    s = stripped(c.cast("string"))
    part = lambda i: F.nullif(F.regexp_extract(s, r"^(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)$", i), F.lit("")).try_cast(PART)
    return F.coalesce(F.try_divide(part(1), part(2)).cast(DECIMAL), F.when(s.rlike(_FLOAT), F.replace(s, F.lit("_"), F.lit("")).try_cast(DECIMAL)))


def ratio_state(n: Column, d: Column, capped: Column, empty_is_full: Column) -> Column:
    """n/d, at most 1 where counts are capped; an empty set is 1 only where its rule says so."""
    share = F.try_divide(n.cast(PART), d.cast(PART)).cast(DECIMAL)
    return F.when(d == 0, F.when(empty_is_full, F.lit(1)).otherwise(0).cast(DECIMAL)).when(capped, F.least(share, F.lit(1).cast(DECIMAL))).otherwise(share)


def scalar(c: Column) -> Column:
    """A single number, thousands commas allowed; null for ranges, thresholds and words."""
    s = F.replace(stripped(c), F.lit(","), F.lit(""))
    return F.when(s.rlike(_FLOAT), s.try_cast(DECIMAL))


def relation_holds(left: Column, op: Column, right: Column, left_unit: Column, right_unit: Column) -> Column:
    """Whether a stated comparison is true; null without two scalars of one unit."""
    a, b = scalar(left), scalar(right)
    truth = F.when(op == "gt", a > b).when(op == "lt", a < b).when(op == "ge", a >= b).when(op == "le", a <= b).when(op == "eq", a == b)
    return F.when(left_unit == right_unit, truth)


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the common part of two intervals."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def display(c: Column) -> Column:
    """Two decimals, half up, as text."""
    return F.round(c.cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string")


def covered(token: Column, authorised: Column, places: int = 6) -> Column:
    """Whether a number is one of the authorised ones, or one of them rounded half up to some decimals."""
    return F.exists(authorised, lambda x: F.coalesce(x == token, F.lit(False)) | F.array_contains(F.array(*(F.round(x, p).cast(DECIMAL) for p in range(1, places + 1))), token))
