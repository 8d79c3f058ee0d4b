"""First, last and best rows of a key, with a partial aggregate before the shuffle instead of a window over whole rows.

Rows of a DataFrame have no order, so every policy takes an explicit order; it must be unique within a key for a
defined result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnLike = str | Column


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = pick(F.struct(*(rest or keys)), F.struct(*[_col(o) for o in order]))
    picked = df.groupBy(*keys).agg(row.alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike]) -> DataFrame:
    """One row per key: the least by order. Null keys form a key of their own."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[ColumnLike]) -> DataFrame:
    """One row per key: the greatest by order."""
    return _pick(df, keys, order, F.max_by)


def distinct_in_order(array: Column) -> Column:
    """The distinct values of an array, first occurrences in their order."""
    return F.array_distinct(array)


def upper_median(values: Column) -> Column:
    """Element floor(n / 2) of the ascending values of an array; null for none. (median() would interpolate.)"""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def upper_medians(df: DataFrame, keys: Sequence[str], value: ColumnLike) -> DataFrame:
    """keys and median: element floor(n / 2) of each key's ascending values, null for none. Values are
    counted first, so equal values of a hot key are summed before they meet."""
    counts = df.where(_col(value).isNotNull()).groupBy(*keys, _col(value).alias("__v")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("__n").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("__upto", upto).withColumn("__all", F.sum("__n").over(w))
    found = placed.where(F.col("__upto") > F.floor(F.col("__all") / 2)).groupBy(*keys).agg(F.min("__v").alias("median"))
    return df.select(*keys).distinct().join(found, list(keys), "left")


def rounded_mean(value: ColumnLike, digits: int = 1) -> Column:
    """The mean of the values that are there, rounded half up; null for none."""
    return js_round(F.avg(_col(value)) * 10**digits) / 10**digits


def js_round(x: Column) -> Column:
    """Half goes up, towards plus infinity."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))
