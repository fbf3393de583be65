"""Event sequences within a partition, ordered by time and then sequence number.

Every event that is an A starts at most one match; each later step takes the earliest event that
qualifies. All steps are one window a direction: frames run from the partition's edge to the row, which
Spark evaluates in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.errors import EngineError


def _ways(keys: list[str], order: list[str]):
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return Window.partitionBy(*keys).orderBy(*order), back


def next_event(df: DataFrame, keys: list[str], order: list[str], a: Column, b: Column, fields: list[str]) -> DataFrame:
    """A next B: B follows at once. Rows: the A event with `b`, a struct of B's fields."""
    ahead, _ = _ways(keys, order)
    following = F.lead(F.struct(b.alias("_is"), *fields)).over(ahead)
    return df.withColumn("b", following).where(a & F.coalesce(F.col("b._is"), F.lit(False))).withColumn("b", F.struct(*[F.col(f"b.{f}").alias(f) for f in fields]))


def then_event(df: DataFrame, keys: list[str], order: list[str], a: Column, b: Column, fields: list[str], within: tuple[str, int] | None = None) -> DataFrame:
    """A then B: the first B after A, other events between allowed. within (column, most): the largest
    difference of that column from A to B."""
    _, back = _ways(keys, order)
    first = F.last(F.when(b, F.struct(*fields)), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    found = df.withColumn("b", first).where(a & F.col("b").isNotNull())
    if within:
        name, most = within
        if name not in fields or most < 0:
            raise EngineError("invalid_parameter", "within needs a field of B and a bound")
        found = found.where(F.col(f"b.{name}") - F.col(name) <= most)
    return found


def absent_until(df: DataFrame, keys: list[str], order: list[str], a: Column, x: Column, b: Column, fields: list[str], within: tuple[str, int]) -> DataFrame:
    """A, no X, then B: the first B after A, and no X strictly between. The bound is needed: absence
    without one has no end."""
    ahead, _ = _ways(keys, order)
    seen = F.count_if(x).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    counted = df.withColumn("_x", seen).withColumn("_here", x.cast("int"))
    found = then_event(counted, keys, order, a, b, [*fields, "_x", "_here"], within)
    between = F.col("b._x") - F.col("b._here") - F.col("_x")
    return found.where(between == 0).withColumn("b", F.struct(*[F.col(f"b.{f}").alias(f) for f in fields])).drop("_x", "_here")
