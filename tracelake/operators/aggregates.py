"""Aggregates and the dashboard's summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, max, sum and avg of a number; nulls don't count. Without keys one row, also over nothing."""
    c = F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.sum(c).alias("sum_value"), F.avg(c).alias("avg_value"))


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Interpolated p50 and p95, and p95 by nearest rank."""
    at = lambda kind, p: F.expr(f"percentile_{kind}({p}) WITHIN GROUP (ORDER BY `{value}`)")
    return df.groupBy(*keys).agg(at("cont", 0.5).alias("p50"), at("cont", 0.95).alias("p95"), at("disc", 0.95).alias("p95_rank"))


def by_bucket(df: DataFrame, bucket: Column, name: str, **aggregates: Column) -> DataFrame:
    return df.groupBy(bucket.alias(name)).agg(*[a.alias(k) for k, a in aggregates.items()])


def gap_filled(counts: DataFrame, bucket: str, value: str, every: DataFrame) -> DataFrame:
    """A row for each bucket of `every`, 0 where there is nothing."""
    return every.join(counts, bucket, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def min_group_size(df: DataFrame, count: str, least: int) -> DataFrame:
    """Groups too small to show are left out."""
    return df.where(F.col(count) >= least)


def distincts(df: DataFrame, keys: list[str], **counted: str) -> DataFrame:
    """The number of different values of each named column."""
    return df.groupBy(*keys).agg(*[F.count_distinct(c).alias(name) for name, c in counted.items()])


def ratio(part: Column, whole: Column) -> Column:
    """part / whole of two aggregates; 0 where whole is 0 (null over nothing)."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def top(df: DataFrame, key: str, by: str, k: int, **aggregates: Column) -> DataFrame:
    """The k groups with the greatest aggregate `by`, ties to the smaller key."""
    return df.groupBy(key).agg(*[a.alias(name) for name, a in aggregates.items()]).orderBy(F.desc(by), key).limit(k)


def local_day(ms: Column, zone: str = "UTC") -> Column:
    """The start of the local day that a time in milliseconds falls in, as a date."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms), zone)) if zone != "UTC" else F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))


# Categories of a timeline by what an event type contains; the first that fits counts.
CATEGORIES = [("error", "error"), ("tool", "tool"), ("message", "message"), ("turn", "turn"), ("session", "session")]


def category(event_type: Column, table: list[tuple[str, str]] = CATEGORIES, other: str = "other") -> Column:
    out = F.lit(other)
    for part, name in reversed(table):
        out = F.when(event_type.contains(part), name).otherwise(out)
    return out


def category_counts(df: DataFrame, key: str, kind: Column, names: list[str]) -> DataFrame:
    """A row a key with a count for each category; categories without events count 0."""
    wide = df.groupBy(key).pivot(kind, names) if isinstance(kind, str) else df.withColumn("_kind", kind).groupBy(key).pivot("_kind", names)
    return wide.agg(F.count(F.lit(1))).select(key, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in names])


def tool_ranking(sessions: DataFrame, tools: str) -> DataFrame:
    """Calls and errors by tool over all sessions; tools: an array of structs (name, calls, errors)."""
    each = sessions.select(F.explode(tools).alias("t")).groupBy(F.col("t.name").alias("tool"))
    return each.agg(F.sum("t.calls").alias("calls"), F.sum("t.errors").alias("errors")).orderBy(F.desc("calls"), "tool")


def filtered(sessions: DataFrame, runtime: str | None = None, project: str | None = None, tool: str | None = None, text: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """The dashboard's filters: runtime and project by equality, use of a tool, a substring of title, project
    or native id in any case, and the time of the last update, both ends included."""
    rows = sessions
    for c, value in (("runtime", runtime), ("project", project)):
        rows = rows if value is None else rows.where(F.col(c) == value)
    if tool is not None:
        rows = rows.where(F.exists("tools", lambda t: t["name"] == tool))
    if text:
        held = [F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in ("title", "project", "native_session_id")]
        rows = rows.where(held[0] | held[1] | held[2])
    rows = rows if start is None else rows.where(F.col("last_updated_ms") >= start)
    return rows if end is None else rows.where(F.col("last_updated_ms") <= end)
