"""Folds of observations into entities: authority cohorts, field winners, provenance, runs, turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What decides between observations of a field, strongest first.
PRECEDENCE = ("phase", "revision", "confidence", "ts_ms", "event_id")


def rank_of(layer: Column, authenticated: Column, authority: Column) -> Column:
    """Authenticated L1 before authenticated L2 before the rest; then authoritative, self_reported, rest."""
    first = F.when(authenticated & (layer == "L1"), 3).when(authenticated & (layer == "L2"), 2).otherwise(1)
    second = F.when(authority == "authoritative", 3).when(authority == "self_reported", 2).otherwise(1)
    return F.struct(first.alias("layer_rank"), second.alias("authority_rank"))


def cohort(obs: DataFrame, entity: list[str], rank: Column) -> DataFrame:
    """Observations of the top rank of their entity. The top rank is a group-by with partial sums, joined
    back, so an entity with a third of all rows is split by AQE and never gathered."""
    ranked = obs.withColumn("_rank", rank)
    top = ranked.groupBy(*entity).agg(F.max("_rank").alias("_top"))
    return ranked.join(top, entity).where(F.col("_rank") == F.col("_top")).drop("_rank", "_top")


def winner(value: str, present: Column | None = None, by: tuple[str, ...] = PRECEDENCE) -> Column:
    """Aggregate: the value of the best observation among those in which the field is present. A present
    null can win: the value travels in a struct."""
    boxed = F.struct(F.col(value).alias("v"))
    key = F.struct(*by)
    best = F.max_by(boxed, key if present is None else F.when(present, key))
    return best["v"]


def provenance(ids: str) -> Column:
    """Aggregate: all observations' ids, sorted and distinct."""
    return F.array_sort(F.collect_set(ids))


def runs(obs: DataFrame, entity: list[str], terminal: Column) -> DataFrame:
    """Start, completion (latest terminal event), best terminal event, revision and size of each run."""
    key = F.struct(*PRECEDENCE)
    return obs.groupBy(*entity).agg(
        F.min("ts_ms").alias("started_ms"),
        F.max(F.when(terminal, F.col("ts_ms"))).alias("completed_ms"),
        F.max_by("event_id", F.when(terminal, key)).alias("terminal_event"),
        F.max(F.coalesce("revision", F.lit(1))).alias("revision"),
        F.count("*").alias("n_events"),
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "turn_index") -> DataFrame:
    """A running number that rises at each row that starts a turn; rows before the first have 0."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.count_if(starts).over(window))


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null so far, this row included."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(window))


def assembled(df: DataFrame, keys: list[str], order: list[str], text: str, name: str = "text") -> DataFrame:
    """Pieces of a message joined in order; null pieces add nothing."""
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("_t"))))
    return df.groupBy(*keys).agg(F.concat_ws("", F.transform(pieces, lambda p: p["_t"])).alias(name), F.count(text).alias("n_pieces"))
