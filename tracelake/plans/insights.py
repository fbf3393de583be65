"""Insights: claims over evidence as an append-only stream of revisions; and how a session may be resumed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.errors import EngineError

# Statuses and the moves allowed between them; what a descriptor can offer.
STATUSES = ["proposed", "confirmed", "rejected", "superseded"]
MOVES = [("proposed", "confirmed"), ("proposed", "rejected"), ("proposed", "superseded"), ("confirmed", "superseded")]
OFFERED = ["resume", "fork-current", "open", "locate-turn"]
NEVER = ["historical-fork", "cross-runtime-handoff"]


def appended(insights: DataFrame, proposals: DataFrame, events: DataFrame) -> DataFrame:
    """proposals with `error`, null for those that may be appended as revision 1, status proposed.

    insights, proposals: insight_id, statement, confidence, evidence (array of event ids), query_hash, skill.
    An error: a field is missing, the confidence is outside 0 to 1, the id is taken or proposed twice, or some
    evidence is no event. Evidence is exploded and joined, so its size does not matter."""
    cited = proposals.select("insight_id", F.explode("evidence").alias("event_id")).distinct()
    lost = cited.join(events.select("event_id").distinct(), "event_id", "left_anti").select("insight_id").distinct().withColumn("_lost", F.lit(True))
    taken = insights.select("insight_id").distinct().withColumn("_taken", F.lit(True))
    twice = proposals.groupBy("insight_id").agg((F.count("*") > 1).alias("_twice"))
    rows = proposals.join(lost, "insight_id", "left").join(taken, "insight_id", "left").join(twice, "insight_id", "left")
    missing = F.lit(False)
    for c in ("insight_id", "statement", "query_hash", "skill"):
        missing = missing | F.coalesce(F.length(c) == 0, F.lit(True))
    empty = missing | F.coalesce(F.size("evidence") <= 0, F.lit(True))
    outside = ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    error = F.when(empty, "missing field").when(outside, "confidence").when(F.col("_taken"), "id is taken").when(F.col("_twice"), "proposed twice").when(F.col("_lost"), "unknown evidence")
    return rows.withColumn("error", error).drop("_lost", "_taken", "_twice").withColumn("revision", F.lit(1).cast("long")).withColumn("status", F.lit("proposed"))


def current(insights: DataFrame) -> DataFrame:
    """The row of each insight's highest revision."""
    return insights.groupBy("insight_id").agg(F.max_by(F.struct(*insights.columns), "revision").alias("_r")).select("_r.*")


def shown(insights: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """What a query sees: by default only insights that are confirmed now."""
    wanted = ["confirmed"] if statuses is None else statuses
    if not set(wanted) <= set(STATUSES):
        raise EngineError("invalid_parameter", f"status is one of {STATUSES}")
    return current(insights).where(F.col("status").isin(wanted))


def transitions(insights: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (insight_id, revision, status) as the rows to append, with `error` for those that may not be:
    unknown insight, a revision that is no longer the latest, a move that is not allowed, or one of several
    requests for the same insight."""
    now = current(insights).withColumnRenamed("status", "_old").withColumnRenamed("revision", "_now")
    several = requests.groupBy("insight_id").agg((F.count("*") > 1).alias("_several"))
    met = requests.join(several, "insight_id").join(now, "insight_id", "left")
    allowed = F.lit(False)
    for old, new in MOVES:
        allowed = allowed | ((F.col("_old") == old) & (F.col("status") == new))
    error = F.when(F.col("_now").isNull(), "not found").when(F.col("_several"), "several requests").when(~F.coalesce(F.col("revision") == F.col("_now"), F.lit(False)), "revision changed").when(~F.coalesce(allowed, F.lit(False)), "move not allowed")
    return met.withColumn("error", error).withColumn("revision", F.col("_now") + 1).drop("_old", "_now", "_several")


def resume(sessions: DataFrame, runtimes: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """A descriptor a session: runtime, native_session_id, match, capabilities and what is unavailable, why.

    sessions: session, provider, native_session_id, expired. runtimes: provider, offers (array), a row a
    provider. matches: session, run_id, turn_id, event_id of the hit, one a session. An expired session can't be
    resumed or forked, but opened; nothing offers a fork of the past or a handoff to another runtime."""
    rows = sessions.join(runtimes, "provider", "left")
    if matches is not None:
        at = matches.select("session", F.struct("run_id", "turn_id", "event_id").alias("match"))
        rows = rows.join(at, "session", "left")
    else:
        rows = rows.withColumn("match", F.lit(None).cast("struct<run_id string, turn_id string, event_id string>"))
    offers, expired = F.coalesce("offers", F.array().cast("array<string>")), F.coalesce("expired", F.lit(False))
    has_turn = F.coalesce(F.col("match.turn_id").isNotNull(), F.lit(False))

    def able(name: str) -> Column:
        has = F.array_contains(offers, name)
        return has & ~expired if name in ("resume", "fork-current") else has & has_turn if name == "locate-turn" else has

    def reason(name: str) -> Column:
        why = F.when(expired, "the native session has expired").otherwise("the runtime does not offer it")
        return F.when(~able(name), F.struct(F.lit(name).alias("capability"), why.alias("reason")))

    never = [F.struct(F.lit(x).alias("capability"), F.lit("not offered by any runtime").alias("reason")) for x in NEVER]
    capabilities = F.array_compact(F.array(*[F.when(able(x), F.lit(x)) for x in OFFERED]))
    unavailable = F.array_compact(F.array(*[reason(x) for x in ("resume", "fork-current")], *never))
    return rows.select("session", F.col("provider").alias("runtime"), "native_session_id", "match", capabilities.alias("capabilities"), unavailable.alias("unavailable"))
