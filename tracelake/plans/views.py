"""Projections of the log: typed bodies, dedup, supersede, visibility, sessions, checkpoints, memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.errors import EngineError

# The kinds of a log record's body.
EVIDENCE, EVENT, CHECKPOINT, VISIBILITY, MEMORY = 240, 241, 242, 243, 244

SCHEMAS = {
    EVIDENCE: "version int, provider string, sourcePath string, sourceGeneration long, byteStart long, byteEnd long, sha256 string, raw array<int>",
    EVENT: "version int, provider string, nativeSessionId string, sourcePath string, sourceGeneration long, eventId string, nativeIdentity string, entityRevision long, event string, evidenceSeqs array<long>",
    CHECKPOINT: "version int, provider string, sourcePath string, generation long, committedOffset long, snapshotLength long, chunks array<string>",
    VISIBILITY: "version int, action string, provider string, sourcePath string, sourceGeneration long, reason string",
    MEMORY: "version int, memoryId string, action string, content string, scope string, evidenceSeqs array<long>, revision long, updatedAtMs long",
}
SOURCE = ["provider", "source_path", "generation"]


def bodies(log: DataFrame, kind: int) -> DataFrame:
    """The log's records of one kind with their body's fields. Bodies that don't parse have null fields."""
    rows = log.where(F.col("kind") == kind)
    return rows.select("seq", "session_id", "ts_ms", F.from_json(F.col("body").cast("string"), SCHEMAS[kind]).alias("b")).select("seq", "session_id", "ts_ms", "b.*")


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the least `order` of each key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def latest_by(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The row with the greatest `order` of each key: checkpoints by seq, memories by (revision, -seq)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def superseded(events: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """events with `current`: whether no later row has the same keys. Partial maxima, then a join that
    AQE can split, so a hot key is never gathered."""
    last = events.groupBy(*keys).agg(F.max(seq).alias("_last"))
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    return events.alias("e").join(last.alias("l"), on).select("e.*", (F.col(f"e.{seq}") == F.col("_last")).alias("current"))


def visible(events: DataFrame, controls: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """events with `visible`: a control hides all earlier events of its source generation; supersede and
    retract act alike."""
    hidden = controls.groupBy(*keys).agg(F.max(seq).alias("_control"))
    return events.join(hidden, keys, "left").withColumn("visible", F.col("_control").isNull() | (F.col("_control") < F.col(seq))).drop("_control")


def sessions(events: DataFrame, active: Column) -> DataFrame:
    """The session fold: first_seen is the time of the first record, not the least time; titles and
    projects are the last that are not null; provider and native id are the first record's; a session is
    active if one of its events is. provider, native_session_id, project: where events have them."""
    first = [F.min_by(c, "seq").alias(c) for c in ("provider", "native_session_id") if c in events.columns]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("project",) if c in events.columns]
    return events.groupBy("session").agg(
        *first,
        *last,
        F.min_by("ts_ms", "seq").alias("first_seen_ms"),
        F.max("ts_ms").alias("last_updated_ms"),
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("title"),
        F.count_if(active).alias("event_count"),
        F.max(active).alias("active"),
    )


def links(events: DataFrame) -> DataFrame:
    """(event_seq, evidence_seq), a row a pair."""
    return events.select(F.col("seq").alias("event_seq"), F.explode("evidenceSeqs").alias("evidence_seq"))


def memories(log: DataFrame) -> DataFrame:
    """Each memory's row of the greatest revision (the first of these), with its status."""
    rows = bodies(log, MEMORY)
    last = latest_by(rows, ["memoryId"], F.struct("revision", -F.col("seq")))
    status = F.create_map(*[F.lit(x) for x in ("candidate", "candidate", "approve", "approved", "revoke", "revoked")])
    return last.withColumn("status", status[F.col("action")])


def _identified(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log's events, each id once, and its visibility controls, with the keys that both share."""
    keys = [F.col("sourcePath").alias("source_path"), F.col("sourceGeneration").alias("generation")]
    return first_by(bodies(log, EVENT), ["eventId"], "seq").select("*", *keys), bodies(log, VISIBILITY).select("seq", "provider", *keys)


def _folded(shown: DataFrame) -> DataFrame:
    rows = shown.withColumn("session", F.col("session_id")).withColumn("native_session_id", F.col("nativeSessionId"))
    rows = rows.withColumn("title", F.get_json_object("event", "$.title")).withColumn("project", F.get_json_object("event", "$.project"))
    return sessions(rows, F.col("active"))


def projection(log: DataFrame) -> dict[str, DataFrame]:
    """All views of one log, the whole rebuild as plans: dedup before supersede, then visibility."""
    events, controls = _identified(log)
    named = superseded(events, [*SOURCE, "nativeIdentity"])
    shown = visible(named, controls, SOURCE).withColumn("active", F.col("current") & F.col("visible"))
    return {"evidence": first_by(bodies(log, EVIDENCE), ["seq"], "ts_ms"), "events": shown, "sessions": _folded(shown), "links": links(events), "checkpoints": latest_by(bodies(log, CHECKPOINT), ["provider", "sourcePath"], "seq"), "memories": memories(log)}


def advanced(old: dict[str, DataFrame], log: DataFrame) -> dict[str, DataFrame]:
    """The views after more records: `old` are the views before them, `log` the records since. What the old
    part of the log held is taken from its views, so it is not parsed again.

    A later event of an identity ends the old ones' being current; a later control hides all old events of
    its source generation. No old control reaches the new events, which all come after it."""
    events, controls = _identified(log)
    events = events.join(old["events"].select("eventId"), "eventId", "left_anti")
    keys = [*SOURCE, "nativeIdentity"]
    added = visible(superseded(events, keys), controls, SOURCE).withColumn("active", F.col("current") & F.col("visible"))
    renamed = events.select(*keys).distinct().withColumn("_newer", F.lit(True))
    hidden = controls.select(*SOURCE).distinct().withColumn("_hidden", F.lit(True))
    same = lambda ks, side: [F.col(f"e.{k}").eqNullSafe(F.col(f"{side}.{k}")) for k in ks]
    before = old["events"].alias("e").join(renamed.alias("n"), same(keys, "n"), "left").join(hidden.alias("h"), [F.col(f"e.{k}") == F.col(f"h.{k}") for k in SOURCE], "left").select("e.*", "_newer", "_hidden")
    before = before.withColumn("current", F.col("current") & F.col("_newer").isNull()).withColumn("visible", F.col("visible") & F.col("_hidden").isNull())
    before = before.withColumn("active", F.col("current") & F.col("visible")).drop("_newer", "_hidden")
    shown = before.unionByName(added)
    return {
        "evidence": old["evidence"].unionByName(first_by(bodies(log, EVIDENCE), ["seq"], "ts_ms")),
        "events": shown,
        "sessions": _folded(shown),
        "links": old["links"].unionByName(links(events)),
        "checkpoints": latest_by(old["checkpoints"].unionByName(bodies(log, CHECKPOINT)), ["provider", "sourcePath"], "seq"),
        "memories": latest_by(old["memories"].unionByName(memories(log)), ["memoryId"], F.struct("revision", -F.col("seq"))),
    }


def built_through(log: DataFrame, base: int = 0) -> int:
    """The projection's watermark: the sequence number below which the log has no gap from base on. A gap
    is an error; so is a repeated number."""
    low, high, n, distinct = log.where(F.col("seq") >= base).agg(F.min("seq"), F.max("seq"), F.count("*"), F.count_distinct("seq")).first()
    if not n:
        return base
    if low != base or high - low + 1 != n or distinct != n:
        raise EngineError("storage_error", f"the log has a gap or a repetition between {base} and {high}")
    return high + 1


def status(spark: SparkSession, folder: str, as_of: int) -> DataFrame:
    """One row: schema_version, generation, built_through, as_of, degraded (whether the log has moved on)."""
    row = spark.read.json(f"{folder}/current.json")
    return row.select("schema_version", "generation", "built_through", F.lit(as_of).alias("as_of"), (F.col("built_through") < as_of).alias("degraded"))


SCHEMA_VERSION = 1
VIEWS = ["evidence", "events", "sessions", "links", "checkpoints", "memories"]


def rebuild(log: DataFrame, folder: str, now_ms: int, previous: int = 0) -> int:
    """Write every view under a new generation, then let current.json name it; readers see the old
    generation until then. Returns the generation, which only grows."""
    spark, generation, upto = log.sparkSession, max(previous + 1, now_ms), built_through(log)
    _write(spark, projection(log), folder, generation, upto)
    return generation


def catch_up(log: DataFrame, folder: str, now_ms: int) -> int:
    """Bring the stored views to the end of the log: only records from the watermark on are read, and the
    result is a new generation. Without new records the generation stays. A gap is an error."""
    spark = log.sparkSession
    now = spark.read.json(f"{folder}/current.json").first()
    upto = built_through(log, now.built_through)
    if upto == now.built_through:
        return now.generation
    old = {name: spark.read.parquet(f"{folder}/generation={now.generation}/{name}") for name in VIEWS}
    generation = max(now.generation + 1, now_ms)
    _write(spark, advanced(old, log.where(F.col("seq") >= now.built_through)), folder, generation, upto)
    return generation


def fresh(log: DataFrame, folder: str) -> tuple[dict[str, DataFrame], int]:
    """The views at the end of the log, and the next sequence number: what is stored and, as plans, what the
    records since make of it. Readers need not wait for a catch-up, which is for when the tail has grown."""
    spark = log.sparkSession
    now = spark.read.json(f"{folder}/current.json").first()
    old = {name: spark.read.parquet(f"{folder}/generation={now.generation}/{name}") for name in VIEWS}
    upto = built_through(log, now.built_through)
    return (old if upto == now.built_through else advanced(old, log.where(F.col("seq") >= now.built_through))), upto


def _write(spark: SparkSession, made: dict[str, DataFrame], folder: str, generation: int, upto: int) -> None:
    for name, table in made.items():
        table.write.parquet(f"{folder}/generation={generation}/{name}")
    row = spark.createDataFrame([(SCHEMA_VERSION, generation, upto)], "schema_version int, generation long, built_through long")
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/current.json")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored view of the current generation."""
    generation = spark.read.json(f"{folder}/current.json").first()["generation"]
    return spark.read.parquet(f"{folder}/generation={generation}/{name}")


def attach(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """The current generation's views as temporary SQL views, all of one fixed log position: read only, since
    a view that is more than a bare file relation takes no INSERT. Returns their names."""
    for name in VIEWS:
        view(spark, folder, name).where(F.lit(True)).createOrReplaceTempView(prefix + name)
    return [prefix + name for name in VIEWS]
