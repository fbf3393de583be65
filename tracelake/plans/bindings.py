"""The engine's row types bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.predicates import epoch_ms
from tracelake.plans.fixed import PROVIDERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log events: seq, session, event_type, ts_ms, value, k."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), "event_type", epoch_ms("ts").alias("ts_ms"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


EV = "ev AS (SELECT event_id AS seq, user_id AS session, event_type, epoch_us(ts) // 1000 AS ts_ms, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def msg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: seq, session, turn, role, text."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("conv_id").alias("session"), "turn", "role", "text")


MSG = "msg AS (SELECT conv_id * 1000 + turn AS seq, conv_id AS session, turn, role, text FROM conversations)"


def ch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as search chunks: chunk, session, text, lang, source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), (F.col("doc_id") % 50).alias("session"), "text", "lang", "source")


CH = "ch AS (SELECT doc_id AS chunk, doc_id % 50 AS session, text, lang, source FROM documents)"


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), "embedding", "label")


def rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as revisions of entities of a source generation."""
    e = ev(spark, sf_dir)
    return e.select("seq", "session", "ts_ms", "value", F.element_at(F.array(*map(F.lit, PROVIDERS)), (F.col("session") % 5 + 1).cast("int")).alias("provider"), F.col("session").alias("source_path"), (F.col("seq") % 3).alias("generation"), F.col("event_type").alias("identity"), "event_type")


REV = f"rev AS (SELECT seq, session, ts_ms, value, ({list(PROVIDERS)})[session % 5 + 1] AS provider, session AS source_path, seq % 3 AS generation, event_type AS identity, event_type FROM ev)"


def edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage: session c from (c - 1) div 2, and one edge back to 0 that closes a cycle."""
    c = table(spark, sf_dir, "conversations").where("conv_id >= 1").select(F.col("conv_id").alias("c")).distinct()
    tree = c.select(F.expr("(c - 1) div 2").alias("src"), F.col("c").alias("dst"), F.col("c").alias("edge_id"), F.element_at(F.array(*map(F.lit, ("fork", "resume", "handoff", "subagent"))), (F.col("c") % 4 + 1).cast("int")).alias("type"))
    back = spark.sql("SELECT 3L AS src, 0L AS dst, 0L AS edge_id, 'resume' AS type")
    return tree.unionByName(back)


EDGE = "edge AS (SELECT (c - 1) // 2 AS src, c AS dst, c AS edge_id, (['fork', 'resume', 'handoff', 'subagent'])[c % 4 + 1] AS type FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id >= 1) UNION ALL SELECT 3, 0, 0, 'resume')"


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations of an entity with layer, authority, revision and confidence."""
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("k") % 3 + 1).cast("int"))
    e = ev(spark, sf_dir)
    return e.select(F.col("session").alias("entity"), F.col("seq").alias("event_id"), "ts_ms", "event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("value"), pick("L1", "L2", "L3").alias("layer"), (F.col("k") % 2 == 0).alias("authenticated"), pick("authoritative", "self_reported", "inferred").alias("authority"), (F.col("event_type") == "purchase").cast("int").alias("phase"), (F.col("seq") % 4).alias("revision"), (F.col("value") / 1000).alias("confidence"))


OBS = "obs AS (SELECT session AS entity, seq AS event_id, ts_ms, event_type, CASE WHEN event_type <> 'view' THEN value END AS value, (['L1', 'L2', 'L3'])[k % 3 + 1] AS layer, k % 2 = 0 AS authenticated, (['authoritative', 'self_reported', 'inferred'])[k % 3 + 1] AS authority, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS phase, seq % 4 AS revision, value / 1000 AS confidence FROM ev)"
