"""From source files to the log and its views: discovery, change detection, parsing, records, catch-up.

The log is a folder of Parquet batches, one a reconcile; a batch that failed is written again under its first
sequence number. A record of evidence stands before its event, checkpoints after all events, controls before them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.identity import framed, session_id
from tracelake.operators import ingest
from tracelake.plans import views
from tracelake.sources import lines as L
from tracelake.sources import providers
from tracelake.sources.stored import stored

LOG = "seq long, session_id string, kind short, ts_ms long, body binary"
CHECKPOINTS = "provider string, path string, generation long, length long, chunks array<string>, missing_since long"
INVENTORY = "provider string, path string, length long, chunks array<string>, tail string"
ORDER = ["rank", "path", "byte_start", "event_id", "part"]


def log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{folder}/log")


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for provider, path, old in zip(frame["provider"], frame["path"], frame["old"]):
            chunks, tail, at = [], None, 0
            with L.opened(path) as file:
                while block := file.read(ingest.CHUNK):
                    if at < old <= at + len(block):
                        tail = hashlib.sha256(block[: int(old) - at]).hexdigest()
                    chunks.append(hashlib.sha256(block).hexdigest())
                    at += len(block)
            rows.append((provider, path, at, chunks, tail))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in INVENTORY.split(", ")])


def inventory(provider: str, found: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """What reconcile() compares. Tasks read the files a chunk at a time; no content is shuffled or held."""
    spread = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # paths are small, what they name is not
    old = checkpoints.where(F.col("provider") == provider).select("path", F.col("length").alias("old"))
    met = found.select(F.lit(provider).alias("provider"), "path").join(old, "path", "left").select("provider", "path", "old")
    return met.repartition(spread, "path").mapInPandas(_digests, INVENTORY)


def _octets(text: Column) -> Column:
    pairs = F.split(F.regexp_replace(F.hex(text.cast("binary")), "(..)(?=.)", "$1,"), ",")
    return F.transform(F.filter(pairs, lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))


def _record(kind: int, **fields: Column | str) -> Column:
    made = F.to_json(F.struct(F.lit(1).alias("version"), *[F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in fields.items()]))
    return F.struct(F.lit(kind).cast("short").alias("kind"), made.cast("binary").alias("body"))


def records(provider: str, plan: DataFrame, known: DataFrame, base: int, now_ms: int, retracted: DataFrame | None = None) -> DataFrame:
    """The log records of a reconcile's plan (stored, since it is read several times), numbered from base.
    A changed file is parsed whole, since lines need what stands before them; events whose id is known go."""
    spark = plan.sparkSession
    changed = plan.where(F.col("change") != "unchanged")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = stored(L.lines(L.contents(changed.select("path", "length").repartition(spread, "path"))))
    parsed = providers.PARSERS[provider](lines).join(changed.select("path", "generation"), "path")
    events = ingest.unknown(ingest.identified(parsed, provider, F.col("generation")), known)
    pairs = events.select(F.lit(1).alias("rank"), "path", "byte_start", "event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), "generation", "byte_end", "native_session_id", "native_identity", "entity_revision", "timestamp_ms", "event", "raw")
    done = lines.groupBy("path").agg(F.max("byte_end").alias("byte_end"))
    points = changed.join(done, "path", "left").select(F.lit(2).alias("rank"), "path", "generation", F.coalesce("byte_end", F.lit(0).cast("long")).alias("byte_end"), "length", "chunks")
    if retracted is None:
        retracted = spark.createDataFrame([], "provider string, path string, generation long")
    hides = ingest.controls(plan, retracted).select(F.lit(0).alias("rank"), "path", "generation", "action")
    every = pairs.unionByName(points, allowMissingColumns=True).unionByName(hides, allowMissingColumns=True)
    rows = ingest.numbered(every, ORDER, base).withColumn("provider", F.lit(provider))
    source = dict(provider="provider", sourcePath="path")
    evidence = _record(views.EVIDENCE, **source, sourceGeneration="generation", byteStart="byte_start", byteEnd="byte_end", sha256=F.sha2(F.col("raw").cast("binary"), 256), raw=_octets(F.col("raw")))
    event = _record(views.EVENT, **source, nativeSessionId="native_session_id", sourceGeneration="generation", eventId="event_id", nativeIdentity="native_identity", entityRevision="entity_revision", event="event", evidenceSeqs=F.array(F.col("seq") - 1))
    point = _record(views.CHECKPOINT, **source, generation="generation", committedOffset="byte_end", snapshotLength="length", chunks="chunks")
    control = _record(views.VISIBILITY, **source, sourceGeneration="generation", action="action")
    made = F.when(F.col("rank") == 0, control).when(F.col("rank") == 2, point).when(F.col("part") == 0, evidence).otherwise(event)
    owner = F.when(F.col("rank") == 1, session_id(F.col("provider"), F.col("native_session_id"))).otherwise(framed(F.col("provider"), F.col("path")))
    return rows.select("seq", owner.alias("session_id"), F.coalesce("timestamp_ms", F.lit(now_ms)).alias("ts_ms"), made.alias("_m")).select("seq", "session_id", "_m.kind", "ts_ms", "_m.body")


def index(spark: SparkSession, provider: str, found: DataFrame, folder: str, now_ms: int) -> int:
    """Index sources for the first time: found (path) are discovered files, of which
    Spark lists those that are not empty. Returns the views' generation."""
    plan = stored(ingest.reconcile(spark.createDataFrame([], CHECKPOINTS), inventory(provider, found, spark.createDataFrame([], CHECKPOINTS))))
    records(provider, plan, spark.createDataFrame([], "event_id string"), 0, now_ms).write.mode("overwrite").parquet(f"{folder}/log/batch=0")
    return views.rebuild(log(spark, folder), f"{folder}/views", now_ms)


def append(spark: SparkSession, provider: str, found: DataFrame, folder: str, now_ms: int, retracted: DataFrame | None = None) -> int:
    """Bring the log up to the sources in found; others stay as they are, so a tick passes hot sources alone.
    retracted (provider, path, generation): sources that ingest.gone() gives up. Without a change nothing is
    written. Returns the next sequence number; views.fresh() sees the new records at once."""
    old, base = views.fresh(log(spark, folder), f"{folder}/views")
    points = old["checkpoints"].select("provider", F.col("sourcePath").alias("path"), "generation", F.col("snapshotLength").alias("length"), "chunks", F.lit(None).cast("long").alias("missing_since"))
    plan = stored(ingest.reconcile(points, inventory(provider, found, points)))
    if plan.where(F.col("change") != "unchanged").isEmpty() and (retracted is None or retracted.isEmpty()):
        return base
    known = old["events"].select(F.col("eventId").alias("event_id"))
    made = records(provider, plan, known, base, now_ms, retracted)
    made.write.mode("overwrite").parquet(f"{folder}/log/batch={base}")
    return views.built_through(log(spark, folder), base)


def reconcile(spark: SparkSession, provider: str, found: DataFrame, folder: str, now_ms: int, retracted: DataFrame | None = None) -> int:
    """append(), then the stored views' catch-up. Without a change the generation stays."""
    append(spark, provider, found, folder, now_ms, retracted)
    return views.catch_up(log(spark, folder), f"{folder}/views", now_ms)
