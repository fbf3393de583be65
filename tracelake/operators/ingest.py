"""Reconciling sources with the log: what changed, which events are new, and their sequence numbers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tracelake.errors import EngineError
from tracelake.functions.identity import event_id, framed
from tracelake.sources.stored import stored

# Fixed value: bytes of a fingerprinted chunk.
CHUNK = 64 << 10


@F.pandas_udf(ArrayType(StringType()))
def fingerprints(content: pd.Series) -> pd.Series:
    """SHA-256 of each chunk of a file."""
    return content.map(lambda b: [hashlib.sha256(b[i : i + CHUNK]).hexdigest() for i in range(0, len(b), CHUNK)])


def change(old_length: Column, old_chunks: Column, length: Column, chunks: Column, old_tail: Column) -> Column:
    """new, unchanged, append or replace. old_tail: the digest, in the new file, of the bytes of the old
    file's last unfinished chunk."""
    full = F.expr(f"cast({old_length._jc.toString()} div {CHUNK} as int)")
    same = F.slice(old_chunks, F.lit(1), F.greatest(full, F.lit(0))) == F.slice(chunks, F.lit(1), F.greatest(full, F.lit(0)))
    tail = (old_length % CHUNK == 0) | (F.element_at(old_chunks, -1) == old_tail)
    return F.when(old_length.isNull(), "new").when((old_length == length) & (old_chunks == chunks), "unchanged").when((length > old_length) & same & tail, "append").otherwise("replace")


def identified(events: DataFrame, provider: str, generation: Column) -> DataFrame:
    """Parsed provider events with their ids."""
    made = event_id(F.lit(provider), F.col("native_session_id"), generation, F.col("native_identity"), F.col("event_type"), F.col("raw"))
    return events.withColumn("event_id", made).withColumn("generation", generation)


def unknown(events: DataFrame, known: DataFrame) -> DataFrame:
    """Events whose id the log lacks, each once."""
    return events.join(known.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])


def numbered(records: DataFrame, order: list[str], base: int) -> DataFrame:
    """records with seq, contiguous from base in the given order (which must tell all rows apart), without
    one task seeing all rows: rows are dealt by range, counted a partition, and each partition starts after
    those before it. The dealing is stored, since counts and rows must see the same bounds."""
    dealt = stored(records.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    dealt = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(starts.drop("_n")), "_p").withColumn("seq", F.col("_start") + F.col("_i") - 1 + base).drop("_p", "_i", "_start")  # a row a partition


def contiguous(records: DataFrame, base: int) -> None:
    """An appended batch must follow the log without a gap."""
    low, high, n = records.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    if n and (low != base or high - low + 1 != n):
        raise EngineError("storage_error", f"seq {low}..{high} has {n} records after {base}")


def gone(checkpoints: DataFrame, inventory: DataFrame, now_ms: int, grace_ms: int = 5_000) -> DataFrame:
    """Checkpointed sources that a full inventory lacks, with `retract` once they are missing for the grace
    period. checkpoints: path, missing_since (null: was there last time)."""
    missing = checkpoints.join(inventory.select("path"), "path", "left_anti")
    since = F.coalesce("missing_since", F.lit(now_ms))
    return missing.withColumn("missing_since", since).withColumn("retract", F.lit(now_ms) - since >= grace_ms)


def composite(artifacts: DataFrame, unit: str = "unit") -> DataFrame:
    """One fingerprint for a source of several files, or of compressed ones: SHA-256 over the files' paths
    and digests in order of path, each after its length. Such a source has no prefix to append to."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda a: F.concat_ws(":", F.length(a["path"]).cast("string"), a["path"], F.length(a["digest"]).cast("string"), a["digest"]))
    grouped = artifacts.groupBy(unit).agg(F.count("*").alias("artifacts"), F.sum("length").alias("length"), parts.alias("_parts"))
    return grouped.withColumn("fingerprint", framed(F.array_join("_parts", ""))).drop("_parts")


def reconcile(checkpoints: DataFrame, inventory: DataFrame, composite_source: Column | None = None) -> DataFrame:
    """What to read of each source, by path: change (new, unchanged, append, replace), generation, from_offset.

    checkpoints: provider, path, generation, length, chunks, missing_since. inventory: provider, path, length,
    chunks, tail (the digest, in the new file, of the bytes of the old file's last unfinished chunk).
    An append keeps its generation and reads on from the old length; what is replaced, and what was
    missing and is back, starts a generation anew. Composite sources never append."""
    old = checkpoints.select("provider", "path", F.col("generation").alias("_generation"), F.col("length").alias("_length"), F.col("chunks").alias("_chunks"), F.col("missing_since").alias("_since"))
    met = inventory.join(old, ["provider", "path"], "left")
    kind = change(F.col("_length"), F.col("_chunks"), F.col("length"), F.col("chunks"), F.col("tail"))
    if composite_source is not None:
        kind = F.when((kind == "append") & composite_source, "replace").otherwise(kind)
    kind = F.when(F.col("_since").isNotNull(), "replace").otherwise(kind)
    rows = met.withColumn("change", kind)
    fresh = F.coalesce(F.col("_generation"), F.lit(-1)) + F.when(F.col("change").isin("new", "replace"), 1).otherwise(0)
    start = F.when(F.col("change") == "append", F.col("_length")).otherwise(F.lit(0))
    return rows.select("provider", "path", "change", fresh.cast("long").alias("generation"), start.cast("long").alias("from_offset"), "length", "chunks")


def controls(plan: DataFrame, retracted: DataFrame) -> DataFrame:
    """The control records of a reconcile, which precede its events: supersede for the generation before a
    replaced one, retract for sources that are gone for good (provider, path, generation)."""
    replaced = plan.where((F.col("change") == "replace") & (F.col("generation") > 0)).select("provider", "path", (F.col("generation") - 1).alias("generation"), F.lit("supersede").alias("action"))
    return replaced.unionByName(retracted.select("provider", "path", "generation", F.lit("retract").alias("action")))


def hot_sources(inventory: DataFrame, most: int = 64) -> DataFrame:
    """The sources a tick looks at: the most recently modified, ties by path."""
    return inventory.orderBy(F.desc("modified"), "path").limit(most)


def state(events: DataFrame, checkpoints: DataFrame, control_records: DataFrame) -> dict[str, DataFrame]:
    """What a restart rebuilds from the log: known event ids, the latest checkpoint a source, and the
    generations that controls hide."""
    latest = checkpoints.groupBy("provider", "path").agg(F.max_by(F.struct(*checkpoints.columns), "seq").alias("_r")).select("_r.*")
    hidden = control_records.groupBy("provider", "path", "generation").agg(F.max("seq").alias("hidden_below"))
    return {"known": events.select("event_id").distinct(), "checkpoints": latest, "hidden": hidden}
