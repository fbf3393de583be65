"""Replay up to a high-water mark, then tail from it; deliveries are at least once and carry an id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.errors import EngineError


def prefix(log: DataFrame, mark: int) -> DataFrame:
    return log.where(F.col("seq") < mark)


def tail(log: DataFrame, mark: int) -> DataFrame:
    """From the mark on; log may be a stream."""
    return log.where(F.col("seq") >= mark)


def delivery_id(*bound) -> Column:
    """Of a row: the same in replay and tail, for the query, its parameters and its policy."""
    return F.sha2(F.concat_ws("|", *[F.lit(str(b)) for b in bound], F.col("seq").cast("string")), 256)


def read_log(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """A folder of log files as a stream, in batches of bounded size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def subscribe(spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, cursor: int | None = None, oldest: int = 0, bound: tuple = ()):
    """Replay the log below the mark in one batch, then follow it. cursor: resume after this sequence
    number; one below `oldest` has expired. transform: row-wise stages only (where, project). Restarts
    may deliver a row again, with the same delivery id."""
    if cursor is not None and cursor < oldest:
        raise EngineError("cursor_expired", f"{cursor} is below {oldest}")
    whole = spark.read.schema(schema).parquet(folder)
    start = 0 if cursor is None else cursor + 1
    mark = whole.agg(F.coalesce(F.max("seq") + 1, F.lit(start))).first()[0]
    marked = lambda df: transform(df).withColumn("delivery_id", delivery_id(*bound))
    sink(marked(tail(prefix(whole, mark), start)), -1)
    rows = marked(tail(read_log(spark, folder, schema), max(mark, start)))
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
