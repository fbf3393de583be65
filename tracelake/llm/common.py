"""What the training-data operators share: the shared folder, written intermediates, input columns."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space in the contracts: U+0020 and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where that is unset a
    single-machine session, such as a test's, gets a folder of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracelake-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_dir(spark)}/tracelake/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clean(spark: SparkSession) -> None:
    """Delete all intermediates of this process. Results that are still lazy must be written first."""
    while _made:
        _delete(spark, _made.pop())


def mark() -> int:
    """For release(): what is made from here on."""
    return len(_made)


def release(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the intermediates made since a mark, but for the table of written() `keep`. What was computed
    from them must be written by now."""
    gone = [path for path in _made[since:] if path != keep.table_path]
    _made[since:] = [keep.table_path]
    for path in gone:
        _delete(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder. Later reads cost a scan, not df's plan, and outlive executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of written(), once nothing lazy reads it any more."""
    _delete(df.sparkSession, df.table_path)


def replayable(df: DataFrame, label: str) -> DataFrame:
    """df if it is a scan with projections and filters, which deals its rows alike each time it is read;
    else a written copy, since a shuffle may bring rows in another order."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {line.lstrip(" :+-|").split(" ", 1)[0].split("[", 1)[0] for line in plan.strip().splitlines()}
    return df if nodes <= {"Relation", "Project", "Filter"} else written(df, label)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and nothing else, so that other columns' names never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: Column) -> Column:
    """Unsigned crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def size_in_bytes(df: DataFrame) -> int:
    """The optimiser's own estimate of df; for a written table that is the size of its files' rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A hint for a side whose estimated size is within the bound; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if size_in_bytes(df) <= most else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file. TRACELAKE_TOKENIZERS names another folder that holds them."""
    if folder := os.environ.get("TRACELAKE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
