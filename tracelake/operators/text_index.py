"""A stored trigram index for ranked phrases: immutable generations, each with a manifest.

A generation holds `texts`, dealt by identity into parts, and `grams`, dealt by trigram into buckets: a row for
each trigram of a block of texts, with the identities of those that have it. A phrase reads only its trigrams'
buckets, keeps identities that have all of them, and reads only these identities' parts. Nulls and texts under three characters have no trigram
but count as documents, as in a search without the index. Rows that came after the build are scanned beside it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.errors import EngineError
from tracelake.operators.search import bm25, phrase_length

# The manifest's version and the index's kind; how many trigrams a block has, and how many characters
# of a text are taken at once.
MANIFEST_VERSION, KIND = "2.0", "fulltext"
BLOCK, PIECE = 1 << 21, 1 << 22
MANIFEST = "manifestVersion string, indexKind string, generation long, builtThroughSeq long, createdAt string, schemaVersion string, identity string, identityType string, text string, buckets int, parts int, documents long, meanLength double"


@dataclass(frozen=True)
class Index:
    """One generation. Searches and later pages of one search hold on to it while others are built."""

    folder: str
    generation: int
    built_through: int
    identity: str
    identity_type: str
    text: str
    buckets: int
    parts: int
    documents: int
    mean: float

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        schema = _schemas(self.identity, self.identity_type, self.text)[name]  # files of an empty table tell none
        return spark.read.schema(schema).parquet(f"{self.folder}/generation={self.generation}/{name}")


def _schemas(identity: str, kind: str, text: str) -> dict[str, str]:
    return {"texts": f"`{identity}` {kind}, `{text}` string, part int", "grams": f"gram string, ids array<{kind}>, bucket int"}


def _place(c: Column, n: int) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % n).cast("int")


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)  # faster here than np.unique()
    return codes[np.diff(codes, prepend=-1) != 0]


def _codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text, 21 bits a character; none for a short one."""
    found = [np.empty(0, np.int64)]
    for at in range(0, max(len(text) - 2, 0), PIECE):
        c = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le"), "<u4").astype(np.int64)
        found.append(_distinct(c[:-2] << 42 | c[1:-1] << 21 | c[2:]))
    return found[-1] if len(found) < 3 else _distinct(np.concatenate(found))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (identity, text): a row for each trigram of a block of texts, with the identities that have it."""
    for batch in batches:
        (ids, texts), first, codes, held = batch.columns, 0, [], 0
        for at, text in enumerate(texts):
            codes.append(_codes(text.as_py() or ""))
            held += len(codes[-1])
            if held < BLOCK and at + 1 < len(texts):
                continue
            grams = np.concatenate(codes)
            order = np.argsort(grams, kind="stable")
            grams, owners = grams[order], np.repeat(np.arange(first, at + 1), list(map(len, codes)))[order]
            starts = np.flatnonzero(np.diff(grams, prepend=-1))
            three = np.stack([grams[starts] >> 42, grams[starts] >> 21, grams[starts]], axis=1) & 0x1FFFFF
            joined = three.astype("<u4").tobytes().decode("utf-32-le")
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(grams)), pa.int32()), ids.take(pa.array(owners)))
            yield pa.RecordBatch.from_arrays([pa.array([joined[i : i + 3] for i in range(0, len(joined), 3)], pa.string()), lists], names=["gram", "ids"])
            first, codes, held = at + 1, [], 0


def build(df: DataFrame, folder: str, identity: str, text: str, now_ms: int, built_through: int, previous: int = 0, buckets: int = 256, parts: int = 256) -> int:
    """Write a new generation of an index on df's rows (one an identity), then let current.json name it.
    Buckets and parts are rebalanced by size when written, so a frequent trigram's bucket takes several files."""
    spark, generation = df.sparkSession, max(previous + 1, now_ms)
    root = f"{folder}/generation={generation}"
    df.select(identity, text).withColumn("part", _place(F.col(identity), parts)).hint("rebalance", "part").write.partitionBy("part").parquet(f"{root}/texts")
    kind = df.schema[identity].dataType.simpleString()
    texts = spark.read.schema(_schemas(identity, kind, text)["texts"]).parquet(f"{root}/texts")
    grams = texts.select(identity, F.lower(text).alias("low")).mapInArrow(_postings, f"gram string, ids array<{kind}>").withColumn("bucket", _place(F.col("gram"), buckets))
    grams.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{root}/grams")
    n, mean = texts.agg(F.count("*"), F.avg(phrase_length(text))).first()
    row = (MANIFEST_VERSION, KIND, generation, built_through, str(now_ms), "1", identity, kind, text, buckets, parts, n, mean or 0.0)
    manifest = spark.createDataFrame([row], MANIFEST).coalesce(1)
    manifest.write.json(f"{root}/manifest.json")
    manifest.write.mode("overwrite").json(f"{folder}/current.json")
    return generation


def opened(spark: SparkSession, folder: str, generation: int | None = None) -> Index:
    """The current generation, or a given older one that is still there."""
    path = f"{folder}/current.json" if generation is None else f"{folder}/generation={generation}/manifest.json"
    m = spark.read.schema(MANIFEST).json(path).first()
    if m is None or m.manifestVersion != MANIFEST_VERSION or m.indexKind != KIND:
        raise EngineError("unsupported_capability", f"no text index of version {MANIFEST_VERSION} in {folder}")
    return Index(folder, m.generation, m.builtThroughSeq, m.identity, m.identityType, m.text, m.buckets, m.parts, m.documents, m.meanLength)


def candidates(spark: SparkSession, index: Index, phrase: str) -> DataFrame:
    """identity and part of the texts that hold every trigram of the phrase."""
    low = phrase.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    buckets = sorted({zlib.crc32(g.encode()) % index.buckets for g in grams})
    found = index.table(spark, "grams").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    held = found.select(F.explode("ids").alias(index.identity)).groupBy(index.identity).agg(F.count("*").alias("_n"))
    return held.where(F.col("_n") == len(grams)).select(index.identity, _place(F.col(index.identity), index.parts).alias("part"))


def phrase_hits(spark: SparkSession, index: Index, phrase: str, tail: DataFrame | None = None) -> DataFrame:
    """identity, text and score of the rows that hold the phrase (three characters or more, any case), scored as
    search.phrase_hits() does over all rows. tail: the rows after the index was built, which are scanned."""
    if len(phrase) < 3:
        raise EngineError("invalid_parameter", "a ranked phrase has three characters or more")
    low, (identity, text) = phrase.lower(), (index.identity, index.text)
    texts = index.table(spark, "texts")
    rows = texts.join(candidates(spark, index, phrase), ["part", identity], "left_semi").select(identity, text)
    n, mean = F.lit(float(index.documents)), F.lit(index.mean)
    if tail is not None:
        added = tail.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.sum(phrase_length(text)), F.lit(0.0)).alias("length"))
        n = F.lit(float(index.documents)) + added.select("n").scalar()
        mean = (F.lit(index.mean * index.documents) + added.select("length").scalar()) / n
        rows = rows.unionByName(tail.select(identity, text))
    found = rows.where(F.lower(text).contains(low))
    hits = found.agg(F.count("*").cast("double")).scalar()
    return found.withColumn("score", bm25(F.col(text), low, n, mean, hits))
