"""Exact dedup over an extendible-hash index on shared files, by DataFrame functions alone.

Texts are equal when identical without white space (U+0020, U+0009 to U+000D). The key of a text is the
XXH64 of what remains.

1. Documents become narrow entries (doc_id, key, code points, SHA-256), written once.
2. The directory doubles while a bucket has over CAPACITY keys: an overfull bucket splits by the key's
   next leading bit, as deep as it takes. The driver holds a depth for each value of the first LEADING
   bits, 65,536 at most, however many buckets there are. The directory is stored beside the buckets.
3. Each text goes to the task that owns its part of a bucket, a range of keys, where texts meet by key and bytes:
   the group-by there compares whole normalised texts. Keys of over HOT rows are combined where they are
   read and only then sent, so a text that a third of all rows repeat is a row a task.
4. The bucket's owner chains the different texts of one key (chain 0, 1, ...) and writes the bucket's file.
5. Entries look their text up by bucket, key and SHA-256; lookup() of other documents opens only the
   buckets that these fall in.

Null text is the empty text. Of equal texts the row with the most code points stays, then the smallest
doc_id (null last). Rows that repeat both doc_id and text are alike; one of them stays. An empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import BLANKS, broadcast_if_small, new_path, partitions, texts, written

CAPACITY, LEADING, DEEPEST, HOT, PARTS = 1 << 14, 16, 62, 1 << 9, 8
INDEX = "key long, chain int, text_sha256 binary, group_size long, keep_id long, keep_points int, bucket long"


def normalised(text: Column | str) -> Column:
    return F.translate(text, BLANKS, "")


def _first_bits(key: str, depth: Column | int) -> Column:
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return F.call_function("shiftrightunsigned", F.shiftrightunsigned(key, 1), (63 - depth).cast("int"))


def bucket_of(key: str, depths: list[int], deeper: int = 0) -> Column:
    """A bucket of depth d has the number 2^d + the first d bits of its keys. depths: one for each slot,
    which is the value of the first bits, as many as the list's length takes. deeper: instead of the bucket
    the part of it that so many further bits name."""
    if len(depths) == 1 and not depths[0]:
        return _first_bits(key, deeper) + (1 << deeper)
    table = F.split(F.lit(" ".join(map(str, depths))), " ").cast("array<int>")
    depth = F.element_at(table, (_first_bits(key, len(depths).bit_length() - 1) + 1).cast("int"))
    depth = F.least(depth + deeper, F.lit(DEEPEST)) if deeper else depth
    return _first_bits(key, depth) + F.call_function("shiftleft", F.lit(1).cast("long"), depth)


def directory(keys: DataFrame, capacity: int = CAPACITY, leading: int = LEADING) -> list[int]:
    """The depth of each slot's bucket. keys (key): distinct. What comes to the driver is a count for
    each value of the first `leading` bits."""
    prefix = _first_bits("key", leading)
    counts = {r["prefix"]: r["n"] for r in keys.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).collect()}
    depths, buckets = [0] * (1 << leading), [(0, 0, sum(counts.values()))]
    while buckets:
        depth, bits, load = buckets.pop()
        below = leading - depth
        span = range(bits << below, (bits + 1) << below)
        if load > capacity and below:
            left = sum(counts.get(p, 0) for p in span[: len(span) // 2])
            buckets += [(depth + 1, 2 * bits + 1, load - left), (depth + 1, 2 * bits, left)]
        elif below:
            depths[span.start : span.stop] = [depth] * len(span)
        else:
            depths[bits] = depth + max(0, ceil(log2(load / capacity)) if load else 0)
    while max(depths) > leading:  # below the counted bits, split until no bucket is overfull
        loads = keys.groupBy(prefix.alias("prefix"), bucket_of("key", depths).alias("bucket")).agg(F.count("*").alias("n"))
        over = [r for r in loads.where(F.col("n") > capacity).groupBy("prefix").agg(F.max("n").alias("n")).collect() if depths[r["prefix"]] < DEEPEST]
        for r in over:
            depths[r["prefix"]] = min(DEEPEST, depths[r["prefix"]] + ceil(log2(r["n"] / capacity)))
        if not over:
            return depths
    step = 1 << (leading - max(depths))  # as many slots as the deepest bucket needs
    return depths[::step]


@dataclass(frozen=True)
class Index:
    """The stored index: where it is, and its directory."""

    spark: SparkSession
    path: str
    depths: list[int]

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark, path, [r["depth"] for r in spark.read.parquet(f"{path}/directory").orderBy("slot").collect()])

    def entries(self) -> DataFrame:
        """A row for each different text; a bucket's rows are in the folder of the bucket."""
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/buckets")


def entries_of(docs: DataFrame) -> DataFrame:
    norm = normalised("text")
    return texts(docs).select("doc_id", F.xxhash64(norm).alias("key"), F.char_length("text").alias("points"), F.unhex(F.sha2(norm, 256)).alias("text_sha256"))


def build_index(docs: DataFrame, counts: DataFrame, path: str, capacity: int = CAPACITY, hot: int = HOT) -> Index:
    """Write the index of docs. counts (key, n): how many rows have a key."""
    spark = docs.sparkSession
    depths = directory(counts.select("key"), capacity)
    spark.createDataFrame(list(enumerate(depths)), "slot int, depth int").coalesce(1).write.parquet(f"{path}/directory")
    whole = texts(docs).select("doc_id", normalised("text").alias("norm"), F.char_length("text").alias("points"))
    whole = whole.select("*", F.xxhash64("norm").alias("key")).withColumn("bucket", bucket_of("key", depths)).withColumn("owned", bucket_of("key", depths, PARTS))
    often = broadcast_if_small(counts.where(F.col("n") > hot).select("key"))
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("not_id"))).alias("best")  # ~ turns the order of ids

    def met(rows: DataFrame) -> DataFrame:  # by bytes
        one = rows.groupBy("owned", "bucket", "key", "norm").agg(F.count("*").alias("group_size"), best)
        return one.select("bucket", "key", F.unhex(F.sha2("norm", 256)).alias("text_sha256"), "group_size", F.bitwise_not("best.not_id").alias("keep_id"), F.col("best.points").alias("keep_points"))

    n = partitions(spark)
    owned = met(whole.join(often, "key", "left_anti").repartition(n, "owned"))
    both = owned.unionByName(met(whole.join(often, "key", "left_semi"))).repartition(n, "bucket")
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    chained = both.withColumn("chain", F.row_number().over(chain) - 1)
    names = [c.split()[0] for c in INDEX.split(", ")]
    chained.select(*names).sortWithinPartitions("bucket", "key").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/buckets")
    return Index(spark, path, depths)


def lookup(docs: DataFrame, index: Index, most: int = 10_000) -> DataFrame:
    """For each document its doc_id, text_sha256, and the index's group_size, keep_id and chain of an equal
    text, null where there is none. Only the buckets of these documents are read where they are at most
    `most`; else the join reads all."""
    asked = entries_of(docs).withColumn("bucket", bucket_of("key", index.depths))
    needed = [r["bucket"] for r in asked.select("bucket").distinct().limit(most + 1).collect()]
    rows = index.entries()
    rows = rows.where(F.col("bucket").isin(needed)) if len(needed) <= most else rows
    found = asked.join(rows, ["bucket", "key", "text_sha256"], "left")
    return found.select("doc_id", F.lower(F.hex("text_sha256")).alias("text_sha256"), "group_size", "keep_id", "chain")


def decisions(docs: DataFrame, capacity: int = CAPACITY, hot: int = HOT) -> DataFrame:
    """A row a document: doc_id, keep_id, group_size, kept, text_sha256, and key, points, chain, repeats
    (how many rows are alike in doc_id and text)."""
    entries = written(entries_of(docs), "dedup-entries")
    counts = written(entries.groupBy("key").agg(F.count("*").alias("n")), "dedup-keys")
    index = build_index(docs, counts, new_path(docs.sparkSession, "dedup-index"), capacity, hot)
    alike = entries.groupBy("doc_id", "key", "points", "text_sha256").agg(F.count("*").alias("repeats"))
    found = alike.withColumn("bucket", bucket_of("key", index.depths)).join(index.entries(), ["bucket", "key", "text_sha256"])
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("copy")
    rows = found.select("doc_id", "keep_id", "group_size", "key", "points", "keep_points", "chain", "repeats", F.lower(F.hex("text_sha256")).alias("text_sha256"), one)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")) & (F.col("copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "key", "points", "chain", "repeats")


def keep_one(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay."""
    kept = written(decisions(docs, capacity).where("kept").select(F.col("doc_id").alias("kept_id"), "key", "points", "repeats"), "dedup-kept")
    text = F.coalesce(docs["text"], F.lit(""))

    def alike(side: DataFrame) -> Column:  # by the sides' own columns, whatever else docs has
        return docs["doc_id"].cast("long").eqNullSafe(side["kept_id"]) & (F.xxhash64(normalised(text)) == side["key"]) & (F.char_length(text) == side["points"])

    single, again = (broadcast_if_small(kept.where(x)) for x in ("repeats = 1", "repeats > 1"))
    once = docs.join(single, alike(single), "left_semi")
    if again.isEmpty():
        return once
    # Rows alike in doc_id and text may differ in other columns: any of them stays.
    more = docs.join(again, alike(again), "left_semi")
    key = F.xxhash64(normalised(F.coalesce(more["text"], F.lit(""))))
    whole = F.struct(*[more[c] for c in docs.columns])
    first = more.groupBy(more["doc_id"], key).agg(F.first(whole).alias("row"))
    return once.unionByName(first.select("row.*"))
