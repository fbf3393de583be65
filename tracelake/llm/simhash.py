"""SimHash fingerprints, their near pairs, and the groups these link.

Fingerprint: A-Z are lower-cased; words are what white space (U+0020, U+0009 to U+000D) leaves; of every
`width` words in a row (fewer words: all of them), joined by one space, the XXH64 with seed 42 is taken.
A bit of the 64 is 1 if it is set in over half of these hashes. A text without a word has fingerprint 0.

Null text is the empty text. Rows that repeat, and texts with one fingerprint, are in one group. A null
doc_id names a group only if the group has no other. An empty table gives no rows.

Links: two fingerprints link at `most` = 4 or fewer differing bits. Four bits touch four bytes at most,
so the two share at least four of eight positional bytes. The inverted index lists fingerprints by byte
positions and the bytes there: by three positions (20 triples are enough that any four positions contain
one of them) or by four (all 70 sets of four), whichever makes fewer entries and chance pairs for the
number of fingerprints; both find every link. In a list, a pair's shared positional bytes are tallied, pairs below four are passed over, and the others
are verified bit by bit. Long lists are dealt out as pairs of chunks; a list yields a spanning forest of
its links, so the number of links stays below the number of list entries however close the texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import broadcast_if_small, partitions, texts, written
from tracelake.llm.components import components
from tracelake.llm.tokens import slices

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Of eight byte positions in groups of 3, 3 and 2: three of a group, or two of a group and one of the next.
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
SHORT, CHUNK, LARGE = 32, 8192, 500
#: From here on 70 entries a fingerprint, in lists of 2^-32 of all, cost less than 20 in lists of 2^-24.
MANY = 85_000_000


def byte_triples() -> list[tuple[int, int, int]]:
    found = []
    for group, after in zip(GROUPS, GROUPS[1:] + GROUPS[:1]):
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                found += [(a, b, c) for c in after] + [(a, b, c) for c in group if c > b]
    return found


def byte_sets(n_fingerprints: int) -> list[tuple[int, ...]]:
    return byte_triples() if n_fingerprints < MANY else list(combinations(range(8), 4))


def fingerprint(text: bytes, width: int = 4) -> int:
    """Of one text in UTF-8, unsigned."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        starts, ends = [0], [len(whole)]
    else:
        starts, ends = [0, *(ends[: len(words) - width] + 1).tolist()], ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(whole[a:b], 42) for a, b in zip(starts, ends)], np.uint64, len(starts)).view(np.uint8).reshape(-1, 8)
    bits = 0
    for k in range(8):
        # How often each byte value stands there, then how often each bit is set.
        set_ = np.bincount(hashes[:, k], minlength=256) @ BITS
        bits |= int(np.packbits(2 * set_ > len(starts), bitorder="little")[0]) << 8 * k
    return bits


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(x, width) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))})

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: each one found is compared with all
    that are not yet found, by shared bytes first and by bits then."""
    todo, a, b = np.arange(len(fps)), [], []
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            differs = fps[todo] ^ fps[x]
            shared = (differs.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = (shared >= 8 - most) & (np.bitwise_count(differs) <= most)
            found = todo[near]
            queue += found.tolist()
            a.append(np.full(len(found), fps[x]))
            b.append(fps[found])
            todo = todo[~near]
    return np.concatenate([fps[:0], *a]), np.concatenate([fps[:0], *b])


def _linker(most: int, chunk: int, few: int):
    """For rows sorted by list: the links of lists of at most `chunk` entries; longer lists' names and sizes."""

    def links(name: np.ndarray, fps: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(name)]]))
        a, b = [fps[:0]], [fps[:0]]
        short = np.repeat(sizes <= few, sizes)
        for step in range(1, min(few, int(sizes.max()))):
            at = np.flatnonzero((name[step:] == name[:-step]) & short[:-step])
            differs = fps[at] ^ fps[at + step]
            shared = (differs.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            at = at[(shared >= 8 - most) & (np.bitwise_count(differs) <= most)]
            a.append(fps[at])
            b.append(fps[at + step])
        for start, size in zip(starts[sizes > few].tolist(), sizes[sizes > few].tolist()):
            x, y = _forest(fps[start : start + size], most)
            a.append(x)
            b.append(y)
        return np.concatenate(a), np.concatenate(b)

    def batch_of(a, b, long_name=(), long_size=()):
        n, m = len(a), len(long_name)
        none = lambda k: pa.nulls(k, pa.int64())
        cat = lambda x, y: pa.concat_arrays([x, y])
        return pa.RecordBatch.from_arrays([cat(pa.array(a.view(np.int64)), none(m)), cat(pa.array(b.view(np.int64)), none(m)), cat(none(n), pa.array(list(long_name), pa.int64())), cat(none(n), pa.array(list(long_size), pa.int64()))], names=["a", "b", "long_list", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, fps, over, over_size = np.zeros(0, np.int64), np.zeros(0, np.uint64), None, 0
        for batch in batches:
            n = batch.column("list").to_numpy(zero_copy_only=False)
            f = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if over is not None:  # inside a list that is too long
                k = int(np.searchsorted(n != over, True)) if n[-1] != over else len(n)
                over_size, n, f = over_size + k, n[k:], f[k:]
                if not len(n):
                    continue
                yield batch_of(fps[:0], fps[:0], [over], [over_size])
                over = None
            name, fps = np.concatenate([name, n]), np.concatenate([fps, f])
            last = int(np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))[-1])
            yield from emit(name[:last], fps[:last])
            name, fps = name[last:], fps[last:]
            if len(name) > chunk:
                over, over_size, name, fps = int(name[0]), len(name), name[:0], fps[:0]
        if over is not None:
            yield batch_of(fps[:0], fps[:0], [over], [over_size])
        yield from emit(name, fps)

    def emit(name, fps):
        if not len(name):
            return
        names, sizes = np.unique(name, return_counts=True)
        if (long := sizes > chunk).any():
            yield batch_of(fps[:0], fps[:0], names[long], sizes[long])
            keep = ~np.isin(name, names[long])
            name, fps = name[keep], fps[keep]
        if len(name):
            yield batch_of(*links(name, fps))

    return run


def near_links(fps: DataFrame, most: int = 4) -> DataFrame:
    """fps (fp, distinct) -> links (a, b) that connect what all pairs at `most` or fewer differing bits connect."""
    if not 0 <= most <= 4:
        raise ValueError("the triples of byte positions are for 0 to 4 differing bits")
    spark = fps.sparkSession
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(F.lit(255))
    lists = [reduce(Column.__add__, [byte(p) * 256**i for i, p in enumerate(places)]) + F.lit(k << 32) for k, places in enumerate(byte_sets(fps.count()))]
    entries = fps.select("fp", F.explode(F.array(*lists)).alias("list"))
    schema = "a long, b long, long_list long, size long"

    def linked(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(spark), "list").sortWithinPartitions("list", "fp")

    links, level = [], 0
    while True:
        found = written(linked(entries).mapInArrow(_linker(most, CHUNK, SHORT), schema), "near")
        links.append(found.where("a is not null").select("a", "b"))
        long_lists = found.where("long_list is not null").select(F.col("long_list").alias("list"), "size")
        if long_lists.isEmpty():
            return reduce(DataFrame.union, links)
        # Of a long list every pair of chunks meets in a list of its own; a chunk has about a third of CHUNK.
        # A pair that is too long all the same is dealt out again, by another hash.
        chunks, level = F.ceil(F.col("size") * 3 / CHUNK), level + 1
        own = entries.join(broadcast_if_small(long_lists), "list").withColumn("n", chunks).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(level)), "n"))
        pairs = own.select("fp", "list", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
        entries = pairs.select("fp", F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")).alias("list"))


def groups(docs: DataFrame, width: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, the document's own included)."""
    prints = written(fingerprints(docs, width), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp-nodes")
    found = components(near_links(nodes.select("fp"), most))
    member = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = written(member, "members")
    # The ends of large components are few for their number of members, so their members need no shuffle.
    least = written(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "components")
    large, small = broadcast_if_small(least.where(F.col("n") > LARGE)), least.where(F.col("n") <= LARGE)
    of_large = member.join(large, "root").select("fp", "component_id")
    of_small = member.join(large, "root", "left_anti").join(small, "root").select("fp", "component_id")
    labels = of_large.union(of_small)
    # A row a fingerprint; copies share one, so a hot fingerprint is one row here and AQE splits its documents.
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 4, most: int = 4) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; all columns stay. Rows that repeat the
    kept doc_id stay too (they are one document); where a group has only null doc_ids, all its rows stay."""
    kept = groups(docs, width, most).where("doc_id = component_id or component_id is null").select(F.col("doc_id").alias("kept_id")).distinct()
    kept = broadcast_if_small(written(kept, "kept"))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]), "left_semi")
