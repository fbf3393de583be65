"""Nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Smallest Euclidean distance is largest inner product: |q - x|^2 = |q|^2 - 2 (q.x - |x|^2 / 2), and |x|^2
is kept exactly beside the code. Vectors are centred first, which changes no distance.

1. Each subspace of SUB dimensions gets 16 centres. Codes and centres minimise the anisotropic loss: the
   part of the residual that is parallel to the vector counts ETA times the part across, since it is what
   bends the largest inner products. Centres are fitted on the SAMPLE vectors whose ids hash lowest.
2. Every vector is indexed: a row a block of vectors with packed four-bit codes.
3. Blocks of codes are dealt to parts, blocks of queries to groups, each of HELD bytes at most on the
   average; each group of queries meets each part once, in a task that holds both. There are no more parts
   than memory asks for, or than leaves the repeated queries at half the index; nothing is broadcast.
4. A query's table of 256 values for each two subspaces is summed over the codes. The RERANK best of a part
   are reranked by exact distance, and their k-th distance bounds what the part can add.
5. Inner products in four bytes, with the most they can be off, give a lower bound of each distance. Every
   further vector whose bound is not above the k-th distance is reranked too, however many there are
   (copies of one vector, say). So a part's k best are exact; they are merged a query at a time into the k
   best of all parts, and nothing is lost to a cap.

A block carries its vectors, in four bytes a component where that is exact. Where four-byte products tell
vectors apart badly, most of a part is reranked: time, not results, depends on the data.

Vectors that are null, zero, empty, or hold null or non-finite components take no part, nor do rows with
a null id. A distance needs equal lengths: a query's candidates are the vectors of its own length, and each
length has blocks of its own; lengths of which the sample holds under CENTRES vectors are compared without
codes. Queries that share a vec_id with other rows are searched one by one, each with ranks of its own, and
no candidate is left out but the query's own row: for a query of another table, one row with its id and its
vector. Where there are fewer candidates, all are returned. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import partitions, written

SUB, CENTRES, ETA = 2, 16, 4.0
SAMPLE, BLOCK, QUERY_BLOCK, RERANK = 10_000, 2048, 256, 200
BLOCK_BYTES, HELD, STEP, FAR = 1 << 20, 32 << 20, 2048, 1e15


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double, of any length) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


class Quantiser:
    """Centres of each subspace, fitted to centred vectors."""

    def __init__(self, x: np.ndarray, rounds: int = 8, seed: int = 5):
        self.centre = x.mean(0)
        x = self.padded(x)
        most = np.linalg.norm(x, axis=1).max()
        self.scale = 2.0 ** -np.ceil(np.log2(most)) if 0 < most < np.inf else 1.0
        rng = np.random.default_rng(seed)
        self.subs = x.shape[1] // SUB
        pick = rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)
        self.books = np.stack([x[pick, s * SUB : (s + 1) * SUB] for s in range(self.subs)])
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        codes = self.assign(x, unit, None)
        for _ in range(rounds):
            self.update(x, unit, codes)
            codes = self.assign(x, unit, codes)

    def padded(self, x: np.ndarray) -> np.ndarray:
        x = x - self.centre
        return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB)))

    def assign(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray | None) -> np.ndarray:
        """Codes by coordinate descent: |r|^2 + (ETA - 1) (r . x/|x|)^2 for the residual r."""
        parts = x.reshape(len(x), self.subs, SUB)
        units = unit.reshape(len(x), self.subs, SUB)
        lengths = (self.books**2).sum(2)
        if codes is None:
            codes = np.stack([(lengths[s] - 2 * parts[:, s] @ self.books[s].T).argmin(1) for s in range(self.subs)], 1)
        along = sum(((parts[:, s] - self.books[s][codes[:, s]]) * units[:, s]).sum(1) for s in range(self.subs))
        rows = np.arange(len(x))
        for _ in range(2):
            for s in range(self.subs):
                across = lengths[s] - 2 * parts[:, s] @ self.books[s].T  # but for the part's own squared length
                each = (parts[:, s] * units[:, s]).sum(1)[:, None] - units[:, s] @ self.books[s].T
                rest = along - each[rows, codes[:, s]]
                best = (across + (ETA - 1) * (rest[:, None] + each) ** 2).argmin(1)
                along = rest + each[rows, best]
                codes[:, s] = best
        return codes

    def update(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        """Each centre to the least loss of its vectors, the other subspaces held."""
        parts, units = x.reshape(len(x), self.subs, SUB), unit.reshape(len(x), self.subs, SUB)
        own = lambda s: ((parts[:, s] - self.books[s][codes[:, s]]) * units[:, s]).sum(1)
        along = sum(own(s) for s in range(self.subs))
        for s in range(self.subs):
            rest = along - own(s)
            for c in range(CENTRES):
                rows = codes[:, s] == c
                if rows.any():
                    p, v = parts[rows, s], units[rows, s]
                    a = rows.sum() * np.eye(SUB) + (ETA - 1) * v.T @ v
                    b = p.sum(0) + (ETA - 1) * (v * ((v * p).sum(1) + rest[rows])[:, None]).sum(0)
                    self.books[s, c] = np.linalg.solve(a, b)
            along = rest + own(s)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed four-bit codes, two a byte, and half the squared length."""
        x = self.padded(x)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        codes = np.pad(self.assign(x, unit, None), ((0, 0), (0, self.subs % 2))).astype(np.uint8)
        return codes[:, ::2] | codes[:, 1::2] << 4, (x**2).sum(1) / 2

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query the inner products with what a byte of codes can stand for: (queries, bytes, 256)."""
        parts = self.padded(q).reshape(len(q), self.subs, SUB)
        one = np.einsum("qsd,scd->qsc", parts, self.books).astype(np.float32)
        one = np.pad(one, ((0, 0), (0, self.subs % 2), (0, 0)))
        return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(q), -1, CENTRES**2)

    def short(self, x: np.ndarray) -> np.ndarray:
        """Centred and scaled to lengths about 1, in four bytes a component."""
        out = np.empty(x.shape, np.float32)
        for a in range(0, len(x), STEP):
            out[a : a + STEP] = (x[a : a + STEP] - self.centre) * self.scale
        return out


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of x to q; a row's result doesn't depend on the other rows, so copies tie."""
    return np.concatenate([np.sqrt(((x[a : a + STEP].astype(np.float64) - q) ** 2).sum(1)) for a in range(0, max(len(x), 1), STEP)])


class Part:
    """The vectors of one length that a task holds."""

    def __init__(self, model: Quantiser | None, ids: np.ndarray, x: np.ndarray, packed: np.ndarray, half: np.ndarray):
        self.model, self.ids, self.x = model, ids, x
        if model is not None:
            self.codes, self.half = packed.T.astype(np.intp), half.astype(np.float32)
            self.short = model.short(x)
            self.halves = half * model.scale**2
            self.norms = np.sqrt(2 * self.halves)
            self.far = np.flatnonzero(~(self.norms < FAR))  # their products may not fit four bytes

    def scores(self, tables: np.ndarray) -> np.ndarray:
        """Of each query and vector, by its code: inner product less half the squared length."""
        tables = np.ascontiguousarray(tables.transpose(1, 2, 0))  # a look-up serves all queries
        out = np.empty((tables.shape[2], len(self.ids)), np.float32)
        for a in range(0, len(self.ids), STEP):
            codes = self.codes[:, a : a + STEP]
            total = np.take(tables[0], codes[0], axis=0, mode="clip")
            more = np.empty_like(total)
            for values, code in zip(tables[1:], codes[1:]):
                total += np.take(values, code, axis=0, out=more, mode="clip")
            out[:, a : a + STEP] = total.T
        return np.subtract(out, self.half, out=out)

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the exact k + 1 nearest, the query's own row among them: ids and distances."""
        k += 1
        if self.model is None or len(self.ids) <= rerank:
            for i in range(len(q)):
                near = distances(self.x, q[i])
                best = nearest_first(self.ids, near, q_ids[i], k)
                yield self.ids[best], near[best]
            return
        scale, centre = self.model.scale, np.linalg.norm(self.model.centre)
        lengths = (((q - self.model.centre) * scale) ** 2).sum(1)
        slack = 1.2e-7 * (q.shape[1] + 8) * np.sqrt(lengths)  # twice what rounding to four bytes can do
        off = 1e-12 * (self.norms.max(where=self.norms < FAR, initial=0) + np.sqrt(lengths) + 4 * scale * centre)  # and centring in eight
        for a in range(0, len(q), 32):
            scores, products = self.scores(self.model.tables(q[a : a + 32])), self.model.short(q[a : a + 32]) @ self.short.T
            for i, score, product in zip(range(a, len(q)), scores, products):
                first = np.argpartition(-score, rerank)[:rerank]
                near = distances(self.x[first], q[i])
                worst = np.partition(near, k - 1)[k - 1] * (1 + 1e-9) * scale + off[i]
                rest = ~(self.halves - product - slack[i] * self.norms > (worst**2 - lengths[i]) / 2 + 1e-30)
                rest[self.far] = True
                if not lengths[i] < FAR**2:
                    rest[:] = True
                rest[first] = False
                rest = np.flatnonzero(rest)
                first, near = np.concatenate([first, rest]), np.concatenate([near, distances(self.x[rest], q[i])])
                best = nearest_first(self.ids[first], near, q_ids[i], k)
                yield self.ids[first[best]], near[best]


def nearest_first(ids: np.ndarray, near: np.ndarray, q_id: int, k: int) -> np.ndarray:
    """Places of the query's own row, if it is here, and then of the nearest, ties to the smaller id: k in all."""
    later = np.ones(len(ids), bool)
    later[np.flatnonzero((ids == q_id) & (near == 0))[:1]] = False
    return np.lexsort((ids, near, later))[:k]


def of_one_length(batch: pa.RecordBatch | pa.Table, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of vectors of one length, of BLOCK_BYTES at most: the length, the ids, the vectors."""
    column = batch.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    for d in np.unique(lengths).tolist():
        rows, step = np.flatnonzero(lengths == d), min(most, max(1, BLOCK_BYTES // (8 * d)))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            yield d, batch.column("vec_id").to_numpy()[part].astype("<i8"), column.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def shortest(x: np.ndarray) -> np.ndarray:
    """x in four bytes a component, if that is exact."""
    with np.errstate(over="ignore"):
        short = x.astype("<f4")
    return short if (short == x).all() else x


def vectors_of(x: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(x, "<f4" if len(x) == 4 * d * n else "<f8").reshape(n, d)


def sizes(blocks: DataFrame) -> tuple[int, int]:
    """Of a table of blocks: rows, bytes."""
    return tuple(blocks.agg(F.count("bytes"), F.coalesce(F.sum("bytes"), F.lit(0))).first())


def dealt(index_rows: int, index_bytes: int, query_bytes: int, n: int) -> tuple[int, int]:
    """Parts of the index, groups of queries. Both fit a task; beyond that there are up to n parts as long as
    the queries, a copy a part, take half the index's room at most."""
    parts = max(-(-index_bytes // HELD), min(n, index_bytes // (2 * max(query_bytes, 1))))
    return max(1, min(parts, index_rows)), max(1, -(-query_bytes // HELD))


def nearest_rows(data: DataFrame, queries: DataFrame, k: int, rerank: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest a query. data, queries: of usable()."""
    spark = data.sparkSession
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toArrow()
    by_length: dict[int, list] = {}
    for d, _, x in of_one_length(sample, SAMPLE):
        by_length.setdefault(d, []).append(x)
    models = {d: Quantiser(np.concatenate(x)) for d, x in by_length.items() if sum(map(len, x)) >= CENTRES}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, ids, x in of_one_length(batch, BLOCK):
                codes, half = models[d].encode(x) if d in models else (np.zeros(0, np.uint8), np.zeros(0))
                row = [v.tobytes() for v in (ids, codes, half, shortest(x))]
                yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "bytes": [sum(map(len, row))]} | {c: [v] for c, v in zip(("ids", "codes", "half", "x"), row)})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, ids, q in of_one_length(batch, QUERY_BLOCK):
                row = [v.tobytes() for v in (ids, shortest(q))]
                yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "bytes": [sum(map(len, row))]} | {c: [v] for c, v in zip(("q_ids", "q"), row)})

    blocks = data.mapInArrow(index, "d int, bytes long, ids binary, codes binary, half binary, x binary")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "codes")
    # A written block's name and a query's place in it tell queries apart that share an id.
    asked = written(queries.mapInArrow(pack, "d int, bytes long, q_ids binary, q binary").withColumn("q_block", F.monotonically_increasing_id()), "query-blocks")
    n = partitions(spark)
    parts, groups = dealt(*sizes(blocks), sizes(asked)[1], n)
    each_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    held = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).withColumn("q_part", each_of(groups))
    everywhere = asked.withColumn("q_part", F.pmod(F.xxhash64("q_block"), F.lit(groups)).cast("int")).withColumn("part", each_of(parts))
    found_schema = pa.schema([("q_block", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])

    def scan(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found_schema.empty_table()
        d = key[2].as_py()
        column = lambda c: left.column(c).to_pylist()
        ids = [np.frombuffer(v, "<i8") for v in column("ids")]
        x = np.concatenate([vectors_of(v, len(i), d) for v, i in zip(column("x"), ids)])
        packed = np.concatenate([np.frombuffer(v, np.uint8).reshape(len(i), -1) for v, i in zip(column("codes"), ids)])
        part = Part(models.get(d), np.concatenate(ids), x, packed, np.concatenate([np.frombuffer(v) for v in column("half")]))
        out = [[], [], [], [], []]
        for q_block, q_ids, q in zip(*(right.column(c).to_pylist() for c in ("q_block", "q_ids", "q"))):
            q_ids = np.frombuffer(q_ids, "<i8")
            q = vectors_of(q, len(q_ids), d).astype(np.float64)
            for place, (near_ids, near) in enumerate(part.nearest(q_ids, q, k, rerank)):
                for to, v in zip(out, (q_block, place, int(q_ids[place]), near_ids.tobytes(), near.tobytes())):
                    to.append(v)
        return pa.Table.from_pydict(dict(zip(found_schema.names, out)), schema=found_schema)

    keys = ("part", "q_part", "d")
    spread = lambda df: df.repartition(4 * parts * groups, *keys).groupBy(*keys)  # noqa: E731  so that few tasks get two
    each = spread(held).cogroup(spread(everywhere)).applyInArrow(scan, "q_block long, place int, query_id long, ids binary, scores binary")
    by_query = each.repartition(n, "q_block", "place").sortWithinPartitions("q_block", "place")
    return by_query.mapInArrow(merging(k), "query_id long, rank int, vec_id long, score double")


def merging(k: int):
    """For rows sorted by query: the nearest of all its rows but one that is the query's own. It holds one
    query's nearest so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, q_id, ids, scores = None, None, None, None

        def best():
            order = nearest_first(ids, scores, q_id, k + 1)
            own = len(order) and ids[order[0]] == q_id and scores[order[0]] == 0
            order = order[1:] if own else order[:k]
            return pa.RecordBatch.from_pydict({"query_id": pa.array(np.full(len(order), q_id)), "rank": pa.array(np.arange(1, len(order) + 1, dtype=np.int32)), "vec_id": pa.array(ids[order]), "score": pa.array(scores[order])})

        for batch in batches:
            for b, p, q, i, s in zip(*(batch.column(c).to_pylist() for c in ("q_block", "place", "query_id", "ids", "scores"))):
                i, s = np.frombuffer(i, "<i8"), np.frombuffer(s)
                if (b, p) != query:
                    if query is not None:
                        yield best()
                    query, q_id, ids, scores = (b, p), q, i, s
                else:
                    ids, scores = np.concatenate([ids, i]), np.concatenate([scores, s])
                    if len(ids) > 20 * (k + 1):
                        order = nearest_first(ids, scores, q_id, k + 1)
                        ids, scores = ids[order], scores[order]
        if query is not None:
            yield best()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, rerank: int = RERANK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest, nearest first, ties to the smaller
    vec_id; score is the Euclidean distance of the original vectors in double precision. rerank: how many
    of a part are reranked before the bound decides about the others."""
    return nearest_rows(usable(vectors), usable(queries), k, max(rerank, 4 * k + 1))
