"""Exact dedup and SimHash groups against brute force."""

import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import exact_dedup, queries, simhash
from tracelake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, key long, h long, fp long, bucket int, kept boolean, node string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n", "a b  c", "ab c", "A b c", "a\tb\x0bc\x0c ", "a bc", "long " * 20000, "long" * 20000, "a b c", None]
    rows = [(None if i in (9, 11) else i, t, "en", i, i, i, i, True, "n") for i, t in enumerate(texts)]
    rows += [(10, "a b c", "fr", 0, 0, 0, 0, False, "m"), (3, "a b  c", "en", 3, 3, 3, 3, True, "n")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_decisions(spark, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t), d is None, d))
    got = exact_dedup.decisions(docs, capacity=2).collect()
    assert len(got) == len(rows)
    by_sha = {}
    for r in got:
        by_sha.setdefault(r.text_sha256, []).append(r)
    assert len(by_sha) == len(groups)
    import hashlib

    for t, members in groups.items():
        found = by_sha[hashlib.sha256(t.encode()).hexdigest()]
        assert {r.group_size for r in found} == {len(members)} and {r.keep_id for r in found} == {min(members)[2]}
        assert sum(r.kept for r in found) == 1
    assert {r.chain for r in got} == {0}


def test_keep_one(spark, docs):
    kept = exact_dedup.keep_one(docs, capacity=2)
    assert kept.columns == docs.columns
    want = {(r.doc_id, r.text_sha256) for r in exact_dedup.decisions(docs).where("kept").collect()}
    assert kept.count() == len(want) == 5


def test_directory_doubles(spark):
    keys = spark.range(20000).select(F.xxhash64("id").alias("key"))
    for leading in (16, 3):  # also where the counted bits are too few
        depths = exact_dedup.directory(keys, capacity=500, leading=leading)
        assert len(depths) & (len(depths) - 1) == 0
        loads = keys.groupBy(exact_dedup.bucket_of("key", depths).alias("b")).count().collect()
        assert sum(r["count"] for r in loads) == 20000 and max(r["count"] for r in loads) <= 500
        # a bucket's number names its depth and its keys' first bits
        top = keys.select(exact_dedup.bucket_of("key", depths).alias("b"), "key").collect()
        assert all(r.b == (1 << (d := r.b.bit_length() - 1)) + ((r.key & 2**64 - 1) >> 64 - d) for r in top)
    assert exact_dedup.directory(keys.limit(10)) == [0] == exact_dedup.directory(keys.limit(0))


def test_index_on_files(spark, docs, tmp_path):
    """Buckets are folders, the directory is stored, and a lookup opens only the buckets it needs."""
    many = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id % 300) AS text")
    counts = exact_dedup.entries_of(many).groupBy("key").agg(F.count("*").alias("n"))
    made = exact_dedup.build_index(many, counts, f"file://{tmp_path}/index", capacity=20)
    index = exact_dedup.Index.at(spark, made.path)
    assert index.depths == made.depths and index.entries().count() == 300
    files = {f.rpartition("/")[0] for f in index.entries().inputFiles()}
    assert len(files) == index.entries().select("bucket").distinct().count() >= 15
    asked = spark.createDataFrame([(1, "text7"), (2, "te xt 7"), (3, "unknown"), (4, None)], "doc_id long, text string")
    found = exact_dedup.lookup(asked, index)
    assert sorted((r.doc_id, r.group_size, r.keep_id) for r in found.collect()) == [(1, 2, 7), (2, 2, 7), (3, None, None), (4, None, None)]
    assert "PartitionFilters: [isnotnull(bucket" in found._jdf.queryExecution().executedPlan().toString() or "bucket#" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1].split("]")[0]


def test_hot_keys_and_extreme_ids(spark):
    rows = [(i, "hot copy", 0) for i in range(3000)] + [(-(2**63), "low", 0), (2**63 - 1, "low", 0), (None, "low", 0)]
    got = exact_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5), hot=100).collect()
    assert len(got) == 3003 and {(r.keep_id, r.group_size) for r in got} == {(0, 3000), (-(2**63), 3)} and sum(r.kept for r in got) == 2


def test_colliding_keys_chain(spark, monkeypatch):
    """With a key that maps all texts to two values, bytes alone tell them apart."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(F.length(*c) % 2))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "a a", "c", "d", "c "])], "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup.decisions(docs).collect()}
    assert {k: r.keep_id for k, r in got.items()} == {0: 2, 1: 1, 2: 2, 3: 5, 4: 4, 5: 5}
    assert {got[i].chain for i in (0, 1)} == {0, 1}


def test_native(spark, docs):
    plan = exact_dedup.decisions(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op4_like_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.op4_exact_dedup(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(queries.OP4_SQL).fetchall())


# SimHash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for t in ["", "\n ", "One", "one two three", "ONE two\tthree\x0bfour", "é É   x y z É", "word " * 3000, "a b c d e f g h i j k " * 7]:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def test_triples_cover():
    triples = simhash.byte_triples()
    assert len(set(triples)) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


@pytest.mark.parametrize("chunk,short,many", [(8192, 32, 10**9), (60, 4, 10**9), (12, 4, 10**9), (8192, 32, 0)])
def test_near_links(spark, monkeypatch, chunk, short, many):
    """A tight cluster makes long lists; small bounds make them be dealt out in chunk pairs."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "SHORT", short)
    monkeypatch.setattr(simhash, "MANY", many)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [base]
    for n in range(1, 7):  # up to six flipped bits
        flips = np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (n, 60)).astype(np.uint64), 0)
        fps.append(base[rng.integers(0, 40, 60)] ^ flips)
    near = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    fps = np.unique(np.concatenate([*fps, near, np.zeros(1, np.uint64)]))
    links = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ a) <= 4]]
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = [(r.a & 2**64 - 1, r.b & 2**64 - 1) for r in simhash.near_links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    nodes = list(map(int, fps))
    assert brute_components(nodes, got) == brute_components(nodes, links)


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + (i * 37) % 50, 100 + ((i + 1) * 37) % 50) for i in range(49)] + [(200, x) for x in range(201, 260)] + [(5, 5), (None, 3)] + [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(60)]
    df = spark.createDataFrame(links, "a long, b long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = sorted({x for p in real for x in p})
    assert {r.node: r.root for r in components(df).collect()} == brute_components(nodes, real)
    assert components(df.limit(0)).count() == 0


def test_groups(spark, docs, sf):
    for table in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r.doc_id, brute_fingerprint(r.text or "")) for r in table.collect()]
        fps = sorted({f for _, f in rows})
        root = brute_components(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4])
        least = {}
        for d, f in rows:
            least.setdefault(root[f], []).append(d)
        want = sorted(((d, f, min((x for x in least[root[f]] if x is not None), default=None)) for d, f in rows), key=repr)
        got = sorted(((r.doc_id, r.fp & 2**64 - 1, r.component_id) for r in simhash.groups(table).collect()), key=repr)
        assert got == want


def test_keep_one_of_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {r.component_id for r in simhash.groups(docs).collect()}


def test_empty(spark, docs):
    none = docs.limit(0)
    assert exact_dedup.decisions(none).count() == exact_dedup.keep_one(none).count() == 0
    assert simhash.groups(none).count() == simhash.keep_one(none).count() == 0
