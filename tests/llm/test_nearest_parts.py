"""Nearest neighbours where queries meet many parts of the index, and where four bytes hold too little."""

import numpy as np
import pytest

from tracelake.llm import nearest


@pytest.fixture
def conf(spark):
    changed = {}

    def put(key, value):
        changed.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def frame(spark, ids, x, kind="float"):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], f"vec_id long, embedding array<{kind}>").repartition(3)


def check(df, ids, x, asked):
    got = {}
    for r in nearest.search(df, df.where(df.vec_id.isin([int(ids[i]) for i in asked]))).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if j != i][:10]
        assert [(v, s) for _, v, s in sorted(got[int(ids[i])])] == want


def test_many_partitions_repeat_no_queries_in_the_driver(spark, conf):
    """A small table of queries, a copy a partition, was broadcast."""
    conf("spark.sql.maxBroadcastTableSize", "4m")
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32)).astype(np.float32).astype(float)
    ids = np.arange(3000)
    df = frame(spark, ids, x)
    conf("spark.sql.shuffle.partitions", "400")
    check(df, ids, x, range(300))


def test_copies_of_queries_take_half_the_room_of_the_index():
    assert nearest.dealt(index_rows=352, index_bytes=207_000_000, query_bytes=1_900_000, n=28) == (28, 1)
    for n in (200, 10_000):
        parts, groups = nearest.dealt(index_rows=352, index_bytes=207_000_000, query_bytes=1_900_000, n=n)
        assert groups == 1 and parts * 1_900_000 <= 207_000_000 / 2
    parts, groups = nearest.dealt(index_rows=10**6, index_bytes=10**10, query_bytes=10**9, n=200)
    assert 10**10 / parts <= nearest.HELD and 10**9 / groups <= nearest.HELD
    assert nearest.dealt(0, 0, 0, 200) == (1, 1)


@pytest.mark.parametrize("case", ["plain", "far from zero", "outliers", "tiny", "huge", "copies", "eight bytes"])
def test_parts_and_groups_lose_nothing(spark, monkeypatch, case):
    monkeypatch.setattr(nearest, "HELD", 60_000)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 7)
    monkeypatch.setattr(nearest, "BLOCK", 400)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 9))
    x += {"far from zero": 1e6}.get(case, 0)
    x *= {"tiny": 1e-160, "huge": 1e140}.get(case, 1)
    if case == "outliers":
        x[5:20] *= np.logspace(3, 160, 15)[:, None]
        x[20:25] = 1e150 + rng.normal(size=(5, 9))
    if case == "copies":
        x[rng.choice(3000, 1500, replace=False)] = x[0]
    if case not in ("eight bytes", "tiny", "huge", "outliers", "far from zero"):
        x = x.astype(np.float32).astype(float)
    ids = rng.permutation(3000)
    check(frame(spark, ids, x, "double"), ids, x, [*range(0, 60), 500, 2999])
