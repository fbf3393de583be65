"""Nearest neighbours behind many copies of one vector, and in several blocks."""

import numpy as np
import pytest

from tracelake.llm import nearest


def brute(ids, x, i, k=10):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    return [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]


@pytest.mark.parametrize("clusters", [0, 20])
def test_copies_hide_no_neighbour(spark, clusters):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    if clusters:
        x = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 6000)] + 0.05 * x
    hot = x[0].copy()
    x[rng.choice(np.arange(100, 6000), 2000, replace=False)] = hot
    asked = list(range(10))
    for i in asked:  # a query, and ten neighbours that are nearer than the hot vector
        x[i] = hot + 0.5 * rng.normal(size=32)
        x[100 + 10 * i : 110 + 10 * i] = x[i] + 0.45 * rng.normal(size=(10, 32))
    x, ids = x.astype(np.float32).astype(float), rng.permutation(6000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in nearest.search(df, df.where(df.vec_id.isin([int(ids[i]) for i in asked]))).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(n)] for q, n in got.items()} == {int(ids[i]): brute(ids, x, i) for i in asked}


def test_repeated_ids_and_other_lengths(spark):
    """Each query row has ranks of its own; rows that share its id are candidates, its own row is not."""
    rng = np.random.default_rng(6)
    rows = [(i % 30, rng.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    rows += [rows[0]] * 15 + [(40 + i, rows[0][1]) for i in range(15)] + [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = [(i, v) for i, v in rows if i in (0, 2)]
    want = []
    for q, v in asked:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if len(x) == len(v))
        near.remove((0.0, q))
        want.append((q, tuple((r + 1, i) for r, (_, i) in enumerate(near[:10]))))
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.search(df, df.where("vec_id in (0, 2)")).collect()]
    assert sorted(got) == sorted((q, r, i) for q, near in want for r, i in near)
