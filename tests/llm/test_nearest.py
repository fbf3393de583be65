"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import nearest, queries


def brute(ids, x, q):
    out = {}
    for i in q:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:10]
    return out


def test_recall_and_scores(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    want, got = brute(ids, x, np.flatnonzero(ids % 100 == 0)), {}
    for r in queries.op3_nearest(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, len(near) + 1))
        assert [s for *_, s in mine] == sorted(s for *_, s in mine)
        at = {int(i): k for k, i in enumerate(ids)}
        for _, v, s in mine:
            assert abs(s - np.sqrt(((x[at[v]] - x[at[q]]) ** 2).sum())) < 1e-9
        hits += len({v for v, _ in near} & {v for _, v, _ in mine})
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(40)]
    rows += [(i, rows[7][1]) for i in range(100, 160)]  # copies, ties to the smaller id
    good = list(rows)
    rows += [(200, None), (201, [0.0] * 5), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame([(a, b, 1, 2.0, "p") for a, b in rows], "vec_id long, embedding array<float>, rank int, score double, part string")
    got = {}
    for r in nearest.search(df, df.where("vec_id in (3, 7, 200, 201, 202)")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    ids, x = np.array([a for a, _ in good]), np.array([b for _, b in good], np.float32).astype(float)
    want = brute(ids, x, [3, 7])
    assert {q: [v for _, v in sorted(n)] for q, n in got.items()} == {q: [v for v, _ in n] for q, n in want.items()}
    few = df.where("vec_id in (1, 2, 3)")
    assert nearest.search(few, few).count() == 6
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0 == nearest.search(df, df.limit(0)).count()


def test_anisotropic_codes_favour_the_parallel_part():
    """Against codes of the plain loss, the residual along the vector is smaller."""
    x = np.random.default_rng(1).normal(size=(2000, 16))
    along = []
    for eta in (1.0, 4.0):
        nearest.ETA = eta
        model = nearest.Quantiser(x)
        packed, _ = model.encode(x)
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(x), -1)[:, : model.subs]
        y = np.concatenate([model.books[s][codes[:, s]] for s in range(model.subs)], 1)
        centred = x - model.centre
        along.append(np.abs(((centred - y) * centred).sum(1) / np.linalg.norm(centred, axis=1)).mean())
    assert along[1] < 0.8 * along[0]
