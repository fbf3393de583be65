"""Quality and language: held-out accuracy, inputs that must not matter, odd rows."""

import zlib

import numpy as np
import pytest

from tracelake.llm import language, quality

ODD = "doc_id long, text string, lang string, source string, score string, x string, h string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "Der die und the.", "de"), (1, None, "en"), (2, "", None), (3, "1234 !!", "fr"), (4, "The and of that " * 9000, "en"), (5, "dup dup", None), (5, "dup dup", None)]
    return spark.createDataFrame([(*r, None, "s", "x", "h") for r in rows], ODD)


def test_quality_held_out(spark, docs, labels):
    rows = quality.score(docs, labels).collect()
    assert len(rows) == docs.count()
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    tested = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert sum(p == y for p, y in tested) >= 0.8 * len(tested)  # of some twenty


def test_quality_odd_rows(spark, docs, labels, odd):
    rows = quality.score(odd.unionByName(docs.withColumns({c: docs.lang for c in ("score", "x", "h")}).drop("n_chars")), labels).collect()
    assert len([r for r in rows if r.doc_id is None]) == 1 and next(r for r in rows if r.doc_id is None).held_out
    kept = quality.keep_good(odd, labels)
    assert kept.schema == odd.schema
    none = labels.limit(0)
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(odd.limit(0), labels).count() == 0 == quality.keep_good(odd.limit(0), labels).count()


def test_risk_is_learned_without_negatives():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1.5, 1, (2000, 4)), rng.normal(-1.5, 1, (2000, 4))
    u = np.concatenate([p[:1400], n[:600]])
    model = quality.fit(p[1400:], u, 0.7, steps=800)
    right = np.concatenate([model.scores(p) >= 0.5, model.scores(n) < 0.5])
    assert right.mean() > 0.97


def test_language_held_out(spark, docs):
    rows = language.predict(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(tested) >= 0.95 * len(tested)


def test_language_odd_rows(spark, odd):
    got = {(r.doc_id, r.lang_pred) for r in language.predict(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(got) == 6
    assert language.predict(odd.limit(0)).count() == 0
    unknown = odd.withColumn("lang", odd.h.substr(9, 1)).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.predict(unknown).collect()} == {"und"}


def test_gradients():
    """Against finite differences."""
    rng = np.random.default_rng(1)
    net = language.Network(3, rng)
    for w in net.parameters():
        w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    x, y = rng.integers(0, 257, (5, language.WINDOW)), np.array([0, 1, 2, 1, 0])
    loss = lambda: -float(np.mean(net.log_probabilities(x)[np.arange(5), y].astype(np.float64)))
    for w, g in zip(net.parameters(), net.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = w[at]
        w[at] = kept + 1e-2
        up = loss()
        w[at] = kept - 1e-2
        down = loss()
        w[at] = kept
        assert abs((up - down) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.75):
        n = 6000
        u = np.where(rng.random((n, 1)) < share, rng.normal(2, 1, (n, 5)), rng.normal(-2, 1, (n, 5)))
        assert share - 0.1 < quality.estimated_prior(rng.normal(2, 1, (n, 5)), u) < share + 0.03


def test_one_id_on_many_rows_stays_within_the_sample(spark, labels):
    good = labels.where("quality = 1").collect()
    one = next(r.doc_id for r in good if zlib.crc32(str(r.doc_id).encode()) % 5)
    docs = spark.range(20_000).selectExpr(f"{one}L AS doc_id", "concat('text ', id) AS text", "'en' AS lang")
    ids = docs.select("doc_id")
    assert len(quality._sampled(docs, ids, 10)) == 10


def test_language_learns_from_null_ids_and_rare_short_texts(spark, docs, monkeypatch):
    seen = {}
    real = language.train
    monkeypatch.setattr(language, "train", lambda x, y, n: seen.update(n=len(x)) or real(x, y, n, steps=150))
    nameless = docs.selectExpr("cast(null as long) doc_id", "text", "lang")
    rare = spark.createDataFrame([(1, "这是", "zh"), (3, "中文字", "zh")], "doc_id long, text string, lang string")
    got = language.predict(nameless.unionByName(rare)).collect()
    assert {r.lang_pred for r in got if r.doc_id is not None} == {"zh"}
    known = [r.lang_pred for r in got if r.doc_id is None]
    assert len(set(known)) >= 4 and seen["n"] <= language.WINDOWS + 5 * language.SAMPLE
    numbers = spark.createDataFrame([(5, "½ ²", None), (6, "Ⅷ ①", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict(rare.unionByName(numbers)).where("doc_id in (5, 6)").collect()} == {"und"}


def test_language_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(language, "train", lambda x, y, n: seen.update(n=len(x)))
    docs = spark.range(20_000).selectExpr("1L AS doc_id", "'one and the same text of some length' AS text", "'en' AS lang")
    language.learn(docs, 10)
    assert 0 < seen["n"] <= 10 * max(1, language.TRAIN_WINDOWS // 10)
