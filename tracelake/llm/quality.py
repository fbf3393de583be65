"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1 in the training fold; the fold as a whole, whatever its labels,
is the unlabelled web text. A small network minimises the non-negative unbiased risk

    prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))

where the class prior is estimated from the same two samples. A network that tells positives from
unlabelled text is fitted on one half of them and scores the other half. Above any cut lies a share a of
the unlabelled and a share b of the positives; since the unlabelled share holds prior * b positives at
least, a / b bounds the prior, and the least such bound (with its margin of chance) is the estimate. No
negative label is read. A prior that is a little low leaves the best decision as it is, while one that is
too high makes the negative risk meaningless; so half the margin is taken off.

Features describe a text's make-up (bytes, words, lines), computed over the whole text; labels, lang,
source and doc_id are no inputs. The model is fitted on at most SAMPLE positive and SAMPLE unlabelled
rows, those whose ids hash lowest, however many rows repeat an id; every document is scored.

Null text is the empty text and is scored as such. A null doc_id counts as the id "" and is held out.
Repeated rows are scored one by one; a document with several labels is positive if one of them is 1.
Without a positive document in the fold there is nothing to learn: every score is the prior's guess, 0.5.
An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import id_crc, texts
from tracelake.llm.tokens import slices

SAMPLE = 15_000
THRESHOLD = 0.3


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


CLASSES = np.stack([_set(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!?", ";:", "\"'()", "|", "#*$%&@^~", "<>[]{}=+/\\_`", "-")] + [np.r_[np.zeros(128, np.int64), np.ones(128, np.int64)]], axis=1)
BLANK, MARK = _set(" \t\n\r\x0b\x0c").astype(bool), _set("#*$%&@^~|<>[]{}=+/\\_`!").astype(bool)
N_FEATURES = CLASSES.shape[1] + 11


def features(text: str) -> list[float]:
    data = text.encode()
    size = len(data)
    if not size:
        return [0.0] * N_FEATURES
    each = np.frombuffer(data, np.uint8)
    shares = np.bincount(each, minlength=256) @ CLASSES / size
    words = data.split()
    n = max(len(words), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    blank, mark = BLANK[each], MARK[each]
    ends = float((mark[:-1] & blank[1:]).sum() + mark[-1]) / n
    again = sum(map(eq, words, words[1:])) / n
    upper = float(((each[1:] - 65 < 26) & (blank[:-1])).sum()) / n
    return [*shares.tolist(), np.log1p(size), np.log1p(n), len(counts) / n, len(counts) / n**0.75, top / n, again, ends, upper, lengths.mean() / 10, lengths.std() / 10, 1 - len(set(lines)) / max(len(lines), 1)]


class Model:
    """One hidden layer; scores are probabilities of label 1."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 24, steps: int = 800, batch: int = 4096, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk by Adam. The loss is the sigmoid loss, which is bounded:
    with it a batch's estimate of the negative risk is steady, also where the prior is high. Without a
    prior it tells positives from unlabelled rows, both weighing the same."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    d = every.shape[1]
    weights = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for step in range(1, steps + 1):
        n, m = min(batch, len(p)), min(batch, len(u))
        x = np.concatenate([p[rng.integers(0, len(p), n)], u[rng.integers(0, len(u), m)]])
        a, b, c, e = weights
        h = np.tanh(x @ a + b)
        y = 1 / (1 + np.exp(-np.clip(h @ c + e, -30, 30)))  # also the loss as a negative; 1 - y as a positive
        slope = y * (1 - y)
        if prior is None:
            g = np.concatenate([-slope[:n] / n, slope[n:] / m])
        elif y[n:].mean() - prior * y[:n].mean() >= 0:
            g = np.concatenate([-2 * prior * slope[:n] / n, slope[n:] / m])
        else:  # the negative risk must not fall further: walk it back
            g = np.concatenate([prior * slope[:n] / n, -slope[n:] / m])
        gh = np.outer(g, c) * (1 - h * h)
        grads = [x.T @ gh + decay * a, gh.sum(0), h.T @ g + decay * c, np.array([g.sum()])]
        now = rate * (1 - step / (steps + 1))
        for w, grad, moment in zip(weights, grads, moments):
            moment[0][:] = 0.9 * moment[0] + 0.1 * grad
            moment[1][:] = 0.999 * moment[1] + 0.001 * grad * grad
            w -= now * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, weights)


def held_out():
    return (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out")


def _sampled(docs: DataFrame, ids: DataFrame, sample: int) -> np.ndarray:
    """Features of at most `sample` rows, by the hash of their ids."""
    chosen = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id", "left_semi")  # at most `sample` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array(x, pa.list_(pa.float32()))})

    # Rows that repeat an id may be more than the ids: what reaches the driver is bounded by rows.
    every = rows.mapInArrow(run, "doc_id long, x array<float>")
    got = every.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toArrow()
    return np.array(got.column("x").to_pylist(), np.float64).reshape(-1, N_FEATURES)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learned from the training fold alone; None where it has no positive document."""
    positive = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out())
    fold = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(~held_out())
    p = _sampled(docs, fold.join(positive, "doc_id", "left_semi"), sample)
    if not len(p):
        return None
    u = _sampled(docs, fold, sample)
    return fit(p, u, estimated_prior(p, u))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 3) -> float:
    """The share of positives among the unlabelled, from these two samples alone. Each half is scored by
    a network fitted on the other; the least bound over all cuts that leave a twentieth of the positives
    above them, less half its margin."""
    rng = np.random.default_rng(seed)
    p, u = (x[rng.permutation(len(x))] for x in (positive, unlabelled))
    if min(len(p), len(u)) < 20:
        return 0.5
    ps, us = np.empty(len(p)), np.empty(len(u))
    for k in (0, 1):
        model = fit(p[k::2], u[k::2], None, steps=300)
        ps[1 - k :: 2], us[1 - k :: 2] = model.logits(p[1 - k :: 2]), model.logits(u[1 - k :: 2])
    cuts = np.sort(ps)[: -max(1, len(ps) // 20)]
    above_p = 1 - np.searchsorted(np.sort(ps), cuts, "left") / len(ps)
    above_u = 1 - np.searchsorted(np.sort(us), cuts, "left") / len(us)
    margin = (np.sqrt(np.log(20) / (2 * len(us))) + np.sqrt(np.log(20) / (2 * len(ps)))) / above_p
    best = (above_u / above_p + margin).argmin()
    return float(np.clip(above_u[best] / above_p[best] - margin[best] / 2, 0.02, 0.98))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3, else 0), a row a document."""
    model = learn(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float64)
            y = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": y})

    return texts(docs).mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those predicted 0; the schema and all columns stay."""
    model = learn(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t or "") for t in batch.column("text").to_pylist()], np.float64)
            y = model.scores(x) if model else np.full(len(x), 0.5)
            yield batch.filter(pa.array(y >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
