"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are read in windows of WINDOW bytes. Each byte is an embedding; filters of several
widths run over a window, the largest value of each filter is kept, and a softmax over the languages
follows. The network is trained in numpy on labelled texts. A text's prediction sums the windows'
log-probabilities, weighted by their bytes, over the whole text.

Training takes windows of at most SAMPLE rows a language, those whose id and text hash lowest, from rows
with a language and crc32(doc_id as text) mod 4 other than 2 (a null doc_id counts as the id ""). Languages
are what these rows name. A language's windows are spread over its rows, more of each row where rows are
few; all languages share a budget of WINDOWS windows, and weigh the same in training. Windows of under
16 bytes count only for a language that has few others. lang, source and doc_id are no inputs of a
prediction.

`und` with score 0 is the answer for null text, text without a letter (number signs such as "½" are none),
and where nothing could be learned. Repeated rows are predicted one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import id_crc
from tracelake.llm.tokens import slices

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 12
SAMPLE, TRAIN_WINDOWS, WINDOWS = 1500, 6000, 60_000
# Parts that a language is dealt over, and the most bytes of a broadcast side.
SALTS, MOST_BROADCAST = 256, 8 << 20
PAD = 256
PLACES = WINDOW - max(WIDTHS) + 1  # of every filter in a window


class Network:
    """Parameters: an embedding of 257 symbols, a filter bank for each width, the softmax layer."""

    def __init__(self, n_langs: int, rng: np.random.Generator):
        self.embedding = rng.normal(0, 0.3, (257, EMBEDDING)).astype(np.float32)
        self.banks = [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n_langs)).astype(np.float32)
        self.shift = np.zeros(n_langs, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.banks, *self.biases, self.out, self.shift]

    def tables(self) -> list[np.ndarray]:
        """What a byte k places into a filter adds to the filter's value, for each k and symbol; filters by
        falling k come last, so a table for k has the columns of the filters that are wider than k."""
        return [np.concatenate([self.embedding @ bank[k * EMBEDDING : (k + 1) * EMBEDDING] for w, bank in zip(WIDTHS, self.banks) if w > k], 1) for k in range(max(WIDTHS))]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """The filters' largest values in each window (windows of symbols, PAD behind a text's end)."""
        tables, bias, out = self.tables(), np.concatenate(self.biases), []
        for a in range(0, len(windows), 16):  # as many as the processor's cache holds
            part = windows[a : a + 16]
            value = tables[0].take(part[:, :PLACES], 0)
            for k in range(1, len(tables)):
                value[:, :, value.shape[2] - tables[k].shape[1] :] += tables[k].take(part[:, k : k + PLACES], 0)
            out.append(value.max(1))
        return np.maximum(np.concatenate(out) + bias, 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.out + self.shift
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, rows = len(windows), np.arange(len(windows))
        x, parts, where = self.embedding[windows], [], []
        for w, bank, bias in zip(WIDTHS, self.banks, self.biases):
            view = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(n, windows.shape[1] - w + 1, -1)[:, :PLACES]
            value = view @ bank
            at = value.argmax(1)
            parts.append(np.take_along_axis(value, at[:, None], 1)[:, 0] + bias)
            where.append((view, at))
        raw = np.concatenate(parts, 1)
        pooled = np.maximum(raw, 0)
        z = pooled @ self.out + self.shift
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[rows, y] -= 1
        p /= n
        below = (p @ self.out.T) * (raw > 0)
        g_embedding, g_banks, g_biases = np.zeros_like(self.embedding), [], []
        for i, (w, bank) in enumerate(zip(WIDTHS, self.banks)):
            g = below[:, i * FILTERS : (i + 1) * FILTERS]
            view, at = where[i]
            best = view[rows[:, None], at]  # (n, filters, w * embedding)
            g_banks.append(np.einsum("nf,nfe->ef", g, best))
            g_biases.append(g.sum(0))
            back = np.einsum("nf,ef->nfe", g, bank).reshape(n, FILTERS, w, EMBEDDING)
            for k in range(w):
                np.add.at(g_embedding, windows[rows[:, None], at + k], back[:, :, k])
        return [g_embedding, *g_banks, *g_biases, pooled.T @ p, p.sum(0)]


def windows_of(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def train(windows: np.ndarray, y: np.ndarray, n_langs: int, steps: int = 1200, batch: int = 64, rate: float = 0.004, seed: int = 11) -> Network:
    """Adam on the softmax loss, over the windows again and again; rarer languages' windows come oftener."""
    rng = np.random.default_rng(seed)
    net, step = Network(n_langs, rng), 0
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.parameters()]
    order, counts = np.zeros(0, int), np.bincount(y, minlength=n_langs)
    places = np.concatenate([np.resize(np.flatnonzero(y == k), counts.max()) for k in range(n_langs) if counts[k]])
    while step < steps:
        order, step = (order if len(order) >= batch else np.concatenate([order, *(rng.permutation(places) for _ in range(1 + batch // len(places)))])), step + 1
        part, order = order[:batch], order[batch:]
        now = rate * (1 - step / (steps + 1))
        for w, g, (m, v) in zip(net.parameters(), net.gradients(windows[part].astype(np.int64), y[part]), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def held_out():
    return (id_crc(F.col("doc_id")) % 4 == 2).alias("held_out")


def _lowest(rows: DataFrame, sample: int, *order: str) -> DataFrame:
    """The `sample` lowest rows of each language, with place. Each language is first dealt over SALTS parts,
    which keep their own lowest, so no task reads all rows of a hot language."""
    over = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    parts = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    few = parts.withColumn("place", over("lang", "salt")).where(F.col("place") <= sample).drop("salt", "place")
    return few.withColumn("place", over("lang")).where(F.col("place") <= sample)


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[Network | None, list[str]]:
    """The network and its languages, in alphabetical order."""
    fold = docs.where("lang is not null and text is not null").where(~held_out())
    rows = fold.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = fold.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n"))
    known = {r["lang"]: r["n"] for r in counts.collect()}
    langs = sorted(known)
    if not langs:
        return None, langs
    windows = max(1, min(TRAIN_WINDOWS, WINDOWS // len(langs)))
    sample = min(sample, windows)
    # The hash up to which a language's rows are taken: its sample-th lowest. What ties there is cut below.
    lowest = _lowest(rows.select("lang", "h"), sample, "h")
    bounds = counts.join(lowest.groupBy("lang").agg(F.max("h").alias("bound")), "lang")
    # A row a language, counted above: broadcast, so that texts need no shuffle, unless there are too many.
    near = rows.join(F.broadcast(bounds) if sum(24 + len(x.encode()) for x in langs) <= MOST_BROADCAST else bounds, "lang").where(F.col("h") <= F.col("bound"))
    chosen = near.withColumn("per", F.greatest(F.lit(1), F.lit(windows) / F.least("n", F.lit(sample))).cast("int"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = []
            for text, per in zip(batch.column("text").to_pylist(), batch.column("per").to_pylist()):
                every = windows_of(text.encode())
                kept.append(every[np.unique(np.linspace(0, len(every) - 1, per).astype(int))].astype("<i2").tobytes())
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "h": batch.column("h"), "w": pa.array(kept, pa.binary())})

    picked = chosen.select("lang", "text", "h", "per").mapInArrow(pick, "lang string, h long, w binary")
    table = _lowest(picked, sample, "h", "w").select("lang", "w", "place").toArrow().sort_by([("lang", "ascending"), ("place", "ascending")])
    parts = [np.frombuffer(w, "<i2").reshape(-1, WINDOW) for w in table.column("w").to_pylist()]
    if not parts:
        return None, langs
    y = np.repeat([langs.index(x) for x in table.column("lang").to_pylist()], [len(x) for x in parts])
    x = np.concatenate(parts)
    full = (x != PAD).sum(1) >= 16
    full |= np.bincount(y, full, len(langs))[y] < 8
    return train(x[full], y[full], len(langs)), langs


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the languages' softmax over the text's mean log-probability)."""
    net, langs = learn(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=500_000):
            texts = batch.column("text").to_pylist()
            known = [i for i, x in enumerate(texts) if net is not None and x and any(map(str.isalpha, x))]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                parts = [windows_of(texts[i].encode()) for i in known]
                n = np.array([len(x) for x in parts])
                every = np.concatenate(parts)
                logs = net.log_probabilities(every.astype(np.intp))
                weight = (every != PAD).sum(1)[:, None].astype(np.float64)
                starts = np.cumsum(n) - n
                mean = np.add.reduceat(logs * weight, starts) / np.add.reduceat(weight, starts)
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, row in zip(known, p):
                    pred[i], score[i] = langs[int(row.argmax())], float(row.max())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pred, "score": score})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out(), "lang_pred", "score")
