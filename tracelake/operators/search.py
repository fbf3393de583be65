"""Search: literal, ranked phrase, bounded substring, semantic, hybrid, top hits a session, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.errors import EngineError
from tracelake.functions.predicates import ascii_lower

# Okapi BM25's usual constants, the RRF constant, the bounds of short searches.
K1, B, RRF, SHORT_SCAN = 1.2, 0.75, 60, 10_000


def phrase_length(text: str) -> Column:
    """A text's length in trigrams, repeats included."""
    return F.greatest(F.length(text) - 2, F.lit(0)).cast("double")


def bm25(text: Column, phrase: str, n: Column, mean: Column, hits: Column) -> Column:
    """The score of a text that holds the lower-case phrase, among n texts of `mean` trigrams of which `hits` hold it."""
    low = F.lower(text)
    tf = ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("double")
    length = F.greatest(F.length(text) - 2, F.lit(0)).cast("double")
    idf = F.greatest(F.log((n - hits + 0.5) / (hits + 0.5)), F.lit(1e-6))
    return -(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)))


def phrase_hits(df: DataFrame, text: str, phrase: str) -> DataFrame:
    """Rows that hold the phrase (three characters or more, any case) with `score`: BM25 over character
    trigrams, negated so that lower is better. The corpus's figures are a scalar subquery: one row."""
    if len(phrase) < 3:
        raise EngineError("invalid_parameter", "a ranked phrase has three characters or more")
    q = phrase.lower()
    found = F.coalesce(F.lower(F.col(text)).contains(q), F.lit(False))
    stats = df.agg(F.count("*").cast("double").alias("n"), F.avg(phrase_length(text)).alias("mean"), F.count_if(found).cast("double").alias("hits"))
    one = lambda c: stats.select(c).scalar()
    return df.where(found).withColumn("score", bm25(F.col(text), q, one("n"), one("mean"), one("hits")))


def short_hits(df: DataFrame, text: str, query: str, seq: str) -> DataFrame:
    """One or two characters: tested on the newest 10,000 rows only, which is this search's contract."""
    newest = df.orderBy(F.desc(seq)).limit(SHORT_SCAN)
    return newest.where(F.instr(ascii_lower(text), query.lower()) > 0)


def is_partial(df: DataFrame) -> bool:
    """Whether a short search over df leaves older rows untested."""
    return df.limit(SHORT_SCAN + 1).count() > SHORT_SCAN


def cosine(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of numbers, in double precision; null for a zero vector."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def semantic_hits(df: DataFrame, vector: str, query: list[float], k: int, identity: str) -> DataFrame:
    """The k rows nearest by cosine, with `similarity`; ties to the smaller identity. Exact: one scan."""
    scored = df.withColumn("similarity", cosine(vector, F.lit([float(x) for x in query])))
    return scored.where(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), identity).limit(k)


def fused(text_hits: DataFrame, vector_hits: DataFrame, chunk: str, text_order: list[Column], vector_order: list[Column], depth: int) -> DataFrame:
    """Reciprocal rank fusion of the first `depth` of either side: score is the sum of 1 / (60 + rank);
    a side that lacks the chunk adds nothing. Order: score, best rank, chunk."""
    ranked = lambda df, order, name: df.orderBy(*order).limit(depth).select(chunk, F.row_number().over(Window.orderBy(*order)).cast("long").alias(name))
    met = ranked(text_hits, text_order, "text_rank").join(ranked(vector_hits, vector_order, "vector_rank"), chunk, "full")
    part = lambda name: F.coalesce(1 / (RRF + F.col(name)), F.lit(0.0))
    return met.withColumn("score", part("text_rank") + part("vector_rank")).withColumn("best_rank", F.least("text_rank", "vector_rank"))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int = 3, name: str = "hit") -> DataFrame:
    """The first k rows of each group. Spark keeps k a group in every task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn(name, place.cast("long")).where(F.col(name) <= k)


def chunks(df: DataFrame, text: str, size: int = 768, overlap: int = 96) -> DataFrame:
    """A row a window of `size` words that overlaps the last by `overlap`: chunk_no, start, n_words, chunk.
    A text of no word has no chunk; a chunk never crosses its row."""
    words, step = F.filter(F.split(text, r"\s+"), lambda w: w != ""), size - overlap
    last = F.greatest(F.ceil((F.size(words) - overlap) / step).cast("int") - 1, F.lit(0))

    def window(i: Column) -> Column:  # the words are cut before rows are made, so no row carries them all
        part = F.slice(words, i * step + 1, F.lit(size))
        return F.struct(i.alias("chunk_no"), (i * step).alias("start"), F.size(part).alias("n_words"), F.concat_ws(" ", part).alias("chunk"))

    windows = F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), window))
    return df.withColumn("_w", F.explode(windows)).select(*df.columns, "_w.*")


def turn_texts(messages: DataFrame, session: str, turn: str, order: list[str], text: str) -> DataFrame:
    """The unit that chunks are cut from: all messages of a session's turn, in order, a line each. byte_start
    and byte_end: where the turn lies in the session's text, in UTF-8 bytes, half open."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_text")))), lambda m: m["_text"]), "\n")
    turns = messages.groupBy(session, turn).agg(whole.alias("text"))
    before = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0))
    return turns.withColumn("byte_start", start.cast("long")).withColumn("byte_end", F.col("byte_start") + F.octet_length("text"))


def search(df: DataFrame, text: str, query: str, identity: str, limit: int = 100) -> DataFrame:
    """The convenience search: literal, any case, the first `limit` rows by identity, each of score 1; an
    empty query finds nothing."""
    found = df.where(F.coalesce(F.lower(F.col(text)).contains(query.lower()), F.lit(False)) & F.lit(bool(query)))
    return found.orderBy(identity).limit(limit).withColumn("score", F.lit(1.0))


def recency_boosted(hits: DataFrame, score: str, ts_ms: str, now_ms: int, half_life_ms: int) -> DataFrame:
    """hits with their score (higher is better) halved for each half-life of age; a hit from the future has age 0."""
    age = F.greatest(F.lit(now_ms) - F.col(ts_ms), F.lit(0)).cast("double")
    return hits.withColumn(score, F.col(score) * F.pow(F.lit(0.5), age / F.lit(float(half_life_ms))))


def session_scores(hits: DataFrame, session: str, score: str) -> DataFrame:
    """A session's score is its best hit's."""
    return hits.groupBy(session).agg(F.max(score).alias("session_score"), F.count("*").alias("hits"))
