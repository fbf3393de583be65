"""The driver's queries: each operator bound to the driver's tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import identity as I
from tracelake.functions import predicates as P
from tracelake.operators import aggregates, entities, folds, graph, ingest, joins, search, sequences, text_index
from tracelake.operators.stages import Rows
from tracelake.plans import bindings as T
from tracelake.plans import access, fixed, views
from tracelake.sources import log as L
from tracelake.sources.providers import typed
from tracelake.sources.stored import folder
from tracelake.streaming import windows
from tracelake.streaming.replay import prefix, tail

CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None, *tables: str):
    """Registers a query under its function's name; tables: the bindings its SQL starts with."""

    def add(f):
        CATALOGUE[f.__name__] = (f, sql and (f"WITH {', '.join(tables)} {sql}" if tables else sql))
        return f

    return add


def _r(c, n: int = 6):
    return F.round(c, n)


# Log scans


@query("SELECT * FROM ev WHERE seq >= 1000 ORDER BY seq", T.EV)
def scan_from_seq(spark, sf):
    return L.scan_all(T.ev(spark, sf), 1000)


@query("SELECT * FROM ev WHERE seq >= 50 ORDER BY seq LIMIT 100", T.EV)
def scan_limit(spark, sf):
    return L.scan_all(T.ev(spark, sf), 50, limit=100)


@query("SELECT * FROM ev WHERE session = 8 AND seq >= 10 ORDER BY seq", T.EV)
def scan_session(spark, sf):
    return L.scan(T.ev(spark, sf), 8, 10, session="session")


@query("SELECT * FROM ev WHERE session = 8 AND seq = 0", T.EV)
def point_get(spark, sf):
    return L.get(T.ev(spark, sf), 8, 0, session="session")


@query("SELECT * FROM ev WHERE seq >= (SELECT max(seq) + 1 - 100 FROM ev)", T.EV)
def recent_n(spark, sf):
    return L.recent(T.ev(spark, sf), 100)


@query("SELECT DISTINCT session FROM ev ORDER BY session", T.EV)
def list_sessions(spark, sf):
    return L.session_ids(T.ev(spark, sf), session="session")


@query("SELECT max(seq) + 1 AS next_seq, count(DISTINCT session) AS session_count, count(*) AS records FROM ev", T.EV)
def log_stats(spark, sf):
    return L.stats(T.ev(spark, sf), session="session")


@query("SELECT seq, event_type FROM ev WHERE seq < 5000", T.EV)
def snapshot_as_of(spark, sf):
    return Rows.of(T.ev(spark, sf), "seq", seq="seq", as_of=5000).df.select("seq", "event_type")


@query("SELECT seq, session, event_type FROM ev WHERE seq BETWEEN 200 AND 299 ORDER BY seq", T.EV)
def scan_page(spark, sf):
    return L.page(T.ev(spark, sf), 200, 100).rows.select("seq", "session", "event_type")


# Predicates


@query("SELECT * FROM ev WHERE event_type IS NOT DISTINCT FROM 'error'", T.EV)
def where_eq(spark, sf):
    return T.ev(spark, sf).where(P.eq(F.col("event_type"), "error"))


@query("SELECT * FROM ev WHERE event_type IS DISTINCT FROM 'error'", T.EV)
def where_ne(spark, sf):
    return T.ev(spark, sf).where(P.ne(F.col("event_type"), "error"))


@query("SELECT * FROM ev WHERE value > 50 AND value <= 200", T.EV)
def where_ordered(spark, sf):
    return T.ev(spark, sf).where(P.both(P.ordered(F.col("value"), ">", 50.0), P.ordered(F.col("value"), "<=", 200.0)))


@query("SELECT * FROM ev WHERE event_type IN ('error', 'signup')", T.EV)
def where_in(spark, sf):
    return T.ev(spark, sf).where(P.is_in(F.col("event_type"), ["error", "signup"]))


@query("SELECT * FROM ev WHERE event_type NOT IN ('error', 'signup')", T.EV)
def where_not_in(spark, sf):
    return T.ev(spark, sf).where(P.not_in(F.col("event_type"), ["error", "signup"]))


@query("SELECT seq, nullif(event_type, 'view') AS kind FROM ev WHERE nullif(event_type, 'view') IS NULL", T.EV)
def where_null(spark, sf):
    kinds = T.ev(spark, sf).select("seq", F.nullif("event_type", F.lit("view")).alias("kind"))
    return kinds.where(F.col("kind").isNull())


@query("SELECT seq, nullif(event_type, 'view') AS kind FROM ev WHERE nullif(event_type, 'view') IS DISTINCT FROM 'error'", T.EV)
def where_ne_missing(spark, sf):
    kinds = T.ev(spark, sf).select("seq", F.nullif("event_type", F.lit("view")).alias("kind"))
    return kinds.where(P.ne(F.col("kind"), "error"))


@query("SELECT * FROM ev WHERE event_type = 'error' AND value > 100 OR NOT (k < 90)", T.EV)
def where_bool_nested(spark, sf):
    e = T.ev(spark, sf)
    return e.where(P.either(P.both(P.eq(e.event_type, "error"), P.ordered(e.value, ">", 100.0)), ~P.ordered(e.k, "<", 90)))


@query("SELECT seq, session, turn, role, text FROM msg WHERE regexp_matches(text, '^[A-Z][a-z]+ [a-z]{2,4}\\b')", T.MSG)
def where_matches(spark, sf):
    return T.msg(spark, sf).where(P.matches(F.col("text"), r"^[A-Z][a-z]+ [a-z]{2,4}\b"))


@query("SELECT * FROM ev WHERE ts_ms >= 1704067200000 AND ts_ms < 1704067200000 + 86400000", T.EV)
def where_between_halfopen(spark, sf):
    return T.ev(spark, sf).where(P.between(F.col("ts_ms"), 1704067200000, 1704067200000 + P.duration_ms("1d")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 95")
def json_path_filter(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", P.json_path("props", "event.k").cast("bigint").alias("k"))
    return e.where(P.between(F.col("k"), 95, 2**62))


# Projection, order, limits


@query("SELECT seq AS \"event.id\", event_type AS \"event.type\", ts_ms AS \"event.timestamp\" FROM ev WHERE event_type = 'error' ORDER BY ts_ms DESC, seq LIMIT 20", T.EV)
def project_alias(spark, sf):
    rows = Rows.of(T.ev(spark, sf), "seq").where(P.eq(F.col("event_type"), "error")).sort_by(("ts_ms", "desc"))
    return rows.project(**{"event.id": "seq", "event.type": "event_type", "event.timestamp": "ts_ms"}).limit(20).rows()


@query("SELECT seq, event_type, value FROM ev ORDER BY event_type, value DESC, seq LIMIT 500", T.EV)
def sort_multi(spark, sf):
    return Rows.of(T.ev(spark, sf), "seq").sort_by(("event_type", "asc"), ("value", "desc")).project(seq="seq", event_type="event_type", value="value").limit(500).rows()


@query("SELECT seq, session, value FROM ev ORDER BY value DESC, seq LIMIT 25", T.EV)
def limit_topn(spark, sf):
    return Rows.of(T.ev(spark, sf), "seq").sort_by(("value", "desc")).project(seq="seq", session="session", value="value").limit(25).rows()


@query("SELECT seq, value FROM ev ORDER BY value, seq LIMIT 50 OFFSET 100", T.EV)
def offset_page(spark, sf):
    return Rows.of(T.ev(spark, sf), "seq").sort_by(("value", "asc")).project(seq="seq", value="value").limit(50, offset=100).rows()


@query("SELECT seq, event_type FROM ev WHERE event_type = 'view' ORDER BY seq LIMIT 1000", T.EV)
def implicit_limit_1000(spark, sf):
    return Rows.of(T.ev(spark, sf), "seq").where(P.eq(F.col("event_type"), "view")).project(seq="seq", event_type="event_type").rows()


# Search


@query("SELECT seq, session, turn, role FROM msg WHERE contains(lower(text), 'the th')", T.MSG)
def search_text_literal(spark, sf):
    return Rows.of(T.msg(spark, sf), "seq").search_text("The TH", "text").df.select("seq", "session", "turn", "role")


@query("SELECT seq, role FROM (SELECT * FROM msg ORDER BY seq DESC LIMIT 10000) WHERE instr(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'th') > 0", T.MSG)
def search_short_bounded(spark, sf):
    return search.short_hits(T.msg(spark, sf), "text", "th", "seq").select("seq", "role")


BM25 = """, st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(greatest(length(text) - 2, 0) AS DOUBLE)) AS mean,
    CAST(count(*) FILTER (contains(lower(text), 'tion')) AS DOUBLE) AS hits FROM ch),
hit AS (SELECT chunk, session, (length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4e0 AS tf,
    CAST(greatest(length(text) - 2, 0) AS DOUBLE) AS len FROM ch WHERE contains(lower(text), 'tion')),
scored AS (SELECT chunk, session, -(greatest(ln((n - hits + 0.5e0) / (hits + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (1 - 0.75e0 + 0.75e0 * len / mean))) AS score FROM hit, st)"""


@query(BM25 + " SELECT chunk, session, round(score * 1e6, 4) AS score FROM scored", T.CH)
def search_bm25_phrase(spark, sf):
    return search.phrase_hits(T.ch(spark, sf), "text", "tion").select("chunk", "session", _r(F.col("score") * 1e6, 4).alias("score"))


@query(BM25 + " SELECT chunk, round(score * 1e6, 4) AS score FROM scored", T.CH)
def search_indexed_phrase(spark, sf):
    rows, root = T.ch(spark, sf), folder(spark)
    text_index.build(rows.where("chunk % 10 <> 3"), root, "chunk", "text", 1, 0, buckets=16, parts=16)
    index = text_index.opened(spark, root)
    return text_index.phrase_hits(spark, index, "tion", rows.where("chunk % 10 = 3")).select("chunk", _r(F.col("score") * 1e6, 4).alias("score"))


@query("SELECT chunk, lang, source FROM ch WHERE contains(lower(text), 'on th') AND lang = 'en' AND source = 'src0' ORDER BY chunk LIMIT 1000", T.CH)
def search_multi_filters(spark, sf):
    rows = Rows.of(T.ch(spark, sf), "chunk").where(P.both(P.eq(F.col("lang"), "en"), P.eq(F.col("source"), "src0")))
    return rows.search_text("on th", "text").project(chunk="chunk", lang="lang", source="source").rows()


_AXIS = [1.0 if i % 2 else -1.0 for i in range(64)]
_AXIS_SQL = "[" + ", ".join(f"{x}e0" for x in _AXIS) + "]"
SIM = f", sim AS (SELECT vec_id AS chunk, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_AXIS_SQL} AS DOUBLE[])) AS similarity FROM embeddings)"


@query("WITH " + SIM[2:] + " SELECT chunk, round(similarity, 9) AS similarity FROM sim ORDER BY sim.similarity DESC, chunk LIMIT 50")
def semantic_topk(spark, sf):
    return search.semantic_hits(T.vec(spark, sf), "embedding", _AXIS, 50, "chunk").select("chunk", _r(F.col("similarity"), 9).alias("similarity"))


RRF = """, tr AS (SELECT chunk, row_number() OVER (ORDER BY round(score, 12), chunk) AS text_rank FROM scored QUALIFY text_rank <= 100),
vr AS (SELECT chunk, row_number() OVER (ORDER BY round(similarity, 12) DESC, chunk) AS vector_rank FROM sim QUALIFY vector_rank <= 100)
SELECT chunk, text_rank, vector_rank, least(text_rank, vector_rank) AS best_rank,
  round(coalesce(1e0 / (60 + text_rank), 0) + coalesce(1e0 / (60 + vector_rank), 0), 9) AS score FROM tr FULL JOIN vr USING (chunk)"""


@query(BM25 + SIM + RRF, T.CH)
def hybrid_rrf(spark, sf):
    text = search.phrase_hits(T.ch(spark, sf), "text", "tion").withColumn("score", F.round("score", 12))
    near = T.vec(spark, sf).withColumn("similarity", F.round(search.cosine("embedding", F.lit(_AXIS)), 12))
    met = search.fused(text, near, "chunk", [F.col("score"), F.col("chunk")], [F.desc("similarity"), F.col("chunk")], 100)
    return met.select("chunk", "text_rank", "vector_rank", "best_rank", _r(F.col("score"), 9).alias("score"))


@query("SELECT chunk, session, length(text) AS n, row_number() OVER (PARTITION BY session ORDER BY length(text) DESC, chunk) AS hit FROM ch WHERE contains(lower(text), 'ing') QUALIFY hit <= 3", T.CH)
def hits_per_session(spark, sf):
    hits = Rows.of(T.ch(spark, sf), "chunk").search_text("ing", "text").df.withColumn("n", F.length("text").cast("bigint"))
    return search.top_per_group(hits, "session", [F.desc("n"), F.col("chunk")], 3).select("chunk", "session", "n", "hit")


@query(
    """, w AS (SELECT chunk, regexp_extract_all(text, '\\S+') AS words FROM ch),
e AS (SELECT chunk, words, unnest(generate_series(0, greatest(CAST(ceil((len(words) - 96) / 672e0) AS BIGINT) - 1, 0))) AS chunk_no FROM w WHERE len(words) > 0)
SELECT chunk AS doc, chunk_no, chunk_no * 672 AS start, CAST(len(words[chunk_no * 672 + 1 : chunk_no * 672 + 768]) AS BIGINT) AS n_words,
  sha256(array_to_string(words[chunk_no * 672 + 1 : chunk_no * 672 + 768], ' ')) AS digest FROM e""",
    T.CH,
)
def chunk_windows(spark, sf):
    each = search.chunks(T.ch(spark, sf).withColumnRenamed("chunk", "doc"), "text")
    return each.select("doc", *[F.col(c).cast("bigint").alias(c) for c in ("chunk_no", "start", "n_words")], F.sha2("chunk", 256).alias("digest"))


@query(
    """, w AS (SELECT chunk, regexp_extract_all(text, '\\S+') AS words FROM ch),
e AS (SELECT chunk, words, unnest(generate_series(0, greatest(CAST(ceil((len(words) - 96) / 672e0) AS BIGINT) - 1, 0))) AS chunk_no FROM w WHERE len(words) > 0),
t AS (SELECT DISTINCT array_to_string(words[chunk_no * 672 + 1 : chunk_no * 672 + 768], ' ') AS t FROM e)
SELECT count(*) AS n_chunks, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM t""",
    T.CH,
)
def chunk_dedup_count(spark, sf):
    once = search.chunks(T.ch(spark, sf).withColumnRenamed("chunk", "doc"), "text").select(F.col("chunk").alias("t")).distinct()
    return once.agg(F.count("*").alias("n_chunks"), F.sum(F.length("t")).cast("bigint").alias("n_chars"))


# Sequences

ORDER = ["ts_ms", "seq"]
FIELDS = ["seq", "ts_ms"]


@query("SELECT seq AS a, b, session FROM (SELECT *, lead(event_type) OVER w AS nt, lead(seq) OVER w AS b FROM ev WINDOW w AS (PARTITION BY session ORDER BY ts_ms, seq)) WHERE event_type = 'click' AND nt = 'purchase'", T.EV)
def match_next(spark, sf):
    e = T.ev(spark, sf)
    return sequences.next_event(e, ["session"], ORDER, e.event_type == "click", e.event_type == "purchase", FIELDS).select(F.col("seq").alias("a"), F.col("b.seq").alias("b"), "session")


THEN = "(SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN seq END IGNORE NULLS) OVER w AS b, first_value(CASE WHEN event_type = 'purchase' THEN ts_ms END IGNORE NULLS) OVER w AS b_ms FROM ev WINDOW w AS (PARTITION BY session ORDER BY ts_ms, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"


@query(f"SELECT seq AS a, b, session, b_ms - ts_ms AS gap FROM {THEN} WHERE event_type = 'signup' AND b_ms - ts_ms <= 86400000", T.EV)
def match_then_within(spark, sf):
    e = T.ev(spark, sf)
    found = sequences.then_event(e, ["session"], ORDER, e.event_type == "signup", e.event_type == "purchase", FIELDS, ("ts_ms", P.duration_ms("1d")))
    return found.select(F.col("seq").alias("a"), F.col("b.seq").alias("b"), "session", (F.col("b.ts_ms") - F.col("ts_ms")).alias("gap"))


@query(f", m AS (SELECT * FROM {THEN} WHERE event_type = 'signup' AND b_ms - ts_ms <= 172800000) SELECT seq AS a, b, session FROM m WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.session = m.session AND x.event_type = 'error' AND (x.ts_ms, x.seq) > (m.ts_ms, m.seq) AND (x.ts_ms, x.seq) < (m.b_ms, m.b))", T.EV)
def match_absence_until(spark, sf):
    e = T.ev(spark, sf)
    found = sequences.absent_until(e, ["session"], ORDER, e.event_type == "signup", e.event_type == "error", e.event_type == "purchase", FIELDS, ("ts_ms", P.duration_ms("2d")))
    return found.select(F.col("seq").alias("a"), F.col("b.seq").alias("b"), "session")


# Graph


def _walk(steps: str, root: int, least: int, most: int) -> str:
    return f"""RECURSIVE {T.EDGE}, step AS ({steps}),
p AS (SELECT CAST({root} AS BIGINT) AS node, 0 AS depth, CAST(NULL AS BIGINT) AS edge_id, [CAST({root} AS BIGINT)] AS path, false AS cycle
  UNION ALL SELECT s.dst, p.depth + 1, s.edge_id, list_append(p.path, s.dst), list_contains(p.path, s.dst) FROM p JOIN step s ON s.src = p.node WHERE NOT p.cycle AND p.depth < {most})
SELECT CAST({root} AS BIGINT) AS root, node, CAST(depth AS BIGINT) AS depth, edge_id, array_to_string(path, '>') AS path, cycle FROM p WHERE depth >= {least}"""


def _paths(spark, sf, root: int, least: int, most: int, direction: str) -> DataFrame:
    found = graph.traverse(T.edge(spark, sf), spark.sql(f"SELECT {root}L AS node"), least, most, direction)
    return found.withColumn("path", F.concat_ws(">", F.col("path").cast("array<string>")))


_OUT, _IN = "SELECT src, dst, edge_id FROM edge", "SELECT dst AS src, src AS dst, edge_id FROM edge"


@query("WITH " + _walk(_OUT, 1, 1, 4))
def traverse_out(spark, sf):
    return _paths(spark, sf, 1, 1, 4, "out")


@query("WITH " + _walk(_IN, 40, 1, 8))
def traverse_in(spark, sf):
    return _paths(spark, sf, 40, 1, 8, "in")


@query("WITH " + _walk(f"{_OUT} UNION ALL {_IN}", 5, 1, 3))
def traverse_both(spark, sf):
    return _paths(spark, sf, 5, 1, 3, "both")


@query("SELECT * FROM (WITH " + _walk(_OUT, 0, 1, 5) + ") WHERE cycle")
def traverse_cycle(spark, sf):
    return _paths(spark, sf, 0, 1, 5, "out").where("cycle")


# Aggregates


@query("SELECT event_type, count(*) AS n, min(value) AS min_value, max(value) AS max_value, round(sum(value), 4) AS sum_value, round(avg(value), 6) AS avg_value FROM ev GROUP BY event_type", T.EV)
def agg_all(spark, sf):
    return aggregates.summary(T.ev(spark, sf), ["event_type"], "value").withColumns({"sum_value": F.round("sum_value", 4), "avg_value": F.round("avg_value", 6)})


@query("SELECT event_type, count(DISTINCT session) AS sessions, count(DISTINCT k) AS ks FROM ev GROUP BY event_type", T.EV)
def agg_distinct(spark, sf):
    return aggregates.distincts(T.ev(spark, sf), ["event_type"], sessions="session", ks="k")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, quantile_disc(value, 0.95) AS p95_rank FROM ev GROUP BY event_type", T.EV)
def agg_percentiles(spark, sf):
    return aggregates.percentiles(T.ev(spark, sf), ["event_type"], "value").withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


@query("SELECT count(*) AS n, min(value) AS min_value, max(value) AS max_value, sum(value) AS sum_value, avg(value) AS avg_value FROM ev WHERE event_type = 'none'", T.EV)
def agg_empty(spark, sf):
    return aggregates.summary(T.ev(spark, sf).where(P.eq(F.col("event_type"), "none")), [], "value")


@query("SELECT event_type, count(*) AS n FROM ev WHERE k < 50 AND event_type <> 'error' GROUP BY event_type", T.EV)
def access_rules(spark, sf):
    policy = access.Policy(rules=(("events", "k < 50"), ("events", "event_type <> 'error'")))
    return policy.leaf("events", T.ev(spark, sf)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT k, count(*) AS n FROM ev GROUP BY k HAVING count(*) >= 100", T.EV)
def agg_min_group(spark, sf):
    return aggregates.min_group_size(T.ev(spark, sf).groupBy("k").agg(F.count("*").alias("n")), "n", 100)


# Projections


@query("SELECT session, event_type, min(seq) AS seq, arg_min(value, seq) AS value FROM ev GROUP BY session, event_type", T.EV)
def dedup_first(spark, sf):
    return views.first_by(T.ev(spark, sf).select("session", "event_type", "seq", "value"), ["session", "event_type"], "seq")


_KEYS = ["provider", "source_path", "generation", "identity"]


@query("SELECT seq, provider, source_path, generation, identity, seq = max(seq) OVER (PARTITION BY provider, source_path, generation, identity) AS current FROM rev", T.EV, T.REV)
def supersede_last(spark, sf):
    return views.superseded(T.rev(spark, sf), _KEYS).select("seq", *_KEYS, "current")


VISIBLE = "SELECT r.*, c.control IS NULL OR c.control < r.seq AS visible FROM rev r LEFT JOIN (SELECT provider, source_path, generation, max(seq) AS control FROM rev WHERE event_type = 'signup' GROUP BY ALL) c USING (provider, source_path, generation)"


@query(f"SELECT seq, provider, source_path, generation, visible FROM ({VISIBLE})", T.EV, T.REV)
def visibility_controls(spark, sf):
    r = T.rev(spark, sf)
    controls = r.where("event_type = 'signup'").select("seq", *views.SOURCE)
    return views.visible(r, controls, views.SOURCE).select("seq", *views.SOURCE, "visible")


SESSIONS = f", a AS (SELECT *, visible AND seq = max(seq) OVER (PARTITION BY provider, source_path, generation, identity) AS active FROM ({VISIBLE})), s AS (SELECT session, arg_min(provider, seq) AS provider, 'n' || session AS native_session_id, arg_max('proj' || (seq % 3), seq) FILTER (event_type = 'click') AS project, arg_min(ts_ms, seq) AS first_seen_ms, max(ts_ms) AS last_updated_ms, arg_max(CASE WHEN event_type = 'error' THEN 'e' || seq END, seq) FILTER (event_type = 'error') AS title, count(*) FILTER (active) AS event_count, bool_or(active) AS active FROM a GROUP BY session)"


def _sessions(spark, sf) -> DataFrame:
    r = T.rev(spark, sf)
    shown = views.visible(views.superseded(r, _KEYS), r.where("event_type = 'signup'").select("seq", *views.SOURCE), views.SOURCE)
    titled = shown.withColumn("title", F.when(F.col("event_type") == "error", F.concat(F.lit("e"), "seq"))).withColumn("native_session_id", F.concat(F.lit("n"), "session"))
    titled = titled.withColumn("project", F.when(F.col("event_type") == "click", F.concat(F.lit("proj"), F.col("seq") % 3)))
    return views.sessions(titled, F.col("current") & F.col("visible"))


@query(SESSIONS + " SELECT * FROM s WHERE active", T.EV, T.REV)
def active_sessions(spark, sf):
    return _sessions(spark, sf).where("active")


@query(SESSIONS + " SELECT session, first_seen_ms, last_updated_ms, event_count FROM s WHERE active AND last_updated_ms >= 1704153600000 AND first_seen_ms <= 1704326400000 ORDER BY last_updated_ms DESC, session LIMIT 1000", T.EV, T.REV)
def session_overlap_list(spark, sf):
    return fixed.session_list(_sessions(spark, sf), 1704153600000, 1704326400000).select("session", "first_seen_ms", "last_updated_ms", "event_count")


@query("SELECT seq, ts_ms, event_type FROM ev WHERE session = 8 AND ts_ms BETWEEN 1704067200000 AND 1705276800000 ORDER BY seq LIMIT 1000", T.EV)
def timeline_window(spark, sf):
    return fixed.timeline(T.ev(spark, sf), 8, 1704067200000, 1705276800000).select("seq", "ts_ms", "event_type")


@query("SELECT provider, source_path, max(seq) AS seq, arg_max(value, seq) AS value FROM rev GROUP BY provider, source_path", T.EV, T.REV)
def source_checkpoint_latest(spark, sf):
    return views.latest_by(T.rev(spark, sf).select("provider", "source_path", "seq", "value"), ["provider", "source_path"], "seq")


@query("SELECT session AS memory, k AS revision, seq FROM ev QUALIFY row_number() OVER (PARTITION BY session ORDER BY k DESC, seq) = 1", T.EV)
def memory_latest_revision(spark, sf):
    rows = T.ev(spark, sf).select(F.col("session").alias("memory"), F.col("k").alias("revision"), "seq")
    return views.latest_by(rows, ["memory"], F.struct("revision", -F.col("seq")))


# Pairing


@query("SELECT r.seq, r.session, r.turn, (SELECT max(d.turn) FROM msg d WHERE d.session = r.session AND d.role = 'user' AND d.turn < r.turn) AS call_turn FROM msg r WHERE role = 'assistant'", T.MSG)
def tool_pairing_left(spark, sf):
    m = T.msg(spark, sf)
    paired = joins.latest_before(m, ["session"], ["turn"], m.role == "user", ["turn"], "call")
    return paired.where("role = 'assistant'").select("seq", "session", "turn", F.col("call.turn").alias("call_turn"))


@query("SELECT DISTINCT session FROM msg WHERE role = 'user' AND session NOT IN (SELECT session FROM msg WHERE role = 'assistant')", T.MSG)
def undeclared_antijoin(spark, sf):
    m = T.msg(spark, sf)
    return joins.missing(m.where("role = 'user'").select("session").distinct(), m.where("role = 'assistant'").select("session"), ["session"])


@query("SELECT e.dst AS node, e.src AS parent, p.src AS grandparent, p.type AS parent_type FROM edge e LEFT JOIN edge p ON p.dst = e.src AND p.edge_id > 0 WHERE e.edge_id > 0", T.EDGE)
def parent_lookup(spark, sf):
    tree = T.edge(spark, sf).where("edge_id > 0")
    named = tree.select(F.col("dst").alias("node"), F.col("src").alias("parent"), "type")
    found = joins.parents(named, ["node"], ["parent"], {"grandparent": "parent", "parent_type": "type"})
    return found.select("node", "parent", "grandparent", "parent_type")


@query("SELECT seq, session, last_value(CASE WHEN event_type = 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM ev", T.EV)
def carry_forward(spark, sf):
    e = T.ev(spark, sf)
    return folds.carried(e, ["session"], ORDER, F.when(e.event_type == "signup", e.k), "context").select("seq", "session", "context")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) OR d.doc_id IN (SELECT vec_id FROM embeddings WHERE label = 1) THEN 'mapped' WHEN d.doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3') THEN 'declared' ELSE 'uncovered' END AS status FROM documents d) GROUP BY status")
def coverage_accounting(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "source")
    vecs = T.table(spark, sf, "embeddings").where("label = 1").select(F.col("vec_id").alias("doc_id"))
    found = joins.coverage(docs, [(T.table(spark, sf, "labels"), ["doc_id"]), (vecs, ["doc_id"])], docs.where("source = 'src3'"), ["doc_id"])
    return found.groupBy("status").agg(F.count("*").alias("n"))


# Folds

COHORT = ", rk AS (SELECT *, CASE WHEN authenticated AND layer = 'L1' THEN 3 WHEN authenticated AND layer = 'L2' THEN 2 ELSE 1 END * 10 + CASE authority WHEN 'authoritative' THEN 3 WHEN 'self_reported' THEN 2 ELSE 1 END AS rk FROM obs), co AS (SELECT * FROM rk QUALIFY rk = max(rk) OVER (PARTITION BY entity))"


def _cohort(spark, sf) -> DataFrame:
    o = T.obs(spark, sf)
    return folds.cohort(o, ["entity"], folds.rank_of(o.layer, o.authenticated, o.authority))


@query(COHORT + " SELECT entity, event_id, layer, authenticated, authority FROM co", T.EV, T.OBS)
def cohort_filter(spark, sf):
    return _cohort(spark, sf).select("entity", "event_id", "layer", "authenticated", "authority")


@query(COHORT + ", w AS (SELECT entity, value, event_id FROM co QUALIFY row_number() OVER (PARTITION BY entity ORDER BY phase DESC, revision DESC, confidence DESC, ts_ms DESC, event_id DESC) = 1) SELECT * FROM w", T.EV, T.OBS)
def field_winner(spark, sf):
    return _cohort(spark, sf).groupBy("entity").agg(folds.winner("value").alias("value"), folds.winner("event_id").alias("event_id"))


@query(COHORT + " SELECT o.entity, o.ids, w.layer FROM (SELECT entity, string_agg(DISTINCT event_id, ',' ORDER BY event_id) AS ids FROM obs GROUP BY entity) o JOIN (SELECT entity, layer FROM co QUALIFY row_number() OVER (PARTITION BY entity ORDER BY phase DESC, revision DESC, confidence DESC, ts_ms DESC, event_id DESC) = 1) w USING (entity)", T.EV, T.OBS)
def provenance_ids(spark, sf):
    ids = T.obs(spark, sf).groupBy("entity").agg(F.concat_ws(",", folds.provenance("event_id").cast("array<string>")).alias("ids"))
    return ids.join(_cohort(spark, sf).groupBy("entity").agg(folds.winner("layer").alias("layer")), "entity").select("entity", "ids", "layer")


@query("SELECT entity, min(ts_ms) AS started_ms, max(ts_ms) FILTER (event_type = 'purchase') AS completed_ms, arg_max(event_id, (phase, revision, confidence, ts_ms, event_id)) FILTER (event_type = 'purchase') AS terminal_event, max(coalesce(revision, 1)) AS revision, count(*) AS n_events FROM obs GROUP BY entity", T.EV, T.OBS)
def run_fold(spark, sf):
    return folds.runs(T.obs(spark, sf), ["entity"], F.col("event_type") == "purchase")


@query("SELECT seq, session, turn, CAST(count(*) FILTER (role = 'user') OVER (PARTITION BY session ORDER BY turn, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS turn_index FROM msg", T.MSG)
def turn_index(spark, sf):
    return folds.numbered(T.msg(spark, sf), ["session"], ["turn", "seq"], F.col("role") == "user").select("seq", "session", "turn", "turn_index")


@query("SELECT session, string_agg(text, '' ORDER BY turn) AS text, count(text) AS n_pieces FROM msg GROUP BY session", T.MSG)
def chunk_assembly(spark, sf):
    return folds.assembled(T.msg(spark, sf), ["session"], ["turn"], "text")


@query("SELECT seq, session, row_number() OVER w AS revision, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars FROM msg WINDOW w AS (PARTITION BY session ORDER BY turn, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", T.MSG)
def cumulative_merge(spark, sf):
    w = Window.partitionBy("session").orderBy("turn", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return T.msg(spark, sf).select("seq", "session", F.count("*").over(w).alias("revision"), F.sum(F.length("text")).over(w).alias("n_chars"))


# Dashboard


@query("SELECT coalesce(nullif(event_type, 'view'), 'Unassigned') AS project, count(DISTINCT session) AS sessions, count(*) AS events, CAST(sum(k) AS BIGINT) AS tokens, count(*) FILTER (event_type = 'error') AS errors, round(CASE WHEN sum(value) = 0 THEN 0 ELSE sum(k) / sum(value) END, 6) AS rate FROM ev GROUP BY 1", T.EV)
def dash_group(spark, sf):
    project = F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("Unassigned"))
    rate = aggregates.ratio(F.sum("k"), F.sum("value"))
    return aggregates.by_bucket(T.ev(spark, sf), project, "project", sessions=F.count_distinct("session"), events=F.count("*"), tokens=F.sum("k"), errors=F.count_if(F.col("event_type") == "error"), rate=_r(rate))


@query("SELECT ts_ms // 86400000 AS day, count(*) AS events, count(DISTINCT session) AS sessions FROM ev GROUP BY 1", T.EV)
def dash_trend_day(spark, sf):
    return aggregates.by_bucket(T.ev(spark, sf), F.expr("ts_ms div 86400000"), "day", events=F.count("*"), sessions=F.count_distinct("session"))


@query(", b AS (SELECT (SELECT min(ts_ms) // 3600000 FROM ev) + unnest(generate_series(0, 23)) AS hour) SELECT b.hour, count(e.seq) AS events FROM b LEFT JOIN ev e ON e.ts_ms // 3600000 = b.hour GROUP BY 1", T.EV)
def dash_throughput_hour(spark, sf):
    e = T.ev(spark, sf).withColumn("hour", F.expr("ts_ms div 3600000"))
    every = e.agg(F.min("hour").alias("h")).select(F.explode(F.sequence(F.col("h"), F.col("h") + 23)).alias("hour"))
    return aggregates.gap_filled(e.groupBy("hour").agg(F.count("*").alias("events")), "hour", "events", every)


@query("SELECT session, CAST(sum(k) AS BIGINT) AS tokens, count(*) AS events FROM ev GROUP BY session ORDER BY tokens DESC, session LIMIT 20", T.EV)
def dash_top_sessions(spark, sf):
    return aggregates.top(T.ev(spark, sf), "session", "tokens", 20, tokens=F.sum("k"), events=F.count("*"))


@query("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (k >= 90) AS errors FROM ev GROUP BY 1 ORDER BY calls DESC, tool", T.EV)
def tool_ranking(spark, sf):
    return aggregates.by_bucket(T.ev(spark, sf), F.col("event_type"), "tool", calls=F.count("*"), errors=F.count_if(F.col("k") >= 90)).orderBy(F.desc("calls"), "tool")


@query("SELECT session, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM ev GROUP BY session", T.EV)
def timeline_categories(spark, sf):
    return aggregates.category_counts(T.ev(spark, sf), "session", F.col("event_type"), ["error", "click", "purchase"])


# Hashes, streaming's batch equal


@query("SELECT event_id, sha256(props) AS digest, md5(event_type) AS type_md5, lower(hex(event_type)) AS kind_hex, base64(encode(event_type)) AS kind_b64 FROM events")
def hash_columns(spark, sf):
    return T.table(spark, sf, "events").select("event_id", F.sha2("props", 256).alias("digest"), F.md5(F.col("event_type").cast("binary")).alias("type_md5"), F.lower(F.hex("event_type")).alias("kind_hex"), F.base64(F.col("event_type").cast("binary")).alias("kind_b64"))


@query("SELECT seq, session, event_type FROM ev", T.EV)
def replay_prefix_plus_tail(spark, sf):
    e = T.ev(spark, sf).select("seq", "session", "event_type")
    return prefix(e, 2000).unionByName(tail(e, 2000))


# Identities, text forms


@query("SELECT seq, sha256(unhex(printf('%02x00000000000000', strlen(event_type))) || encode(event_type) || unhex(printf('%02x00000000000000', strlen(CAST(session AS VARCHAR)))) || encode(CAST(session AS VARCHAR))) AS id FROM ev", T.EV)
def identity_framed(spark, sf):
    return T.ev(spark, sf).select("seq", I.framed(F.col("event_type"), F.col("session").cast("string")).alias("id"))


@query("SELECT seq, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, '01' || lpad(lower(to_hex(ts_ms)), 12, '0') || '-' || lpad(CAST(seq % 10000 AS VARCHAR), 4, '0') AS order_key FROM ev", T.EV)
def time_and_order_keys(spark, sf):
    return T.ev(spark, sf).select("seq", I.iso_ms(F.col("ts_ms")).alias("iso"), I.order_key(F.col("ts_ms"), F.col("seq")).alias("order_key"))


@query("SELECT seq, CASE event_type WHEN 'error' THEN 'turn.aborted' WHEN 'click' THEN 'tool.called' WHEN 'purchase' THEN 'tool.completed' ELSE 'native.event' END AS kind FROM ev", T.EV)
def event_type_map(spark, sf):
    table = {"error": "turn.aborted", "click": "tool.called", "purchase": "tool.completed"}
    return T.ev(spark, sf).select("seq", typed(F.col("event_type"), table).alias("kind"))


# Ingest


@query("SELECT seq AS event, row_number() OVER (ORDER BY ts_ms, seq) - 1 + 500 AS seq FROM ev", T.EV)
def assign_sequence(spark, sf):
    e = T.ev(spark, sf).select(F.col("seq").alias("event"), "ts_ms")
    return ingest.numbered(e, ["ts_ms", "event"], 500).select("event", "seq")


@query("SELECT DISTINCT session AS event_id FROM ev WHERE session NOT IN (SELECT session FROM ev WHERE event_type = 'signup' AND k > 50)", T.EV)
def unknown_antijoin(spark, sf):
    e = T.ev(spark, sf).withColumn("event_id", F.col("session"))
    return ingest.unknown(e.select("event_id"), e.where("event_type = 'signup' AND k > 50"))


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 2)")
def evidence_semijoin(spark, sf):
    vecs = T.table(spark, sf, "embeddings").where("label = 2").select(F.col("vec_id").alias("doc_id"))
    return T.table(spark, sf, "labels").join(vecs, "doc_id", "left_semi").select("doc_id")


@query("SELECT session AS path, CAST(max(ts_ms) AS BIGINT) AS modified FROM ev GROUP BY session ORDER BY modified DESC, path LIMIT 64", T.EV)
def hot_sources_topk(spark, sf):
    return ingest.hot_sources(T.ev(spark, sf).groupBy(F.col("session").alias("path")).agg(F.max("ts_ms").alias("modified")))


@query(", gone AS (SELECT DISTINCT session FROM ev WHERE event_type = 'error' EXCEPT SELECT session FROM ev WHERE event_type = 'signup' AND k > 60) SELECT session AS path, 1000 AS missing_since, true AS retract FROM gone", T.EV)
def missing_sources(spark, sf):
    e = T.ev(spark, sf).withColumn("path", F.col("session"))
    known = e.where("event_type = 'error'").select("path").distinct().withColumn("missing_since", F.lit(1000))
    return ingest.gone(known, e.where("event_type = 'signup' AND k > 60"), 7000).select("path", "missing_since", "retract")


# Sets, windows, lists


@query("SELECT session, event_type FROM ev WHERE k < 10 UNION SELECT session, event_type FROM ev WHERE k >= 90 EXCEPT SELECT session, event_type FROM ev WHERE k = 50", T.EV)
def set_operations(spark, sf):
    e = T.ev(spark, sf).select("session", "event_type", "k")
    part = lambda p: e.where(p).select("session", "event_type")
    return part("k < 10").union(part("k >= 90")).distinct().subtract(part("k = 50"))


@query("SELECT epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) // 1000 AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf):
    made = windows.tumbling(T.table(spark, sf, "events"), "ts", "10 minutes", ["event_type"])
    return made.select(P.epoch_ms("start").alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


@query(", g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < 7200000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY session ORDER BY ts_ms, seq)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts_ms, seq) AS part FROM g) SELECT session, CAST(min(ts_ms) AS BIGINT) AS start_ms, count(*) AS n FROM s GROUP BY session, part", T.EV)
def window_sessions(spark, sf):
    e = T.ev(spark, sf).withColumn("at", F.timestamp_millis("ts_ms"))
    return windows.sessions(e, "at", "2 hours", ["session"]).select("session", F.unix_millis("start").alias("start_ms"), "n")


@query("SELECT session, string_agg(seq, ',' ORDER BY turn, seq) AS message_ids FROM msg WHERE role <> 'system' GROUP BY session", T.MSG)
def child_lists(spark, sf):
    m = T.msg(spark, sf)
    rows = m.where("role <> 'system'").select(F.col("session"), F.col("session").alias("run"), F.col("turn").alias("order"), F.col("seq").cast("string").alias("id"))
    runs = rows.select("session", F.col("session").alias("id")).distinct()
    return entities.children(runs, rows, "run", "message_ids").select("session", F.concat_ws(",", "message_ids").alias("message_ids"))


@query("SELECT session, count(*) AS n FROM ev WHERE event_type = 'click' AND session IN (SELECT session FROM ev WHERE k = 99) AND ts_ms >= 1704153600000 GROUP BY session", T.EV)
def dash_filters(spark, sf):
    e = T.ev(spark, sf)
    rows = e.where(P.both(P.eq(F.col("event_type"), "click"), F.col("ts_ms") >= 1704153600000))
    return rows.join(e.where("k = 99").select("session").distinct(), "session", "left_semi").groupBy("session").agg(F.count("*").alias("n"))


@query("SELECT CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(k) FILTER (event_type = 'view') AS BIGINT) AS cached, round(CASE WHEN sum(k) = 0 THEN 0 ELSE sum(k) FILTER (event_type = 'view') / sum(k) END, 6) AS hit_rate FROM ev", T.EV)
def dash_totals(spark, sf):
    cached = F.sum(F.when(F.col("event_type") == "view", F.col("k")))
    return T.ev(spark, sf).agg(F.sum("k").alias("tokens"), cached.alias("cached"), _r(aggregates.ratio(cached, F.sum("k"))).alias("hit_rate"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Errors a type of event: count and p95 of value, in order of the type."""
    by_type = T.ev(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))
    return by_type.orderBy("event_type")
