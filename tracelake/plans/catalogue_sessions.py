"""More of the driver's queries: transcripts, frames, entities, lists, reconcile, dashboard.

Transcripts, envelopes and frames are made of the driver's tables by the bindings below, then read by the
library's parsers; the SQL says what must come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import predicates as P
from tracelake.functions import texts
from tracelake.operators import aggregates, entities, ingest, search
from tracelake.operators.stages import Rows, bound, source
from tracelake.plans import bindings as T
from tracelake.plans import catalogue, fixed, views
from tracelake.plans.catalogue import SESSIONS, query
from tracelake.sources import lines as frames_of
from tracelake.sources import log as L
from tracelake.sources import providers

# Lists and search


@query(SESSIONS + " SELECT session, project, native_session_id, event_count FROM s WHERE active AND provider = 'claude' AND project = 'proj1' ORDER BY last_updated_ms DESC, session LIMIT 1000", T.EV, T.REV)
def session_list_filtered(spark, sf):
    return fixed.session_list(catalogue._sessions(spark, sf), provider="claude", project="proj1").select("session", "project", "native_session_id", "event_count")


@query(SESSIONS + " SELECT session, provider, first_seen_ms, title, event_count FROM s WHERE active AND session = (SELECT min(session) FROM s WHERE active)", T.EV, T.REV)
def session_detail(spark, sf):
    sessions = catalogue._sessions(spark, sf)
    first = sessions.where("active").agg(F.min("session")).first()[0]
    return fixed.session_detail(sessions, first).select("session", "provider", "first_seen_ms", "title", "event_count")


@query(SESSIONS + " SELECT a.seq, -a.value AS score, a.session, s.title AS session_title, s.project AS session_project FROM a LEFT JOIN s USING (session) WHERE a.active AND a.event_type = 'error' AND s.project = 'proj2' ORDER BY score, seq LIMIT 50", T.EV, T.REV)
def search_joined(spark, sf):
    r = T.rev(spark, sf)
    shown = views.visible(views.superseded(r, catalogue._KEYS), r.where("event_type = 'signup'").select("seq", *views.SOURCE), views.SOURCE)
    events = shown.select("seq", "session", (F.col("current") & F.col("visible")).alias("active"))
    hits = r.where("event_type = 'error'").select("seq", (-F.col("value")).alias("score"))
    return fixed.hits_with_context(hits, events, catalogue._sessions(spark, sf), "proj2", 50).select("seq", "score", "session", "session_title", "session_project")


@query("SELECT DISTINCT source_path FROM rev WHERE provider = 'pi' ORDER BY source_path", T.EV, T.REV)
def source_paths(spark, sf):
    return fixed.source_paths(views.latest_by(T.rev(spark, sf), ["provider", "source_path"], "seq"), "pi")


@query("SELECT source_path, max(seq) AS seq FROM rev WHERE provider = 'codex' AND source_path = 6 GROUP BY source_path", T.EV, T.REV)
def source_by_key(spark, sf):
    return fixed.source(views.latest_by(T.rev(spark, sf), ["provider", "source_path"], "seq"), "codex", 6).select("source_path", "seq")


@query("SELECT seq, session, 1e0 AS score FROM msg WHERE contains(lower(text), 'the') ORDER BY seq LIMIT 100", T.MSG)
def convenience_search(spark, sf):
    return search.search(T.msg(spark, sf), "text", "The", "seq").select("seq", "session", "score")


@query("SELECT session, round(max(value * pow(0.5e0, (1705000000000 - least(ts_ms, 1705000000000)) / 86400000e0)), 6) AS session_score, count(*) AS hits FROM ev WHERE event_type = 'click' GROUP BY session", T.EV)
def recency_session_scores(spark, sf):
    hits = search.recency_boosted(T.ev(spark, sf).where("event_type = 'click'"), "value", "ts_ms", 1705000000000, P.duration_ms("1d"))
    return search.session_scores(hits, "session", "value").withColumn("session_score", F.round("session_score", 6))


@query(
    ", t AS (SELECT session, turn // 2 AS turn, string_agg(text, chr(10) ORDER BY turn, seq) AS text FROM msg GROUP BY ALL) SELECT session, turn, text, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start, CAST(sum(strlen(text) + 1) OVER (PARTITION BY session ORDER BY turn) - 1 AS BIGINT) AS byte_end FROM t",
    T.MSG,
)
def chunk_turns(spark, sf):
    m = T.msg(spark, sf).withColumn("episode", F.expr("turn div 2"))
    return search.turn_texts(m, "session", "episode", ["turn", "seq"], "text").withColumnRenamed("episode", "turn")


# Stages


@query("SELECT event_type, k % 10 AS digit, count(*) AS n, max(value) AS most FROM ev WHERE value > 20 GROUP BY ALL ORDER BY event_type, digit LIMIT 30", T.EV)
def stage_group_by(spark, sf):
    given = bound({"least": 20.0}, {"least": "double"})
    e = T.ev(spark, sf).withColumn("digit", F.col("k") % 10)
    rows = source({"events": e}, "events").where(P.ordered(F.col("value"), ">", given["least"]))
    return rows.group_by("event_type", "digit").summarize(n=F.count("*"), most=F.max("value")).limit(30).rows()


@query("SELECT stage, n AS rows FROM (SELECT 1 AS i, 'from' AS stage, count(*) AS n FROM ev UNION ALL SELECT 2, 'where', count(*) FROM ev WHERE event_type = 'error' UNION ALL SELECT 3, 'where', count(*) FROM ev WHERE event_type = 'error' AND k < 50)", T.EV)
def explain_counts(spark, sf):
    rows = Rows.of(T.ev(spark, sf), "seq").counted().where(P.eq(F.col("event_type"), "error")).where(P.ordered(F.col("k"), "<", 50))
    return spark.createDataFrame([(x["stage"], x["rows"]) for x in rows.result().explain()], "stage string, rows long")


@query("SELECT seq FROM ev WHERE ts_ms >= 1704067200000 AND ts_ms < 1704067200000 + 5400000", T.EV)
def time_literals(spark, sf):
    low = P.time_ms("2024-01-01T01:00:00+01:00")
    return T.ev(spark, sf).where(P.between(F.col("ts_ms"), low, low + P.duration_ms("90m"))).select("seq")


# Reconcile

_SOURCES = """, p AS (SELECT DISTINCT session AS path FROM ev),
old AS (SELECT path, path % 4 AS generation, path % 3 + 1 AS n, [sha256(path || '-' || i) FOR i IN range(1, path % 3 + 2)] AS chunks, CASE WHEN path % 11 = 0 THEN 5 END AS missing_since FROM p WHERE path % 6 > 0),
inv AS (SELECT path, path % 4 + 1 AS n, [sha256(path || '-' || (CASE WHEN path % 5 = 0 THEN -i ELSE i END)) FOR i IN range(1, path % 4 + 2)] AS chunks FROM p WHERE path % 7 > 0),
plan AS (SELECT path, o.n AS old_n, generation, CASE WHEN o.path IS NULL THEN 'new' WHEN missing_since IS NOT NULL THEN 'replace' WHEN o.n = i.n AND o.chunks = i.chunks THEN 'unchanged' WHEN i.n > o.n AND i.chunks[1:o.n] = o.chunks THEN 'append' ELSE 'replace' END AS change FROM inv i LEFT JOIN old o USING (path))"""


def _reconcile(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = T.ev(spark, sf).select(F.col("session").alias("path")).distinct()
    chunks = lambda n, sign: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.sha2(F.concat_ws("-", F.col("path").cast("string"), (i * sign).cast("string")), 256))
    n, m = F.col("path") % 3 + 1, F.col("path") % 4 + 1
    sized = lambda rows, n, sign: rows.select(F.lit("pi").alias("provider"), "path", (n * ingest.CHUNK).alias("length"), chunks(n, sign).alias("chunks"))
    old = sized(p.where("path % 6 > 0"), n, F.lit(1)).withColumn("generation", F.col("path") % 4).withColumn("missing_since", F.when(F.col("path") % 11 == 0, 5))
    new = sized(p.where("path % 7 > 0"), m, F.when(F.col("path") % 5 == 0, -1).otherwise(1)).withColumn("tail", F.lit(None).cast("string"))
    return old, new


@query(f"{_SOURCES} SELECT path, change, coalesce(generation, -1) + CASE WHEN change IN ('new', 'replace') THEN 1 ELSE 0 END AS generation, CASE WHEN change = 'append' THEN old_n * 65536 ELSE 0 END AS from_offset FROM plan", T.EV)
def reconcile_plan(spark, sf):
    return ingest.reconcile(*_reconcile(spark, sf)).select("path", "change", "generation", "from_offset")


@query(f"{_SOURCES} SELECT path, generation, 'supersede' AS action FROM plan WHERE change = 'replace' UNION ALL SELECT path, generation, 'retract' FROM old WHERE path % 7 = 0 AND missing_since IS NOT NULL", T.EV)
def reconcile_controls(spark, sf):
    old, new = _reconcile(spark, sf)
    lost = ingest.gone(old, new, 9000).where("retract")
    return ingest.controls(ingest.reconcile(old, new), lost).select("path", "generation", "action")


@query(
    ", p AS (SELECT session, k, CAST(seq AS VARCHAR) AS path, sha256(event_type) AS digest FROM ev), j AS (SELECT session AS unit, count(*) AS artifacts, CAST(sum(k) AS BIGINT) AS length, string_agg(length(path) || ':' || path || ':64:' || digest, '' ORDER BY path) AS s FROM p GROUP BY session) SELECT unit, artifacts, length, sha256(unhex(printf('%02x', length(s) % 256) || printf('%02x', length(s) // 256 % 256) || printf('%02x', length(s) // 65536) || '0000000000') || encode(s)) AS fingerprint FROM j",
    T.EV,
)
def composite_fingerprints(spark, sf):
    files = T.ev(spark, sf).select(F.col("session").alias("unit"), F.col("seq").cast("string").alias("path"), F.sha2(F.col("event_type"), 256).alias("digest"), F.col("k").alias("length"))
    return ingest.composite(files)


@query("SELECT provider, source_path AS path, generation, max(seq) AS hidden_below FROM rev WHERE event_type = 'signup' GROUP BY ALL", T.EV, T.REV)
def hidden_generations(spark, sf):
    r = T.rev(spark, sf).withColumnRenamed("source_path", "path")
    return ingest.state(r.select(F.col("seq").alias("event_id")), r.select("seq", "provider", "path"), r.where("event_type = 'signup'"))["hidden"]


# Dashboard


@query("SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day, count(*) AS events FROM events GROUP BY 1")
def dash_trend_local_day(spark, sf):
    return aggregates.by_bucket(T.ev(spark, sf), aggregates.local_day(F.col("ts_ms"), "America/New_York"), "day", events=F.count("*"))


_TYPES = "CASE event_type WHEN 'error' THEN 'tool.error' WHEN 'click' THEN 'tool.called' WHEN 'view' THEN 'message.created' WHEN 'signup' THEN 'session.started' ELSE 'native' END"


@query("SELECT session, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS tool, count(*) FILTER (event_type = 'view') AS message, count(*) FILTER (event_type = 'purchase') AS other FROM ev GROUP BY session", T.EV)
def timeline_category_order(spark, sf):
    kind = aggregates.category(F.expr(_TYPES))
    return aggregates.category_counts(T.ev(spark, sf), "session", kind, ["error", "tool", "message", "other"])


_TOOLS = "SELECT session, 'proj' || (session % 3) AS project, 'Title ' || session AS title, 'n' || session AS native_session_id, CASE WHEN session % 2 = 0 THEN 'claude' ELSE 'codex' END AS runtime, max(ts_ms) AS last_updated_ms FROM ev GROUP BY session"


def _dashboard(spark, sf) -> DataFrame:
    e = T.ev(spark, sf)
    tools = e.groupBy("session", F.col("event_type").alias("name")).agg(F.count("*").alias("calls"), F.count_if(F.col("k") >= 90).alias("errors"))
    listed = tools.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("name", "calls", "errors"))).alias("tools"))
    s = e.groupBy("session").agg(F.max("ts_ms").alias("last_updated_ms")).join(listed, "session")
    s = s.withColumn("project", F.concat(F.lit("proj"), F.col("session") % 3)).withColumn("title", F.concat(F.lit("Title "), "session"))
    return s.withColumn("native_session_id", F.concat(F.lit("n"), "session")).withColumn("runtime", F.when(F.col("session") % 2 == 0, "claude").otherwise("codex"))


@query("SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (k >= 90) AS errors FROM ev GROUP BY 1 ORDER BY calls DESC, tool", T.EV)
def tool_ranking_flattened(spark, sf):
    return aggregates.tool_ranking(_dashboard(spark, sf), "tools")


@query(f", s AS ({_TOOLS}) SELECT session, title FROM s WHERE runtime = 'claude' AND project = 'proj1' AND session IN (SELECT session FROM ev WHERE event_type = 'purchase') AND (contains(lower(title), '1') OR contains(native_session_id, '1') OR contains(project, '1')) AND last_updated_ms >= 1704153600000", T.EV)
def dash_session_filters(spark, sf):
    return aggregates.filtered(_dashboard(spark, sf), "claude", "proj1", "purchase", "1", 1704153600000).select("session", "title")


# Transcripts: a line a turn of conversations


def _lines(spark, sf, raw: Column, head: Column | None = None) -> DataFrame:
    m = T.msg(spark, sf)
    path = F.concat(F.lit("/t/s"), F.col("session"), F.lit(".jsonl")).alias("path")
    rows = m.select(path, F.lit(10_000).cast("long").alias("length"), (F.col("turn") + 1).alias("line"), ((F.col("turn") + 1) * 1000).alias("byte_start"), ((F.col("turn") + 1) * 1000 + 900).alias("byte_end"), raw.alias("raw"))
    if head is None:
        return rows
    zero = lambda n, name: F.lit(n).cast("long").alias(name)
    return rows.unionByName(m.select("session").distinct().select(path, zero(10_000, "length"), zero(0, "line"), zero(0, "byte_start"), zero(900, "byte_end"), head.alias("raw")))


def _id() -> Column:
    return F.concat(F.lit("s"), F.col("session"))


def _content() -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.col("text")))


@query(
    "SELECT 's' || session AS native_session_id, CASE role WHEN 'assistant' THEN 'a' || session ELSE 'u' || seq END AS native_identity, CASE WHEN role IN ('user', 'assistant') THEN 'message.created' ELSE 'system.notice' END AS event_type, CASE role WHEN 'assistant' THEN count(*) OVER w ELSE 1 END AS entity_revision, turn AS timestamp_ms, CASE role WHEN 'assistant' THEN string_agg(text, '|') OVER w ELSE text END AS said FROM msg WINDOW w AS (PARTITION BY session, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    T.MSG,
)
def provider_claude(spark, sf):
    message = F.struct(F.when(F.col("role") == "assistant", F.concat(F.lit("a"), "session")).alias("id"), "role", _content().alias("content"))
    raw = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("u"), "seq").alias("uuid"), _id().alias("sessionId"), F.col("turn").alias("timestamp"), message.alias("message")))
    got = providers.claude(_lines(spark, sf, raw))
    content = F.coalesce(providers.at("$.message.content", "event"), providers.at("$.entry.message.content", "event"))
    said = F.array_join(F.transform(F.from_json(content, "array<struct<text string>>"), lambda b: b["text"]), "|")
    return got.select("native_session_id", "native_identity", "event_type", "entity_revision", "timestamp_ms", said.alias("said"))


@query(
    "SELECT 's' || session AS native_session_id, CASE role WHEN 'user' THEN 'response_item:' || (turn + 1) * 1000 ELSE 'r' || seq END AS native_identity, CASE role WHEN 'user' THEN 'message.created' ELSE 'reasoning.created' END AS event_type, context FROM (SELECT *, last_value(CASE WHEN role = 'system' THEN turn END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn) AS context FROM msg) WHERE role <> 'system'",
    T.MSG,
)
def provider_codex(spark, sf):
    kind = F.when(F.col("role") == "system", "turn_context").otherwise("response_item")
    payload = F.struct(F.when(F.col("role") == "user", "message").when(F.col("role") == "assistant", "reasoning").alias("type"), F.when(F.col("role") == "assistant", F.concat(F.lit("r"), "seq")).alias("id"), F.when(F.col("role") == "system", F.col("turn")).alias("turn"))
    head = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(_id().alias("id")).alias("payload")))
    got = providers.codex(_lines(spark, sf, F.to_json(F.struct(kind.alias("type"), payload.alias("payload"))), head))
    return got.select("native_session_id", "native_identity", "event_type", providers.at("$.turnContext.turn", "event").cast("long").alias("context"))


@query("SELECT 's' || session AS native_session_id, 'p' || seq AS native_identity, CASE role WHEN 'assistant' THEN 'tool.completed' ELSE 'message.created' END AS event_type, turn AS timestamp_ms FROM msg UNION ALL SELECT DISTINCT 's' || session, 's' || session, 'session.started', 0 FROM msg", T.MSG)
def provider_pi(spark, sf):
    role = F.when(F.col("role") == "assistant", "toolResult").otherwise(F.col("role"))
    raw = F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("p"), "seq").alias("id"), F.col("turn").cast("string").alias("timestamp"), F.struct(role.alias("role"), _content().alias("content")).alias("message")))
    head = F.to_json(F.struct(F.lit("session").alias("type"), _id().alias("id")))
    return providers.pi(_lines(spark, sf, raw, head)).select("native_session_id", "native_identity", "event_type", "timestamp_ms")


@query("SELECT 's' || session AS native_session_id, string_agg(text, '' ORDER BY turn) AS said FROM msg WHERE role = 'assistant' GROUP BY session", T.MSG)
def provider_deepseek_partials(spark, sf):
    chunk = F.struct(F.lit("text-delta").alias("type"), F.col("text"))
    raw = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("assistant/chunk").alias("type"), "seq", F.struct(F.lit("m").alias("messageId"), chunk.alias("chunk")).alias("data"))))
    raw = F.coalesce(raw, F.to_json(F.struct(F.lit("user/message").alias("type"), "seq", F.struct(F.col("text")).alias("data"))))
    head = F.to_json(F.struct(F.lit("session").alias("type"), _id().alias("id")))
    got = providers.deepseek(_lines(spark, sf, raw, head)).where("event_type = 'message.partial'")
    return got.select("native_session_id", providers.at("$.content[0].text", "event").alias("said"))


@query("SELECT 'k' || session AS native_session_id, CASE turn % 2 WHEN 0 THEN 'main' ELSE 'sub' END || ':w' || seq AS native_identity, CASE role WHEN 'system' THEN 'session.summary' ELSE 'message.created' END AS event_type, CASE turn % 2 WHEN 1 THEN 'main' END AS parent FROM msg UNION ALL SELECT DISTINCT 'k' || session, 'k' || session || ':state', 'session.metadata', NULL FROM msg", T.MSG)
def provider_kimi(spark, sf):
    m = T.msg(spark, sf)
    home = F.concat(F.lit("/k/"), F.col("session"))
    state = F.concat(F.lit('{"sessionId":"k'), F.col("session"), F.lit('","agents":{"main":{},"sub":{"parentAgentId":"main"}}}'))
    states = m.select("session").distinct().select(F.concat(home, F.lit("/state.json")).alias("path"), F.length(state).cast("long").alias("length"), state.cast("binary").alias("content"))
    agent = F.when(F.col("turn") % 2 == 0, "main").otherwise("sub")
    kind = F.when(F.col("role") == "system", "compact/summary").otherwise(F.concat("role", F.lit("/message")))
    raw = F.to_json(F.struct(kind.alias("type"), F.concat(F.lit("w"), "seq").alias("id"), F.col("turn").alias("timestamp")))
    wires = m.select(F.concat(home, F.lit("/agents/"), agent, F.lit("/wire.jsonl")).alias("path"), F.lit(9_000).cast("long").alias("length"), F.col("turn").alias("line"), (F.col("turn") * 100).alias("byte_start"), (F.col("turn") * 100 + 90).alias("byte_end"), raw.alias("raw"))
    got = providers.kimi(states, wires)
    return got.select("native_session_id", "native_identity", "event_type", providers.at("$.parentAgentId", "event").alias("parent"))


# Frames: the first hundred events as one framed file


def _framed(spark, sf) -> DataFrame:
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    le4 = lambda c: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 8, "0"), i, 2) for i in (7, 5, 3, 1)]))
    e = T.ev(spark, sf).where("seq < 100")
    body = F.col("event_type").cast("binary")
    payload = F.concat(byte(F.col("seq")), F.unhex(F.lpad(F.hex("session"), 64, "0")), byte(F.lit(241)), byte(F.col("k")), byte(F.octet_length(body)), body)
    frame = F.concat(le4(F.octet_length(payload)), le4(F.crc32(payload)), payload)
    every = e.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex(frame).alias("f")))), lambda x: x["f"]), "").alias("all"))
    torn = F.concat(F.lit("00" * frames_of.HEADER), "all", F.lit("0A0000"))  # a frame that was not finished
    return every.select(F.lit("/log").alias("path"), F.unhex(torn).alias("content"))


@query("SELECT seq, lpad(lower(to_hex(session)), 64, '0') AS session_id, 241 AS kind, k AS ts_ms, event_type AS body FROM ev WHERE seq < 100", T.EV)
def frames_decoded(spark, sf):
    return frames_of.frames(_framed(spark, sf)).where("seq is not null").select("seq", "session_id", F.col("kind").cast("int").alias("kind"), "ts_ms", F.col("body").cast("string").alias("body"))


@query("SELECT CAST(64 + sum(8 + 36 + strlen(event_type)) AS BIGINT) AS data_end, max(seq) + 1 AS next_seq, count(DISTINCT session) AS session_count, count(*) AS frame_count, 'torn' AS stopped FROM ev WHERE seq < 100", T.EV)
def frames_verified(spark, sf):
    return frames_of.verified(frames_of.frames(_framed(spark, sf))).select("data_end", "next_seq", "session_count", "frame_count", "stopped")


# Canonical events and what they fold into


def _envelopes(spark, sf) -> DataFrame:
    """Of each turn a message, and a tool call of each assistant turn; of each conversation a run."""
    m = T.msg(spark, sf)
    at = F.concat(F.lit("2024-01-01T00:00:0"), F.col("turn"), F.lit("Z"))
    origin = F.struct(F.lit("L1").alias("layer"), F.lit("x").alias("adapter"), F.lit(True).alias("authenticated"))
    run = F.concat(F.lit("r"), "session").alias("runId")

    def event(rows, kind, name, links, payload):
        return rows.select("session", "seq", F.to_json(F.struct(F.lit("1.0").alias("schemaVersion"), F.concat(F.lit(name), "seq").alias("eventId"), F.lit(kind).alias("type"), _id().alias("sessionId"), at.alias("timestamp"), origin.alias("source"), F.lit("authoritative").alias("authority"), F.lit(1.0).alias("confidence"), F.struct(*links).alias("correlation"), payload.alias("payload"))).alias("event"))

    message = F.struct(F.struct("role", _content().alias("content")).alias("message"), F.col("turn").alias("messageIndex"))
    said = event(m, "message.completed", "m", [run, F.concat(F.lit("m"), "seq").alias("messageId")], message)
    call = F.struct(F.lit("grep").alias("toolName"), F.struct("turn").alias("args"), (F.col("turn") % 3 == 0).alias("isError"))
    tools = event(m.where("role = 'assistant'"), "tool.completed", "t", [run, F.concat(F.lit("t"), "seq").alias("toolCallId")], call)
    first = event(m.where("turn = 0"), "run.started", "b", [run], F.struct(F.lit(1).alias("x")))
    last = event(m.where("turn = 1"), "run.settled", "e", [run], F.struct(F.when(F.col("session") % 2 == 0, "cancelled").otherwise("completed").alias("state")))
    return said.unionByName(tools).unionByName(first).unionByName(last)


@query("SELECT 's' || session AS session, 'm' || seq AS id, 'r' || session AS run_id, turn AS \"order\", role, 'completed' AS state, text FROM msg", T.MSG)
def entity_messages(spark, sf):
    found = entities.messages(entities.observations(_envelopes(spark, sf)))
    return found.select("session", "id", "run_id", "order", "role", "state", F.get_json_object("content", "$[0].text").alias("text"))


@query("SELECT 's' || session AS session, 't' || seq AS id, 'grep' AS name, CASE WHEN turn % 3 = 0 THEN 'failed' ELSE 'completed' END AS state, '{\"turn\":' || turn || '}' AS arguments FROM msg WHERE role = 'assistant'", T.MSG)
def entity_tools(spark, sf):
    return entities.tools(entities.observations(_envelopes(spark, sf))).select("session", "id", "name", "state", "arguments")


@query("SELECT 's' || session AS session, 'r' || session AS id, CASE WHEN max(turn) < 1 THEN 'running' WHEN session % 2 = 0 THEN 'cancelled' ELSE 'completed' END AS state FROM msg GROUP BY session", T.MSG)
def entity_runs(spark, sf):
    return entities.runs(entities.observations(_envelopes(spark, sf))).select("session", "id", "state")


@query("SELECT 's' || session AS session, count(*) AS messages, count(*) FILTER (role = 'assistant') AS tools, 1 AS runs FROM msg GROUP BY session", T.MSG)
def entity_snapshots(spark, sf):
    return entities.snapshots(entities.observations(_envelopes(spark, sf))).select("session", "messages", "tools", F.col("runs").cast("int").alias("runs"))


@query("SELECT error, count(*) AS n FROM (SELECT unnest(CASE turn % 3 WHEN 0 THEN ['message id', 'role'] WHEN 1 THEN ['schema/type'] ELSE [] END) AS error FROM msg) GROUP BY error", T.MSG)
def envelope_errors(spark, sf):
    e = _envelopes(spark, sf).where("event LIKE '%message.completed%'").withColumn("turn", F.col("seq") % 1000)
    bad = F.when(F.col("turn") % 3 == 0, F.regexp_replace(F.regexp_replace("event", '"messageId":"[^"]*"', '"messageId":""'), '"role":"[a-z]*"', '"role":"nobody"')).when(F.col("turn") % 3 == 1, F.replace("event", F.lit("message.completed"), F.lit("no.such"))).otherwise(F.col("event"))
    found = e.withColumn("event", bad).select(F.explode(entities.errors("event")).alias("error"))
    return found.where("error <> 'correlation'").groupBy("error").agg(F.count("*").alias("n"))


@query(
    "SELECT session, row_number() OVER (PARTITION BY session ORDER BY step, turn) AS place, line FROM (SELECT DISTINCT 's' || session AS session, 0 AS step, -1 AS turn, '{\"type\":\"session_meta\",\"payload\":{\"id\":\"s' || session || '\",\"cwd\":\"/\"}}' AS line FROM msg UNION ALL SELECT DISTINCT 's' || session, 1, -1, '{\"type\":\"turn_context\",\"payload\":{\"cwd\":\"/\"}}' FROM msg UNION ALL SELECT 's' || session, 2, turn, '{\"type\":\"response_item\",\"payload\":{\"type\":\"message\",\"role\":\"' || role || '\",\"content\":[{\"type\":\"' || CASE role WHEN 'assistant' THEN 'output_text' ELSE 'input_text' END || '\",\"text\":' || CAST(to_json(text) AS VARCHAR) || '}]}}' FROM msg UNION ALL SELECT DISTINCT 's' || session, 3, 99, '{\"type\":\"event_msg\",\"payload\":{\"type\":\"turn_aborted\"}}' FROM msg WHERE session % 2 = 0 AND session IN (SELECT session FROM msg WHERE turn = 1))",
    T.MSG,
)
def export_codex(spark, sf):
    obs = entities.observations(_envelopes(spark, sf))
    return entities.exported_codex(entities.messages(obs), entities.runs(obs)).select("session", F.col("place").cast("long").alias("place"), "line")


@query("SELECT 's' || session AS \"sessionId\", 'm' || seq AS \"messageId\", role, lpad(CAST(row_number() OVER (PARTITION BY session ORDER BY turn) AS VARCHAR), 10, '0') AS place FROM msg", T.MSG)
def export_rows(spark, sf):
    rows = entities.exported_rows(entities.messages(entities.observations(_envelopes(spark, sf))))["messages"]
    return rows.select("sessionId", "messageId", "role", F.substring("orderKey", 1, 10).alias("place"))


@query("SELECT 'm' || seq AS event_id, role || chr(10) || text AS said FROM msg", T.MSG)
def searchable_texts(spark, sf):
    e = _envelopes(spark, sf).where("event LIKE '%message.completed%'")
    whole = e.select(F.get_json_object("event", "$.eventId").alias("event_id"), texts.index_text(F.get_json_object("event", "$.payload.message")).alias("said"))
    return whole.withColumn("said", F.regexp_replace("said", "\ntext\n", "\n"))


@query("SELECT 'm' || seq AS event_id, 'message.completed' AS event_type, false AS has_evidence FROM msg", T.MSG)
def canonical_events(spark, sf):
    e = _envelopes(spark, sf).where("event LIKE '%message.completed%'")
    log = e.select("seq", _id().alias("session_id"), F.lit(241).cast("short").alias("kind"), F.lit(0).cast("long").alias("ts_ms"), F.col("event").cast("binary").alias("body"))
    return L.canonical(log).select("event_id", "event_type", "has_evidence")


@query("SELECT seq, CASE turn % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'tool-call' ELSE 'unknown' END AS type, CASE turn % 3 WHEN 0 THEN text END AS text, CASE turn % 3 WHEN 1 THEN 'c' || seq END AS call FROM msg", T.MSG)
def content_blocks(spark, sf):
    kind = F.element_at(F.array(F.lit("input_text"), F.lit("function_call"), F.lit("strange")), (F.col("turn") % 3 + 1).cast("int"))
    content = F.to_json(F.array(F.struct(kind.alias("type"), "text", F.concat(F.lit("c"), "seq").alias("id"))))
    b = texts.blocks("content")[0]
    return T.msg(spark, sf).withColumn("content", content).select("seq", b["type"].alias("type"), b["text"].alias("text"), b["toolCallId"].alias("call"))
