"""Provider transcripts as events. Each parser is a plan over lines() of the provider's files:

path, native_session_id, native_identity, event_type, timestamp_ms, byte_start, byte_end, entity_revision,
raw, event (JSON).

State that a line needs from others of its file (the session's id, the turn's context, a message's earlier
blocks) is a window over the file's lines; a file is bounded, so such a window is too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Event types by native type, for each provider; other types are native.event.
CLAUDE = {"user": "message.created", "assistant": "message.created", "system": "system.notice", "summary": "session.summary", "custom-title": "session.title.updated", "ai-title": "session.title.updated"}
CODEX = {"message": "message.created", "function_call": "tool.called", "custom_tool_call": "tool.called", "function_call_output": "tool.completed", "custom_tool_call_output": "tool.completed", "reasoning": "reasoning.created", "token_count": "usage.updated", "turn_aborted": "turn.aborted"}
PI = {"session": "session.started", "message": "message.created", "model_change": "model.changed", "thinking_level_change": "reasoning.level.changed"}
DEEPSEEK = {"session": "session.started", "user/message": "message.created", "assistant/message": "message.created", "assistant/chunk": "message.chunk", "tool/call": "tool.called", "tool/result": "tool.completed", "turn/start": "turn.started", "turn/end": "turn.completed", "compaction/summary": "session.summary"}
IDENTITY = ["$.id", "$.uuid", "$.eventId", "$.messageId", "$.callId", "$.data.id", "$.data.message.id", "$.data.callId"]

COLUMNS = ["path", "native_session_id", "native_identity", "event_type", "timestamp_ms", "byte_start", "byte_end", "entity_revision", "raw", "event"]


def so_far() -> WindowSpec:
    return Window.partitionBy("path").orderBy("byte_start").rowsBetween(Window.unboundedPreceding, 0)


def whole_file() -> WindowSpec:
    return Window.partitionBy("path").orderBy("byte_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def at(path: str, doc: str | Column = "raw") -> Column:
    return F.get_json_object(doc, path)


def typed(kind: Column, table: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[kind], F.lit("native.event"))


def timestamp_ms(doc: str | Column = "raw", path: str = "$.timestamp") -> Column:
    """A number, a number as text, or RFC 3339 text; else, and before 1970, 0."""
    text = at(path, doc)
    ms = F.coalesce(text.try_cast("bigint"), F.unix_millis(F.try_to_timestamp(text)))
    return F.when(ms >= 0, ms).otherwise(F.lit(0).cast("bigint"))


def stem() -> Column:
    return F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)


def quoted(c: Column) -> Column:
    """A string as JSON text."""
    return F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))


def event_json(event_type: Column, kind: Column, **parts: Column) -> Column:
    """parts: values that are JSON text already; null ones become null."""
    fields = [F.concat(F.lit(f',"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in parts.items()]
    return F.concat(F.lit('{"schemaVersion":"1.0","type":"'), event_type, F.lit('","timestampMs":'), F.col("timestamp_ms").cast("string"), F.lit(',"nativeType":'), quoted(kind), *fields, F.lit("}"))


def checked(lines: DataFrame) -> DataFrame:
    """lines; malformed JSON is an error with its place."""
    bad = F.try_parse_json("raw").isNull()
    message = F.concat(F.lit("parse_error: malformed JSON at byte "), F.col("byte_start").cast("string"), F.lit(" of "), "path")
    return lines.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))


def claude(lines: DataFrame) -> DataFrame:
    """Assistant lines of one message id add blocks to it: each line is a revision with all blocks so far."""
    kind, uuid = F.coalesce(at("$.type"), F.lit("unknown")), F.coalesce(at("$.uuid"), F.concat(F.lit("offset:"), F.col("byte_start").cast("string")))
    session = F.coalesce(at("$.sessionId"), F.raise_error(F.concat(F.lit("parse_error: no sessionId at byte "), F.col("byte_start").cast("string"))))
    rows = checked(lines).select("*", kind.alias("kind"), uuid.alias("uuid"), session.alias("native_session_id"), timestamp_ms().alias("timestamp_ms"))
    reply = F.col("kind") == "assistant"
    rows = rows.withColumn("native_identity", F.when(reply, F.coalesce(at("$.message.id"), "uuid")).otherwise(F.col("uuid")))
    message = Window.partitionBy("path", "kind", "native_identity").orderBy("byte_start").rowsBetween(Window.unboundedPreceding, 0)
    inner = F.regexp_extract(at("$.message.content"), r"(?s)^\s*\[\s*(.*?)\s*\]\s*$", 1)
    rows = rows.withColumn("so_far", F.when(reply, F.array_join(F.filter(F.collect_list(F.when(reply, inner)).over(message), lambda x: x != ""), ",")))
    rows = rows.withColumn("entity_revision", F.when(reply, F.count(F.lit(1)).over(message)).otherwise(F.lit(1).cast("bigint"))).withColumn("event_type", typed(F.col("kind"), CLAUDE))
    parts = F.from_json(at("$.message"), "map<string,variant>")
    merged = F.to_json(F.map_concat(F.map_filter(parts, lambda k, v: k != "content"), F.create_map(F.lit("content"), F.parse_json(F.concat(F.lit("["), F.coalesce("so_far", F.lit("")), F.lit("]"))))))
    assistant = event_json(F.col("event_type"), F.col("kind"), message=merged, uuid=quoted(F.col("uuid")), parentUuid=quoted(at("$.parentUuid")), isSidechain=at("$.isSidechain"))
    return rows.withColumn("event", F.when(reply, assistant).otherwise(event_json(F.col("event_type"), F.col("kind"), entry=F.col("raw")))).select(*COLUMNS)


def codex(lines: DataFrame) -> DataFrame:
    """Response items, and token counts and aborts; each with the turn context before it. Session ids carry on."""
    kind = F.coalesce(at("$.type"), F.lit(""))
    rows = checked(lines).select("*", kind.alias("kind"), at("$.payload").alias("payload"), timestamp_ms().alias("timestamp_ms"))
    rows = rows.withColumn("native_session_id", F.coalesce(F.last(F.when(F.col("kind") == "session_meta", at("$.payload.id")), ignorenulls=True).over(so_far()), stem()))
    rows = rows.withColumn("context", F.last(F.when(F.col("kind") == "turn_context", F.col("payload")), ignorenulls=True).over(so_far())).withColumn("native_type", F.coalesce(at("$.payload.type"), "kind"))
    kept = rows.where((F.col("kind") == "response_item") | F.col("kind").isin("token_count", "turn_aborted") | ((F.col("kind") == "event_msg") & F.col("native_type").isin("token_count", "turn_aborted")))
    identity = F.coalesce(at("$.payload.id"), at("$.payload.call_id"), F.concat_ws(":", "kind", "byte_start"))
    kept = kept.select("*", identity.alias("native_identity"), typed(F.col("native_type"), CODEX).alias("event_type"), F.lit(1).cast("bigint").alias("entity_revision"))
    return kept.withColumn("event", event_json(F.col("event_type"), F.col("native_type"), payload=F.col("payload"), turnContext=F.col("context"))).select(*COLUMNS)


def pi(lines: DataFrame) -> DataFrame:
    """The session's id may stand anywhere in the file; tool results are messages of their role."""
    kind = F.coalesce(at("$.type"), F.lit("unknown"))
    rows = checked(lines).select("*", kind.alias("kind"), timestamp_ms().alias("timestamp_ms"), F.lit(1).cast("bigint").alias("entity_revision"))
    rows = rows.withColumn("native_session_id", F.coalesce(F.first(F.when(F.col("kind") == "session", at("$.id")), ignorenulls=True).over(whole_file()), stem()))
    rows = rows.withColumn("native_identity", F.coalesce(at("$.id"), F.concat_ws(":", "kind", "byte_start")))
    result = (F.col("kind") == "message") & (at("$.message.role") == "toolResult")
    rows = rows.withColumn("event_type", F.when(result, "tool.completed").otherwise(typed(F.col("kind"), PI)))
    return rows.withColumn("event", event_json(F.col("event_type"), F.col("kind"), entry=F.col("raw"))).select(*COLUMNS)


def kimi(states: DataFrame, wires: DataFrame) -> DataFrame:
    """states: files named state.json (path, length, content); wires: lines of their agents' wire.jsonl.
    A wire belongs to the deepest state folder above it. Agents know their parents from the state."""
    home = lambda c: F.regexp_extract(c, r"^(.*)/[^/]+$", 1)
    text = F.col("content").cast("string")
    state = states.select(F.col("path").alias("state_path"), home(F.col("path")).alias("home"), "length", text.alias("state"))
    state = state.withColumn("native_session_id", F.coalesce(at("$.sessionId", "state"), at("$.id", "state"), F.regexp_extract("home", r"([^/]+)$", 1)))
    listed = F.coalesce(F.from_json(at("$.agents", "state"), "map<string, struct<parentAgentId string, parentId string>>"), F.create_map().cast("map<string, struct<parentAgentId string, parentId string>>"))
    state = state.withColumn("parents", F.transform_values(listed, lambda k, v: F.coalesce(v["parentAgentId"], v["parentId"])))
    when = F.greatest(*[F.lit(0).cast("bigint")] * 2, F.coalesce(*[F.nullif(timestamp_ms("state", f"$.{k}"), F.lit(0).cast("bigint")) for k in ("updatedAt", "createdAt")], F.lit(0).cast("bigint")))
    own = state.select(F.col("state_path").alias("path"), "native_session_id", F.concat("native_session_id", F.lit(":state")).alias("native_identity"), F.lit("session.metadata").alias("event_type"), when.alias("timestamp_ms"), F.lit(0).cast("bigint").alias("byte_start"), F.col("length").alias("byte_end"), F.lit(1).cast("bigint").alias("entity_revision"), F.col("state").alias("raw"), F.concat(F.lit('{"schemaVersion":"1.0","type":"session.metadata","nativeType":"kimi.state","state":'), "state", F.lit("}")).alias("event"))

    folders = F.split(home(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.array_join(F.slice(folders, F.lit(1), n), "/"))
    rows = checked(wires).withColumn("agent", F.regexp_extract("path", r"([^/]+)/wire\.jsonl$", 1))
    met = rows.withColumn("home", F.explode(above)).join(state.select("home", "native_session_id", "parents"), "home")
    deepest = Window.partitionBy("path", "byte_start").orderBy(F.desc(F.length("home")))
    rows = met.withColumn("_depth", F.row_number().over(deepest)).where("_depth = 1")
    rows = rows.select("*", F.coalesce(at("$.type"), F.lit("unknown")).alias("kind"), timestamp_ms().alias("timestamp_ms"), F.lit(1).cast("bigint").alias("entity_revision"))
    plain = F.translate(F.lower("kind"), "_/", "..")
    has = lambda *words: F.greatest(*[plain.contains(w) for w in (*words, words[0])])
    event_type = (
        F.when(has("tool") & has("result"), "tool.completed").when(has("tool") & has("call", "use"), "tool.called").when(has("summary", "compact"), "session.summary")
        .when(has("user", "assistant", "message"), "message.created").when(has("llm.request"), "model.requested").otherwise("native.event")
    )
    identity = F.coalesce(*[at(p) for p in IDENTITY], F.concat(F.lit("seq:"), at("$.seq")), F.concat_ws(":", "agent", "byte_start"))
    rows = rows.withColumn("event_type", event_type).withColumn("native_identity", F.concat_ws(":", "agent", identity))
    wired = rows.withColumn("event", event_json(F.col("event_type"), F.col("kind"), agentId=quoted(F.col("agent")), parentAgentId=quoted(F.col("parents")[F.col("agent")]), entry=F.col("raw"))).select(*COLUMNS)
    return own.unionByName(wired)


def deepseek(lines: DataFrame) -> DataFrame:
    """The first line is the header. Packed chunk records are taken apart; a message's deltas are put
    together again as one message.partial."""
    rows = checked(lines)
    first = F.first("raw").over(whole_file())
    header = F.when(at("$.type", first) == "session", first).otherwise(F.raise_error(F.concat(F.lit("parse_error: no header record in "), "path")))
    rows = rows.withColumn("header", header).withColumn("native_session_id", F.coalesce(at("$.id", "header"), F.raise_error(F.lit("parse_error: the header has no id"))))
    packed = F.when(at("$.type").endswith("-chunks"), F.from_json(F.coalesce(at("$.data.chunks"), at("$.chunks")), "array<string>"))
    one = F.array(F.lit(None).cast("string"))
    rows = rows.select("*", packed.isNotNull().alias("packed"), F.posexplode(F.coalesce(packed, one)).alias("part", "piece"))
    rows = rows.withColumn("kind", F.when(F.col("packed"), "assistant/chunk").otherwise(F.coalesce(at("$.type"), F.lit("unknown"))))
    rows = rows.withColumn("chunk", F.when(F.col("packed"), F.col("piece")).when(F.col("kind") == "assistant/chunk", F.coalesce(at("$.data.chunk"), at("$.data"))))
    rows = rows.withColumn("timestamp_ms", F.greatest(timestamp_ms(), timestamp_ms("header"))).withColumn("event_type", typed(F.col("kind"), DEEPSEEK)).withColumn("entity_revision", F.lit(1).cast("bigint"))
    call = F.when(~F.col("packed"), F.coalesce(at("$.data.callId"), at("$.data.message.source.callId"), at("$.data.message.content[0].toolCallId")))
    named = [at(p) if not p.startswith("$.data") else F.when(~F.col("packed"), at(p)) for p in IDENTITY]
    identity = F.coalesce(*named, F.concat(F.lit("seq:"), at("$.seq")), call, F.concat_ws(":", "byte_start", "part"))
    entry = F.when(F.col("packed"), F.to_json(F.map_concat(F.map_filter(F.from_json("raw", "map<string,variant>"), lambda k, v: ~k.isin("type", "data")), F.create_map(F.lit("type"), F.parse_json(F.lit('"assistant/chunk"')), F.lit("data"), F.parse_json(F.concat(F.lit('{"chunk":'), F.coalesce("piece", F.lit("null")), F.lit(',"packedIndex":'), F.col("part").cast("string"), F.lit("}"))))))).otherwise(F.col("raw"))
    events = rows.withColumn("native_identity", identity).withColumn("event", event_json(F.col("event_type"), F.col("kind"), callId=quoted(call), entry=entry))

    key = F.coalesce(at("$.messageId"), F.when(~F.col("packed"), at("$.data.messageId")), F.lit("current"))
    kind, delta = at("$.type", "chunk"), F.coalesce(at("$.text", "chunk"), at("$.delta", "chunk"), F.lit(""))
    tool = F.when(kind == "tool-call-delta", F.coalesce(at("$.id", "chunk"), at("$.callId", "chunk"), F.lit("unknown")))
    deltas = rows.where(F.col("chunk").isNotNull() & kind.isin("text-delta", "reasoning-delta", "tool-call-delta")).select("path", "native_session_id", "length", key.alias("message"), F.when(kind == "tool-call-delta", "2").when(kind == "text-delta", "1").otherwise("0").alias("rank"), tool.alias("tool"), "byte_start", "part", F.when(kind == "tool-call-delta", F.coalesce(at("$.arguments", "chunk"), delta)).otherwise(delta).alias("delta"))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("byte_start", "part", "delta"))), lambda d: d["delta"]))
    texts = deltas.groupBy("path", "native_session_id", "length", "message", "rank", "tool").agg(joined.alias("text")).where((F.col("text") != "") | (F.col("rank") == "2"))
    block = F.when(F.col("rank") == "2", F.concat(F.lit('{"type":"tool-call","id":'), quoted(F.col("tool")), F.lit(',"arguments":'), quoted(F.col("text")), F.lit("}"))).otherwise(F.concat(F.when(F.col("rank") == "0", '{"type":"reasoning","text":').otherwise('{"type":"text","text":'), quoted(F.col("text")), F.lit("}")))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tool", block.alias("block")))), lambda b: b["block"]), ",")
    partial = texts.groupBy("path", "native_session_id", "length", "message").agg(content.alias("content"))
    zero = F.lit(0).cast("bigint")
    partial = partial.select("path", "native_session_id", F.concat(F.lit("chunk-message:"), "message").alias("native_identity"), F.lit("message.partial").alias("event_type"), zero.alias("timestamp_ms"), zero.alias("byte_start"), F.col("length").alias("byte_end"), F.lit(1).cast("bigint").alias("entity_revision"), F.lit("").alias("raw"), F.concat(F.lit('{"schemaVersion":"1.0","type":"message.partial","nativeType":"dsh.chunk-assembly","messageId":'), quoted(F.col("message")), F.lit(',"content":['), "content", F.lit("]}")).alias("event"))
    return events.select(*COLUMNS).unionByName(partial)


PARSERS = {"claude": claude, "codex": codex, "pi": pi, "deepseek": deepseek}
