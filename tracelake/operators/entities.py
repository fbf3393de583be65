"""Canonical events and the entities they fold into: messages, tools, turns, runs, approvals, sessions.

Of an entity's events only the cohort of the highest authority counts; in it each field comes from the
best event that has the field at all (a present null counts). Values stay JSON text. Every fold is one
group-by over the cohort, so it is distributed by entity and combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.identity import order_key
from tracelake.operators import folds

# The canonical event types, layers, authorities, roles and decisions.
EVENT_TYPES = [
    "session.started", "session.ended", "session.bound", "capabilities.changed", "input.observed",
    "run.started", "run.settled", "turn.started", "turn.completed",
    "message.started", "message.updated", "message.completed",
    "tool.started", "tool.updated", "tool.completed", "approval.requested", "approval.resolved",
    "artifact.observed", "task.updated", "action.intent", "action.dispatched", "action.rejected",
    "action.applied", "action.unknown", "action.accepted", "status.changed", "unknown.observed",
]
LAYERS, AUTHORITIES, ROLES, DECISIONS = ["L1", "L2", "L3"], ["authoritative", "self_reported", "inferred"], ["system", "user", "assistant", "tool"], ["approved", "rejected", "cancelled"]
KEYS = ["schemaVersion", "eventId", "type", "sessionId", "timestamp", "entityRevision", "source", "authority", "confidence", "correlation", "payload"]
SOURCE_KEYS = ["adapter", "layer", "authenticated", "nativeEventId", "generation"]
LINKS = ["agentSessionId", "runId", "turnId", "messageId", "toolCallId", "toolResultId", "parentId", "clientActionId"]
SETTLED = ["completed", "failed", "cancelled"]

ENVELOPE = f"""schemaVersion string, eventId string, type string, sessionId string, timestamp string, entityRevision long,
source struct<layer string, adapter string, nativeEventId string, authenticated boolean, generation string>,
authority string, confidence double, correlation struct<{', '.join(f'{k} string' for k in LINKS)}>"""


def observations(events: DataFrame, event: str = "event") -> DataFrame:
    """events (event: JSON text of an envelope) as one row each: ids, links, rank, precedence, payload."""
    e = F.from_json(event, ENVELOPE)
    rows = events.select(e.alias("e"), F.try_variant_get(F.try_parse_json(event), "$.payload", "variant").alias("payload"))
    ts = F.unix_millis(F.try_to_timestamp(F.col("e.timestamp")))
    rank = folds.rank_of(F.col("e.source.layer"), F.coalesce(F.col("e.source.authenticated"), F.lit(False)), F.col("e.authority"))
    phase = F.when(F.col("e.type").isin("message.completed", "tool.completed", "turn.completed", "run.settled", "approval.resolved"), 1).otherwise(0)
    return rows.select(F.col("e.eventId").alias("event_id"), F.col("e.type").alias("type"), F.col("e.sessionId").alias("session"), F.col("e.timestamp").alias("timestamp"), ts.alias("ts_ms"), F.coalesce("e.entityRevision", F.lit(1)).alias("revision"), F.col("e.confidence").alias("confidence"), phase.alias("phase"), rank.alias("rank"), F.col("e.source").alias("source"), F.coalesce("e.correlation", F.from_json(F.lit("{}"), "struct<" + ", ".join(f"{k}: string" for k in LINKS) + ">")).alias("link"), "payload")


def errors(event: str = "event") -> Column:
    """What is wrong with an envelope, as an array of names; an empty one is valid."""
    e, text = F.from_json(event, ENVELOPE), F.col(event)
    keys = lambda path: F.json_object_keys(F.get_json_object(text, path))
    extra = lambda path, known: F.coalesce(F.size(F.array_except(keys(path), F.array(*map(F.lit, known)))) > 0, F.lit(False))
    short = lambda c, n: F.coalesce(F.length(c).between(1, n), F.lit(False))
    links = F.array_compact(F.array(*[e["correlation"][k] for k in LINKS]))
    checks = {
        "json": F.try_parse_json(text).isNull(),
        "unexpected key": extra("$", KEYS) | extra("$.source", SOURCE_KEYS) | extra("$.correlation", LINKS),
        "schema/type": ~F.coalesce((e["schemaVersion"] == "1.0") & e["type"].isin(EVENT_TYPES), F.lit(False)),
        "identity": ~(short(e["eventId"], 256) & short(e["sessionId"], 1024) & F.try_to_timestamp(e["timestamp"]).isNotNull()),
        "revision": F.coalesce(e["entityRevision"] < 0, F.lit(False)),
        "source": ~(short(e["source"]["adapter"], 256) & F.coalesce(e["source"]["layer"].isin(LAYERS), F.lit(False)) & e["source"]["authenticated"].isNotNull()),
        "authority": ~F.coalesce(e["authority"].isin(AUTHORITIES), F.lit(False)),
        "confidence": ~F.coalesce(e["confidence"].between(0, 1), F.lit(False)),
        "correlation": F.exists(links, lambda v: ~F.length(v).between(1, 1024)),
        "payload": ~F.coalesce(F.array_contains(keys("$"), "payload"), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in (checks | _by_type(e, text)).items()]))


def _by_type(e: Column, text: Column) -> dict[str, Column]:
    """What each event type asks of its links and payload."""
    kind, link = e["type"], e["correlation"]
    at = lambda path: F.get_json_object(text, f"$.payload.{path}")
    starts = lambda prefix: F.coalesce(kind.startswith(prefix), F.lit(False))
    said = lambda c, known: F.coalesce(~c.isin(known), F.lit(False))
    lacks = lambda prefix, value: starts(prefix) & F.coalesce(F.length(value) == 0, F.lit(True))
    return {
        "message id": lacks("message.", link["messageId"]),
        "tool call id": lacks("tool.", link["toolCallId"]),
        "run id": lacks("run.", link["runId"]),
        "turn id": lacks("turn.", link["turnId"]),
        "approval id": lacks("approval.", at("approvalId")),
        "client action id": lacks("action.", link["clientActionId"]),
        "role": starts("message.") & said(F.coalesce(at("message.role"), at("role")), [*ROLES, "toolResult"]),
        "run state": (kind == "run.settled") & said(at("state"), SETTLED),
        "decision": (kind == "approval.resolved") & ~F.coalesce(at("decision").isin(DECISIONS), F.lit(False)),
        "summary": (kind == "approval.requested") & at("summary").isNull(),
        "result id": starts("tool.") & F.coalesce(link["toolResultId"] != F.coalesce(at("toolResultId"), link["toolResultId"]), F.lit(False)),
        "call id": starts("tool.") & F.coalesce(link["toolCallId"] != F.coalesce(at("toolCallId"), link["toolCallId"]), F.lit(False)),
    }


def linkage_errors(messages_of: DataFrame, tools_of: DataFrame) -> DataFrame:
    """Tool links that contradict each other: session, tool_call_id, error. A call has one result id, a result
    message names a call that exists, and both name the same result."""
    calls = tools_of.select("session", F.col("id").alias("tool_call_id"), "tool_result_id")
    results = messages_of.where((F.col("role") == "tool") & F.col("tool_call_id").isNotNull()).select("session", "tool_call_id", F.col("tool_result_id").alias("said"))
    met = results.join(calls, ["session", "tool_call_id"], "left").join(calls.select("session", "tool_call_id", F.lit(True).alias("known")), ["session", "tool_call_id"], "left")
    several = results.groupBy("session", "tool_call_id").agg(F.count_distinct("said").alias("n")).where("n > 1")
    differs = met.where("known AND tool_result_id IS NOT NULL AND said <> tool_result_id")
    named = lambda df, error: df.select("session", "tool_call_id", F.lit(error).alias("error"))
    return named(met.where("known IS NULL"), "result of an unknown call").union(named(several, "several results of a call")).union(named(differs, "call and result differ")).distinct()


def has(path: str) -> Column:
    """Whether the payload has the path; JSON null counts."""
    return F.try_variant_get("payload", path, "variant").isNotNull()


def text(path: str) -> Column:
    return F.try_variant_get("payload", path, "string")


def best(value: Column, present: Column) -> Column:
    """Aggregate: the value of the best event among those in which the field is present."""
    return F.max_by(F.struct(value.alias("v")), F.when(present, F.struct(*folds.PRECEDENCE)))["v"]


def field(*paths: str) -> Column:
    """Aggregate: a payload field as JSON text; the first path that the event has."""
    raw = F.coalesce(*[F.try_variant_get("payload", p, "variant") for p in paths])
    return best(F.to_json(raw), raw.isNotNull())


def linked(name: str) -> Column:
    return best(F.col(f"link.{name}"), F.col(f"link.{name}").isNotNull())


def _cohort(obs: DataFrame, prefix: str, id_link: str | Column) -> DataFrame:
    key = F.col(f"link.{id_link}") if isinstance(id_link, str) else id_link
    rows = obs.where(F.col("type").startswith(prefix)).withColumn("id", key).where("id is not null")
    return folds.cohort(rows, ["session", "id"], F.col("rank"))


def _common() -> list[Column]:
    key = F.struct(*folds.PRECEDENCE)
    return [F.max("revision").alias("revision"), F.min("ts_ms").alias("created_ms"), F.max("ts_ms").alias("updated_ms"), F.max_by("source", key).alias("source")]


def _with_provenance(folded: DataFrame, obs: DataFrame, prefix: str, id_link: str | Column) -> DataFrame:
    """Adds all observations' ids, those outside the cohort too."""
    key = F.col(f"link.{id_link}") if isinstance(id_link, str) else id_link
    ids = obs.where(F.col("type").startswith(prefix)).withColumn("id", key).groupBy("session", "id").agg(folds.provenance("event_id").alias("source_events"))
    return folded.join(ids, ["session", "id"])


def _state(flagged: bool = False) -> Column:
    failed = F.when(F.lit(flagged) & F.coalesce(F.try_variant_get("payload", "$.isError", "boolean"), F.lit(False)), "failed").otherwise("completed")
    said = text("$.state")
    return best(F.when(F.col("phase") == 1, F.when(said.isin(SETTLED), said).otherwise(failed)).otherwise("running"), F.lit(True))


def messages(obs: DataFrame) -> DataFrame:
    said = F.coalesce(text("$.message.role"), text("$.role"))
    role = F.when(said == "toolResult", "tool").when(said.isin(ROLES), said).otherwise("unknown")
    index = lambda k: F.try_variant_get("payload", f"$.{k}", "bigint")
    order = F.coalesce(index("messageIndex"), index("turnIndex"))
    folded = _cohort(obs, "message.", "messageId").groupBy("session", "id").agg(
        *[linked(k).alias(n) for k, n in (("runId", "run_id"), ("turnId", "turn_id"), ("parentId", "parent_id"), ("toolCallId", "tool_call_id"), ("toolResultId", "tool_result_id"))],
        F.coalesce(best(order, order.isNotNull()), F.max("ts_ms")).alias("order"),
        F.coalesce(best(role, said.isNotNull()), F.lit("unknown")).alias("role"),
        _state().alias("state"), field("$.message.content", "$.content").alias("content"),
        *[field(f"$.message.{k}", f"$.{k}").alias(n) for k, n in (("model", "model"), ("thinking", "thinking"), ("usage", "usage"), ("stopReason", "stop_reason"), ("error", "error"))],
        *_common(),
    )
    result = F.coalesce("tool_result_id", F.when(F.col("tool_call_id").isNotNull(), F.concat(F.lit("result:"), "tool_call_id")))
    return _with_provenance(folded.withColumn("tool_result_id", result), obs, "message.", "messageId")


def tools(obs: DataFrame) -> DataFrame:
    index = F.try_variant_get("payload", "$.toolIndex", "bigint")
    folded = _cohort(obs, "tool.", "toolCallId").groupBy("session", "id").agg(
        *[linked(k).alias(n) for k, n in (("runId", "run_id"), ("turnId", "turn_id"), ("messageId", "parent_message_id"), ("toolResultId", "tool_result_id"))],
        F.coalesce(best(index, index.isNotNull()), F.max("ts_ms")).alias("order"),
        F.coalesce(best(text("$.toolName"), has("$.toolName")), F.lit("unknown")).alias("name"),
        _state(True).alias("state"), field("$.args").alias("arguments"), field("$.partialResult").alias("partial_result"), field("$.result").alias("result"), field("$.isError").alias("is_error"),
        *_common(),
    )
    return _with_provenance(folded, obs, "tool.", "toolCallId")


def runs(obs: DataFrame) -> DataFrame:
    said = text("$.state")
    settled = F.col("type") == "run.settled"
    state = best(F.when(said.isin(SETTLED), said).otherwise("completed"), settled)
    folded = _cohort(obs, "run.", "runId").groupBy("session", "id").agg(F.coalesce(state, F.lit("running")).alias("state"), F.min("ts_ms").alias("started_ms"), F.max(F.when(settled, F.col("ts_ms"))).alias("completed_ms"), *_common())
    return _with_provenance(folded, obs, "run.", "runId")


def turns(obs: DataFrame) -> DataFrame:
    index = F.coalesce(F.try_variant_get("payload", "$.turnIndex", "bigint"), F.try_variant_get("payload", "$.index", "bigint"))
    done = F.col("type") == "turn.completed"
    folded = _cohort(obs, "turn.", "turnId").groupBy("session", "id").agg(linked("runId").alias("run_id"), best(index, index.isNotNull()).alias("turn_index"), F.when(F.max(done), "completed").otherwise("running").alias("state"), F.min("ts_ms").alias("started_ms"), F.max(F.when(done, F.col("ts_ms"))).alias("completed_ms"), *_common())
    return _with_provenance(folded, obs, "turn.", "turnId")


def approvals(obs: DataFrame) -> DataFrame:
    """Only approvals with a request; pending until a decision."""
    key = text("$.approvalId")
    asked, answered = F.col("type") == "approval.requested", F.col("type") == "approval.resolved"
    first = lambda v: F.min_by(F.struct(v.alias("v")), F.when(asked, F.struct("ts_ms", "event_id")))["v"]
    decision = best(text("$.decision"), answered)
    folded = _cohort(obs, "approval.", key).groupBy("session", "id").agg(
        first(F.col("link.runId")).alias("run_id"), first(F.col("link.toolCallId")).alias("tool_call_id"), F.coalesce(first(text("$.kind")), F.lit("permission")).alias("kind"),
        first(text("$.summary")).alias("summary"), F.when(decision.isin(DECISIONS), decision).alias("decision"), best(text("$.reason"), answered).alias("reason"),
        F.min(F.when(asked, F.col("ts_ms"))).alias("requested_ms"), best(F.col("ts_ms"), answered).alias("resolved_ms"), *_common(),
    )
    made = folded.where("requested_ms is not null").withColumn("state", F.coalesce("decision", F.lit("pending")))
    return _with_provenance(made, obs, "approval.", key)


def children(parents: DataFrame, rows: DataFrame, link: str, name: str) -> DataFrame:
    """parents with the ids of their rows, in order, then by id. A run has as many as its session holds."""
    listed = rows.where(F.col(link).isNotNull()).groupBy("session", F.col(link).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("order", F.col("id").alias("child")))), lambda x: x["child"]).alias(name))
    return parents.join(listed, ["session", "id"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def snapshots(obs: DataFrame) -> DataFrame:
    """A row a session: its events, revision and the counts of its entities."""
    base = obs.groupBy("session").agg(F.count("*").alias("revision"), (F.count("*") - 1).alias("seq"))
    for name, table in (("messages", messages(obs)), ("tools", tools(obs)), ("runs", runs(obs)), ("turns", turns(obs))):
        base = base.join(table.groupBy("session").agg(F.count("*").alias(name)), "session", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return base.withColumn("status", F.lit("exited"))


def exported(messages_of: DataFrame) -> DataFrame:
    """Messages as a linear JSON-lines transcript: session, place, line. A line's parent is the one before."""
    window = Window.partitionBy("session").orderBy("order", "id")
    role = F.when(F.col("role") == "tool", "toolResult").otherwise(F.col("role"))
    line = F.concat(F.lit('{"type":"message","id":'), _quoted("id"), F.lit(',"parentId":'), _quoted(F.lag("id").over(window)), F.lit(',"message":{"role":'), _quoted(role), F.lit(',"content":'), F.coalesce("content", F.lit("null")), F.lit("}}"))
    return messages_of.select("session", F.row_number().over(window).alias("place"), line.alias("line"))


def _quoted(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")), F.lit("null"))


# Exports: canonical blocks back to a harness's own, a line a record, with what could not be said.

BLOCKS = "array<struct<type string, text string, toolCallId string, name string, arguments string, content string, isError boolean, signature string>>"


def _json(**fields: Column) -> Column:
    """An object of JSON text; values that are null are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def codex_item(block: Column, role: Column) -> Column:
    """A canonical block as a response item, in JSON; null for what that harness can't hold."""
    plain = _json(type=F.lit('"message"'), role=_quoted(role), content=F.concat(F.lit('[{"type":"'), F.when(role == "assistant", "output_text").otherwise("input_text"), F.lit('","text":'), _quoted(block["text"]), F.lit("}]")))
    thought = _json(type=F.lit('"reasoning"'), summary=F.concat(F.lit('[{"type":"summary_text","text":'), _quoted(block["text"]), F.lit("}]")))
    call = _json(type=F.lit('"function_call"'), name=_quoted(block["name"]), arguments=_quoted(F.coalesce(block["arguments"], F.lit("{}"))), call_id=_quoted(block["toolCallId"]))
    result = _json(type=F.lit('"function_call_output"'), call_id=_quoted(block["toolCallId"]), output=_quoted(F.coalesce(block["content"], F.lit(""))))
    return F.when(block["type"] == "text", plain).when(block["type"] == "thinking", thought).when(block["type"] == "tool-call", call).when(block["type"] == "tool-result", result)


def exported_codex(messages_of: DataFrame, runs_of: DataFrame, cwd: str = "/") -> DataFrame:
    """session, place, line, lost: a session's rollout. First session_meta; for each run a turn_context, its
    messages' items in order, and at last how the run ended. `lost` names a block that has no item."""
    runs_in = runs_of.select("session", F.col("id").alias("run_id"), F.col("started_ms").alias("run_order"), F.col("state").alias("run_state"))
    line = lambda kind, payload: _json(type=_quoted(F.lit(kind)), payload=payload)
    none = F.lit(None).cast("string")
    meta = runs_in.groupBy("session").agg(F.min("run_order").alias("run_order")).select("session", F.lit(-1).cast("long").alias("run_order"), F.lit("").alias("run_id"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("order"), F.lit("").alias("id"), F.lit(0).alias("block"), line("session_meta", _json(id=_quoted("session"), cwd=_quoted(F.lit(cwd)))).alias("line"), none.alias("lost"))
    context = runs_in.select("session", "run_order", "run_id", F.lit(1).alias("step"), F.lit(0).cast("long").alias("order"), F.lit("").alias("id"), F.lit(0).alias("block"), line("turn_context", _json(cwd=_quoted(F.lit(cwd)))).alias("line"), none.alias("lost"))
    every = messages_of.select("session", F.coalesce("run_id", F.lit("")).alias("run_id"), "order", "id", "role", F.posexplode(F.from_json("content", BLOCKS)).alias("block", "b"))
    every = every.join(runs_in, ["session", "run_id"], "left")
    item = codex_item(F.col("b"), F.col("role"))
    items = every.select("session", F.coalesce("run_order", F.lit(0).cast("long")).alias("run_order"), "run_id", F.lit(2).alias("step"), "order", "id", "block", F.when(item.isNotNull(), line("response_item", item)).alias("line"), F.when(item.isNull(), F.col("b.type")).alias("lost"))
    ends = runs_in.where("run_state = 'cancelled'").select("session", "run_order", "run_id", F.lit(3).alias("step"), F.lit(0).cast("long").alias("order"), F.lit("").alias("id"), F.lit(0).alias("block"), line("event_msg", F.lit('{"type":"turn_aborted"}')).alias("line"), none.alias("lost"))
    rows = meta.unionByName(context).unionByName(items).unionByName(ends)
    window = Window.partitionBy("session").orderBy("run_order", "run_id", "step", "order", "id", "block")
    return rows.select("session", F.row_number().over(window).alias("place"), "line", "lost")


def exported_rows(messages_of: DataFrame) -> dict[str, DataFrame]:
    """A session's rows of the relational harness: sessions (sessionId, createdAt, updatedAt) and messages
    (messageId, sessionId, role, parts, orderKey), whose keys sort as the messages do."""
    place = F.row_number().over(Window.partitionBy("session").orderBy("order", "id"))
    rows = messages_of.select(F.col("id").alias("messageId"), F.col("session").alias("sessionId"), "role", F.coalesce("content", F.lit("[]")).alias("parts"), order_key(F.col("created_ms"), F.lit(0)).alias("_k"), place.alias("_p"), F.col("created_ms").alias("createdAt"), F.col("updated_ms").alias("updatedAt"))
    keyed = rows.withColumn("orderKey", F.concat(F.lpad(F.col("_p").cast("string"), 10, "0"), F.lit("-"), "_k")).drop("_k", "_p")
    return {"sessions": keyed.groupBy("sessionId").agg(F.min("createdAt").alias("createdAt"), F.max("updatedAt").alias("updatedAt")), "messages": keyed}
