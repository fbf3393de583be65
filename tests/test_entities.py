"""Envelope checks, entity folds, memories and cursors."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.errors import EngineError
from tracelake.operators import entities as E
from tracelake.plans import cursor, memory, views

N = iter(range(10_000))


def ev(kind, second=0, payload=None, layer="L2", auth=True, authority="authoritative", rev=None, conf=1.0, **link):
    e = {"schemaVersion": "1.0", "eventId": f"e{next(N):04d}", "type": kind, "sessionId": "s", "timestamp": f"2026-08-14T09:00:{second:02d}.000Z", "source": {"layer": layer, "adapter": "a", "authenticated": auth}, "authority": authority, "confidence": conf, "correlation": link, "payload": payload or {}}
    return e | ({"entityRevision": rev} if rev is not None else {})


def table(spark, events):
    return spark.createDataFrame([(json.dumps(e),) for e in events], "event string")


def test_envelopes(spark):
    good = ev("message.completed", messageId="m")
    cases = {"": good, "unexpected key": good | {"more": 1}, "schema/type": good | {"type": "other"}, "identity": good | {"timestamp": "never"}, "revision": good | {"entityRevision": -1}, "source": good | {"source": {"layer": "L9", "adapter": "a", "authenticated": True}}, "authority": good | {"authority": "me"}, "confidence": good | {"confidence": 2}, "payload": {k: v for k, v in good.items() if k != "payload"}, "correlation": good | {"correlation": {"messageId": "m", "runId": ""}}, "message id": good | {"correlation": {"runId": "r"}}, "role": good | {"payload": {"message": {"role": "nobody"}}}}
    got = [r.e for r in table(spark, cases.values()).select(E.errors().alias("e")).collect()]
    assert [",".join(e) for e in got] == list(cases)
    assert "json" in spark.createDataFrame([("{oops",)], "event string").select(E.errors().alias("e")).first().e


def test_message_fold(spark):
    msg = lambda **m: {"message": m}
    events = [
        ev("message.started", 1, msg(role="assistant", content=[{"type": "text", "text": "a"}], model="m1"), messageId="m", runId="r"),
        ev("message.updated", 2, msg(content="late", model=None), messageId="m", rev=2),
        ev("message.completed", 3, msg(usage={"n": 1}) | {"messageIndex": 4, "state": "failed"}, messageId="m", rev=2, turnId="t"),
        ev("message.completed", 9, msg(role="user", content="weak"), layer="L3", messageId="m", rev=99),
        ev("message.completed", 5, msg(role="toolResult", content="r"), messageId="n", toolCallId="c"),
        ev("message.completed", 5, msg(role="robot"), messageId=None),
    ]
    rows = {r.id: r for r in E.messages(E.observations(table(spark, events))).collect()}
    m, n = rows["m"], rows["n"]
    assert set(rows) == {"m", "n"}
    assert (m.role, m.content, m.model, m.usage, m.state, m.order, m.revision, m.run_id, m.turn_id) == ("assistant", '"late"', "null", '{"n":1}', "failed", 4, 2, "r", "t")
    assert len(m.source_events) == 4 and m.source_events == sorted(m.source_events) and m.updated_ms - m.created_ms == 2000
    assert (n.role, n.tool_result_id, n.state) == ("tool", "result:c", "completed")
    lines = [json.loads(r.line) for r in E.exported(E.messages(E.observations(table(spark, events)))).orderBy("place").collect()]
    assert [(x["id"], x["parentId"], x["message"]["role"]) for x in lines] == [("m", None, "assistant"), ("n", "m", "toolResult")]


def test_tools_runs_turns_approvals(spark):
    events = [
        ev("tool.started", 1, {"toolName": "sh", "args": {"a": 1}}, toolCallId="c", runId="r"),
        ev("tool.completed", 2, {"result": None, "isError": True}, toolCallId="c"),
        ev("run.started", 0, runId="r"), ev("run.settled", 8, {"state": "cancelled"}, runId="r"), ev("run.started", 9, runId="r2"),
        ev("turn.started", 1, {"turnIndex": 3}, turnId="t", runId="r"), ev("turn.completed", 4, turnId="t"),
        ev("approval.requested", 2, {"approvalId": "p", "summary": "ok?"}, toolCallId="c"), ev("approval.resolved", 3, {"approvalId": "p", "decision": "rejected", "reason": "no"}),
        ev("approval.requested", 2, {"approvalId": "q", "kind": "k"}), ev("approval.resolved", 3, {"approvalId": "z", "decision": "approved"}),
    ]
    obs = E.observations(table(spark, events)).cache()
    tool = E.tools(obs).first()
    assert (tool.name, tool.arguments, tool.result, tool.is_error, tool.state, tool.run_id, tool.partial_result) == ("sh", '{"a":1}', "null", "true", "failed", "r", None)
    runs = E.runs(obs)
    assert {r.id: (r.state, r.completed_ms is None) for r in runs.collect()} == {"r": ("cancelled", False), "r2": ("running", True)}
    turn = E.turns(obs).first()
    assert (turn.turn_index, turn.state, turn.run_id, turn.completed_ms - turn.started_ms) == (3, "completed", "r", 3000)
    asked = {r.id: (r.state, r.kind, r.reason, r.tool_call_id) for r in E.approvals(obs).collect()}
    assert asked == {"p": ("rejected", "permission", "no", "c"), "q": ("pending", "k", None, None)}
    assert {r.id: r.tool_ids for r in E.children(runs, E.tools(obs), "run_id", "tool_ids").collect()} == {"r": ["c"], "r2": []}
    snap = E.snapshots(obs).first()
    assert (snap.revision, snap.seq, snap.messages, snap.tools, snap.runs, snap.turns, snap.status) == (11, 10, 0, 1, 2, 1, "exited")


def test_memories(spark):
    log = spark.createDataFrame([(0, views.EVIDENCE), (1, views.EVENT)], "seq long, kind short")
    new = memory.propose(log, "m", "  keep this ", "{}", [0], 5)
    assert new.first().content == "keep this"
    for bad in ({"content": " "}, {"evidence": [1]}, {"evidence": []}, {"content": "x" * 20_000}):
        with pytest.raises(EngineError):
            memory.propose(log, **({"memory_id": "m", "content": "c", "scope": "{}", "evidence": [0], "now_ms": 1} | bad))
    now = new.withColumn("status", F.lit("candidate"))
    assert memory.move(now, "m", "approve", 1, 6).first().revision == 2
    for args in (("m", "revoke", 1), ("m", "approve", 2), ("x", "approve", 1)):
        with pytest.raises(EngineError):
            memory.move(now, *args, 6)


def test_cursors():
    token = cursor.make(b"k", "q", 10, 1, 50)
    assert cursor.read(b"k", token, "q", 10, 1) == 50
    for args in ((b"other", token, "q", 10, 1), (b"k", token[:-2] + "AA", "q", 10, 1), (b"k", token, "p", 10, 1), (b"k", token, "q", 11, 1), (b"k", "??", "q", 10, 1)):
        with pytest.raises(EngineError):
            cursor.read(*args)
    assert cursor.following(b"k", "q", 10, 1, 0, 9, 10) is None and cursor.following(b"k", "q", 10, 1, 0, 10, 10)
