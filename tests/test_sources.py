"""Provider transcripts, line offsets, framed logs, identities, texts."""

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.functions import identity, texts
from tracelake.operators import ingest
from tracelake.sources import lines as L
from tracelake.sources import providers as P

T = "2026-08-14T09:00:0{}.000Z"
MS = 1786698000000


def put(folder, name, rows, tail=""):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)
    return str(path)


def parsed(spark, parser, path):
    return sorted(parser(L.lines(L.files(spark, path))).collect(), key=lambda r: (r.byte_start, r.byte_end))


def test_lines_have_offsets(spark, tmp_path):
    data = '{"a":1}\r\n\n  \n{"b":"é"}\n{"unfinished":'.encode()
    (tmp_path / "x.jsonl").write_bytes(data)
    got = L.lines(L.files(spark, str(tmp_path))).orderBy("byte_start").collect()
    assert [(data[r.byte_start : r.byte_end], json.loads(r.raw)) for r in got] == [(b'{"a":1}\r\n', {"a": 1}), ('{"b":"é"}\n'.encode(), {"b": "é"})]


def test_compressed_frames(spark, tmp_path):
    import zstandard

    (tmp_path / "x.zst").write_bytes(zstandard.compress(b'{"a":1}\n') + zstandard.compress(b'{"b":2}\n'))
    assert [r.raw for r in L.lines(L.files(spark, str(tmp_path))).orderBy("byte_start").collect()] == ['{"a":1}', '{"b":2}']


def test_malformed_line_is_an_error(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"type":"user","sessionId":"s"}\n{oops\n')
    with pytest.raises(Exception, match="malformed JSON at byte 32"):
        parsed(spark, P.claude, str(tmp_path))


def test_claude_merges_blocks(spark, tmp_path):
    base = {"sessionId": "s1", "cwd": "/p", "isSidechain": False}
    rows = [
        {**base, "type": "user", "uuid": "u1", "parentUuid": None, "timestamp": T.format(0), "message": {"role": "user", "content": "hi"}},
        {**base, "type": "assistant", "uuid": "a1", "parentUuid": "u1", "timestamp": T.format(1), "message": {"id": "m1", "role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}]}},
        {**base, "type": "assistant", "uuid": "a2", "parentUuid": "a1", "timestamp": T.format(2), "message": {"id": "m1", "role": "assistant", "content": [{"type": "text", "text": "a [b], c"}]}},
        {**base, "type": "summary", "timestamp": T.format(3), "summary": "s"},
    ]
    got = parsed(spark, P.claude, put(tmp_path, "c.jsonl", rows))
    assert [(r.native_identity, r.event_type, r.entity_revision, r.timestamp_ms) for r in got[:3]] == [("u1", "message.created", 1, MS), ("m1", "message.created", 1, MS + 1000), ("m1", "message.created", 2, MS + 2000)]
    assert got[3].event_type == "session.summary" and got[3].native_identity.startswith("offset:")
    second = json.loads(got[2].event)
    assert second["message"] == {"id": "m1", "role": "assistant", "content": [rows[1]["message"]["content"][0], rows[2]["message"]["content"][0]]}
    assert second["parentUuid"] == "a1" and second["isSidechain"] is False and json.loads(got[0].event)["entry"] == rows[0]


def test_codex_carries_context(spark, tmp_path):
    rows = [
        {"timestamp": T.format(0), "type": "session_meta", "payload": {"id": "cx", "cwd": "/p"}},
        {"timestamp": T.format(1), "type": "turn_context", "payload": {"model": "m"}},
        {"timestamp": T.format(2), "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "x"}]}},
        {"timestamp": T.format(2), "type": "event_msg", "payload": {"type": "user_message", "message": "x"}},
        {"timestamp": T.format(3), "type": "response_item", "payload": {"type": "function_call", "name": "sh", "arguments": "{}", "call_id": "c1"}},
        {"timestamp": T.format(4), "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "hi"}},
        {"timestamp": T.format(5), "type": "event_msg", "payload": {"type": "token_count", "info": {}}},
    ]
    got = parsed(spark, P.codex, put(tmp_path, "roll.jsonl", rows))
    assert [r.event_type for r in got] == ["message.created", "tool.called", "tool.completed", "usage.updated"]
    assert {r.native_session_id for r in got} == {"cx"} and [r.native_identity for r in got][1:3] == ["c1", "c1"]
    assert json.loads(got[1].event)["turnContext"] == {"model": "m"} and json.loads(got[1].event)["payload"] == rows[4]["payload"]
    assert parsed(spark, P.codex, put(tmp_path, "only.jsonl", rows[2:3]))[0].native_session_id == "only"


def test_pi(spark, tmp_path):
    rows = [
        {"type": "model_change", "id": "a", "timestamp": T.format(1), "modelId": "m"},
        {"type": "session", "id": "sess", "timestamp": T.format(0)},
        {"type": "message", "id": "b", "timestamp": str(MS), "message": {"role": "toolResult", "toolCallId": "t"}},
        {"type": "message", "id": "c", "timestamp": MS + 5, "message": {"role": "user", "content": []}},
        {"type": "custom", "timestamp": "never"},
    ]
    got = parsed(spark, P.pi, put(tmp_path, "p.jsonl", rows))
    assert [(r.event_type, r.timestamp_ms) for r in got] == [("model.changed", MS + 1000), ("session.started", MS), ("tool.completed", MS), ("message.created", MS + 5), ("native.event", 0)]
    assert {r.native_session_id for r in got} == {"sess"} and got[4].native_identity.startswith("custom:")


def test_kimi(spark, tmp_path):
    put(tmp_path, "one/state.json", [])
    (tmp_path / "one/state.json").write_text(json.dumps({"sessionId": "k1", "updatedAt": T.format(6), "agents": {"main": {"id": "main"}, "agent-0": {"parentAgentId": "main"}}}))
    put(tmp_path, "one/agents/main/wire.jsonl", [{"type": "user.message", "id": "u1", "timestamp": T.format(1)}, {"type": "TOOL_result", "callId": "c", "timestamp": T.format(2)}, {"type": "context.clear", "seq": 4, "timestamp": T.format(3)}])
    put(tmp_path, "one/agents/agent-0/wire.jsonl", [{"type": "tool/use", "timestamp": T.format(4)}])
    states, wires = L.files(spark, str(tmp_path), glob="state.json"), L.lines(L.files(spark, str(tmp_path), glob="wire.jsonl"))
    got = sorted(P.kimi(states, wires).collect(), key=lambda r: (r.timestamp_ms, r.native_identity))
    assert [(r.native_identity, r.event_type) for r in got] == [("main:u1", "message.created"), ("main:c", "tool.completed"), ("main:seq:4", "native.event"), ("agent-0:agent-0:0", "tool.called"), ("k1:state", "session.metadata")]
    assert {r.native_session_id for r in got} == {"k1"}
    assert json.loads(got[3].event)["parentAgentId"] == "main" and json.loads(got[0].event)["parentAgentId"] is None


def test_deepseek(spark, tmp_path):
    rows = [
        {"type": "session", "id": "d1", "timestamp": T.format(2)},
        {"type": "user/message", "seq": 1, "timestamp": T.format(0), "data": {"message": {"id": "u1"}}},
        {"type": "assistant/chunk", "seq": 2, "timestamp": T.format(3), "data": {"messageId": "a1", "chunk": {"type": "text-delta", "text": "wor"}}},
        {"type": "assistant/chunk", "seq": 3, "timestamp": T.format(3), "data": {"messageId": "a1", "chunk": {"type": "tool-call-delta", "id": "c1", "arguments": '{"a":'}}},
        {"type": "assistant-chunks", "seq": 4, "timestamp": T.format(4), "messageId": "a1", "data": {"chunks": [{"type": "text-delta", "text": "king"}, {"type": "tool-call-delta", "id": "c1", "arguments": "1}"}]}},
        {"type": "tool/call", "timestamp": T.format(5), "data": {"callId": "c1"}},
    ]
    got = P.deepseek(L.lines(L.files(spark, put(tmp_path, "d.jsonl", rows)))).collect()
    kinds = sorted((r.byte_start, r.event_type) for r in got if r.event_type != "message.partial")
    assert [k for _, k in kinds] == ["session.started", "message.created", "message.chunk", "message.chunk", "message.chunk", "message.chunk", "tool.called"]
    partial = next(r for r in got if r.event_type == "message.partial")
    assert json.loads(partial.event)["content"] == [{"type": "text", "text": "working"}, {"type": "tool-call", "id": "c1", "arguments": '{"a":1}'}]
    user = next(r for r in got if r.native_identity == "u1")
    assert user.timestamp_ms == MS + 2000
    with pytest.raises(Exception, match="no header record"):
        P.deepseek(L.lines(L.files(spark, put(tmp_path, "e.jsonl", rows[1:])))).collect()


# Framed logs


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def frame(seq, body, kind=241):
    payload = varint(seq) + bytes(range(32)) + bytes([kind]) + varint(1786698000000) + varint(len(body)) + body
    return struct.pack("<II", len(payload), zlib.crc32(payload)) + payload


def test_frames_at_every_cut(spark, tmp_path):
    head, frames = b"\0" * 64, [frame(i, b"x" * (i * 50)) for i in range(4)]
    whole = head + b"".join(frames)
    for cut in range(len(head), len(whole) + 1):
        found, end, why = L.unframed(whole[:cut])
        n = sum(64 + sum(map(len, frames[: i + 1])) <= cut for i in range(4))
        assert len(found) == n and end == 64 + sum(map(len, frames[:n])) and why == ("end" if end == cut else "torn")
    damaged = bytearray(whole)
    damaged[64 + len(frames[0]) + 20] ^= 1
    assert L.unframed(bytes(damaged))[2] == "checksum" and len(L.unframed(bytes(damaged))[0]) == 1
    assert L.unframed(head + struct.pack("<II", 1 << 30, 0))[2] == "length"
    bad = varint(1) + b"short"
    with pytest.raises(ValueError, match="does not decode"):
        L.unframed(head + struct.pack("<II", len(bad), zlib.crc32(bad)) + bad)
    (tmp_path / "a.log").write_bytes(whole[:-3])
    records = L.frames(L.files(spark, str(tmp_path)))
    got = records.where("seq is not null").orderBy("seq").collect()
    assert [(r.seq, len(r.body), r.kind, r.session_id) for r in got] == [(i, i * 50, 241, bytes(range(32)).hex()) for i in range(3)]
    v = L.verified(records).first()
    assert (v.data_end, v.next_seq, v.session_count, v.frame_count, v.stopped) == (64 + sum(map(len, frames[:3])), 3, 1, 3, "torn")


def framed(*parts):
    return hashlib.sha256(b"".join(struct.pack("<Q", len(p)) + p for p in parts)).hexdigest()


def test_identities(spark):
    row = spark.sql("SELECT 'pi' p, 'né' n, 258L g, 'i' i, 't' t, '{}' raw").select(identity.session_id(F.col("p"), F.col("n")).alias("s"), identity.event_id(*[F.col(c) for c in ("p", "n", "g", "i", "t", "raw")]).alias("e"), identity.order_key(F.lit(1786698000000), F.lit(12345)).alias("o"), identity.iso_ms(F.lit(1786698000001)).alias("iso")).first()
    assert row.s == framed(b"pi", "né".encode())
    assert row.e == framed(b"pi", "né".encode(), struct.pack("<Q", 258), b"i", b"t", hashlib.sha256(b"{}").hexdigest().encode())
    assert row.o == f"01{1786698000000:012x}-2345" and row.iso == "2026-08-14T09:00:00.001Z"
    assert identity.stable_id({"b": 1, "a": [1, None]}) == hashlib.sha256(b'{"a":[1,null],"b":1}').hexdigest()[:32]


def test_texts_and_blocks(spark):
    event = json.dumps({"type": "message.created", "payload": {"message": {"content": [{"type": "text", "text": "one"}, {"type": "image", "text": "no"}, {"type": "text", "text": "two"}]}, "tool": {"name": "sh"}}, "raw": "hidden", "z": [{"signature": "hidden", "k": "deep"}]})
    row = spark.createDataFrame([(event,), (None,), ("{oops",)], "event string").select(texts.sdk_text().alias("sdk"), texts.index_text("event").alias("index")).collect()
    assert row[0].sdk == "message.created\none\ntwo\nsh"
    assert "hidden" not in row[0]["index"] and row[0]["index"].split("\n")[-1] == "deep" and row[1]["index"] is None and row[2]["index"] is None
    content = [json.dumps([{"type": "thinking", "thinking": "t", "signature": "s"}, {"type": "tool_use", "id": "c", "name": "n", "input": {"a": 1}}, {"type": "tool_result", "tool_use_id": "c", "content": "r", "is_error": True}, {"type": "image"}]), "plain", None]
    got = [r.b for r in spark.createDataFrame([(c,) for c in content], "c string").select(texts.blocks("c").alias("b")).collect()]
    assert [(b.type, b.text, b.toolCallId, b.arguments, b.isError, b.nativeType) for b in got[0]] == [("thinking", "t", None, None, None, None), ("tool-call", None, "c", '{"a":1}', None, None), ("tool-result", None, "c", None, True, None), ("unknown", None, None, None, None, "image")]
    assert [(b.type, b.text) for b in got[1]] == [("text", "plain")] and got[2] == []


def test_ingest(spark, tmp_path):
    c = ingest.CHUNK
    cases = {"same": (b"a" * c, b"a" * c), "more": (b"a" * (c + 5), b"a" * (c + 9)), "edit": (b"a" * (c + 5), b"b" + b"a" * (c + 8)), "tail": (b"a" * 5, b"aabaaa"), "less": (b"aaa", b"aa"), "new": (None, b"a")}
    rows = [(k, None if o is None else len(o), bytearray(o) if o is not None else None, len(n), bytearray(n)) for k, (o, n) in cases.items()]
    df = spark.createDataFrame(rows, "k string, old_length long, old binary, length long, content binary")
    df = df.withColumn("old_chunks", F.when(F.col("old").isNotNull(), ingest.fingerprints(F.coalesce("old", F.lit(b""))))).withColumn("chunks", ingest.fingerprints("content"))
    df = df.withColumn("tail", F.expr(f"sha2(substring(content, cast(old_length div {c} * {c} + 1 as int), cast(old_length % {c} as int)), 256)"))
    got = {r.k: r.what for r in df.select("k", ingest.change(F.col("old_length"), F.col("old_chunks"), F.col("length"), F.col("chunks"), F.col("tail")).alias("what")).collect()}
    assert got == {"same": "unchanged", "more": "append", "edit": "replace", "tail": "replace", "less": "replace", "new": "new"}
    records = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    numbers = ingest.numbered(records, ["k"], 50)
    assert [r.seq - 50 for r in numbers.orderBy("k").collect()] == list(range(1000))
    ingest.contiguous(numbers, 50)
    with pytest.raises(Exception, match="storage_error"):
        ingest.contiguous(numbers, 49)
    known = spark.createDataFrame([("a",)], "event_id string")
    assert [r.event_id for r in ingest.unknown(spark.createDataFrame([("a",), ("b",), ("b",)], "event_id string"), known).collect()] == ["b"]
