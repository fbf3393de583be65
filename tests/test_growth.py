"""Catch-up of stored views, the text index, raw sessions, capture, SQLite sources, insights, resume."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tracelake.errors import EngineError
from tracelake.operators import search, text_index
from tracelake.plans import insights, views
from tracelake.sources import capture, sqlite
from tracelake.sources import log as L

LOG = "seq long, session_id string, kind short, ts_ms long, body binary"


def record(seq, kind, **body):
    return (seq, "ab"[seq % 2] * 64, kind, 1000 + seq, json.dumps(body).encode())


def event(i, identity, generation=0, path="f"):
    return dict(provider="pi", nativeSessionId="n1", sourcePath=path, sourceGeneration=generation, eventId=f"e{i}", nativeIdentity=identity, event=json.dumps({"title": f"T{i}"}), evidenceSeqs=[0])


@pytest.fixture(scope="module")
def log(spark):
    control = dict(action="supersede", provider="pi", sourcePath="f", sourceGeneration=0)
    rows = [
        record(0, views.EVIDENCE, provider="pi", sourcePath="f"), record(1, views.EVENT, **event(1, "x")), record(2, views.EVENT, **event(2, "y")),
        record(3, views.VISIBILITY, **control), record(4, views.EVENT, **event(4, "x")), record(5, views.MEMORY, memoryId="m", action="candidate", revision=1),
        record(6, views.CHECKPOINT, provider="pi", sourcePath="f", committedOffset=9), record(7, views.EVENT, **event(1, "x")), record(8, views.EVENT, **event(8, "x")),
        record(9, views.EVENT, **event(9, None, 1)), record(10, views.EVENT, **event(10, None, 1)), record(11, views.VISIBILITY, **control),
        record(12, views.MEMORY, memoryId="m", action="approve", revision=2), record(13, views.EVIDENCE, provider="pi", sourcePath="g"),
        record(14, views.CHECKPOINT, provider="pi", sourcePath="f", committedOffset=12), record(15, views.EVENT, **event(15, "x", 0, "g")),
    ]
    return spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize("at", [1, 5, 9])
def test_catch_up_equals_rebuild(spark, log, tmp_path, at):
    folder = f"file://{tmp_path}/views"
    views.rebuild(log.where(F.col("seq") < at), folder, 5)
    generation = views.catch_up(log, folder, 6)
    assert generation == 6 and views.catch_up(log, folder, 9) == 6
    for name, table in views.projection(log).items():
        got = views.view(spark, folder, name).select(*table.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, table.collect())), name
    with pytest.raises(EngineError):
        views.catch_up(log.union(spark.createDataFrame([record(18, views.EVENT, **event(18, "z"))], LOG)), folder, 9)


def test_index_equals_scan(spark, tmp_path):
    texts = ["The station", "nation, action!", None, "", "ab", "TION tion", "x" * 5000 + "tion", "stat ion", "ÄTION"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    folder = f"file://{tmp_path}/index"
    text_index.build(rows.where("id < 20"), folder, "id", "text", 7, 20, buckets=4, parts=4)
    index = text_index.opened(spark, folder)
    assert text_index.build(rows, folder, "id", "text", 7, 27, previous=index.generation, buckets=4, parts=4) == 8
    for phrase in ("tion", "xxx", "nowhere", "äti"):
        want = {r.id: round(r.score, 9) for r in search.phrase_hits(rows, "text", phrase).collect()}
        for given in ((index, rows.where("id >= 20")), (text_index.opened(spark, folder), None)):
            assert {r.id: round(r.score, 9) for r in text_index.phrase_hits(spark, given[0], phrase, given[1]).collect()} == want
    assert text_index.opened(spark, folder, 7).built_through == 20  # a search holds on to its generation
    with pytest.raises(EngineError):
        text_index.phrase_hits(spark, index, "ti")
    text_index.build(rows.where("id < 0"), f"{folder}0", "id", "text", 1, 0)
    assert text_index.phrase_hits(spark, text_index.opened(spark, f"{folder}0"), "tion", rows).count() == search.phrase_hits(rows, "text", "tion").count()


def test_raw_session(log):
    assert [r.seq for r in L.raw_session(log, "a" * 64, 4).collect()] == [4, 6, 8, 10, 12, 14]
    for bad, code in ((lambda: L.raw_session(log, "A" * 64), "invalid_parameter"), (lambda: L.raw_session(log, "a" * 64, most=7), "resource_limit")):
        with pytest.raises(EngineError) as e:
            bad()
        assert e.value.code == code


def test_capture(spark):
    sessions = spark.createDataFrame([("a" * 64, "p", "pi", "n1"), ("b" * 64, "q", "codex", "n2")], "session_id string, path string, harness string, native_session_id string")
    lines = spark.createDataFrame([("p", 0, "one"), ("p", 4, " \t "), ("p", 8, "two")], "path string, byte_start long, raw string")
    got = capture.records(lines, sessions, 50, 100).orderBy("seq").collect()
    assert [(r.seq, r.session_id[0], r.kind) for r in got] == [(100, "a", 0), (101, "a", 1), (102, "a", 1), (103, "b", 0)]
    assert json.loads(bytes(got[0].body)) == {"harness": "pi", "native_session_id": "n1", "started_at_ms": 50} and bytes(got[2].body) == b"two"
    assert capture.resumed(lines, sessions, 50, 7).agg(F.min("seq"), F.count("*")).first() == (7, 2)
    with pytest.raises(EngineError):
        capture.records(lines, sessions.union(sessions), 50, 0)


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/a b.sqlite"
    db = sqlite3.connect(path)
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("CREATE TABLE sessions (sessionId, cwd, title, status, createdAt, updatedAt, version)")
    db.execute("CREATE TABLE messages (messageId, sessionId, role, parts, attachments, toolMetadata, metadata, orderKey, createdAt, updatedAt)")
    db.execute("INSERT INTO sessions VALUES ('s1', '/w', 'T', 'open', '1', '2', 3)")
    for key, name in (("k2", "m2"), ("k1", "m1"), ("k3", "m3")):
        db.execute("INSERT INTO messages VALUES (?, 's1', 'user', '[]', NULL, NULL, NULL, ?, '1', '1')", (name, key))
    db.commit()  # still open, so the rows are in the write-ahead log only
    db.execute("DELETE FROM messages")  # and this is no part of any committed state
    rows = sqlite.databases(spark, [f"file://{path.replace(' ', '%20')}"]).collect()
    db.close()
    assert [json.loads(r.body)["messageId"] for r in sorted((r for r in rows if r.record == "message"), key=lambda r: r.ordinal)] == ["m1", "m2", "m3"]
    assert {(r.record, r.native_session_id) for r in rows} == {("session", "s1"), ("message", "s1")} and len({r.sha256 for r in rows}) == 1
    assert sqlite.databases(spark, []).count() == 0


def test_insights(spark):
    kept = spark.createDataFrame([("i1", 1, "proposed"), ("i2", 1, "proposed"), ("i2", 2, "confirmed"), ("i3", 1, "rejected")], "insight_id string, revision long, status string")
    assert [r.insight_id for r in insights.shown(kept).collect()] == ["i2"]
    asked = spark.createDataFrame([("i1", 1, "confirmed"), ("i2", 1, "superseded"), ("i3", 1, "confirmed"), ("i9", 1, "rejected")], "insight_id string, revision long, status string")
    got = {r.insight_id: (r.error, r.revision) for r in insights.transitions(kept, asked).collect()}
    assert got == {"i1": (None, 2), "i2": ("revision changed", 3), "i3": ("move not allowed", 2), "i9": ("not found", None)}
    new = spark.createDataFrame([("n1", "s", 0.5, ["e1"], "q", "k"), ("n2", "s", 2.0, ["e1"], "q", "k"), ("n3", "s", 0.5, ["e1", "e9"], "q", "k"), ("n4", "", 0.5, ["e1"], "q", "k"), ("i1", "s", 0.5, ["e1"], "q", "k"), ("n5", "s", 0.5, [], "q", "k")], "insight_id string, statement string, confidence double, evidence array<string>, query_hash string, skill string")
    events = spark.createDataFrame([("e1",), ("e1",)], "event_id string")
    errors = {r.insight_id: r.error for r in insights.appended(kept, new, events).collect()}
    assert errors == {"n1": None, "n2": "confidence", "n3": "unknown evidence", "n4": "missing field", "i1": "id is taken", "n5": "missing field"}


def test_resume(spark):
    sessions = spark.createDataFrame([("s1", "pi", "n1", False), ("s2", "pi", "n2", True), ("s3", "other", "n3", None)], "session string, provider string, native_session_id string, expired boolean")
    runtimes = spark.createDataFrame([("pi", ["resume", "open", "locate-turn"])], "provider string, offers array<string>")
    matches = spark.createDataFrame([("s1", "r", "t", "e")], "session string, run_id string, turn_id string, event_id string")
    got = {r.session: r for r in insights.resume(sessions, runtimes, matches).collect()}
    assert got["s1"].capabilities == ["resume", "open", "locate-turn"] and got["s1"].match.turn_id == "t"
    assert got["s2"].capabilities == ["open"] and got["s2"].unavailable[0].reason == "the native session has expired"
    assert got["s3"].capabilities == [] and len(got["s3"].unavailable) == 4
    assert insights.resume(sessions, runtimes).where("match is null").count() == 3
