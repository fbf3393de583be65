"""Stored generations, lists, parameters, linkage, counted explain."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.errors import EngineError
from tracelake.operators import entities, search
from tracelake.operators.stages import Rows, bound, fresh, source
from tracelake.plans import fixed, views


def record(seq, kind, **body):
    return (seq, "a" * 64, kind, 1000 + seq, json.dumps(body).encode())


@pytest.fixture(scope="module")
def log(spark):
    event = lambda i, **e: dict(provider="pi", nativeSessionId="n1", sourcePath="f", sourceGeneration=0, eventId=f"e{i}", nativeIdentity=f"i{i}", event=json.dumps(e), evidenceSeqs=[0])
    rows = [record(0, views.EVIDENCE, provider="pi", sourcePath="f", raw=[1, 2]), record(1, views.EVENT, **event(1, title="T", project="P")), record(2, views.EVENT, **event(2)), record(3, views.CHECKPOINT, provider="pi", sourcePath="f", committedOffset=9), record(4, views.MEMORY, memoryId="m", action="candidate", content="c", revision=1)]
    return spark.createDataFrame(rows, "seq long, session_id string, kind short, ts_ms long, body binary")


def test_generations_and_watermark(spark, log, tmp_path):
    folder = f"file://{tmp_path}/views"
    first = views.rebuild(log, folder, 50)
    assert first == 50 and views.rebuild(log, folder, 50, previous=first) == 51
    row = views.status(spark, folder, 6).first()
    assert (row.generation, row.built_through, row.degraded) == (51, 5, True)
    assert views.attach(spark, folder, "log_")[0] == "log_evidence"
    s = spark.sql("SELECT * FROM log_sessions").first()
    assert (s.provider, s.native_session_id, s.project, s.title, s.event_count) == ("pi", "n1", "P", "T", 2)
    with pytest.raises(Exception):
        spark.sql("INSERT INTO log_sessions SELECT * FROM log_sessions")
    for gap in (log.where("seq <> 2"), log.union(log.where("seq = 4"))):
        with pytest.raises(EngineError) as e:
            views.built_through(gap)
        assert e.value.code == "storage_error"


def test_lists(log):
    made = views.projection(log)
    sessions, events = made["sessions"], made["events"]
    assert fixed.session_list(sessions, provider="pi", project="P").count() == 1 and fixed.session_list(sessions, provider="codex").count() == 0
    assert fixed.session_detail(sessions, "a" * 64).first().title == "T"
    assert fixed.memory_get(made["memories"], "m").first().status == "candidate"
    hits = events.select("seq", F.lit(-1.0).alias("score"))
    joined = fixed.hits_with_context(hits, events.withColumn("session", F.col("session_id")), sessions, "P")
    assert [r.session_title for r in joined.collect()] == ["T", "T"]
    for bad in (lambda: fixed.session_list(sessions, provider="other"), lambda: fixed.session_list(sessions, session="short"), lambda: fixed.session_detail(sessions, "b" * 64), lambda: fixed.memory_get(made["memories"], "x")):
        with pytest.raises(EngineError):
            bad()


def test_parameters_sources_and_freshness(log):
    given = bound({"at": "2024-01-01T00:00:00Z", "for": "5m", "names": ["a"]}, {"at": "timestamp", "for": "duration", "names": "list"})
    assert given["names"] == ["a"]
    for parameters, code in (({}, "invalid_parameter"), ({"n": "x"}, "type_error"), ({"n": True}, "type_error")):
        with pytest.raises(EngineError) as e:
            bound(parameters, {"n": "int"})
        assert e.value.code == code
    for name, code in (("nope", "parse_error"), ("tools", "unsupported_capability")):
        with pytest.raises(EngineError) as e:
            source({"events": log}, name)
        assert e.value.code == code
    assert fresh({"text": 5, "vectors": 3}, ["text", "vectors"]) == 3
    with pytest.raises(EngineError) as e:
        fresh({"text": 5}, ["text"], 6)
    assert e.value.retryable


def test_counted_explain_and_groups(log):
    rows = Rows.of(log, "seq").counted().where(F.col("seq") > 1).group_by("kind").summarize(n=F.count("*"))
    result = rows.result({"text": 5})
    assert [x["rows"] for x in result.explain()] == [5, 3, 3] and result.envelope()["watermarks"] == {"text": 5}
    assert [r.kind for r in result.rows.collect()] == sorted(r.kind for r in result.rows.collect())


def test_linkage(spark):
    messages = spark.createDataFrame([("s", "m1", "tool", "c1", "r1"), ("s", "m2", "tool", "c1", "r2"), ("s", "m3", "tool", "c9", "r9"), ("s", "m4", "tool", "c2", "r2")], "session string, id string, role string, tool_call_id string, tool_result_id string")
    tools = spark.createDataFrame([("s", "c1", None), ("s", "c2", "other"), ("s", "c3", "r3")], "session string, id string, tool_result_id string")
    got = {(r.tool_call_id, r.error) for r in entities.linkage_errors(messages, tools).collect()}
    assert got == {("c1", "several results of a call"), ("c9", "result of an unknown call"), ("c2", "call and result differ")}


def test_empty_search_finds_nothing(log):
    rows = log.withColumn("text", F.col("body").cast("string"))
    assert search.search(rows, "text", "", "seq").count() == 0 and search.search(rows, "text", "PI", "seq").count() == 4
