"""Stages, predicates, projections, sequences, graph bounds, and streams equal to batches."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tracelake.errors import EngineError
from tracelake.functions import predicates as P
from tracelake.operators import folds, graph, search, sequences
from tracelake.operators.stages import Rows
from tracelake.plans import fixed, views
from tracelake.sources import log as L
from tracelake.streaming import follow, replay, windows


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([(1, "b", 2.0), (2, None, 1.0), (3, "a", None), (4, "b", 2.0)], "id long, s string, v double")


def test_two_valued_logic(few):
    assert ids(few.where(P.ne(F.col("s"), "b"))) == [2, 3] and ids(few.where(~P.ne(F.col("s"), "b"))) == [1, 4]
    assert ids(few.where(P.not_in(F.col("s"), ["b"]))) == [2, 3]
    assert ids(few.where(P.between(F.col("v"), 1.0, 2.0))) == [2]
    with pytest.raises(Exception, match="type_error"):
        few.where(P.ordered(F.col("v"), ">", 0)).collect()
    assert ids(few.where(P.both(F.col("v").isNotNull(), P.ordered(F.col("v"), ">", 0)))) == [1, 2, 4]


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1", r"a*+"])
def test_only_re2(pattern):
    with pytest.raises(EngineError):
        P.matches(None, pattern)


def test_durations():
    assert [P.duration_ms(x) for x in ("5ms", "2s", "3m", "1h", "2d")] == [5, 2000, 180000, 3600000, 172800000]
    with pytest.raises(EngineError):
        P.duration_ms("2w")


def test_order_and_limits(spark, few):
    rows = Rows.of(few, "id")
    assert ids(rows.sort_by(("s", "asc"), ("v", "desc")).rows()) == [2, 3, 1, 4]
    assert ids(rows.sort_by(("v", "desc")).limit(2, offset=1).rows()) == [4, 2]
    assert rows.project(key="s").sort_by(("id", "desc")).rows().columns == ["key"]
    with pytest.raises(EngineError) as e:
        rows.limit(1001)
    assert e.value.code == "unsupported_capability"
    with pytest.raises(EngineError) as e:
        rows.project(x="nope")
    assert e.value.code == "unknown_field"
    many = Rows.of(spark.range(1500), "id").result()
    assert many.warnings == ["implicit_limit"] and many.rows.count() == 1000
    assert rows.limit(1).result().warnings == [] and rows.where(F.col("id") > 2).result().explain()[1] == {"stage": "where", "in": 4, "rows": 2}


def test_snapshot_is_fixed(spark):
    log = spark.createDataFrame([(i, "s") for i in range(20)], "seq long, session_id string")
    more = log.unionByName(spark.createDataFrame([(20, "s")], log.schema))
    at = lambda df: ids(Rows.of(df, "seq", seq="seq", as_of=20).rows(), "seq")
    assert at(log) == at(more) == list(range(20))
    page = L.page(more, 5, 10)
    assert ids(page.rows, "seq") == list(range(5, 15)) and page.has_more and page.next_from_seq == 15
    assert not L.page(more, 15, 10).has_more
    with pytest.raises(EngineError):
        L.snapshot(more, 21, most=20)
    assert ids(L.recent(more, 2), "seq") == [19, 20]
    assert L.stats(log.limit(0)).first().next_seq == 0


def test_canonical_events(spark):
    event = {"schemaVersion": "1.0", "eventId": "e", "type": "t", "sessionId": "s", "timestamp": "2026-01-01T00:00:00Z", "payload": {}}
    proof = {"sessionId": "s", "eventId": "e", "sourcePath": "p", "sourceDigest": "0" * 64, "byteStart": 0, "byteEnd": 5, "parserVersion": "1"}
    bodies = [event, {"event": event, "evidence": proof}, {"event": event, "evidence": {**proof, "byteEnd": -1}}, {**event, "sessionId": "other"}, {k: v for k, v in event.items() if k != "payload"}, "text"]
    rows = [(i, "s", 241, 0, bytearray(json.dumps(b).encode())) for i, b in enumerate(bodies)] + [(9, "s", 1, 0, bytearray(b"\xff{"))]
    got = L.canonical(spark.createDataFrame(rows, L.SCHEMA)).orderBy("seq").collect()
    assert [(r.seq, r.has_evidence) for r in got] == [(0, False), (1, True), (2, False)]


def body(**b):
    return bytearray(json.dumps(b).encode())


def test_projection(spark):
    event = lambda i, identity, gen=0, path="f": body(provider="pi", nativeSessionId="n", sourcePath=path, sourceGeneration=gen, eventId=i, nativeIdentity=identity, event='{"title":null}', evidenceSeqs=[0])
    memory = lambda rev, action: body(memoryId="m", action=action, content="c", scope="{}", evidenceSeqs=[0], revision=rev, updatedAtMs=1)
    records = [(views.EVENT, event("e1", "a")), (views.EVENT, event("e1", "a")), (views.EVENT, event("e2", "a")), (views.EVENT, event("e3", "b")), (views.VISIBILITY, body(action="supersede", provider="pi", sourcePath="f", sourceGeneration=0)), (views.EVENT, event("e4", "a", 1)), (views.MEMORY, memory(1, "candidate")), (views.MEMORY, memory(2, "approve")), (views.MEMORY, memory(2, "revoke")), (views.CHECKPOINT, body(provider="pi", sourcePath="f", committedOffset=1)), (views.CHECKPOINT, body(provider="pi", sourcePath="f", committedOffset=7))]
    log = spark.createDataFrame([(i, "s", k, 100 - i, b) for i, (k, b) in enumerate(records)], L.SCHEMA)
    made = views.projection(log)
    assert {r.eventId: (r.seq, r.current, r.visible) for r in made["events"].collect()} == {"e1": (0, False, False), "e2": (2, True, False), "e3": (3, True, False), "e4": (5, True, True)}
    session = made["sessions"].first()
    assert (session.first_seen_ms, session.last_updated_ms, session.title, session.event_count, session.active) == (100, 100, None, 1, True)
    assert made["memories"].first().status == "approved" and made["checkpoints"].first().committedOffset == 7
    assert made["links"].count() == 4
    assert fixed.memory_list(made["memories"], "approved").count() == 1
    with pytest.raises(EngineError):
        fixed.checked(provider="other")
    with pytest.raises(EngineError):
        fixed.checked(start=2, end=1)


def test_present_null_wins(spark):
    obs = spark.createDataFrame([("x", "old", True, 0, 1, 1.0, 1, "a"), ("x", None, True, 0, 2, 1.0, 1, "b"), ("x", "absent", False, 0, 3, 1.0, 1, "c")], "entity string, value string, has boolean, phase int, revision int, confidence double, ts_ms long, event_id string")
    row = obs.groupBy("entity").agg(folds.winner("value", F.col("has")).alias("v"), folds.winner("event_id", F.col("has")).alias("e")).first()
    assert (row.v, row.e) == (None, "b")


def test_matches(spark):
    kinds = ["a", "x", "b", "a", "b", "a", "c"]
    e = spark.createDataFrame([(1, i, i * 10, k) for i, k in enumerate(kinds)] + [(2, 0, 0, "b"), (2, 1, 0, "a")], "s long, seq long, ts_ms long, k string")
    run = lambda f, *a: sorted((r.s, r.seq, r.b.seq) for r in f(e, ["s"], ["ts_ms", "seq"], e.k == "a", *a).collect())
    fields = ["seq", "ts_ms"]
    assert run(sequences.next_event, e.k == "b", fields) == [(1, 3, 4)]
    assert run(sequences.then_event, e.k == "b", fields) == [(1, 0, 2), (1, 3, 4)]
    assert run(sequences.then_event, e.k == "b", fields, ("ts_ms", 15)) == [(1, 3, 4)]
    assert run(sequences.absent_until, e.k == "x", e.k == "b", fields, ("ts_ms", 100)) == [(1, 3, 4)]
    assert run(sequences.absent_until, e.k == "b", e.k == "b", fields, ("ts_ms", 100)) == [(1, 0, 2), (1, 3, 4)]


def test_traverse_stops_at_cycles(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 0, 3), (1, 1, 4)], "src long, dst long, edge_id long")
    start = spark.createDataFrame([(0,)], "node long")
    got = sorted((r.depth, r.node, r.cycle) for r in graph.traverse(edges, start, 0, 5).collect())
    assert got == [(0, 0, False), (1, 1, False), (2, 1, True), (2, 2, False), (3, 0, True)]
    with pytest.raises(EngineError):
        graph.traverse(edges, start, 0, 99)


def test_rrf_value(spark):
    a = spark.createDataFrame([(1, 5.0), (2, 4.0)], "chunk long, s double")
    b = spark.createDataFrame([(2, 9.0), (3, 8.0)], "chunk long, s double")
    got = {r.chunk: r.score for r in search.fused(a, b, "chunk", [F.desc("s")], [F.desc("s")], 10).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})


# Streams


def test_replay_then_tail(spark, tmp_path):
    schema, folder = "seq long, k string", str(tmp_path / "log")
    write = lambda a, b: spark.range(a, b).selectExpr("id seq", "if(id % 2 = 0, 'even', 'odd') k").coalesce(1).write.mode("append").parquet(folder)
    write(0, 200)
    got, lock = [], threading.Lock()

    def sink(df, batch):
        rows = [(r.seq, r.delivery_id, batch) for r in df.collect()]
        with lock:
            got.extend(rows)
            if batch == -1:
                write(200, 210)  # appended while replaying

    even = lambda df: df.where(P.eq(F.col("k"), "even"))
    replay.subscribe(spark, folder, schema, even, sink, str(tmp_path / "cp"), bound=("q",)).awaitTermination()
    assert sorted(s for s, *_ in got) == list(range(0, 210, 2)) and len({d for _, d, _ in got}) == len(got)
    assert {b for s, _, b in got if s >= 200} != {-1}
    with pytest.raises(EngineError) as e:
        replay.subscribe(spark, folder, schema, even, sink, str(tmp_path / "cp2"), cursor=3, oldest=5)
    assert e.value.code == "cursor_expired"


def test_windows_stream_like_batch(spark, tmp_path):
    events = spark.sql("SELECT id, timestamp_seconds(1700000000 + id * 37) ts, cast(id % 3 as string) k, cast(id as double) value FROM range(200)")
    folder = str(tmp_path / "ev")
    events.repartition(3).write.parquet(folder)
    stream = windows.tumbling(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder), "ts", "10 minutes", ["k"])
    query = stream.writeStream.outputMode("complete").format("memory").queryName("win").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, windows.tumbling(events, "ts", "10 minutes", ["k"]).collect()))
    assert windows.sliding(events, "ts", "10 minutes", "5 minutes", ["k"]).count() > windows.tumbling(events, "ts", "10 minutes", ["k"]).count()
    assert windows.sessions(events, "ts", "5 minutes", ["k"]).count() == 3


def test_follow_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "a.jsonl"
    reader = follow.FollowReader({"path": f"file://{tmp_path}/in", "maxBytesPerTask": "5"})
    read = lambda start, end: [r[1:] for p in reader.partitions(start, end) for r in reader.read(p)]
    path.write_bytes(b'{"a":1}\n{"b":2}\n{"c"')
    at = reader.latestOffset()
    assert list(at.values()) == [20] and read(reader.initialOffset(), at) == [(0, 8, '{"a":1}'), (8, 16, '{"b":2}')]
    path.write_bytes(b'{"a":1}\n{"b":2}\n{"c":3}\n')
    at2 = reader.latestOffset()
    assert read(at, at2) == [(16, 24, '{"c":3}')] and read(at2, at2) == []
    path.write_bytes(b'{"n":1}\n')  # shorter: read anew
    assert read(at2, reader.latestOffset()) == [(0, 8, '{"n":1}')]
    spark.dataSource.register(follow.Follow)
    query = spark.readStream.format("follow_lines").load(f"file://{tmp_path}/in").writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        with path.open("ab") as f:
            f.write(b'{"m":2}\npartial')
        query.processAllAvailable()
        assert sorted(r.raw for r in spark.table("followed").collect()) == ['{"m":2}', '{"n":1}']
    finally:
        query.stop()


def test_match_on_a_stream_like_batch(spark, tmp_path, sf):
    from tracelake.plans import bindings
    from tracelake.streaming import matching

    e = bindings.ev(spark, sf)
    folder, bound = str(tmp_path / "ev"), P.duration_ms("1d")
    for low in range(0, 1000, 250):
        e.where(F.col("seq").between(low, low + 249)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    made = matching.then_within(stream, "session", F.col("event_type") == "signup", F.col("event_type") == "purchase", bound)
    query = made.writeStream.outputMode("append").format("memory").queryName("then_b").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    batch = sequences.then_event(e.where("seq < 1000"), ["session"], ["ts_ms", "seq"], F.col("event_type") == "signup", F.col("event_type") == "purchase", ["seq", "ts_ms"], ("ts_ms", bound))
    want = sorted((str(r.session), r.seq, r.b.seq) for r in batch.collect())
    assert want and sorted((r.key, r.a, r.b) for r in spark.table("then_b").collect()) == want
    with pytest.raises(EngineError):
        matching.then_within(e, "session", F.lit(True), F.lit(True), 0)
