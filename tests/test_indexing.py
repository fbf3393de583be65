"""Files to log to views: first index, a reconcile without change, an append, a rewrite."""

import json

from pyspark.sql import functions as F

from tracelake.plans import indexing, views
from tracelake.sources import lines as L


def turn(session, i, text):
    return json.dumps({"type": "user", "uuid": f"{session}-{i}", "sessionId": session, "timestamp": "2025-03-02T11:40:00Z", "message": {"role": "user", "content": text}}) + "\n"


def test_index_and_reconcile(spark, tmp_path):
    src, folder = tmp_path / "src", f"file://{tmp_path}/out"
    src.mkdir()
    for n in range(6):
        (src / f"s{n}.jsonl").write_text(turn(f"s{n}", 0, "größer") + turn(f"s{n}", 1, "two"))
    (src / "empty.jsonl").write_text("")
    found = lambda: L.files(spark, str(src)).drop("content")
    assert indexing.index(spark, "claude", found(), folder, 5) == 5
    view = lambda name: views.view(spark, f"{folder}/views", name)
    log = indexing.log(spark, folder)
    assert views.built_through(log) == log.count() == 6 * 2 * 2 + 6  # a file without bytes is not discovered
    assert view("events").where("active").count() == 12 and view("sessions").count() == 6
    evidence, linked = view("evidence"), view("links")
    rows = view("events").join(linked, F.col("seq") == F.col("event_seq")).join(evidence.select(F.col("seq").alias("evidence_seq"), "byteStart", "byteEnd", "raw", F.col("sourcePath").alias("p")), "evidence_seq").collect()
    assert len(rows) == 12
    for r in rows:
        data = open(r.p.removeprefix("file:"), "rb").read()[r.byteStart : r.byteEnd]
        assert r.p == r.sourcePath and bytes(r.raw) == data.rstrip(b"\n")

    assert indexing.reconcile(spark, "claude", found(), folder, 6) == 5  # nothing changed
    with open(src / "s1.jsonl", "a") as f:
        f.write(turn("s1", 2, "three") + '{"unfinished')
    assert indexing.append(spark, "claude", found(), folder, 7) == 30 + 3  # evidence, event, checkpoint
    assert view("events").where("active").count() == 12  # as stored
    assert views.fresh(indexing.log(spark, folder), f"{folder}/views")[0]["events"].where("active").count() == 13
    (src / "s2.jsonl").write_text(turn("s2", 9, "other"))
    gone = view("checkpoints").where(F.col("sourcePath").endswith("s3.jsonl")).select("provider", F.col("sourcePath").alias("path"), "generation")
    (src / "s3.jsonl").unlink()
    assert indexing.reconcile(spark, "claude", found(), folder, 8, gone) == 8
    assert view("events").where("active").count() == 13 - 2 + 1 - 2
    assert view("checkpoints").where(F.col("sourcePath").endswith("s2.jsonl")).first()["generation"] == 1
    whole = views.projection(indexing.log(spark, folder))
    for name in views.VIEWS:
        assert sorted(map(str, view(name).select(*whole[name].columns).collect())) == sorted(map(str, whole[name].collect())), name
