"""Counts of stages on more rows than a query shows, and of stages that are empty."""

from pyspark.sql import functions as F

from tracelake.operators.stages import Rows


def test_stages_are_counted_to_the_last_row(spark):
    rows = Rows.of(spark.range(0, 100_000, 1, 8), "id").counted().where("id % 2 = 0").where("id % 4 = 0")
    result = rows.result()
    assert [x["rows"] for x in result.explain()] == [100_000, 50_000, 25_000] == [x["rows"] for x in result.explain()]
    assert [x["in"] for x in result.explain()] == [None, 100_000, 50_000]


def test_empty_stages_are_counted(spark):
    rows = Rows.of(spark.range(10), "id").counted().where("id < 0").group_by("id").summarize(n=F.count("*"))
    assert [x["rows"] for x in rows.result().explain()] == [10, 0, 0]
    assert [x["rows"] for x in Rows.of(spark.range(10), "id").counted().where("id > 4").limit(0).result().explain()] == [10, 5, 0]
