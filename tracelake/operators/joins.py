"""Joins that pair records: results with calls, children with parents, what is missing or uncovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_before(df: DataFrame, keys: list[str], order: list[str], declares: Column, fields: list[str], name: str) -> DataFrame:
    """For every row the most recent earlier declaration of its key (a struct, null where there is none)."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(declares, F.struct(*fields)), ignorenulls=True).over(window))


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def parents(df: DataFrame, child: list[str], parent: list[str], fields: dict[str, str]) -> DataFrame:
    """df with fields of each row's parent, null where it has none."""
    over = df.select(*[F.col(c).alias(p) for c, p in zip(child, parent)], *[F.col(c).alias(name) for name, c in fields.items()])
    return df.join(over, parent, "left")


def coverage(records: DataFrame, evidence: list[tuple[DataFrame, list[str]]], declared: DataFrame, keys: list[str]) -> DataFrame:
    """records with `status`: mapped (some evidence names it), declared (a declared loss), or uncovered."""
    found = records
    marks = []
    for i, (table, on) in enumerate([*evidence, (declared, keys)]):
        mark = f"_m{i}"
        found = found.join(table.select(*on).distinct().withColumn(mark, F.lit(True)), on, "left")
        marks.append(F.coalesce(F.col(mark), F.lit(False)))
    mapped = marks[0]
    for m in marks[1:-1]:
        mapped = mapped | m
    status = F.when(mapped, "mapped").when(marks[-1], "declared").otherwise("uncovered")
    return found.withColumn("status", status).drop(*[f"_m{i}" for i in range(len(marks))])
