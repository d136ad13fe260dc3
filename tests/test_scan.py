"""Running values by chunks: equal to a plain fold, whatever the cuts, and spread over tasks."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docframe.operators import markdown as M
from docframe.operators import scan


def plain(rows):
    """A row at a time: (group, place, sum, last, before, after)."""
    out = []
    for group in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: r[1])
        total, last = 0, None
        for i, (_, place, n, v) in enumerate(mine):
            total, last = total + (n or 0), v if v is not None else last
            out.append((group, place, total, last, mine[i - 1][3] if i else None, mine[i + 1][3] if i + 1 < len(mine) else None))
    return sorted(out, key=str)


def found(spark, rows, chunk):
    df = spark.createDataFrame(rows, "g string, place int, n int, v string").repartition(3)
    got = scan.scanned(df, "g", "place", {"total": F.col("n")}, {"last": F.col("v")}, {"prev": F.col("v")}, {"next": F.col("v")}, chunk)
    return sorted((tuple(r) for r in got.select("g", "place", "total", "last", "prev", "next").collect()), key=str)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-40, 40), st.none() | st.integers(-5, 5), st.none() | st.sampled_from("xyz")), max_size=60, unique_by=lambda r: r[:2]), st.sampled_from([1, 3, 7, 100]))
def test_scan_equals_fold(spark, rows, chunk):
    assert found(spark, rows, chunk) == plain(rows)


def test_one_long_group_is_spread(spark, monkeypatch):
    """A document of 200,000 lines: no task has more than a few chunks, and the rows are those of one window."""
    monkeypatch.setattr(scan, "CHUNK", 2_000)
    shape = F.element_at(F.array(*map(F.lit, ("## two %", "text", "### three %", "| a |", "| b |", "text", "```", "code", "```", ""))), (F.hash("line_no") % 10 + 10).cast("int") % 10 + 1)
    lines = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), F.lit("").alias("x")).withColumn("line", F.replace(shape, F.lit("%"), F.col("line_no").cast("string"))).drop("x")
    whole = M.table_blocks(lines), M.blocks(lines), M.slides(lines), M.fenced(lines)
    spread = [sorted(map(str, df.collect())) for df in whole]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = [r["count"] for r in M.fenced(lines).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) == 4 and max(per_task) < 0.4 * sum(per_task)
    monkeypatch.setattr(scan, "CHUNK", 1 << 40)  # one chunk: a plain window
    again = M.table_blocks(lines), M.blocks(lines), M.slides(lines), M.fenced(lines)
    for a, df in zip(spread, again, strict=True):
        assert a == sorted(map(str, df.collect()))


def test_empty(spark):
    assert found(spark, [], 5) == []
    assert found(spark, [("a", 5, None, None)], 5) == [("a", 5, 0, None, None, None)]


@pytest.mark.parametrize("name", ["_group", "total"])
def test_own_columns_are_kept_or_replaced(spark, name):
    df = spark.createDataFrame([("a", 1, 2, 9)], f"g string, place int, n int, {name} int")
    got = scan.scanned(df, "g", "place", {"total": F.col("n")}).collect()[0].asDict()
    assert got["total"] == 2 and (name == "total" or got[name] == 9)
