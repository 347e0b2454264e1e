"""Merged daily sketches against direct ones and exact figures."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tickloom.operators import sketches

D0 = dt.date(2024, 1, 1)


def table(spark):
    rnd = random.Random(6)
    rows = [(D0 + dt.timedelta(days=rnd.randrange(20)), rnd.randrange(30_000), rnd.gauss(0, 1) if rnd.random() > 0.1 else None, "x") for _ in range(60_000)]
    return spark.createDataFrame(rows, "d date, k long, v double, word string")


def test_merged_equals_direct_within_the_bounds(spark):
    df = table(spark)
    daily = sketches.daily_sketches(df, "d", ["k", "word"], ["v"])
    assert daily.count() == 3 * 20
    got = {r.column_name: r for r in sketches.measured(sketches.merged(daily), (0.1, 0.5, 0.9)).collect()}
    whole = {r.column_name: r for r in sketches.measured(sketches.merged(sketches.daily_sketches(df.withColumn("d", F.lit(D0)), "d", ["k", "word"], ["v"])), (0.1, 0.5, 0.9)).collect()}
    exact = df.select("k").distinct().count()
    values = sorted(r.v for r in df.where("v IS NOT NULL").collect())
    for found in (got, whole):
        assert abs(found["k"].distinct_count - exact) <= exact * sketches.DISTINCT_ERROR and found["word"].distinct_count == 1
        assert found["k"].row_count == 60_000 and found["v"].null_count == 60_000 - len(values) and found["k"].quantiles == [None] * 3
        for rank, value in zip((0.1, 0.5, 0.9), found["v"].quantiles, strict=True):
            assert abs(sum(x <= value for x in values) / len(values) - rank) <= sketches.RANK_ERROR
    assert abs(got["k"].distinct_count - whole["k"].distinct_count) <= 2 * exact * sketches.DISTINCT_ERROR


def test_a_new_day_reads_no_history(spark, tmp_path):
    df, path = table(spark), str(tmp_path / "s")
    sketches.store_days(sketches.daily_sketches(df.where(F.col("d") < D0 + dt.timedelta(days=19)), "d", ["k"], ["v"]), path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("*.parquet")}
    new = sketches.daily_sketches(df.where(F.col("d") == D0 + dt.timedelta(days=19)), "d", ["k"], ["v"])
    sketches.store_days(new, path)
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    got = {r.column_name: r for r in sketches.measured(sketches.merged(sketches.stored(spark, path))).collect()}
    assert got["k"].row_count == 60_000 and set(got) == {"k", "v"}
    nothing = sketches.daily_sketches(df.where("false"), "d", ["k"], ["v"])
    assert nothing.count() == 0 and sketches.measured(sketches.merged(nothing)).count() == 0
    empty = sketches.daily_sketches(df.withColumns({"k": F.lit(None).cast("long"), "v": F.lit(None).cast("double")}), "d", ["k"], ["v"])
    assert [(r.distinct_count, r.quantiles) for r in sketches.measured(sketches.merged(empty)).collect()] == [(0, [None] * 3)] * 2


def test_exact_count_beside_a_sketch_keeps_no_sketch_per_key(spark, tmp_path):
    from tickloom.catalog.table_queries import approx_distinct

    rows = [(i // 3 if i % 7 else None,) for i in range(9_000)]
    spark.createDataFrame(rows, "l_orderkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = approx_distinct(spark, str(tmp_path))
    assert tuple(found.first()) == (True, 3_000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    keyed = [line for line in plan.splitlines() if "Aggregate [l_orderkey" in line]
    assert keyed and not any("approx" in line for line in keyed)
