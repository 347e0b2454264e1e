"""As-of joins, running scans and the global rank against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import scans

D0 = dt.date(2020, 1, 1)


def frames(spark, seed):
    rnd = random.Random(seed)
    # Key "a" holds most of the rows on both sides.
    left = [(i, rnd.choice("aaaaabc"), D0 + dt.timedelta(days=rnd.randrange(400))) for i in range(300)]
    right = [(rnd.choice("aaaaab"), D0 + dt.timedelta(days=rnd.randrange(400)), float(rnd.randrange(50)), rnd.choice([None, 5, 30])) for _ in range(120)]
    right = [(k, t, v, None if e is None else t + dt.timedelta(days=e)) for k, t, v, e in right]
    return (
        left, right, spark.createDataFrame(left, "id int, k string, t date"), spark.createDataFrame(right, "k string, rt date, v double, till date"),
    )


@pytest.fixture
def forced_splits(spark):
    """Small tables keep all their range partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_one_hot_month_spans_all_partitions(spark, forced_splits):
    """One key, all rows in one month and many at one time: rows spread evenly, and the carry crosses partitions without a right row."""
    rnd = random.Random(1)
    left = [(i, "a", dt.datetime(2020, 5, 1) + dt.timedelta(minutes=rnd.randrange(200) * 200)) for i in range(4000)] + [(9000 + i, "a", None) for i in range(3000)] + [(99999, None, dt.datetime(2020, 5, 2))]
    right = [("a", dt.datetime(2020, 5, 1, 0, 1), 1.0), ("a", dt.datetime(2020, 5, 27), 2.0), ("a", None, 9.0)]
    ldf = spark.createDataFrame(left, "id int, k string, t timestamp")
    rdf = spark.createDataFrame(right, "k string, rt timestamp, v double")
    placed = scans.in_blocks(ldf.where("t IS NOT NULL"), ["k"], ["t"]).groupBy("_blk").count().collect()
    assert len(placed) >= 6 and max(r["count"] for r in placed) < 1200
    got = {r.id: r.v for r in scans.asof_join(ldf, rdf, ["k"], "t", "rt", columns=["v"]).collect()}
    for i, k, t in left:
        assert got[i] == (None if k is None or t is None or t < right[0][1] else 1.0 if t < right[1][1] else 2.0)
    assert len(got) == len(left)


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("direction, strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_join(spark, forced_splits, bounded, direction, strict):
    left, right, ldf, rdf = frames(spark, 7)
    got = {r.id: (r.rt, r.v) for r in scans.asof_join(
        ldf, rdf, ["k"], "t", "rt", columns=["rt", "v"], tie_break=["v"], bounded=bounded, direction=direction, strict=strict
    ).collect()}
    for i, k, t in left:
        if direction == "backward":
            fits = [(rt, v) for rk, rt, v, _ in right if rk == k and (rt < t or (rt == t and not strict))]
            want = max(fits, default=(None, None))
        else:
            fits = [(rt, v) for rk, rt, v, _ in right if rk == k and (rt > t or (rt == t and not strict))]
            first = min((rt for rt, _ in fits), default=None)
            want = max(((rt, v) for rt, v in fits if rt == first), default=(None, None))
        assert got[i] == want
    assert len(got) == len(left)


@pytest.mark.parametrize("bounded", [True, False])
def test_asof_expiry_and_inner(spark, forced_splits, bounded):
    left, right, ldf, rdf = frames(spark, 8)
    got = {r.id: r.v for r in scans.asof_join(ldf, rdf, ["k"], "t", "rt", columns=["v"], valid_to="till", tie_break=["v"], bounded=bounded).collect()}
    inner = {r.id for r in scans.asof_join(ldf, rdf, ["k"], "t", "rt", how="inner", columns=["v"], bounded=bounded).collect()}
    for i, k, t in left:
        fits = [(rt, v, e) for rk, rt, v, e in right if rk == k and rt <= t]
        if not fits:
            assert got[i] is None and i not in inner
            continue
        assert i in inner
        day = max(rt for rt, _, _ in fits)
        _, value, till = max(((rt, v, e) for rt, v, e in fits if rt == day), key=lambda x: (x[1], x[2] or dt.date.min))
        assert got[i] == (value if till is None or t <= till else None)


def test_asof_many_equals_single_joins(spark):
    _, _, ldf, rdf = frames(spark, 9)
    ldf = ldf.dropDuplicates(["k", "t"])
    rdf = rdf.dropDuplicates(["k", "rt"])
    other = rdf.select("k", F.date_add("rt", 3).alias("ot"), (F.col("v") * 2).alias("w"))
    both = scans.asof_many(ldf, ["k"], "t", [scans.Side(rdf, "rt", ("v",), valid_to="till"), scans.Side(other, "ot", ("w",))])
    one = scans.asof_join(ldf, rdf, ["k"], "t", "rt", columns=["v"], valid_to="till", bounded=True)
    two = scans.asof_join(one, other, ["k"], "t", "ot", columns=["w"], bounded=True)
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)


@pytest.mark.parametrize("order", ["rising", "falling", "sparse"])
def test_running_scans_split_hot_keys(spark, order):
    """Equal results whatever the sequence numbers look like, as the dates come first; few carries."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rnd = random.Random(10)
    number = {"rising": lambda i: i, "falling": lambda i: 1000 - i, "sparse": lambda i: i << 40}[order]
    rows = [(rnd.choice("aaaab"), i, number(i), float(rnd.randrange(-20, 20))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, day int, seq long, v double")
    got = scans.running(df, ["k"], ["day", "seq"], {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}).collect()
    blocks = scans.in_blocks(df, ["k"], ["day", "seq"]).groupBy("k").agg(F.countDistinct("_blk").alias("n")).where("k = 'a'").first().n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, state = {}, {}
    for k, i, _, v in rows:
        s, hi, lo = state.get(k, (0.0, float("-inf"), float("inf")))
        state[k] = want[i] = (s + v, max(hi, v), min(lo, v))
    assert {r.day: (r.s, r.hi, r.lo) for r in got} == want
    assert 1 < blocks <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_global_rank_equals_window(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice("xxxxy"), rnd.randrange(5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    got = scans.global_rank(df, ["g"], [F.col("v").desc(), F.col("id")], "r")
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id")))
    assert got.join(want, ["g", "v", "id"]).where("r <> w").count() == 0
    assert got.count() == 500


def placed_by(df):
    """Column lists by which the plan of ``df`` shuffles."""
    return [line.split("hashpartitioning(")[1] for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_blocks_are_scanned_where_they_lie(spark):
    """Windows and totals of a block, and the rows that meet their carry, are not shuffled; nulls are a key as well."""
    rows = [(None if i % 7 == 0 else "ab"[i % 2], i, float(i % 5)) for i in range(60)]
    found = scans.running(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], ["t"], {"s": ("sum", F.col("v"))})
    assert not [x for x in placed_by(found) if "_blk" in x]
    want, state = {}, {}
    for k, t, v in rows:
        state[k] = want[t] = state.get(k, 0.0) + v
    assert {r.t: r.s for r in found.collect()} == want


def test_whole_and_torn_keys(spark, forced_splits):
    rows = [(k, i) for k, n in (("a", 2000), ("b", 3), (None, 5), ("c", 4)) for i in range(n)]
    placed = scans.in_blocks(spark.createDataFrame(rows, "k string, t int"), ["k"], ["t"])
    whole, torn = scans.whole_and_torn(placed, ["k"])
    blocks = {}
    for r in placed.collect():
        blocks.setdefault(r.k, set()).add(r["_blk"])
    assert len(blocks["a"]) > 3 and any(len(b) == 1 for b in blocks.values())
    assert sorted(((r.k, r.t) for r in torn.collect()), key=repr) == sorted(((k, t) for k, t in rows if len(blocks[k]) > 1), key=repr)
    assert sorted(((r.k, r.t) for r in whole.collect()), key=repr) == sorted(((k, t) for k, t in rows if len(blocks[k]) == 1), key=repr)
