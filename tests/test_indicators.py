"""Hand-computed indicator cases and invariants."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind

DAY = dt.date(2020, 1, 1)


def series(spark, values, column="close_price", code="600000.SH", **more):
    rows = [(code, DAY + dt.timedelta(days=i), v, *[c[i] for c in more.values()]) for i, v in enumerate(values)]
    schema = f"security_code string, trade_date date, {column} double" + "".join(f", {n} double" for n in more)
    return spark.createDataFrame(rows, schema)


def column(df, name):
    return [r[name] for r in df.orderBy("trade_date").collect()]


def test_moving_averages_of_a_ramp(spark):
    df = series(spark, [float(i) for i in range(1, 25)], volume=[float(i) for i in range(1, 25)])
    last = ind.moving_averages(df).orderBy(F.col("trade_date").desc()).first()
    assert (last.price_ma_3, last.price_ma_6, last.price_ma_12, last.price_ma_24) == (23, 21.5, 18.5, 12.5)
    assert last.price_avg_ma_3_6_12_24 == pytest.approx((23 + 21.5 + 18.5 + 12.5) / 4)
    assert last.price_ma_28 is None and last.price_avg_ma_14_28_57_114 is None


def test_wide_means_equal_direct_means(spark):
    rnd = random.Random(1)
    values = [None if rnd.random() < 0.1 else rnd.uniform(10, 20) for _ in range(300)]
    got = column(ind.means(series(spark, values), "close_price", {57: "a", 250: "b"}), "b")
    seen = []
    for value, g in zip(values, got, strict=True):
        if value is None:
            assert g is None
            continue
        seen.append(value)
        assert (g is None) if len(seen) < 250 else g == pytest.approx(sum(seen[-250:]) / 250, abs=1e-9)


def test_nulls_do_not_move_the_window(spark):
    assert column(ind.sma(series(spark, [1.0, None, 2.0, 3.0]), "close_price", 3), "sma_3") == [None, None, None, 2.0]


def test_bollinger_of_a_ramp(spark):
    rows = ind.bollinger(series(spark, [float(i) for i in range(1, 51)])).orderBy("trade_date").collect()
    sigma = math.sqrt(33.25)
    assert rows[19].boll_mid_20 == 10.5
    assert rows[19].boll_upper_20 == pytest.approx(10.5 + 2 * sigma, abs=1e-9)
    assert rows[49].boll_mid_50 == 25.5
    assert rows[49].boll_lower_50 == pytest.approx(25.5 - 2.5 * math.sqrt(208.25), abs=1e-9)


def test_rsi_first_values(spark):
    rnd = random.Random(2)
    df = ind.rsi(series(spark, [rnd.uniform(5, 15) for _ in range(60)]))
    six, fifty = column(df, "rsi_6"), column(df, "rsi_50")
    assert six[5] is None and six[6] is not None
    assert fifty[49] is None and fifty[50] is not None
    assert all(v is None or 0 <= v <= 100 for v in six + fifty)


@pytest.mark.parametrize("values, expected", [([5.0] * 10, 50.0), ([float(i) for i in range(10)], 100.0), ([float(-i) for i in range(10)], 0.0)])
def test_rsi_edges(spark, values, expected):
    assert column(ind.rsi(series(spark, values), windows=(6,)), "rsi_6")[-1] == expected


def test_rsv_and_kdj_start(spark):
    df = series(spark, [11.0, 11.0, 11.0], high_price=[10.0, 11.0, 12.0], low_price=[8.0, 8.0, 8.0])
    df = df.withColumn("close_price", F.lit(11.0))
    row = ind.kdj(df, windows=(3, 3, 3)).orderBy(F.col("trade_date").desc()).first()
    assert row.rsv == 75
    k = 2 / 3 * 50 + 1 / 3 * 75
    d = 2 / 3 * 50 + 1 / 3 * k
    assert (row.k_value, row.d_value, row.j_value) == pytest.approx((k, d, 3 * k - 2 * d))


def test_macd_by_hand(spark):
    rnd = random.Random(3)
    xs = [rnd.uniform(5, 15) for _ in range(80)]

    def ema(values, n):
        out, state, seed = [], None, []
        for v in values:
            if v is None:
                out.append(None)
            elif state is None:
                seed.append(v)
                state = sum(seed) / n if len(seed) == n else None
                out.append(state)
            else:
                state = 2 / (n + 1) * v + (1 - 2 / (n + 1)) * state
                out.append(state)
        return out

    fast, slow = ema(xs, 12), ema(xs, 26)
    dif = [a - b if a is not None and b is not None else None for a, b in zip(fast, slow, strict=True)]
    dea = ema(dif, 9)
    got = ind.macd(series(spark, xs))
    for name, wanted in (("macd_dif", dif), ("macd_dea", dea)):
        for g, w in zip(column(got, name), wanted, strict=True):
            assert (g is None and w is None) or g == pytest.approx(w, abs=1e-9)


def test_continuing_equals_full_history(spark):
    rnd = random.Random(4)
    df = series(spark, [None if rnd.random() < 0.1 else rnd.uniform(5, 15) for _ in range(120)])
    steps = [ind.rsi_step(), ind.macd_step(), ind.ema2_step()]
    full = ind.recurrences(df, steps)
    cut = full.where("close_price is not null").orderBy("trade_date").collect()[79]
    names = [c for s in steps for c in s.states if c != "previous_close"]
    state = spark.createDataFrame(
        [(cut.security_code, cut.trade_date, cut.close_price, *[cut[n] for n in names])],
        "security_code string, state_date date, previous_close double" + "".join(f", {n} double" for n in names),
    )
    more = ind.recurrences(df, steps, state).where(F.col("trade_date") > F.lit(cut.trade_date))
    for name in ("rsi_6", "rsi_50", "macd_dif", "macd_dea", "price_ema2_10"):
        wanted = column(full.where(F.col("trade_date") > F.lit(cut.trade_date)), name)
        for g, w in zip(column(more, name), wanted, strict=True):
            assert (g is None and w is None) or g == pytest.approx(w, abs=1e-9)


def test_bad_input_fails(spark):
    twice = series(spark, [1.0, 2.0]).withColumn("trade_date", F.lit(DAY))
    with pytest.raises(Exception, match="strictly increasing"):
        ind.ema(twice, n=1).collect()
    with pytest.raises(Exception, match="finite"):
        ind.ema(series(spark, [1.0, float("inf")]), n=1).collect()


def best_structure(bars):
    """Plain search over all choices of the last 20 bars."""
    best = None
    h, n = bars[-1][0], len(bars)
    for a, b, c in itertools.combinations(range(n - 1), 3):
        l1, h1, l2 = bars[a][1], bars[b][0], bars[c][1]
        if h1 / l1 - 1 < 0.08 or h1 <= l1 or l2 / l1 < 1.01 or not 0.25 <= (h1 - l2) / (h1 - l1) <= 0.75:
            continue
        stage = 3 if h >= h1 else 2 if h / l2 >= 1.03 else 1
        key = (stage, c, b, -a)
        if best is None or key > best[0]:
            best = (key, (l2 / l1, (h1 - l2) / (h1 - l1), h / l2))
    return best


def test_structure_against_plain_search(spark):
    rnd = random.Random(5)
    lows = [rnd.uniform(8, 12) for _ in range(90)]
    highs = [x * rnd.uniform(1.0, 1.15) for x in lows]
    for i in (0, 30, 31, 60):
        lows[i] = None
    got = ind.n_structure(series(spark, highs, "high_price", low_price=lows)).orderBy("trade_date").collect()
    window, shown = [], None
    for high, low, row in zip(highs, lows, got, strict=True):
        if low is not None:
            window = [*window, (high, low)][-20:]
            shown = best_structure(window)
        assert row.n_structure_stage == (ind.STAGES[shown[0][0]] if shown else "none")
        assert row.is_valid_n_structure == bool(shown and shown[0][0] >= 2)
        if shown:
            assert (row.higher_low_ratio, row.pullback_depth, row.rebound_ratio) == pytest.approx(shown[1])


def test_streaks(spark):
    closes = [1.0, 2.0, 3.0, 3.0, 4.0, None, 5.0, 4.0, 3.0]
    previous = [None, 1.0, 2.0, 3.0, 3.0, 4.0, 4.0, 5.0, 4.0]
    df = ind.streaks(series(spark, closes, prev_close_price=previous))
    assert column(df, "close_up_streak_days") == [None, 1, 2, 0, 1, None, 1, 0, 0]
    assert column(df, "close_down_streak_days") == [None, 0, 0, 0, 0, None, 0, 1, 2]


def test_partitioning_does_not_matter(spark):
    rnd = random.Random(6)
    df = series(spark, [rnd.uniform(5, 15) for _ in range(60)]).unionByName(series(spark, [rnd.uniform(5, 15) for _ in range(60)], code="000001.SZ"))
    a = ind.rsi(df.coalesce(1)).orderBy("security_code", "trade_date").collect()
    b = ind.rsi(df.repartition(7, F.rand(1))).orderBy("security_code", "trade_date").collect()
    assert a == b


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_share_one_shuffle_and_sort(spark):
    df = series(spark, [1.0] * 5, volume=[2.0] * 5, high_price=[3.0] * 5, low_price=[1.0] * 5)
    plan = physical(ind.means(df, "close_price", {n: f"m{n}" for n in (3, 5, 60, 250)}))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert physical(ind.moving_averages(df)).count("Exchange hashpartitioning") == 1
    steps = [ind.rsi_step(), ind.macd_step(), ind.kdj_step(), ind.ema2_step()]
    assert physical(ind.recurrences(ind.rsv(df), steps)).count("Exchange hashpartitioning") == 1


def test_top_n_is_limited_before_the_shuffle(spark):
    from tickloom.catalog.screening_rule import CATALOG, RULE, signal_base
    from tickloom.plans import screening

    metrics = signal_base(spark, "/root/testdata/sf0.001")
    plan = physical(screening.signals(metrics, RULE, CATALOG, "1996-01-01", "1999-12-31"))
    assert "WindowGroupLimit" in plan


def test_scan_reads_only_needed_columns(spark):
    from tickloom.catalog.screening_rule import signal_base

    plan = signal_base(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    scan = plan[plan.rindex("ReadSchema"):].split("\n")[0]
    assert "l_returnflag" not in scan and "l_tax" not in scan


STRICT = {
    "sma": lambda df, **k: ind.sma(df, "close_price", 3, **k), "stddev": lambda df, **k: ind.rolling_stddev(df, "close_price", 3, **k),
    "averages": ind.moving_averages, "bollinger": ind.bollinger, "ema": ind.ema, "ema2": ind.ema2, "rsi": ind.rsi, "macd": ind.macd,
}


@pytest.mark.parametrize("name", sorted(STRICT))
@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_non_finite_input_is_an_error(spark, name, bad):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), bad if i == 5 else float(i), 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "security_code string, trade_date date, close_price double, volume double")
    with pytest.raises(Exception, match="must be finite"):
        STRICT[name](df).collect()
    if name in ("sma", "stddev", "averages", "bollinger"):  # recurrences always check
        STRICT[name](df, strict=False).collect()


def test_a_run_from_the_lookback_gives_the_same_bits(spark):
    rnd = random.Random(3)
    days = [dt.date(2018, 1, 1) + dt.timedelta(days=i) for i in range(600)]
    df = spark.createDataFrame([("A", d, rnd.random() * 1e6, rnd.random()) for d in days], "security_code string, trade_date date, close_price double, volume double")
    late = ind.moving_averages(df.where(f"trade_date >= date'{days[300]}'")).where(f"trade_date >= date'{days[560]}'").orderBy("trade_date").collect()
    assert late == ind.moving_averages(df).where(f"trade_date >= date'{days[560]}'").orderBy("trade_date").collect()
