"""FIFO lots, uncapped lots, performance status and NAV against plain Python."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tickloom.operators import tables
from tickloom.plans import ledger, performance

D0 = dt.date(2020, 1, 1)
SCHEMA = (
    "run_id string, attempt_id string, security_code string, trade_date date, trade_seq long, side string, quantity double, "
    "gross_amount double, total_fee double, reason string"
)


def calendar(spark, n=400):
    return tables.trade_calendar(spark.createDataFrame([(D0 + dt.timedelta(days=i),) for i in range(n)], "trade_date date"))


def random_trades(seed, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        q = float(rnd.randrange(1, 6) * 100)
        rows.append(("r", "r-1", rnd.choice("AAAB"), D0 + dt.timedelta(days=i), i + 1, rnd.choice(["buy", "sell"]), q, q * rnd.randrange(5, 15), q * 0.01, "x"))
    return rows


def fifo(rows):
    lots, out = {}, {}
    for _, _, code, day, seq, side, q, gross, fee, _ in rows:
        queue = lots.setdefault(code, deque())
        if side == "buy":
            queue.append([seq, day, q, q, gross, fee])
            continue
        left = q
        while left > 0 and queue:
            lot = queue[0]
            take = min(left, lot[2])
            pnl = gross * take / q - lot[4] * take / lot[3] - lot[5] * take / lot[3] - fee * take / q
            out[(code, lot[0], seq)] = (take, pnl, (day - lot[1]).days)
            lot[2] -= take
            left -= take
            if lot[2] <= 0:
                queue.popleft()
    return out


@pytest.fixture
def many_partitions(spark):
    """Small tables stay in as many partitions as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e9 / 500])
@pytest.mark.parametrize("seed", [1, 2])
def test_fifo_against_queue(spark, many_partitions, seed, scale):
    """Raw ledgers with sells beyond the position, over several blocks, for tiny and huge quantities."""
    rows = [(*r[:6], r[6] * scale, *r[7:]) for r in random_trades(seed)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ledger.fifo_closed_trades(df, calendar(spark)).collect()
    want = fifo([(*r[:6], round(r[6] * 1e8), *r[7:]) for r in rows])
    found = {(r.security_code, r.entry_trade_seq, r.exit_trade_seq): (r.quantity * 1e8, r.realized_pnl, r.holding_days) for r in got}
    assert found.keys() == want.keys()
    for key, value in want.items():
        assert found[key] == pytest.approx(value, rel=1e-9, abs=1e-6)
    assert len({r.closed_trade_id for r in got}) == len(got)


@pytest.mark.parametrize("renumber", [lambda n: n << 40, lambda n: 10_000 - n, lambda n: (n * 7919) % 10_007])
def test_ledger_follows_dates_first(spark, many_partitions, renumber):
    """Sparse sequence numbers, and numbers that don't rise with the dates, change nothing."""
    rows = random_trades(4)
    plain = ledger.matched_ledger(spark.createDataFrame(rows, SCHEMA)).orderBy("trade_date").select("bought_upto", "sold_upto", "matched_upto").collect()
    other = [(*r[:4], renumber(r[4]), *r[5:]) for r in rows]
    assert ledger.matched_ledger(spark.createDataFrame(other, SCHEMA)).orderBy("trade_date").select("bought_upto", "sold_upto", "matched_upto").collect() == plain


def test_open_lots_are_segments_without_sell(spark, many_partitions):
    rows = random_trades(5)
    segments = ledger.fifo_segments(spark.createDataFrame(rows, SCHEMA))
    still = {(r.security_code, r.entry_trade_seq): r.q for r in ledger.lots_of(segments).where("exit_date IS NULL").groupBy("security_code", "entry_trade_seq").agg(F.sum("lot_quantity").alias("q")).collect()}
    used = {}
    for (code, entry, _), (q, _, _) in fifo(rows).items():
        used[code, entry] = used.get((code, entry), 0) + q
    left = {(r[2], r[4]): r[6] - used.get((r[2], r[4]), 0) for r in rows if r[5] == "buy"}
    assert still == pytest.approx({k: v for k, v in left.items() if v > 0})


def test_crossing_on_the_entry_day_and_unpriced_holdings(spark):
    """A lot entered on a crossing day exits; a held day without a close counts as a holding and a warning."""
    days = [D0 + dt.timedelta(days=i) for i in range(4)]
    bars = spark.createDataFrame(
        [("A", d, 10.0, c, c, 10.0) for d, c in zip(days, [11.0, 9.0, 8.5, 8.0], strict=True)],
        "security_code string, trade_date date, open_price_backward_adj double, close_price_backward_adj double, close_price_forward_adj double, m double",
    )
    held = spark.createDataFrame([("r", "r-1", "A", days[1], 10.0, days[i], i - 1) for i in (1, 2, 3)], "run_id string, attempt_id string, security_code string, entry_date date, entry_price double, trade_date date, holding_days int")
    rule = ledger.IndicatorStop("m", "cross_below_metric")
    event = ledger.exit_events(held, bars, calendar(spark, 4), [rule]).first()
    assert (event.trigger_date, event.exit_reason) == (days[1], "indicator_stop_loss")
    trades = spark.createDataFrame([("r", "r-1", c, days[0], n, "buy", 10.0, 100.0, 0.0, "x") for n, c in enumerate("AB")], SCHEMA)
    prices = spark.createDataFrame([("A", d, 11.0) for d in days] + [("B", days[0], 9.0)], "security_code string, trade_date date, close_price double")
    cal = calendar(spark, 4)
    positions = ledger.position_days(ledger.lots_of(ledger.fifo_segments(trades)), prices, cal, keep_unpriced=True)
    nav = ledger.nav_series(trades, positions, cal, 1000.0).orderBy("trade_date").collect()
    assert [(r.position_count, r.warning_count, r.position_market_value) for r in nav] == [(2, 0, 200.0), *[(2, 1, 110.0)] * 3]


def test_small_ledger_by_hand(spark):
    rows = [
        ("r", "r-1", "A", D0, 1, "buy", 100.0, 1000.0, 1.0, "x"),
        ("r", "r-1", "A", D0 + dt.timedelta(days=1), 2, "buy", 200.0, 2200.0, 2.0, "x"),
        ("r", "r-1", "A", D0 + dt.timedelta(days=2), 3, "sell", 150.0, 1800.0, 3.0, "x"),
    ]
    got = ledger.fifo_closed_trades(spark.createDataFrame(rows, SCHEMA), calendar(spark)).orderBy("entry_trade_seq").collect()
    assert [(r.quantity, round(r.realized_pnl, 6)) for r in got] == [(100.0, 197.0), (50.0, 48.5)]
    metrics = ledger.trade_metrics(ledger.fifo_closed_trades(spark.createDataFrame(rows, SCHEMA), calendar(spark))).first()
    assert (metrics.closed_trade_count, metrics.winning_trade_count, metrics.losing_trade_count) == (2, 2, 0)
    assert metrics.profit_loss_ratio is None


def test_uncapped_lots(spark):
    days = [D0 + dt.timedelta(days=i) for i in range(8)]
    opens = [10.0, 10.0, 11.0, 12.0, 20.0, 21.0, 20.0, 8.0]
    closes = [10.0, 10.5, 11.5, 15.5, 20.5, 20.0, 9.0, 8.0]
    bars = spark.createDataFrame(
        [("A", d, o, c, c) for d, o, c in zip(days, opens, closes, strict=True)],
        "security_code string, trade_date date, open_price_backward_adj double, close_price_backward_adj double, close_price_forward_adj double",
    )
    signals = spark.createDataFrame([("r", "r-1", "A", days[1]), ("r", "r-1", "A", days[2]), ("r", "r-1", "A", days[4])],
        "run_id string, attempt_id string, security_code string, execution_date date")
    rules = [ledger.StopLoss(0.2), ledger.TakeProfit(0.5)]
    lots = ledger.signal_lots(signals, bars, calendar(spark, 8), rules).orderBy("entry_date").collect()
    # The first lot takes profit at the close of day 3; the signal of day 2 finds it open, that of day 4 does not.
    assert [(r.entry_date, r.exit_date, r.exit_reason) for r in lots] == [
        (days[1], days[4], "take_profit"), (days[4], days[7], "fixed_stop_loss"),
    ]
    trades = ledger.signal_trades(signals, bars, calendar(spark, 8), rules, lot_size=100)
    assert trades.groupBy("side").count().orderBy("side").collect() == [("buy", 2), ("sell", 2)]
    assert trades.where("side = 'buy' and execution_price <= reference_price").count() == 0


def nav_frame(spark, n, r=0.01):
    rows = [("r", "r-1", D0 + dt.timedelta(days=i), None if i == 0 else r * (1 + i % 3), -0.01 * (i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "run_id string, attempt_id string, trade_date date, daily_return double, drawdown double")


def curve(spark, n, name, value):
    return spark.createDataFrame([(D0 + dt.timedelta(days=i), value) for i in range(n)], f"trade_date date, {name} double")


@pytest.mark.parametrize("n, bench_n, rf_n, status", [
    (40, 40, 40, "succeeded"), (40, 10, 40, "missing_benchmark"), (40, 40, 10, "missing_risk_free_rate"), (10, 10, 10, "insufficient_observations"),
])
def test_performance_status(spark, n, bench_n, rf_n, status):
    perf = performance.performance(nav_frame(spark, n), curve(spark, bench_n, "return_daily", 0.001), curve(spark, rf_n, "daily_rate", 0.0001))
    assert perf.first().metric_status == status
    if status == "succeeded":
        rows = {r.metric_name: (r.metric_status, r.reason_code) for r in performance.performance_status(perf).collect()}
        assert rows["beta"] == ("zero_division", "benchmark_variance_zero")
        assert rows["treynor_ratio"] == ("zero_division", "beta_zero")
        assert rows["sortino_ratio"] == ("zero_division", "downside_deviation_zero")
        assert rows["sharpe_ratio"] == ("succeeded", "none")


def test_invalid_return(spark):
    nav = nav_frame(spark, 40).withColumn("daily_return", F.when(F.dayofmonth("trade_date") == 5, float("nan")).otherwise(F.col("daily_return")))
    row = performance.performance(nav, curve(spark, 40, "return_daily", 0.001), curve(spark, 40, "daily_rate", 0.0001)).first()
    assert (row.metric_status, row.observation_count) == ("invalid_input", 0)


def test_rebase_needs_the_base_day(spark):
    nav = nav_frame(spark, 5).withColumn("total_equity", F.lit(100.0)).withColumn("nav", F.lit(1.0))
    with pytest.raises(Exception, match="no usable base equity"):
        ledger.rebase_nav(nav.where("daily_return is not null"), D0.isoformat()).collect()


def test_unfolded_days_meet_prices_without_being_placed(spark):
    """A lot of 200 days and one that never ends: days with two closes, days without, closes before, after and off the calendar."""
    cal = calendar(spark, 300)
    day = lambda i: D0 + dt.timedelta(days=i)
    lots = spark.createDataFrame(
        [("r", "r-1", "A", 1, day(20), day(220), 10.0, 50.0), ("r", "r-1", "B", 2, day(290), None, 5.0, 5.0), ("r", "r-1", "C", 3, day(1), day(3), 5.0, 5.0)],
        "run_id string, attempt_id string, security_code string, entry_trade_seq long, entry_date date, exit_date date, lot_quantity double, cost_basis double",
    )
    closes = [("A", i, float(i)) for i in (0, 19, 20, 20, 63, 64, 65, 219, 220, 299)] + [("A", 100, None), ("B", 299, 7.0), ("B", 305, 8.0), ("D", 5, 1.0)]
    bars = spark.createDataFrame([(c, day(i), p) for c, i, p in closes], "security_code string, trade_date date, close_price double")
    held = [("A", i) for i in range(20, 220)] + [("B", i) for i in range(290, 300)] + [("C", 1), ("C", 2)]
    want = [(c, day(i), p) for c, i in held for p in [x for k, n, x in closes if (k, n) == (c, i) and x is not None] or [None]]
    for unpriced in (False, True):
        found = ledger.position_days(lots, bars, cal, keep_unpriced=unpriced)
        rows = [tuple(r) for r in found.select("security_code", "trade_date", "close_price").collect()]
        assert sorted(rows, key=repr) == sorted([x for x in want if unpriced or x[2] is not None], key=repr)
        assert {r.holding_days for r in found.where("security_code = 'A' and trade_date = date'2020-03-05'").collect()} == {44.0}
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        unfolding = next(i for i, line in enumerate(plan) if "Generate explode" in line)
        assert not any("Exchange hashpartitioning" in line for line in plan[:unfolding]), "unfolded days are shuffled"


def test_whole_and_torn_ledgers_without_further_shuffles(spark, many_partitions):
    """A long ledger over several blocks beside many short ones; trades are not placed again, nor lots to meet the calendar."""
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        q = float(rnd.randrange(1, 6) * 100)
        rows.append(("r", "r-1", rnd.choice(["LONG", "LONG", f"S{rnd.randrange(40)}"]), D0 + dt.timedelta(days=i % 399), i + 1, rnd.choice(["buy", "sell"]), q, q * 10, q * 0.01, "x"))
    rows.sort(key=lambda r: (r[3], r[4]))
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of unknown size
    try:
        closed = ledger.fifo_closed_trades(df, calendar(spark))
        plan = closed._jdf.queryExecution().executedPlan().toString()
        got = {(r.security_code, r.entry_trade_seq, r.exit_trade_seq): r.quantity for r in closed.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: v[0] for k, v in fifo(rows).items()}
    assert "SortMergeJoin" not in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "_blk" in x]


def test_sides_lie_by_security_before_they_are_stacked(spark):
    """Quotes of three securities; the stack of quotes, shares and dividends is not shuffled again, and the calendar is broadcast."""
    from tickloom.plans import quotes

    day = lambda i: D0 + dt.timedelta(days=i)
    q = spark.createDataFrame(
        [(c, day(i), 10.0, 11.0, 9.0, 10.0 + i, 10.0, 100.0, 1000.0, False, False) for c in "ABC" for i in range(6)],
        "security_code string, trade_date date, open_price double, high_price double, low_price double, close_price double, prev_close_price double, volume double, amount double, is_suspend boolean, is_st boolean",
    )
    universe = spark.createDataFrame([(c, "sse_main_board") for c in "ABC"], "security_code string, security_board string")
    shares = spark.createDataFrame(
        [("A", day(1), day(3), 100.0, 80.0, 60.0), ("B", day(2), None, 50.0, 40.0, 30.0)],
        "security_code string, effective_date date, expiry_date date, shares double, float_shares_a double, free_float_shares double",
    ).repartition("security_code")
    events = spark.createDataFrame(
        [("A", day(-30), day(1), 0.5, True), ("B", day(-30), day(2), 0.25, True)],
        "security_code string, report_date date, ex_dividend_date date, cash_dividend_per_share double, has_cash_dividend boolean",
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quotes.quotes_unadj(q, universe, calendar(spark, 10), shares, events)
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        rows = {(r.security_code, (r.trade_date - D0).days): (r.shares, r.prev_close_price_unadj) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    first = next(i for i, line in enumerate(lines) if "Union" in line)
    assert not [line for line in lines[:first] if "Exchange" in line], "the stack is shuffled"
    assert not [line for line in lines if "SortMergeJoin" in line and "trade_date" in line]
    held = lambda c, i: (100.0 if 1 <= i <= 3 else None) if c == "A" else (50.0 if i >= 2 else None) if c == "B" else None
    assert rows == {(c, i): (held(c, i), 10.0 + i - 1 if i else None) for c in "ABC" for i in range(6)}
