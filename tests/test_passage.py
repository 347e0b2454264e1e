"""First passage against a scan of every bar, and lots of many settings against the rules day by day."""

import datetime as dt
import random

import numpy as np
import pytest

from tickloom.operators.passage import FirstPassage, next_true
from tickloom.plans import ledger

D0 = dt.date(2024, 1, 1)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 7, 8, 9, 100, 257])
def test_first_passage_equals_a_scan(count):
    rng = np.random.default_rng(count)
    values = np.where(rng.random(count) < 0.1, np.nan, rng.normal(size=count))
    starts = rng.integers(0, count + 1, 300)
    levels = rng.normal(size=300) * 2
    for lowest in (True, False):
        got = FirstPassage(values, lowest).after(starts, lambda v: v <= levels if lowest else v >= levels)
        for start, level, at in zip(starts, levels, got, strict=True):
            hits = [i for i in range(start, count) if (values[i] <= level if lowest else values[i] >= level)]
            assert at == (hits[0] if hits else count)


def test_first_passage_asks_a_logarithm():
    asked = []
    table = FirstPassage(np.ones(8000), True)
    table.after(np.zeros(5, np.int64), lambda v: asked.append(1) or v <= 0)
    assert len(asked) <= 14


def test_next_true():
    assert next_true(np.array([False, True, False, True, False])).tolist() == [1, 1, 3, 3, 5, 5]
    assert next_true(np.array([], bool)).tolist() == [0]


SETTINGS = {
    "none": (),
    "fixed": (ledger.StopLoss(0.1), ledger.TakeProfit(0.2)),
    "timed": (ledger.TimeStop(5, 0.02), ledger.TakeProfit(0.2)),
    "below": (ledger.IndicatorStop("ma", "close_below_metric"), ledger.StopLoss(0.3)),
    "cross": (ledger.IndicatorStop("ma", "cross_below_metric"), ledger.TakeProfit(0.1)),
}


def plain_lots(rows, entries, rules, slip):
    """Day by day: the close of each held day against the rules, exit at the next open."""
    lots, free = [], D0
    by_day = {r[0]: i for i, r in enumerate(rows)}
    for entry in sorted(entries):
        if entry not in by_day or rows[by_day[entry]][1] is None or entry < free:
            continue
        start = by_day[entry]
        price = rows[start][1] * slip
        found = None
        for i in range(start, len(rows)):
            close, ma = rows[i][2], rows[i][3]
            if close is None:
                continue
            gain = close / price - 1
            yesterday = i > 0 and (rows[i][0] - rows[i - 1][0]).days == 1
            for rule in rules:
                if isinstance(rule, ledger.StopLoss):
                    hit = gain <= -rule.loss
                elif isinstance(rule, ledger.TakeProfit):
                    hit = gain >= rule.profit
                elif isinstance(rule, ledger.TimeStop):
                    hit = (rows[i][0] - entry).days >= rule.holding_days and gain < rule.max_return
                else:
                    hit = ma is not None and close < ma
                    if rule.operator == "cross_below_metric":
                        hit = hit and yesterday and rows[i - 1][2] is not None and rows[i - 1][3] is not None and rows[i - 1][2] >= rows[i - 1][3]
                if hit:
                    found = i, ledger.REASONS[type(rule)]
                    break
            if found:
                break
        out = next((j for j in range(found[0] + 1, len(rows)) if rows[j][1] is not None), None) if found else None
        lots.append((entry, rows[out][0] if out else None, found[1] if out else None, (rows[out][0] - entry).days if out else None))
        if out is None:
            break
        free = rows[out][0]
    return lots


def test_lots_of_settings(spark):
    rnd = random.Random(2)
    calendar = spark.createDataFrame(
        [(D0 + dt.timedelta(days=i), i + 1, 120, D0 + dt.timedelta(days=i - 1) if i else None) for i in range(120)],
        "trade_date date, day_no int, day_count int, prev_trade_date date",
    )
    bars, signals, by_code = [], [], {}
    for code in ("A", "B", "C"):
        price, rows = 10.0, []
        for i in range(120):
            price *= 1 + rnd.uniform(-0.06, 0.06)
            if rnd.random() < 0.1:
                continue  # no bar on that day
            gap = rnd.random()
            rows.append((D0 + dt.timedelta(days=i), None if gap < 0.05 else price * 1.01, None if 0.05 < gap < 0.1 else price, None if rnd.random() < 0.1 else 10.0))
        by_code[code] = rows
        bars += [(code, d, o, c, c, m) for d, o, c, m in rows]
    entries = {}
    for run in ("r1", "r2"):
        for code in by_code:
            entries[run, code] = rnd.sample([D0 + dt.timedelta(days=i) for i in range(120)], 25)
            signals += [(run, "a", code, d) for d in entries[run, code]] * 2
    signals.append(("r1", "a", "Z", D0))  # no bars at all
    signals.append(("r1", "a", "A", None))
    frame = spark.createDataFrame(bars, "security_code string, trade_date date, open_price_backward_adj double, close_price_backward_adj double, close_price_forward_adj double, ma double")
    asked = spark.createDataFrame(signals, "run_id string, attempt_id string, security_code string, execution_date date")
    lots = ledger.setting_lots(asked, frame, calendar, SETTINGS, 5.0)
    got = {}
    for r in lots.collect():
        got.setdefault((r.run_id, r.security_code, r.setting_id), []).append((r.entry_date, r.exit_date, r.exit_reason, r.holding_days))
    for (run, code), days in entries.items():
        for name, rules in SETTINGS.items():
            assert sorted(got.pop((run, code, name)), key=str) == sorted(plain_lots(by_code[code], set(days), rules, 1.0005), key=str), (run, code, name)
    assert not got
    one = ledger.signal_lots(asked, frame, calendar, SETTINGS["fixed"], 5.0)
    assert one.count() == lots.where("setting_id = 'fixed'").count()


def test_plan_does_not_grow_with_settings(spark):
    calendar = spark.createDataFrame([(D0, 1, 1, None)], "trade_date date, day_no int, day_count int, prev_trade_date date")
    frame = spark.createDataFrame([("A", D0, 1.0, 1.0, 1.0)], "security_code string, trade_date date, open_price_backward_adj double, close_price_backward_adj double, close_price_forward_adj double")
    asked = spark.createDataFrame([("r", "a", "A", D0)], "run_id string, attempt_id string, security_code string, execution_date date")

    def size(n):
        settings = {f"s{i}": (ledger.StopLoss(0.01 * (i + 1)), ledger.TakeProfit(0.02 * (i + 1))) for i in range(n)}
        return ledger.setting_lots(asked, frame, calendar, settings)._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert size(1) == size(100)
