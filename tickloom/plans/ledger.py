"""Signals, lots, positions and NAV of many runs at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalars
from tickloom.operators.passage import FirstPassage, next_true
from tickloom.operators.scans import AFTER, BEFORE, UP_TO, in_blocks, whole_and_torn, with_carry

RUN = ("run_id", "attempt_id")
SERIES = (*RUN, "security_code")
EPSILON = 1e-9
#: Trading days of a stretch of the calendar, within which positions meet prices.
STRETCH_DAYS = 32


def next_open_signals(signals: DataFrame, calendar: DataFrame, end: str, date: str = "signal_date") -> DataFrame:
    """Execution on the next trading day, with the reason where a signal is dropped."""
    days = calendar.select(F.col("trade_date").alias(date), F.col("next_trade_date").alias("execution_date"))
    joined = signals.join(days, date, "left")
    reason = F.when(F.col("execution_date").isNull(), "no_next_trade_date").when(
        F.col("execution_date") > F.lit(end).cast("date"), "after_end_date"
    )
    return joined.withColumn("drop_reason", reason)


def dropped_signals(mapped: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return mapped.where("drop_reason is not null").groupBy(*keys, "drop_reason").agg(F.count(F.lit(1)).alias("signal_count"))


# --- exit rules ------------------------------------------------------------------------------


@dataclass(frozen=True)
class StopLoss:
    loss: float


@dataclass(frozen=True)
class TakeProfit:
    profit: float


@dataclass(frozen=True)
class TimeStop:
    holding_days: int
    max_return: float


@dataclass(frozen=True)
class IndicatorStop:
    metric: str
    operator: str = "close_below_metric"


REASONS = {StopLoss: "fixed_stop_loss", TakeProfit: "take_profit", TimeStop: "time_stop_loss", IndicatorStop: "indicator_stop_loss"}


def indicator_close() -> Column:
    return F.coalesce("close_price_forward_adj", "close_price_backward_adj")


def with_previous_bar(bars: DataFrame, calendar: DataFrame, rules: Sequence) -> DataFrame:
    """Close and metrics of the previous trading day for the crossing rules, one lag window."""
    metrics = [r.metric for r in rules if isinstance(r, IndicatorStop) and r.operator == "cross_below_metric"]
    if not metrics:
        return bars
    window = Window.partitionBy("security_code").orderBy("trade_date")
    on_time = F.lag("trade_date").over(window) == F.col("prev_trade_date")
    return bars.join(F.broadcast(calendar.select("trade_date", "prev_trade_date")), "trade_date").select(
        "*", F.when(on_time, F.lag(indicator_close()).over(window)).alias("_prev_close"),
        *[F.when(on_time, F.lag(m).over(window)).alias(f"_prev_{m}") for m in dict.fromkeys(metrics)],
    )


def exit_events(
    positions: DataFrame, bars: DataFrame, calendar: DataFrame, rules: Sequence, lot: Sequence[str] = (*SERIES, "entry_date")
) -> DataFrame:
    """First triggered exit of every lot; on one day the first rule in the list wins.

    ``positions`` has one row per lot and held day with ``entry_price`` and ``holding_days``. A
    crossing needs the bar of the trading day before, which is the market's and not the lot's: it is
    judged on the entry day too.
    """
    judged = judge(positions.join(with_previous_bar(bars, calendar, rules), ["security_code", "trade_date"]), rules)
    return judged.groupBy(*lot).agg(*first_trigger(), F.count_if("missing").alias("missing_indicator_days"))


def judge(held: DataFrame, rules: Sequence) -> DataFrame:
    """``held`` (a lot, a day, its bar and the bar before) with the day's exit reason and whether an indicator is missing."""
    gain = F.col("close_price_backward_adj") / F.col("entry_price") - 1
    close = indicator_close()
    reason = F.lit(None).cast("string")
    missing = F.lit(False)
    for rule in reversed(list(rules)):
        if isinstance(rule, StopLoss):
            hit = gain <= -rule.loss
        elif isinstance(rule, TakeProfit):
            hit = gain >= rule.profit
        elif isinstance(rule, TimeStop):
            hit = (F.col("holding_days") >= rule.holding_days) & (gain < rule.max_return)
        else:
            missing = missing | (close.isNotNull() & F.col(rule.metric).isNull())
            hit = indicator_hit(rule)
        reason = F.when(hit & gain.isNotNull(), REASONS[type(rule)]).otherwise(reason)
    return held.select("*", reason.alias("reason"), missing.alias("missing"))


def indicator_hit(rule: IndicatorStop) -> Column:
    """Whether the close is (``close_below_metric``) or falls (``cross_below_metric``) under the metric."""
    hit = indicator_close() < F.col(rule.metric)
    return hit & (F.col("_prev_close") >= F.col(f"_prev_{rule.metric}")) if rule.operator == "cross_below_metric" else hit


def first_trigger() -> list[Column]:
    when = F.when(F.col("reason").isNotNull(), F.col("trade_date"))
    return [F.min(when).alias("trigger_date"), F.min_by("reason", when).alias("exit_reason")]


# --- uncapped trades -------------------------------------------------------------------------


EXIT = "entry_price double, exit_date date, exit_price double, exit_reason string, holding_days int"


def entry_exits(
    entries: DataFrame, bars: DataFrame, calendar: DataFrame, settings: Mapping[str, Sequence], slippage_bps: float = scalars.FeeConfig.slippage_bps
) -> DataFrame:
    """What becomes of a lot opened at each entry under each setting, a list of exit rules.

    ``entries`` has distinct security_code and entry_date; those without an open on that day have no
    row. Of the rules of a setting the first to be triggered decides, on one day the first in the list.
    Price rules are first passages of the close, asked once per entry and rule; indicator rules
    don't depend on the entry and are the next flagged bar. Entries and bars of a security are
    bounded by the calendar, and settings are data, so the plan is the same for any number of them.
    """
    rules = list(dict.fromkeys(rule for listed in settings.values() for rule in listed))
    flagged = [rule for rule in rules if isinstance(rule, IndicatorStop)]
    gain = F.col("close_price_backward_adj").isNotNull()
    numbered = with_previous_bar(bars, calendar, rules).join(F.broadcast(calendar.select("trade_date", "day_no")), "trade_date").select(
        "security_code", "trade_date", F.col("day_no").cast("int").alias("day_no"), F.col("open_price_backward_adj").alias("open"),
        F.col("close_price_backward_adj").alias("close"), *[F.coalesce(indicator_hit(rule) & gain, F.lit(False)).alias(f"hit_{i}") for i, rule in enumerate(flagged)],
    )
    listed = {name: [rules.index(rule) for rule in own] for name, own in settings.items()}
    slipped = 1 + slippage_bps / 10000.0

    def work(asked: pa.Table, days: pa.Table) -> pa.Table:
        days = days.sort_by("trade_date")
        day, no = days["trade_date"].cast(pa.int32()).to_numpy(), days["day_no"].to_numpy()
        opens, closes = (days[c].to_numpy().astype(float) for c in ("open", "close"))
        opened, count = ~np.isnan(opens), len(day)
        entry = np.sort(asked["entry_date"].cast(pa.int32()).to_numpy())
        at = np.searchsorted(day, entry)
        at = at[(at < count) & opened[np.minimum(at, max(count - 1, 0))] & (day[np.minimum(at, max(count - 1, 0))] == entry)] if count else at[:0]
        price = opens[at] * slipped
        low, high = FirstPassage(closes, True), FirstPassage(closes, False)

        def trigger(rule) -> np.ndarray:
            if isinstance(rule, StopLoss):
                return low.after(at, lambda close: close / price - 1 <= -rule.loss)
            if isinstance(rule, TakeProfit):
                return high.after(at, lambda close: close / price - 1 >= rule.profit)
            if isinstance(rule, TimeStop):
                return low.after(np.maximum(at, np.searchsorted(no, no[at] + rule.holding_days)), lambda close: close / price - 1 < rule.max_return)
            return next_true(days[f"hit_{flagged.index(rule)}"].to_numpy(zero_copy_only=False))[at]

        triggers = [trigger(rule) for rule in rules]
        following = next_true(opened)
        parts = []
        for name, own in listed.items():
            first = np.full(len(at), count)
            reason = np.full(len(at), -1)
            for i in reversed(own):
                sooner = triggers[i] <= first
                first, reason = np.where(sooner, triggers[i], first), np.where(sooner, i, reason)
            out = following[np.minimum(first + 1, count)]
            ended = out < count  # a trigger without a later open leaves the lot open
            gone = np.minimum(out, max(count - 1, 0))
            parts.append(pa.table({
                "security_code": pa.array([asked["security_code"][0].as_py()] * len(at), pa.string()), "entry_date": pa.array(day[at]).cast(pa.date32()),
                "setting_id": pa.array([name] * len(at), pa.string()), "entry_price": pa.array(opens[at]),
                "exit_date": pa.array(day[gone], mask=~ended).cast(pa.date32()), "exit_price": pa.array(opens[gone], mask=~ended),
                "exit_reason": pa.array([REASONS[type(rules[i])] if e else None for i, e in zip(reason, ended, strict=True)], pa.string()),
                "holding_days": pa.array((no[gone] - no[at]).astype(np.int32), mask=~ended),
            }))
        return pa.concat_tables(parts)

    by_security = entries.select("security_code", "entry_date").groupBy("security_code").cogroup(numbered.groupBy("security_code"))
    return by_security.applyInArrow(lambda asked, days: work(asked, days) if asked.num_rows else empty_exits(), f"security_code string, entry_date date, setting_id string, {EXIT}")


def empty_exits() -> pa.Table:
    names = ["security_code", "entry_date", "setting_id", "entry_price", "exit_date", "exit_price", "exit_reason", "holding_days"]
    kinds = [pa.string(), pa.date32(), pa.string(), pa.float64(), pa.date32(), pa.float64(), pa.string(), pa.int32()]
    return pa.table([pa.array([], k) for k in kinds], names=names)


def without_overlap(lots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lots of each key in order of entry, without those that start before the end of the lot taken before.

    One pass over sorted rows that remembers the key and the day it is free again. A security has
    one entry per day, so that keys are bounded by the calendar.
    """
    never = 2**31 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, free = None, 0
        for batch in batches:
            named = zip(*[batch.column(c).to_pylist() for c in keys], strict=True)
            starts = batch.column("entry_date").cast(pa.int32()).to_pylist()
            ends = batch.column("exit_date").cast(pa.int32()).fill_null(never).to_pylist()
            taken = []
            for i, (key, start, end) in enumerate(zip(named, starts, ends, strict=True)):
                if key != last or start >= free:
                    taken.append(i)
                    last, free = key, end
            yield batch.take(pa.array(taken, pa.int32()))

    return lots.repartition(*keys).sortWithinPartitions(*keys, "entry_date").mapInArrow(run, lots.schema)


def setting_lots(
    signals: DataFrame, bars: DataFrame, calendar: DataFrame, settings: Mapping[str, Sequence], slippage_bps: float = scalars.FeeConfig.slippage_bps
) -> DataFrame:
    """Lots of an uncapped portfolio per run and setting: a signal opens one at the next open unless one is open.

    ``signals`` carry ``execution_date``. Exits are found once per security and day, whatever
    number of runs have a signal there; a security has at most one bar per trading day.
    """
    entries = signals.where("execution_date is not null").select(*SERIES, F.col("execution_date").alias("entry_date")).distinct()
    exits = entry_exits(entries.select("security_code", "entry_date").distinct(), bars, calendar, settings, slippage_bps)
    candidates = entries.join(exits, ["security_code", "entry_date"]).select(*SERIES, "setting_id", "entry_date", *[c.split()[0] for c in EXIT.split(", ")])
    return without_overlap(candidates, (*SERIES, "setting_id"))


def signal_lots(
    signals: DataFrame, bars: DataFrame, calendar: DataFrame, rules: Sequence, slippage_bps: float = scalars.FeeConfig.slippage_bps
) -> DataFrame:
    """Lots of ``setting_lots`` under one list of exit rules."""
    return setting_lots(signals, bars, calendar, {"": tuple(rules)}, slippage_bps).drop("setting_id")


def signal_trades(
    signals: DataFrame, bars: DataFrame, calendar: DataFrame, rules: Sequence,
    fees: scalars.FeeConfig = scalars.FeeConfig(), notional: float = 1_000_000.0, lot_size: int = 100,
) -> DataFrame:
    """Buy and sell trades of the uncapped lots with costs."""
    return lot_trades(signal_lots(signals, bars, calendar, rules, fees.slippage_bps), fees, notional, lot_size)


def lot_trades(lots: DataFrame, fees: scalars.FeeConfig = scalars.FeeConfig(), notional: float = 1_000_000.0, lot_size: int = 100) -> DataFrame:
    """A buy and, once it is closed, a sell for each lot that ``notional`` buys at least one board lot of."""
    lots = lots.withColumn("quantity", scalars.floor_to_lot(F.lit(notional) / F.col("entry_price"), lot_size)).where("quantity > 0")
    legs = F.explode(F.array(
        F.struct(F.lit("buy").alias("side"), F.col("entry_date").alias("trade_date"), F.col("entry_price").alias("reference_price"), F.lit("signal").alias("reason")),
        F.struct(F.lit("sell").alias("side"), F.col("exit_date").alias("trade_date"), F.col("exit_price").alias("reference_price"), F.col("exit_reason").alias("reason")),
    )).alias("leg")
    trades = lots.select(*SERIES, "entry_date", "quantity", legs).where("leg.trade_date is not null").select(
        *SERIES, "entry_date", "quantity", "leg.*"
    )
    return scalars.trade_costs(trades, fees)


# --- FIFO ------------------------------------------------------------------------------------


def exact(column: Column | str) -> Column:
    """Quantity on an exact axis, so that equal ends are equal however they were summed."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(32,8)")


def matched_ledger(trades: DataFrame) -> DataFrame:
    """Cumulative bought and matched quantity after every trade, to eight decimals.

    A sell can use at most the open position; what exceeds it is dropped. With cumulative buys B
    and sells S, the dropped quantity so far is the running maximum of ``S - B``, floored at 0, so
    the matched sells are ``S`` minus that: ordered scans and no sequential loop. Both scans run in
    one pass over the blocks of a security; the sums and the peak of earlier blocks are added after.
    """
    return matched_blocks(in_blocks(trades, SERIES, ["trade_date", "trade_seq"])).drop("_blk")


def matched_blocks(rows: DataFrame, whole: bool = False) -> DataFrame:
    """``matched_ledger`` of trades that lie in blocks; ``whole`` says that each security lies in one."""
    buy = F.col("side") == "buy"
    amount = F.col("quantity").cast("decimal(20,8)")
    zero = exact(F.lit(0))
    columns = rows.columns
    rows = rows.withColumn("_b", F.when(buy, amount).otherwise(F.lit(0).cast("decimal(20,8)"))).withColumn(
        "_s", F.when(buy, F.lit(0).cast("decimal(20,8)")).otherwise(amount)
    )
    ordered = Window.partitionBy(*SERIES, "_blk").orderBy("trade_date", "trade_seq")
    inside = ordered.rowsBetween(*UP_TO)
    short = exact(F.col("_ls") - F.col("_lb"))
    local = rows.select("*", exact(F.sum("_b").over(inside)).alias("_lb"), exact(F.sum("_s").over(inside)).alias("_ls")).select(
        "*", F.max(short).over(inside).alias("_lp"), F.max(short).over(ordered.rowsBetween(*BEFORE)).alias("_lq")
    )
    if whole:
        none = zero.cast("decimal(32,8)")
        joined = local.withColumns({"_cb": none, "_cs": none, "_cp": none})
    else:
        earlier = Window.partitionBy(*SERIES).orderBy("_blk").rowsBetween(*BEFORE)
        blocks = local.groupBy(*SERIES, "_blk").agg(
            F.sum("_b").alias("_tb"), F.sum("_s").alias("_ts"), F.max("_lp").alias("_tp")
        ).select(
            *SERIES, "_blk", "_tp", exact(F.sum("_tb").over(earlier)).alias("_sb"), exact(F.sum("_ts").over(earlier)).alias("_ss"),
            F.count(F.lit(1)).over(earlier).alias("_n"),
        ).withColumns({"_cb": F.coalesce("_sb", zero), "_cs": F.coalesce("_ss", zero)})
        carry = blocks.select(
            *SERIES, "_blk", "_cb", "_cs", F.max(exact(F.col("_tp") + F.col("_cs") - F.col("_cb"))).over(earlier).alias("_cp"), "_n"
        ).where("_n > 0").drop("_n")
        joined = with_carry(local, carry, SERIES)
    bought, sold = F.coalesce("_cb", zero), F.coalesce("_cs", zero)

    def dropped(local_peak: str) -> Column:
        return F.greatest(zero, F.col("_cp"), exact(F.col(local_peak) + sold - bought))

    return joined.select(
        *columns, exact(bought + F.col("_lb")).alias("bought_upto"), exact(sold + F.col("_ls")).alias("sold_upto"),
        dropped("_lp").alias("_dropped"), exact(dropped("_lp") - dropped("_lq")).alias("dropped_quantity"),
    ).withColumn("matched_upto", exact(F.col("sold_upto") - F.col("_dropped"))).drop("_dropped")


def fifo_segments(trades: DataFrame) -> DataFrame:
    """First in, first out: stretches of quantity with their buy and their sell, which is NULL for what is still open.

    On the axis of matched quantity every buy and every matched sell is an interval, and both sets
    tile the axis. Their ends cut it into segments; a segment belongs to the first buy and the
    first sell that end at or after it. So lots are found by sorting the cuts, not by pairing buys
    with sells. A security that lies in one block of the trades is cut there; of the others the cuts
    are scanned in blocks of their own, each with the neighbours' edges carried in, so no lot history
    has to fit one task.
    """
    used = (*SERIES, "trade_date", "trade_seq", "side", "quantity", "gross_amount", "total_fee", "reason")
    whole, torn = whole_and_torn(in_blocks(trades.select(*used), SERIES, ["trade_date", "trade_seq"]), SERIES)
    alone = cut_segments(axis_ends(matched_blocks(whole, whole=True)).groupBy(*SERIES, "_blk", "cut").agg(*both_sides()))
    placed = in_blocks(axis_ends(matched_blocks(torn)).groupBy(*SERIES, "cut").agg(*both_sides()), SERIES, ["cut"])
    edges = placed.groupBy(*SERIES, "_blk").agg(
        F.min_by("buy", F.when(F.col("buy").isNotNull(), F.col("cut"))).alias("first_buy"),
        F.min_by("sell", F.when(F.col("sell").isNotNull(), F.col("cut"))).alias("first_sell"),
        F.max("cut").alias("last_cut"),
    )
    blocks = Window.partitionBy(*SERIES).orderBy("_blk")
    carry = edges.select(
        *SERIES, "_blk",
        F.first("first_buy", ignorenulls=True).over(blocks.rowsBetween(*AFTER)).alias("next_buy"),
        F.first("first_sell", ignorenulls=True).over(blocks.rowsBetween(*AFTER)).alias("next_sell"),
        F.last("last_cut").over(blocks.rowsBetween(*BEFORE)).alias("prev_cut"),
    ).where("next_buy IS NOT NULL OR next_sell IS NOT NULL OR prev_cut IS NOT NULL")
    return alone.unionByName(cut_segments(placed, carry))


def axis_ends(ledger: DataFrame) -> DataFrame:
    """Where each buy and each matched sell ends on the axis.

    A sell's matched part ends at matched_upto. Sells that matched nothing are left out, so that
    cuts rise strictly on each side and a cut has at most one buy and one sell.
    """
    buy = F.col("side") == "buy"
    seller = F.struct("trade_date", "trade_seq", "quantity", "gross_amount", "total_fee", "reason")
    buyer = F.struct("trade_date", "trade_seq", "quantity", "gross_amount", "total_fee")
    moved = exact("quantity") - F.when(buy, exact(F.lit(0))).otherwise(F.col("dropped_quantity"))
    return ledger.where(moved > 0).select(
        *SERIES, "_blk",
        F.when(buy, F.col("bought_upto")).otherwise(F.col("matched_upto")).alias("cut"),
        F.when(buy, buyer).alias("buy"), F.when(~buy, seller).alias("sell"),
    )


def both_sides() -> list[Column]:
    return [F.min("buy").alias("buy"), F.min("sell").alias("sell")]


def cut_segments(cuts: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Segments of the cuts of a block, with what ``carry`` brings in from its neighbours."""
    inside = Window.partitionBy(*SERIES, "_blk").orderBy("cut")
    # the first at or after a cut, as a running frame from the far end
    onwards = Window.partitionBy(*SERIES, "_blk").orderBy(F.col("cut").desc()).rowsBetween(*UP_TO)
    local = cuts.select(
        *SERIES, "_blk", "cut", F.last("buy", ignorenulls=True).over(onwards).alias("buy"),
        F.last("sell", ignorenulls=True).over(onwards).alias("sell"), F.lag("cut").over(inside).alias("below"),
    )
    buy, sell, below = F.col("buy"), F.col("sell"), F.coalesce("below", exact(F.lit(0)))
    if carry is not None:
        local = with_carry(local, carry, SERIES)
        buy, sell, below = F.coalesce("buy", "next_buy"), F.coalesce("sell", "next_sell"), F.coalesce("below", "prev_cut", exact(F.lit(0)))
    return local.select(*SERIES, buy.alias("buy"), sell.alias("sell"), (F.col("cut") - below).cast("double").alias("quantity")).where(F.col("buy").isNotNull())


def fifo_closed_trades(trades: DataFrame, calendar: DataFrame) -> DataFrame:
    """Closed lots, first in first out, with fees and gross split pro rata."""
    return closed_trades(fifo_segments(trades), calendar)


def closed_trades(segments: DataFrame, calendar: DataFrame) -> DataFrame:
    """The segments that have a sell, with amounts, result and trading days held."""
    share_in, share_out = F.col("quantity") / F.col("buy.quantity"), F.col("quantity") / F.col("sell.quantity")
    lots = segments.where("sell IS NOT NULL").select(
        *SERIES,
        F.concat_ws("-", "attempt_id", F.lit("closed"), F.col("sell.trade_seq"), F.col("buy.trade_seq")).alias("closed_trade_id"),
        F.concat_ws("-", "attempt_id", F.lit("lot"), F.col("buy.trade_seq")).alias("position_lot_id"),
        F.col("buy.trade_seq").alias("entry_trade_seq"), F.col("sell.trade_seq").alias("exit_trade_seq"),
        F.col("buy.trade_date").alias("entry_date"), F.col("sell.trade_date").alias("exit_date"), "quantity",
        (F.col("buy.gross_amount") * share_in).alias("entry_gross_amount"),
        (F.col("sell.gross_amount") * share_out).alias("exit_gross_amount"),
        (F.col("buy.total_fee") * share_in).alias("entry_fee"), (F.col("sell.total_fee") * share_out).alias("exit_fee"),
        F.col("sell.reason").alias("exit_reason"),
    )
    # lots stay where they are: the calendar, a row per trading day, is broadcast
    numbered = (
        lots.join(F.broadcast(calendar.select(F.col("trade_date").alias("entry_date"), F.col("day_no").alias("_in"))), "entry_date", "left")
        .join(F.broadcast(calendar.select(F.col("trade_date").alias("exit_date"), F.col("day_no").alias("_out"))), "exit_date", "left")
    )
    span = F.coalesce(F.col("_out") - F.col("_in"), F.date_diff("exit_date", "entry_date"))
    pnl = F.col("exit_gross_amount") - F.col("entry_gross_amount") - F.col("entry_fee") - F.col("exit_fee")
    return numbered.select(
        *lots.columns, pnl.alias("realized_pnl"), F.greatest(span, F.lit(0)).alias("holding_days")
    )


def closed_trade_view(closed: DataFrame) -> DataFrame:
    """Total fee and realised return, NULL on zero cost (X11)."""
    cost = F.col("entry_gross_amount") + F.col("entry_fee")
    return closed.select(
        "*", (F.col("entry_fee") + F.col("exit_fee")).alias("total_fee"),
        F.when(cost != 0, F.col("realized_pnl") / cost).alias("realized_return"),
    )


def trade_metrics(closed: DataFrame, keys=RUN) -> DataFrame:
    """Counts, win rate, mean win and loss, extremes and holding days per run."""
    r = F.col("realized_return")
    win, loss = r > EPSILON, r < -EPSILON
    total = F.count(F.lit(1))
    a = closed_trade_view(closed).groupBy(*keys).agg(
        total.alias("closed_trade_count"), F.count_if(win).alias("winning_trade_count"), F.count_if(loss).alias("losing_trade_count"),
        (F.count_if(win) / total).alias("win_rate_closed_trades"),
        F.avg(F.when(win, r)).alias("average_win_return"), F.avg(F.when(loss, r)).alias("average_loss_return"),
        F.avg("holding_days").alias("average_holding_days"),
        F.max(F.when(win, r)).alias("largest_win_return"), F.min(F.when(loss, r)).alias("largest_loss_return"),
    )
    return a.select(
        "*",
        (F.col("closed_trade_count") - F.col("winning_trade_count") - F.col("losing_trade_count")).alias("breakeven_trade_count"),
        F.when(F.col("average_loss_return") != 0, F.abs("average_win_return") / F.abs("average_loss_return")).alias("profit_loss_ratio"),
    )


# --- positions and NAV -----------------------------------------------------------------------


def lots_of(segments: DataFrame) -> DataFrame:
    """Every lot with its holding range; the exit of an open one is NULL."""
    cost = (F.col("buy.gross_amount") + F.col("buy.total_fee")) * F.col("quantity") / F.col("buy.quantity")
    return segments.select(
        *SERIES, F.col("buy.trade_seq").alias("entry_trade_seq"), F.col("buy.trade_date").alias("entry_date"),
        F.col("sell.trade_date").alias("exit_date"), F.col("quantity").alias("lot_quantity"), cost.alias("cost_basis"),
    )


def stretch(day_no: str) -> Column:
    return F.floor(F.col(day_no) / STRETCH_DAYS).cast("int")


def position_days(
    lots: DataFrame, bars: DataFrame, calendar: DataFrame, close: str = "close_price", keep_unpriced: bool = False
) -> DataFrame:
    """Mark to market of every run and security per trading day it is held.

    Days without a close have no row; ``keep_unpriced`` keeps them, with NULL values, for the counts
    of ``nav_series``.

    Lots become +quantity on their entry day and -quantity on their exit day; a running sum of
    those changes gives the position, carried over the trading days up to the next change. Nothing
    is unfolded per lot and day.

    Positions and prices meet by stretches of the calendar: one row per position and stretch, and one
    list per security and stretch with its closes. Days are unfolded after that, so they are never
    placed or sorted. The calendar itself, a row per trading day, is broadcast.
    """
    steps = F.explode(F.array(
        F.struct(F.col("entry_date").alias("d"), F.lit(1.0).alias("sign")), F.struct(F.col("exit_date").alias("d"), F.lit(-1.0).alias("sign"))
    )).alias("step")
    number = calendar.select(F.col("trade_date").alias("entry_date"), F.col("day_no").cast("double").alias("_entry_no"))
    changes = lots.join(F.broadcast(number), "entry_date").select(
        *SERIES, "lot_quantity", "cost_basis", "_entry_no", steps
    ).where("step.d is not null").groupBy(*SERIES, F.col("step.d").alias("trade_date")).agg(
        F.sum(F.col("step.sign") * F.col("lot_quantity")).alias("dq"), F.sum(F.col("step.sign") * F.col("cost_basis")).alias("dc"),
        F.sum(F.col("step.sign") * F.col("lot_quantity") * F.col("_entry_no")).alias("dn"),
    )
    # One row per security and day with a change: bounded by the calendar.
    ordered = Window.partitionBy(*SERIES).orderBy("trade_date")
    upto = ordered.rowsBetween(*UP_TO)
    levels = changes.select(
        *SERIES, F.col("trade_date").alias("from_date"), F.lead("trade_date").over(ordered).alias("to_date"),
        F.sum("dq").over(upto).alias("quantity"), F.sum("dc").over(upto).alias("cost_basis"), F.sum("dn").over(upto).alias("_weighted_entry"),
    ).where(F.col("quantity") > EPSILON)
    numbers = F.broadcast(calendar.select("trade_date", "day_no"))
    starts = calendar.select(F.col("trade_date").alias("from_date"), F.col("day_no").alias("_a"), F.col("day_count").alias("_z"))
    ends = calendar.select(F.col("trade_date").alias("to_date"), F.col("day_no").alias("_b"))
    spans = levels.join(F.broadcast(starts), "from_date").join(F.broadcast(ends), "to_date", "left").withColumn(
        "_last", F.coalesce(F.col("_b") - 1, F.col("_z"))
    )
    pieces = spans.withColumn("_stretch", F.explode(F.sequence(stretch("_a"), stretch("_last")))).select(
        *SERIES, "_stretch", "quantity", "cost_basis", "_weighted_entry",
        F.greatest("_a", F.col("_stretch") * STRETCH_DAYS).alias("_from"), F.least("_last", (F.col("_stretch") + 1) * STRETCH_DAYS - 1).alias("_to"),
    )
    closes = bars.select("security_code", "trade_date", F.col(close).alias("close_price")).where(F.col("close_price").isNotNull()).join(
        numbers, "trade_date"
    ).groupBy("security_code", stretch("day_no").alias("_stretch")).agg(F.collect_list(F.struct("day_no", "close_price")).alias("_closes"))
    met = pieces.join(closes, ["security_code", "_stretch"], "left" if keep_unpriced else "inner").withColumn(
        "_priced", F.filter("_closes", lambda x: x["day_no"].between(F.col("_from"), F.col("_to")))
    )
    on_days = F.col("_priced")
    if keep_unpriced:
        none = F.lit(None).cast(bars.schema[close].dataType).alias("close_price")
        span = F.sequence("_from", "_to")
        without = F.coalesce(F.array_except(span, F.col("_priced.day_no")), span)
        unpriced = F.transform(without, lambda d: F.struct(d.alias("day_no"), none))
        on_days = F.coalesce(F.concat("_priced", unpriced), unpriced)
    priced = met.withColumn("_day", F.explode(on_days)).withColumn("day_no", F.col("_day.day_no")).join(numbers, "day_no").select(
        *SERIES, "trade_date", "quantity", "cost_basis", F.col("_day.close_price").alias("close_price"),
        (F.col("day_no") - F.col("_weighted_entry") / F.col("quantity")).alias("holding_days"),
    )
    value = F.col("quantity") * F.col("close_price")
    return priced.select(
        *SERIES, "trade_date", "quantity", "cost_basis", (F.col("cost_basis") / F.col("quantity")).alias("average_entry_price"),
        "close_price", value.alias("market_value"), (value - F.col("cost_basis")).alias("unrealized_pnl"),
        F.when(F.col("cost_basis") != 0, (value - F.col("cost_basis")) / F.col("cost_basis")).alias("unrealized_return"),
        "holding_days", F.lit(False).alias("is_stale_price"),
    )


def nav_series(trades: DataFrame, positions: DataFrame, calendar: DataFrame, initial_cash: float) -> DataFrame:
    """Cash, equity, return, drawdown, exposure and turnover per run and trading day.

    The day before a run's first trade seeds the series with the initial cash. ``position_count``
    counts every holding of ``positions`` (from ``position_days`` with ``keep_unpriced``), and
    ``warning_count`` those without a close, which add no value.
    """
    buy = F.col("side") == "buy"
    flow = F.when(buy, -(F.col("gross_amount") + F.col("total_fee"))).otherwise(F.col("gross_amount") - F.col("total_fee"))
    flows = trades.groupBy(*RUN, "trade_date").agg(
        F.sum(flow).alias("flow"), F.sum("gross_amount").alias("traded"), F.sum("total_fee").alias("fee_amount")
    )
    values = positions.groupBy(*RUN, "trade_date").agg(
        F.sum("market_value").alias("position_market_value"), F.count(F.lit(1)).alias("position_count"),
        F.count_if(F.col("close_price").isNull()).alias("warning_count"),
    )
    numbers = calendar.select("trade_date", "day_no")
    first = flows.groupBy(*RUN).agg(F.min("trade_date").alias("trade_date")).join(
        calendar.select("trade_date", "day_no", "day_count"), "trade_date"
    )
    days = first.select(
        *RUN, F.explode(F.sequence(F.greatest(F.col("day_no") - 1, F.lit(1)), F.col("day_count"))).alias("day_no")
    ).join(numbers, "day_no").drop("day_no")
    daily = days.join(flows, [*RUN, "trade_date"], "left").join(values, [*RUN, "trade_date"], "left").fillna(
        0, ["flow", "traded", "fee_amount", "position_market_value", "position_count", "warning_count"]
    )
    by_run = Window.partitionBy(*RUN).orderBy("trade_date")
    cash = F.lit(initial_cash) + F.sum("flow").over(by_run.rowsBetween(*UP_TO))
    equity = daily.withColumn("cash_balance", cash).withColumn("total_equity", F.col("cash_balance") + F.col("position_market_value"))
    return with_drawdown(equity, by_run, initial_cash).select(
        *RUN, "trade_date", "cash_balance", "position_market_value", "total_equity", (F.col("total_equity") / initial_cash).alias("nav"),
        "daily_return", "drawdown",
        F.coalesce(scalars.safe_ratio("position_market_value", "total_equity"), F.lit(0.0)).alias("gross_exposure"), "position_count",
        F.coalesce(scalars.safe_ratio("traded", "total_equity"), F.lit(0.0)).alias("turnover"), "fee_amount", "warning_count",
    )


def with_drawdown(equity: DataFrame, by_run, floor: Column | float) -> DataFrame:
    """Return to the day before and drawdown from the running peak, which starts at ``floor``."""
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    peak = F.greatest(floor, F.max("total_equity").over(by_run.rowsBetween(*UP_TO)))
    before = F.lag("total_equity").over(by_run)
    return equity.withColumn("_peak", peak).select(
        "*", (F.col("total_equity") / before - 1).alias("daily_return"),
        F.when(F.col("_peak") > 0, F.col("total_equity") / F.col("_peak") - 1).otherwise(0.0).alias("drawdown"),
    ).drop("_peak")


def run_totals(nav: DataFrame, trades: DataFrame, initial_cash: float) -> DataFrame:
    """Ending equity, total return, worst drawdown, trades and fees per run."""
    ends = nav.groupBy(*RUN).agg(
        F.max_by("total_equity", "trade_date").alias("ending_equity"), F.least(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown")
    )
    counts = trades.groupBy(*RUN).agg(F.count(F.lit(1)).alias("trade_count"), F.sum("total_fee").alias("total_fee"))
    return ends.join(counts, list(RUN), "left").select(
        *RUN, "ending_equity", (F.col("ending_equity") / initial_cash - 1).alias("total_return"), "max_drawdown",
        F.coalesce("trade_count", F.lit(0)).alias("trade_count"), F.coalesce("total_fee", F.lit(0.0)).alias("total_fee"),
    )


def rebase_nav(nav: DataFrame, live_start: str | DataFrame) -> DataFrame:
    """NAV from a live start on, relative to that day's equity (X15); a run without a usable base fails.

    ``live_start`` is one date, or a frame with ``live_start_date`` per run.
    """
    if isinstance(live_start, DataFrame):
        dated = nav.join(live_start.select(*RUN, F.col("live_start_date").alias("_start")), list(RUN))
    else:
        dated = nav.withColumn("_start", F.lit(live_start).cast("date"))
    live = dated.where(F.col("trade_date") >= F.col("_start")).drop("_start")
    base = dated.groupBy(*RUN).agg(F.max(F.when(F.col("trade_date") == F.col("_start"), F.col("total_equity"))).alias("_base"))
    checked = live.join(base, list(RUN)).withColumn(
        "_base",
        F.when(F.col("_base") > 0, F.col("_base")).otherwise(
            F.raise_error(F.concat(F.lit("no usable base equity on the live start date for run "), "run_id")).cast("double")
        ),
    )
    kept = [c for c in nav.columns if c not in ("nav", "daily_return", "drawdown")]
    by_run = Window.partitionBy(*RUN).orderBy("trade_date")
    return with_drawdown(checked.select(*kept, "_base"), by_run, F.col("_base")).select(
        *kept, (F.col("total_equity") / F.col("_base")).alias("nav"), "daily_return", "drawdown"
    )
