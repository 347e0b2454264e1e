"""Read models over run facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scalars
from tickloom.operators.joins import left_any
from tickloom.operators.scans import UP_TO
from tickloom.operators.tables import daily_win_rate, latest_targets, position_balance, rebalance_counts
from tickloom.plans.ledger import RUN, SERIES, closed_trade_view
from tickloom.plans.performance import METRICS

PERIOD_YEARS = {"1y": 1, "2y": 2, "3y": 3}


def as_date(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def nav_vs_benchmark(nav: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark compounded from 1 at a run's first day, NULL from its first missing return on."""
    joined = nav.select(*RUN, "trade_date", "nav").join(
        benchmark.select("trade_date", "return_daily"), "trade_date", "left"
    )
    by_run = Window.partitionBy(*RUN).orderBy("trade_date")
    upto = by_run.rowsBetween(*UP_TO)
    marked = joined.withColumn("_first", F.lag("trade_date").over(by_run).isNull())
    step = F.when(F.col("_first"), 1.0).otherwise(1 + F.col("return_daily"))
    broken = F.bool_or(~F.col("_first") & F.col("return_daily").isNull()).over(upto)
    grown = marked.withColumn("benchmark_nav", F.when(~broken, F.product(step).over(upto)))
    return grown.select(
        *RUN, "trade_date", F.col("nav").alias("strategy_nav"), "benchmark_nav", (F.col("nav") - F.col("benchmark_nav")).alias("excess_return")
    )


def on_day(df: DataFrame, days: DataFrame, column: str = "trade_date") -> DataFrame:
    """Rows of the chosen day of each run."""
    return df.join(days.select(*RUN, F.col("_day").alias(column)), [*RUN, column], "left_semi")


def default_days(nav: DataFrame) -> DataFrame:
    """Last day of each run with positions or turnover."""
    return nav.where((F.col("position_count") > 0) | (F.col("turnover") > 0)).groupBy(*RUN).agg(F.max("trade_date").alias("_day"))


def rebalance_rows(
    trades: DataFrame, positions: DataFrame, closed: DataFrame, nav: DataFrame, days: DataFrame, names: DataFrame
) -> DataFrame:
    """Buys, untouched holdings and sells of one day per run, with their share of equity."""
    equity = on_day(nav, days).select(*RUN, "total_equity")
    bought = on_day(trades, days).where("side = 'buy'")
    traded = on_day(trades, days).select(*SERIES).distinct()
    held = on_day(positions, days).select(
        *SERIES, F.col("quantity").alias("held_quantity"), "holding_days", "unrealized_return", "average_entry_price", "close_price", "unrealized_pnl"
    )
    buys = bought.join(held, list(SERIES), "left").select(
        *SERIES, F.lit("buy").alias("direction"), "quantity", "holding_days", F.col("unrealized_return").alias("change_pct"),
        F.coalesce("average_entry_price", "execution_price").alias("cost_price"), F.col("close_price").alias("current_price"),
        F.col("unrealized_pnl").alias("_pnl"), "reason",
    )
    holds = held.join(traded, list(SERIES), "left_anti").select(
        *SERIES, F.lit("hold").alias("direction"), F.col("held_quantity").alias("quantity"), "holding_days",
        F.col("unrealized_return").alias("change_pct"), F.col("average_entry_price").alias("cost_price"),
        F.col("close_price").alias("current_price"), F.col("unrealized_pnl").alias("_pnl"), F.lit(None).cast("string").alias("reason"),
    )
    sells = closed_trade_view(on_day(closed, days, "exit_date")).select(
        *SERIES, F.lit("sell").alias("direction"), "quantity", F.col("holding_days").cast("double").alias("holding_days"),
        F.col("realized_return").alias("change_pct"), (F.col("entry_gross_amount") / F.col("quantity")).alias("cost_price"),
        (F.col("exit_gross_amount") / F.col("quantity")).alias("current_price"), F.col("realized_pnl").alias("_pnl"),
        F.col("exit_reason").alias("reason"),
    )
    rows = buys.unionByName(holds).unionByName(sells).join(equity, list(RUN), "left")
    share = F.when(F.col("total_equity") != 0, F.col("_pnl") / F.col("total_equity"))
    return left_any(
        rows.select("*", share.alias("contribution_pct")).drop("_pnl", "total_equity"),
        names.select("security_code", "security_name"), ["security_code"], right_unique=True,
    )


def rebalance_summary(nav: DataFrame, trades: DataFrame) -> DataFrame:
    """Securities bought, sold and held per run and day."""
    counts = rebalance_counts(trades)
    joined = nav.select(*RUN, "trade_date", "position_count").join(counts, [*RUN, "trade_date"], "left").fillna(0, ["buy_count", "sell_count"])
    return joined.select(
        *RUN, "trade_date", "buy_count", "sell_count", F.greatest(F.col("position_count") - F.col("buy_count"), F.lit(0)).alias("hold_count")
    )


def statement_summary(nav: DataFrame, trades: DataFrame, closed: DataFrame, start, end) -> DataFrame:
    """Exposure, trades, win rate and holding days of a period per run."""
    def within(c: str) -> Column:
        return F.col(c).between(as_date(start), as_date(end))

    days = nav.where(within("trade_date")).groupBy(*RUN).agg(
        F.avg("gross_exposure").alias("average_position_pct"), F.count_if(F.col("position_count") > 0).alias("holding_days")
    )
    traded = trades.where(within("trade_date"))
    counts = traded.groupBy(*RUN).agg(
        F.count_distinct("security_code").alias("traded_security_count"), F.count(F.lit(1)).alias("trade_count")
    )
    by_exit = closed.groupBy(*SERIES, F.col("exit_trade_seq").alias("trade_seq")).agg(F.sum("realized_pnl").alias("pnl"))
    won = traded.where("side = 'sell'").select(*SERIES, "trade_seq").join(by_exit, [*SERIES, "trade_seq"], "left").groupBy(*RUN).agg(
        F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("trade_win_rate")
    )
    by_security = closed.where(within("exit_date")).groupBy(*SERIES).agg(F.sum("realized_pnl").alias("pnl")).groupBy(*RUN).agg(
        F.count_if(F.col("pnl") > 0).alias("winning_security_count"), F.count_if(F.col("pnl") < 0).alias("losing_security_count")
    )
    result = days.join(counts, list(RUN), "full_outer").join(won, list(RUN), "full_outer").join(by_security, list(RUN), "full_outer")
    return result.fillna(0, ["holding_days", "traded_security_count", "trade_count", "winning_security_count", "losing_security_count"])


def statement_operations(trades: DataFrame, closed: DataFrame, start, end, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Trades of a period with position after them and realised result, newest first.

    The balance runs over all trades before the period filter.
    """
    balanced = position_balance(trades).where(F.col("trade_date").between(as_date(start), as_date(end)))
    by_exit = closed.groupBy(*SERIES, F.col("exit_trade_seq").alias("trade_seq")).agg(F.sum("realized_pnl").alias("realized_pnl"))
    rows = balanced.join(by_exit, [*SERIES, "trade_seq"], "left").select(
        *SERIES, "trade_seq", "trade_date", "side", "execution_price", "quantity", F.lit(100).alias("lot_size"),
        (F.col("quantity") / 100.0).alias("lot_count"), "gross_amount", "total_fee", "position_balance_quantity", "realized_pnl", "reason",
    )
    if limit is None:
        return rows
    return rows.orderBy(F.col("trade_date").desc(), F.col("trade_seq").desc(), *SERIES).offset(offset).limit(limit)


def statement_period(runs: DataFrame, key: str | Column) -> DataFrame:
    """Start and end of a statement period per run with ``live_start_date`` and ``latest_date``."""
    key = key if isinstance(key, Column) else F.lit(key)
    return runs.select(
        "*", scalars.statement_start(F.col("latest_date"), F.col("live_start_date"), key).alias("start_date"), F.col("latest_date").alias("end_date")
    )


def range_options(quotes: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Backtest ranges of 1, 2 and 3 years back from the last day with quote and benchmark."""
    days = quotes.select("trade_date").distinct()
    usable = benchmark.where("return_daily is not null").select("trade_date")
    shared = days.join(usable, "trade_date", "left_semi").agg(F.max("trade_date").alias("latest_date"))
    # The distinct days are calendar-sized: the newest shared day rides along as one window value.
    marked = days.join(shared.select(F.col("latest_date").alias("trade_date"), F.col("latest_date")), "trade_date", "left")
    whole = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dated = marked.select("trade_date", F.max("latest_date").over(whole).alias("latest_date"))
    options = dated.select(
        "*", F.explode(F.map_from_arrays(
            F.array(*[F.lit(k) for k in PERIOD_YEARS]), F.array(*[F.lit(-12 * y) for y in PERIOD_YEARS.values()])
        )).alias("period_key", "months")
    )
    return options.where(
        (F.col("trade_date") >= F.add_months("latest_date", F.col("months"))) & (F.col("trade_date") <= F.col("latest_date"))
    ).groupBy("period_key").agg(
        F.min("trade_date").alias("resolved_start_date"), F.max("latest_date").alias("resolved_end_date")
    )


def security_series(
    quotes: DataFrame, trend: DataFrame, momentum: DataFrame, codes: DataFrame, start, end, adjustment: str = "none",
    overlays: Sequence[str] = (), kdj: Sequence[str] = ("k_value", "d_value", "j_value"),
) -> DataFrame:
    """Price series of chosen securities with overlays; KDJ falls back to the quotes mart."""
    key = ["security_code", "trade_date"]

    def chosen(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        return df.where(F.col("trade_date").between(as_date(start), as_date(end))).join(codes, "security_code", "left_semi").select(*key, *columns)

    base = scalars.select_ohlc(chosen(quotes, [c for c in quotes.columns if c not in key]), adjustment)
    own = [c for c in kdj if c in quotes.columns]
    right = chosen(momentum, [F.col(c).alias(f"_m_{c}") for c in kdj])
    series = base.join(chosen(trend, list(overlays)), key, "left").join(right, key, "left")
    return series.select(
        *key, "open", "high", "low", "close", *overlays,
        *[(F.coalesce(f"_m_{c}", c) if c in own else F.col(f"_m_{c}")).alias(c) for c in kdj],
    )


def read_facts(
    facts: DataFrame, date: str = "trade_date", default_latest: bool = False, order: Sequence[str] = (), limit: int | None = None, **equals
) -> DataFrame:
    """Facts filtered by equality on any columns; by default of the latest date."""
    rows = facts
    for column, value in equals.items():
        rows = rows.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    if default_latest:
        keys = [k for k in RUN if k in facts.columns]
        rows = rows.join(rows.groupBy(*keys).agg(F.max(date).alias(date)), [*keys, date], "left_semi")
    if order:
        rows = rows.orderBy(*order)
    return rows.limit(limit) if limit is not None else rows


def price_bars(quotes: DataFrame, trend: DataFrame, codes: DataFrame, start, end, prices: Sequence[str], metrics: Sequence[str] = ()) -> DataFrame:
    """Bars of chosen securities with only the trend columns asked for (X26); none asked, none read."""
    key = ["security_code", "trade_date"]

    def within(df: DataFrame) -> DataFrame:
        return df.where(F.col("trade_date").between(as_date(start), as_date(end))).join(codes, "security_code", "left_semi")

    bars = within(quotes).select(*key, *prices)
    return bars.join(within(trend).select(*key, *metrics), key, "left") if metrics else bars


def security_display(basics: DataFrame, codes: DataFrame) -> DataFrame:
    """Names, exchange and board of a set of codes."""
    return basics.join(codes.select("security_code"), "security_code", "left_semi").select(
        "security_code", "security_name", "exchange_code", "security_board"
    )


def dashboard(nav: DataFrame, benchmark: DataFrame, perf: DataFrame, targets: DataFrame, names: DataFrame) -> DataFrame:
    """One row per run: latest NAV and change, excess, win rate, all metrics, first five targets with names."""
    latest = nav.groupBy(*RUN).agg(
        F.max("trade_date").alias("latest_date"), F.max_by("nav", "trade_date").alias("latest_nav"),
        F.max_by("daily_return", "trade_date").alias("recent_change"),
    )
    excess = nav_vs_benchmark(nav, benchmark).groupBy(*RUN).agg(
        F.max_by("excess_return", F.when(F.col("excess_return").isNotNull(), F.col("trade_date"))).alias("excess_return")
    )
    wins = daily_win_rate(nav).select(*RUN, "win_rate")
    best = left_any(latest_targets(targets, 5), names.select("security_code", "security_name"), ["security_code"], right_unique=True)
    # At most five targets a run reach the list.
    listed = best.groupBy("run_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("rank_no", "security_code", "security_name"))), lambda x: F.concat_ws(" ", x["security_code"], x["security_name"])
        ), ",").alias("top_targets")
    )
    chosen = perf.select(*RUN, *METRICS)
    return latest.join(excess, list(RUN), "left").join(wins, list(RUN), "left").join(chosen, list(RUN), "left").join(listed, "run_id", "left")
