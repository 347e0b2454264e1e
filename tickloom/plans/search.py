"""Search over rules and risk settings: all of them in one plan, ranked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scalars
from tickloom.operators import tables
from tickloom.plans import ledger, performance, rule_tables
from tickloom.plans.screening import between
from tickloom.session import checkpoint

RUN = ("run_id", "setting_id")
RANKED = ("holding_period_return", "max_drawdown", "sharpe_ratio")


def signals_of(metrics: DataFrame, rules: rule_tables.RuleTables, start: str, end: str, depth: int | None = None) -> DataFrame:
    """Top-N signals of every valid rule as a run: security_code, trade_date, score, rank_no, run_id."""
    hits = rule_tables.screen_all(between(metrics, start, end), rules, depth).withColumnRenamed("rule_id", "run_id")
    ranked = tables.rank_signals(hits, ("run_id", "trade_date"))
    return ranked.where("rank_no <= top_n").select("security_code", "trade_date", "score", "rank_no", "run_id")


def settings_nav(
    signals: DataFrame, bars: DataFrame, prices: DataFrame, calendar: DataFrame, settings: Mapping[str, Sequence], end: str, initial_cash: float,
    fees: scalars.FeeConfig = scalars.FeeConfig(), notional: float = 1_000_000.0, lot_size: int = 100,
) -> DataFrame:
    """NAV series of every run under every setting (``attempt_id`` is the setting).

    ``signals`` have run_id, security_code and trade_date. Lots of a security don't overlap within a
    run and setting, so they are the positions as they stand and need no FIFO match.
    """
    asked = signals.select("run_id", F.lit("").alias("attempt_id"), "security_code", F.col("trade_date").alias("signal_date"))
    lots = ledger.setting_lots(ledger.next_open_signals(asked, calendar, end), bars, calendar, settings, fees.slippage_bps)
    # read several times below; a row per lot
    lots = checkpoint(lots.drop("attempt_id").withColumnRenamed("setting_id", "attempt_id"))
    trades = ledger.lot_trades(lots, fees, notional, lot_size)
    buys = trades.where("side = 'buy'").select(*ledger.SERIES, "entry_date", F.col("quantity").alias("lot_quantity"), (F.col("gross_amount") + F.col("total_fee")).alias("cost_basis"))
    held = buys.join(lots.select(*ledger.SERIES, "entry_date", "exit_date"), [*ledger.SERIES, "entry_date"])
    return ledger.nav_series(trades, ledger.position_days(held, prices, calendar, keep_unpriced=True), calendar, initial_cash)


def ranked_settings(nav: DataFrame, benchmark: DataFrame, risk_free: DataFrame, metrics: Sequence[str] = RANKED, config: performance.PerformanceConfig = performance.PerformanceConfig()) -> DataFrame:
    """run_id, setting_id, metric_name, metric_value, metric_rank: every run and setting that traded, one rank per metric."""
    measured = performance.performance(nav, benchmark, risk_free, config).where("metric_status = 'succeeded'")
    long = tables.unpivot_metrics(measured, list(ledger.RUN), list(metrics))
    ranked = performance.metric_rank(long, tables.rank_catalog(nav.sparkSession), [], ledger.RUN)
    return ranked.select("run_id", F.col("attempt_id").alias("setting_id"), "metric_name", "metric_value", "metric_rank")
