"""Performance metrics against a benchmark, their status and ranks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scans import global_rank
from tickloom.operators.tables import PERFORMANCE_DIRECTIONS, TRADE_DIRECTIONS, compound, rank_catalog, unpivot_metrics

RUN = ("run_id", "attempt_id")
METRICS = tuple(PERFORMANCE_DIRECTIONS)

# Metric to the reason given when its denominator is missing or zero.
ZERO_DIVISION_REASONS = {
    "calmar_ratio": "max_drawdown_zero",
    "sortino_ratio": "downside_deviation_zero",
    "sharpe_ratio": "annualized_volatility_zero",
    "information_ratio": "tracking_error_zero",
    "beta": "benchmark_variance_zero",
    "alpha": "benchmark_variance_zero",
    "treynor_ratio": "beta_zero",
}
SERIES_REASONS = {
    "missing_benchmark": "benchmark_series_missing",
    "missing_risk_free_rate": "risk_free_series_missing",
    "insufficient_observations": "n_below_min_observations",
    "invalid_input": "invalid_return_value",
}


@dataclass(frozen=True)
class PerformanceConfig:
    annualization_days: int = 252
    min_observations: int = 20
    minimum_acceptable_return: float = 0.0


def finite(c: str) -> Column:
    return ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def performance(
    nav: DataFrame, benchmark: DataFrame, risk_free: DataFrame, config: PerformanceConfig = PerformanceConfig(), keys=RUN
) -> DataFrame:
    """All metrics of every run in one aggregate.

    Days enter only with a return, a benchmark return and a rate; drawdown looks at every day.
    """
    days = config.annualization_days
    joined = nav.select(*keys, "trade_date", "daily_return", "drawdown").join(
        benchmark.select("trade_date", F.col("return_daily").alias("b")), "trade_date", "left"
    ).join(risk_free.select("trade_date", F.col("daily_rate").alias("f")), "trade_date", "left")
    has_return = F.col("daily_return").isNotNull()
    aligned = has_return & F.col("b").isNotNull() & F.col("f").isNotNull()
    # Columns of aligned days only; aggregates skip the NULLs of the rest.
    rows = joined.select(
        *keys, "drawdown", aligned.alias("in_"),
        (has_return & F.col("b").isNull()).alias("no_b"),
        (has_return & F.col("b").isNotNull() & F.col("f").isNull()).alias("no_f"),
        *[F.when(aligned, F.col(c)).alias(n) for c, n in (("daily_return", "p"), ("b", "b"), ("f", "f"))],
    )
    shortfall = F.least(F.col("p") - config.minimum_acceptable_return, F.lit(0.0))
    a = rows.groupBy(*keys).agg(
        F.count_if("in_").alias("observation_count"),
        F.bool_or("no_b").alias("no_b"), F.bool_or("no_f").alias("no_f"),
        F.bool_or(F.col("in_") & ~(finite("p") & finite("b") & finite("f"))).alias("invalid"),
        compound("p").alias("hpr"), compound("b").alias("bench_hpr"), compound("f").alias("rf_hpr"),
        F.stddev_samp("p").alias("sd"), F.sum(shortfall * shortfall).alias("shortfall_sq"),
        F.stddev_samp(F.col("p") - F.col("b")).alias("tracking_sd"),
        F.covar_samp("p", "b").alias("cov"), F.var_samp("b").alias("var_b"),
        F.abs(F.least(F.min("drawdown"), F.lit(0.0))).alias("max_dd"),
    )
    n = F.col("observation_count")
    status = (
        F.when(F.coalesce(F.col("invalid"), F.lit(False)), "invalid_input")
        .when((n < config.min_observations) & F.col("no_b"), "missing_benchmark")
        .when((n < config.min_observations) & F.col("no_f"), "missing_risk_free_rate")
        .when(n < config.min_observations, "insufficient_observations")
        .otherwise("succeeded")
    )

    def yearly(total: str) -> Column:
        return F.pow(1 + F.col(total), F.try_divide(F.lit(float(days)), n)) - 1

    base = a.select(
        "*", status.alias("metric_status"), yearly("hpr").alias("ann"), yearly("bench_hpr").alias("ann_b"),
        yearly("rf_hpr").alias("ann_f"), (F.col("sd") * days**0.5).alias("vol"),
        (F.sqrt(F.try_divide(F.col("shortfall_sq"), n - 1)) * days**0.5).alias("down"),
        (F.col("tracking_sd") * days**0.5).alias("te"), F.when(F.col("var_b") != 0, F.col("cov") / F.col("var_b")).alias("beta_"),
    )

    def ratio(numerator: Column, denominator: str) -> Column:
        return F.when(F.col(denominator) != 0, numerator / F.col(denominator))

    excess = F.col("ann") - F.col("ann_f")
    values = {
        "holding_period_return": F.col("hpr"),
        "annualized_return": F.col("ann"),
        "annualized_volatility": F.col("vol"),
        "max_drawdown": F.col("max_dd"),
        "calmar_ratio": ratio(F.col("ann"), "max_dd"),
        "downside_deviation": F.col("down"),
        "sortino_ratio": ratio(excess, "down"),
        "sharpe_ratio": ratio(excess, "vol"),
        "information_ratio": ratio(F.col("ann") - F.col("ann_b"), "te"),
        "beta": F.col("beta_"),
        "alpha": F.col("ann") - (F.col("ann_f") + F.col("beta_") * (F.col("ann_b") - F.col("ann_f"))),
        "treynor_ratio": ratio(excess, "beta_"),
    }
    done = F.col("metric_status") == "succeeded"
    return base.select(
        *keys, "metric_status",
        F.when(F.col("metric_status") == "invalid_input", 0).otherwise(n).alias("observation_count"),
        *[F.when(done, e).alias(name) for name, e in values.items()],
    )


def performance_status(perf: DataFrame, keys=RUN) -> DataFrame:
    """One status and reason per run and metric."""
    long = unpivot_metrics(perf, [*keys, "metric_status"], METRICS)
    reason = F.lit(None).cast("string")
    for metric, text in ZERO_DIVISION_REASONS.items():
        reason = F.when(F.col("metric_name") == metric, text).otherwise(reason)
    series_reason = F.lit("none")
    for status, text in SERIES_REASONS.items():
        series_reason = F.when(F.col("metric_status") == status, text).otherwise(series_reason)
    zero = (F.col("metric_status") == "succeeded") & F.col("metric_value").isNull() & reason.isNotNull()
    return long.select(
        *keys, "metric_name",
        F.when(zero, "zero_division").otherwise(F.col("metric_status")).alias("metric_status"),
        F.when(zero, reason).otherwise(series_reason).alias("reason_code"),
    )


def metric_rank(long: DataFrame, directions: DataFrame, groups: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Rank per metric, direction from the catalog table.

    The ids make every rank unique. A metric's group holds every run, so the rank comes from a
    cluster-wide sort instead of a window.
    """
    rankable = long.join(directions.where("rank_direction <> 'none'").select("metric_name", "rank_direction"), "metric_name").where(
        "metric_value is not null"
    )
    directed = F.when(F.col("rank_direction") == "desc", F.col("metric_value")).otherwise(-F.col("metric_value"))
    return global_rank(rankable, [*groups, "metric_name"], [directed.desc(), *[F.col(i) for i in ids]], "metric_rank")


def performance_rank(perf: DataFrame, groups: Sequence[str] = (), keys=RUN) -> DataFrame:
    """Ranks of the succeeded performance metrics."""
    # A metric of a succeeded run that could not be divided is NULL, which the rank leaves out.
    long = unpivot_metrics(perf.where("metric_status = 'succeeded'"), [*keys, *groups], METRICS)
    return metric_rank(long, rank_catalog(perf.sparkSession), groups, keys)


def trade_rank(metrics: DataFrame, groups: Sequence[str] = (), keys=RUN) -> DataFrame:
    """Ranks of the trade metrics."""
    long = unpivot_metrics(metrics, [*keys, *groups], list(TRADE_DIRECTIONS))
    return metric_rank(long, rank_catalog(metrics.sparkSession, TRADE_DIRECTIONS), groups, keys)
