"""Aggregations, windows, top-k and reshaping (A, W, T and U operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.scans import UP_TO, asof_join, running

# Rank direction of each portfolio metric.
PERFORMANCE_DIRECTIONS = {
    "holding_period_return": "desc",
    "annualized_return": "desc",
    "annualized_volatility": "asc",
    "max_drawdown": "asc",
    "calmar_ratio": "desc",
    "downside_deviation": "asc",
    "sortino_ratio": "desc",
    "sharpe_ratio": "desc",
    "information_ratio": "desc",
    "beta": "none",
    "alpha": "desc",
    "treynor_ratio": "desc",
}
TRADE_DIRECTIONS = {
    "closed_trade_count": "desc",
    "win_rate_closed_trades": "desc",
    "average_win_return": "desc",
    "average_loss_return": "asc",
    "profit_loss_ratio": "desc",
    "average_holding_days": "asc",
    "largest_win_return": "desc",
    "largest_loss_return": "asc",
}


# --- aggregations ----------------------------------------------------------------------------


def sum_if(value: Column | str, condition: Column) -> Column:
    """Sum where the condition holds, 0 if it never does."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def rebalance_counts(trades: DataFrame) -> DataFrame:
    """Distinct securities bought and sold per run and day."""
    def distinct(side: str) -> Column:
        return F.count_distinct(F.when(F.col("side") == side, F.col("security_code")))

    return trades.groupBy("run_id", "attempt_id", "trade_date").agg(
        distinct("buy").alias("buy_count"), distinct("sell").alias("sell_count")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str], by: Column) -> DataFrame:
    """Row, distinct-key and duplicate counts per partition value.

    Keys are counted first, so the second step sums one row per key.
    """
    per_key = df.groupBy(by.alias("part"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("part").agg(
        F.sum("n").alias("row_count"),
        F.count(F.lit(1)).alias("key_count"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_count"),
    )


def approx_distinct(df: DataFrame, column: str, rsd: float = 0.02) -> DataFrame:
    """Approximate distinct count."""
    return df.agg(F.approx_count_distinct(column, rsd).alias("approx_distinct"))


def latest_by(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Values at the latest ``order`` per key (A06); map-side combined, no window."""
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *columns)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in (order, *columns)])


def first_valid(column: str, order: str | Column) -> Column:
    """Value at the smallest ``order`` among rows where it is set."""
    order = F.col(order) if isinstance(order, str) else order
    return F.min_by(column, F.when(F.col(column).isNotNull(), order))


def last_valid(column: str, order: str | Column) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.max_by(column, F.when(F.col(column).isNotNull(), order))


def major_holders(holders: DataFrame, pct: float = 5.0) -> DataFrame:
    """Shares and number of A-share holders above ``pct`` per security and report."""
    deduped = (
        holders.where(F.col("shares_type") == "A股")
        .groupBy("security_code", F.col("report_date").alias("end_date"), "holder_identifier", "holder_name", "shares_type")
        .agg(
            F.max("free_float_hold_shares").alias("shares"),
            F.max("free_float_holdnum_ratio_pct").alias("ratio"),
        )
    )
    major = F.col("ratio") > pct
    return deduped.groupBy("security_code", "end_date").agg(
        sum_if("shares", major).alias("major_holder_a_float_shares"),
        F.count_if(major).alias("major_holder_count"),
    )


def compound(column: Column | str) -> Column:
    """Product of ``1 + r`` minus one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.product(1 + column) - 1


def daily_win_rate(nav: DataFrame, keys=("run_id", "attempt_id")) -> DataFrame:
    """Share of days with a positive return."""
    r = F.col("daily_return")
    return nav.groupBy(*keys).agg(
        F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("win_rate"),
        F.count(r).alias("observation_count"),
        F.count_if(r > 0).alias("winning_day_count"),
    )


def settlement_date(marts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Latest date of every mart and the smallest of them, NULL if one has none."""
    latest = None
    for name, (df, date) in marts.items():
        part = df.agg(F.max(date).alias("latest_date")).select(F.lit(name).alias("mart"), "latest_date")
        latest = part if latest is None else latest.unionByName(part)
    return latest.agg(
        F.when(F.count(F.lit(1)) == F.count("latest_date"), F.min("latest_date")).alias("settlement_date"),
        F.max("latest_date").alias("newest_date"),
        F.count(F.lit(1)).alias("mart_count"),
    )


def fact_counts(facts: dict[str, DataFrame], keys=("run_id", "attempt_id")) -> DataFrame:
    """Rows of every fact table per attempt, one column per table."""
    stacked = None
    for name, df in facts.items():
        part = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("fact", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("fact") == n, F.col("n"))), F.lit(0)).alias(f"{n}_count") for n in facts]
    )


def demand_summary(demand: DataFrame, start: str = "start_date") -> DataFrame:
    """Spread of first-needed dates: min, lower-index p50 and p90, max, count in the first 20 %.

    Dates are counted first; the percentile then reads one row per date.
    """
    per_day = demand.groupBy(F.col(start).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.orderBy("d").rowsBetween(*UP_TO)  # one row per calendar date
    whole = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = per_day.select(
        "d", "n", F.sum("n").over(ordered).alias("hi"), F.sum("n").over(whole).alias("total"),
        F.min("d").over(whole).alias("first"), F.max("d").over(whole).alias("last"),
    )

    def at(percent: int) -> Column:
        index = F.floor((F.col("total") - 1) * percent / 100)
        return F.min(F.when(F.col("hi") > index, F.col("d")))

    early = F.date_diff("d", "first") <= F.date_diff("last", "first") * 0.2
    return placed.agg(
        F.min("d").alias("min_date"), at(50).alias("p50_date"), at(90).alias("p90_date"),
        F.max("d").alias("max_date"), F.sum(F.when(early, F.col("n")).otherwise(0)).alias("early_count"),
        F.max("total").alias("demand_count"),
    )


def run_day_counts(screened: DataFrame, calendar: DataFrame, runs: DataFrame) -> DataFrame:
    """Pool and signal counts per run and trading day, days without hits kept as 0."""
    daily = screened.groupBy("run_id", "trade_date").agg(
        F.count(F.lit(1)).alias("pool_count"), F.count_if("is_buy_signal").alias("signal_count")
    )
    # The wanted grid, one row per run and trading day: each run unfolds its own date range.
    days = runs.select(
        "run_id", F.explode(F.sequence("start_date", "end_date")).alias("trade_date")
    ).join(calendar.select("trade_date").distinct(), "trade_date", "left_semi")
    return days.join(daily, ["run_id", "trade_date"], "left").fillna(0, ["pool_count", "signal_count"])


def run_totals_of_days(day_counts: DataFrame) -> DataFrame:
    return day_counts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("day_count"), F.sum("pool_count").alias("pool_total"),
        F.sum("signal_count").alias("signal_total"),
    )


# --- windows ---------------------------------------------------------------------------------


def with_prev(
    df: DataFrame, columns: Sequence[str], key: str = "security_code", date: str = "trade_date"
) -> DataFrame:
    """``prev_x`` for every listed column, one sort for all."""
    window = Window.partitionBy(key).orderBy(date)
    return df.select("*", *[F.lag(c).over(window).alias(f"prev_{c}") for c in columns])


def trade_calendar(days: DataFrame, date: str = "trade_date") -> DataFrame:
    """Trading days with neighbours, running number and total.

    The only unpartitioned window in the package: its input is one row per calendar day.
    """
    window = Window.orderBy(date)
    return days.select(F.col(date).cast("date").alias(date)).distinct().select(
        date,
        F.lag(date).over(window).alias("prev_trade_date"),
        F.lead(date).over(window).alias("next_trade_date"),
        F.row_number().over(window).alias("day_no"),
        F.count(F.lit(1)).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int").alias("day_count"),
    )


def with_expiry(df: DataFrame, keys: Sequence[str], effective: str = "effective_date") -> DataFrame:
    """``expiry_date``: the day before the next effective date, NULL for the last."""
    window = Window.partitionBy(*keys).orderBy(effective)
    return df.withColumn("expiry_date", F.date_sub(F.lead(effective).over(window), 1))


def ttm(
    df: DataFrame, value: str, month_end_aware: bool = False, key="security_code", date="report_date"
) -> DataFrame:
    """Sum over four quarters that are all present and consecutive.

    By default the first quarter must lie exactly ``add_months(date, -9)`` back, which a report of
    30 September never meets; ``month_end_aware`` compares month ends.
    """
    ordered = Window.partitionBy(key).orderBy(date)
    frame = ordered.rowsBetween(-3, 0)
    wanted = F.add_months(date, -9)
    if month_end_aware:
        wanted = F.last_day(wanted)
    whole = (F.count(value).over(frame) == 4) & (F.lag(date, 3).over(ordered) == wanted)
    return df.withColumn(f"ttm_{value}", F.when(whole, F.sum(value).over(frame)))


def rank_signals(
    df: DataFrame, by: Sequence[str] = ("trade_date",), score: str = "score", tie: str = "security_code"
) -> DataFrame:
    """Rank by score within a date, ties by code (W08); a date holds one row per security."""
    window = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank_no", F.row_number().over(window))


def with_pool_count(df: DataFrame, by: Sequence[str] = ("trade_date",)) -> DataFrame:
    """Number of hits of the date on every row (W09). A date's pool is bounded by the universe, so one window does."""
    return df.withColumn("pool_count", F.count(F.lit(1)).over(Window.partitionBy(*by)))


def position_balance(trades: DataFrame, keys=("run_id", "attempt_id", "security_code")) -> DataFrame:
    """Running position per run and security (W11), over all trades before any period filter."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    return running(trades, keys, ["trade_date", "trade_seq"], {"position_balance_quantity": ("sum", signed)})


def lookback_start(df: DataFrame, n: int, upto: str, key="security_code", date="trade_date") -> DataFrame:
    """Earliest date among each security's last ``n`` rows before ``upto``."""
    window = Window.partitionBy(key).orderBy(F.col(date).desc())
    recent = df.where(F.col(date) < F.lit(upto).cast("date")).select(
        key, date, F.row_number().over(window).alias("rn")
    ).where(F.col("rn") <= n)
    return recent.agg(F.min(date).alias("lookback_start"))


def lookback_start_dates(df: DataFrame, n: int, upto: str, date="trade_date") -> DataFrame:
    """First of the last ``n`` distinct dates up to ``upto``."""
    days = df.where(F.col(date) <= F.lit(upto).cast("date")).select(date).distinct()
    return days.orderBy(F.col(date).desc()).limit(n).agg(F.min(date).alias("lookback_start"))


# --- top-k, sets, reshaping ------------------------------------------------------------------


def top_n_per_date(ranked: DataFrame, n: int) -> DataFrame:
    """Best ``n`` per date (T01); Spark limits groups before the shuffle."""
    return ranked.where(F.col("rank_no") <= n)


def latest_rows(df: DataFrame, n: int, upto: str, keys=("security_code",), date="trade_date") -> DataFrame:
    """Latest ``n`` rows of every series up to a date."""
    window = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    return df.where(F.col(date) <= F.lit(upto).cast("date")).withColumn(
        "_rn", F.row_number().over(window)
    ).where(F.col("_rn") <= n).drop("_rn")


def latest_targets(targets: DataFrame, n: int, keys=("run_id",), date="signal_date") -> DataFrame:
    """Rows of the latest signal date of every run, best ``n`` ranks."""
    newest = targets.groupBy(*keys).agg(F.max(date).alias(date))
    return targets.where(F.col("rank_no") <= n).join(newest, [*keys, date], "left_semi")


def virtual_account(nav: DataFrame, positions: DataFrame, keys=("run_id", "attempt_id")) -> DataFrame:
    """Equity of the latest day, its change to the day before and the positions held.

    The two latest days come from one aggregate of (date, equity), not from a sort of the run.
    """
    latest = _latest_two(nav, keys)
    held = positions.groupBy(*keys, "trade_date").agg(
        F.sum("market_value").alias("position_market_value"), F.count(F.lit(1)).alias("position_count")
    )
    return latest.join(held, [*keys, "trade_date"], "left").fillna(0, ["position_count"])


def _latest_two(nav: DataFrame, keys) -> DataFrame:
    newest = nav.groupBy(*keys).agg(F.max(F.struct("trade_date", "total_equity")).alias("_last"))
    earlier = nav.join(newest, list(keys)).where(F.col("trade_date") < F.col("_last.trade_date")).groupBy(*keys).agg(
        F.max_by("total_equity", "trade_date").alias("previous_equity")
    )
    return newest.join(earlier, list(keys), "left").select(
        *keys, F.col("_last.trade_date").alias("trade_date"), F.col("_last.total_equity").alias("total_equity"),
        "previous_equity", (F.col("_last.total_equity") - F.col("previous_equity")).alias("daily_pnl"),
    )


def trade_dates(df: DataFrame, start: str, end: str, date: str = "trade_date") -> DataFrame:
    """Distinct dates in a range, sorted."""
    bounds = F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.where(bounds).select(date).distinct().orderBy(date)


def nearest_trade_date(
    df: DataFrame, column: str, calendar: DataFrame, side: str, name: str = "nearest_trade_date"
) -> DataFrame:
    """Nearest trading day before, on or before, or after each date of a column.

    The few distinct dates are resolved against the calendar and joined back.
    """
    days = calendar.select(F.lit(1).alias("_k"), F.col("trade_date").alias("_day")).distinct()
    wanted = df.where(F.col(column).isNotNull()).select(F.lit(1).alias("_k"), F.col(column).alias("_want")).distinct()
    direction, strict = {"before": ("backward", True), "on_or_before": ("backward", False), "after": ("forward", True)}[side]
    found = asof_join(
        wanted, days, ["_k"], "_want", "_day", direction=direction, strict=strict, right_unique=True, bounded=True
    ).select(F.col("_want").alias(column), F.col("_day").alias(name))
    return df.join(found, column, "left")


def union_distinct(*parts: DataFrame) -> DataFrame:
    """Distinct rows of aligned inputs."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()


def key_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys on one side only, tagged."""
    left, right = a.select(*keys), b.select(*keys)
    return left.subtract(right).withColumn("side", F.lit("left_only")).unionByName(
        right.subtract(left).withColumn("side", F.lit("right_only"))
    )


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per id and metric."""
    pairs = [
        F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value")) for m in metrics
    ]
    return df.select(*ids, F.inline(F.array(*pairs)))


def rank_catalog(spark: SparkSession, directions: dict[str, str] = PERFORMANCE_DIRECTIONS) -> DataFrame:
    """Rank direction of every metric as a table."""
    return spark.createDataFrame(
        [(m, d, "exclude") for m, d in directions.items()],
        "metric_name string, rank_direction string, null_policy string",
    )

