"""Layered models: staging, share history, quotes, adjustment, valuation, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import codes, scalars
from tickloom.operators import tables
from tickloom.operators.joins import forward_fill, grid
from tickloom.operators.scans import AFTER, UP_TO, Side, asof_many

CODE, DATE = "security_code", "trade_date"

# Column mappings of the rename-only layers: source name to our name. One select serves them all.
STAGING_MAPPINGS = {
    "income_ytd": {
        "security_code": "security_code", "report_date": "report_date", "report_type": "report_type",
        "ytd_profit": "parent_netprofit", "total_assets": "total_assets",
        "total_parent_equity": "total_parent_equity", "share_capital": "share_capital",
    },
    "trade_calendar": {"trade_date": "trade_date"},
    "government_bond": {"work_date": "trade_date", "curve_name": "curve_name", "one_year_yield_pct": "one_year_yield_pct"},
}
MART_MAPPINGS = {
    "share_capital_history": {
        "security_code": "security_code", "end_date": "change_date", "total_shares": "total_shares",
        "unlimited_shares": "float_shares", "listed_a_shares": "a_float_shares", "limited_a_shares": "limited_a_shares",
    },
    "boll_daily": {"security_code": "security_code", "trade_date": "trade_date", "boll_mid_20": "boll_mid_20"},
}


def rename_select(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Fixed column list under new names."""
    return df.select(*[F.col(source).alias(name) for source, name in mapping.items()])


def stage_quotes(raw: DataFrame) -> DataFrame:
    """Unadjusted daily quotes under canonical names."""
    return raw.where("adjustflag = 3").select(
        codes.normalize_code("code", codes.PREFIX).alias(CODE), F.col("date").alias(DATE),
        F.col("open").alias("open_price"), F.col("high").alias("high_price"), F.col("low").alias("low_price"),
        F.col("close").alias("close_price"), F.col("preclose").alias("prev_close_price"), "volume", "amount",
        (F.col("tradestatus") == 0).alias("is_suspend"), F.col("isST").alias("is_st"),
    )


def shares_history(equity: DataFrame, holders: DataFrame) -> DataFrame:
    """Share counts per change point with validity range."""
    major = tables.major_holders(holders)
    points = tables.union_distinct(
        equity.select(CODE, F.col("end_date").alias("effective_date")),
        major.select(CODE, F.col("end_date").alias("effective_date")),
    )
    both = asof_many(points, [CODE], "effective_date", [
        Side(
            equity.withColumn("source_equity_end_date", F.col("end_date")), "end_date",
            ("source_equity_end_date", "total_shares", "unlimited_shares", "listed_a_shares", "limited_a_shares"), unique=False,
        ),
        Side(
            major.withColumn("source_freeholders_end_date", F.col("end_date")), "end_date",
            ("source_freeholders_end_date", "major_holder_a_float_shares", "major_holder_count"),
        ),
    ]).where(F.col("source_equity_end_date").isNotNull())
    listed, limited = F.col("listed_a_shares"), F.col("limited_a_shares")
    held = F.coalesce("major_holder_a_float_shares", F.lit(0.0))
    return tables.with_expiry(both, [CODE]).select(
        CODE, "effective_date", "expiry_date", "source_equity_end_date", "source_freeholders_end_date", "total_shares",
        F.col("unlimited_shares").alias("float_shares"),
        F.when(listed.isNotNull() | limited.isNotNull(), F.coalesce(listed, F.lit(0.0)) + F.coalesce(limited, F.lit(0.0))).alias("shares"),
        listed.alias("float_shares_a"),
        F.when(listed.isNotNull(), F.greatest(F.lit(0.0), listed - held)).alias("free_float_shares"),
        held.alias("major_holder_a_float_shares"),
        F.coalesce("major_holder_count", F.lit(0)).alias("major_holder_count"),
    )


def exrights_events(main: DataFrame, allotment: DataFrame) -> DataFrame:
    """Ex-rights events per security and ex-date from dividend plans and allotments (A10)."""
    text = scalars.first_non_blank("new_profile", "impl_plan_profile", "impl_plan_newprofile")
    plans = main.where(
        (F.col("assign_progress") == "实施方案") & ~F.col("is_unassign") & F.col("ex_dividend_date").isNotNull()
    ).withColumn("plan_text", text)
    components = plans.select(
        CODE, "ex_dividend_date", "equity_record_date", "notice_date", "report_date", "report_period_label",
        scalars.parse_per_ten("plan_text", "cash").alias("cash_dividend_per_share"),
        scalars.parse_per_ten("plan_text", "bonus").alias("bonus_share_per_share"),
        scalars.parse_per_ten("plan_text", "transfer").alias("transfer_share_per_share"),
        F.lit(0.0).alias("allotment_share_per_share"),
        F.lit(True).alias("source_has_dividend_main"), F.lit(False).alias("source_has_allotment"),
        F.col("plan_text").alias("source_plan_text"),
    )
    rights = allotment.where(F.col("ex_dividend_date").isNotNull()).select(
        CODE, "ex_dividend_date", "equity_record_date", "notice_date",
        *[F.lit(0.0).alias(c) for c in ("cash_dividend_per_share", "bonus_share_per_share", "transfer_share_per_share")],
        scalars.parse_per_ten("event_explain", "allotment").alias("allotment_share_per_share"),
        F.col("issue_price").alias("allotment_price_yuan"),
        F.lit(False).alias("source_has_dividend_main"), F.lit(True).alias("source_has_allotment"),
        F.col("event_explain").alias("source_allotment_text"),
    )
    # One aggregate over both sources; texts come from the latest notice, then the largest text.
    def latest(c: str):
        return tables.last_valid(c, F.struct("notice_date", c)).alias(c)

    merged = components.unionByName(rights, allowMissingColumns=True).groupBy(CODE, "ex_dividend_date").agg(
        F.min("equity_record_date").alias("equity_record_date"), F.max("notice_date").alias("notice_date"),
        F.max("report_date").alias("report_date"), latest("report_period_label"),
        *[F.max(c).alias(c) for c in (
            "cash_dividend_per_share", "bonus_share_per_share", "transfer_share_per_share", "allotment_share_per_share",
            "allotment_price_yuan",
        )],
        F.bool_or("source_has_dividend_main").alias("source_has_dividend_main"),
        F.bool_or("source_has_allotment").alias("source_has_allotment"),
        latest("source_plan_text"), latest("source_allotment_text"),
    )
    cash = F.col("cash_dividend_per_share") > 0
    right = (F.col("bonus_share_per_share") > 0) | (F.col("transfer_share_per_share") > 0) | (F.col("allotment_share_per_share") > 0)
    return merged.select(
        "*", scalars.exrights_tag(cash, right).alias("event_tag"), cash.alias("has_cash_dividend"), right.alias("has_share_right"),
    ).where("has_cash_dividend or has_share_right")


def cash_events(events: DataFrame) -> DataFrame:
    return events.where("has_cash_dividend and cash_dividend_per_share > 0")


def annual_dividends(events: DataFrame) -> DataFrame:
    """Cash of the reports of 31 December, dated at their last ex-date."""
    year_end = (F.month("report_date") == 12) & (F.dayofmonth("report_date") == 31)
    return cash_events(events).where(year_end).groupBy(CODE, "report_date").agg(
        F.sum("cash_dividend_per_share").alias("latest_annual_cash_dividend_per_share"),
        F.max("ex_dividend_date").alias("latest_ex_dividend_date"),
    )


def cumulative_dividends(events: DataFrame) -> DataFrame:
    """Running cash per security and ex-date (W04); one row per key and day after the sum."""
    daily = cash_events(events).groupBy(CODE, "ex_dividend_date").agg(F.sum("cash_dividend_per_share").alias("cash"))
    window = Window.partitionBy(CODE).orderBy("ex_dividend_date").rowsBetween(*UP_TO)
    return daily.select(CODE, "ex_dividend_date", F.sum("cash").over(window).alias("cumulative_cash"))


def year_after(column: str):
    """First day whose date one year earlier is on or after the given one."""
    leap = (F.month(column) == 2) & (F.dayofmonth(column) == 29)
    return F.when(leap, F.make_date(F.year(column) + 1, F.lit(3), F.lit(1))).otherwise(scalars.add_years(column, 1))


def cumulative_sides(cumulative: DataFrame) -> list[Side]:
    """The running sum as it stood now and one year ago, both on today's time axis."""
    now = cumulative.select(CODE, "ex_dividend_date", F.col("cumulative_cash").alias("current_cumulative"))
    before = cumulative.select(
        CODE, year_after("ex_dividend_date").alias("_known"), F.col("ex_dividend_date").alias("_ex"),
        F.col("cumulative_cash").alias("previous_cumulative"),
    )
    return [
        Side(now, "ex_dividend_date", ("current_cumulative",)),
        Side(before, "_known", ("previous_cumulative",), tie_break=("_ex",), unique=False),
    ]


def with_ttm_cash(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "ttm_cash", F.col("current_cumulative") - F.coalesce("previous_cumulative", F.lit(0.0))
    ).drop("current_cumulative", "previous_cumulative")


def ttm_from_cumulative(df: DataFrame, cumulative: DataFrame, date: str = DATE) -> DataFrame:
    """Trailing-year sum as the difference of two as-of running sums."""
    return with_ttm_cash(asof_many(df, [CODE], date, cumulative_sides(cumulative)))


def quotes_unadj(
    quotes: DataFrame, universe: DataFrame, days: DataFrame, shares: DataFrame, events: DataFrame,
    first_date: str = "1995-01-01", limits: scalars.PriceLimitRules = scalars.PriceLimitRules(), rounding: str = "half_even",
) -> DataFrame:
    """Unadjusted daily quotes with share counts, limits, caps and dividend yields.

    Only days after ``first_date`` are read; other first days can be passed.

    Every input holds one row per security and day, so the as-of scans are bounded by the calendar
    and all of them, like the adjustment windows after, use the security as their only shuffle key.
    Each side lies by security before it is stacked, so that the stack is not shuffled again.
    """
    base = quotes.where(F.col(DATE) > F.lit(first_date).cast("date")).join(
        universe.select(CODE, "security_board"), CODE
    ).join(F.broadcast(days.select(DATE, "prev_trade_date")), DATE, "left")
    # The row on the previous trading day is the lagged row if that row has exactly that date.
    window = Window.partitionBy(CODE).orderBy(DATE)
    on_time = F.lag(DATE).over(window) == F.col("prev_trade_date")
    base = base.select(
        "*", F.when(on_time, F.lag("close_price").over(window)).alias("prev_close_price_unadj"),
        F.when(on_time, F.lag("volume").over(window)).alias("prev_volume"),
    ).drop("prev_trade_date")
    matched = asof_many(base, [CODE], DATE, [
        Side(shares, "effective_date", ("shares", "float_shares_a", "free_float_shares"), valid_to="expiry_date"),
        Side(
            annual_dividends(events).repartition(CODE), "latest_ex_dividend_date", ("latest_annual_cash_dividend_per_share",),
            tie_break=("report_date",), unique=False,
        ),
        *cumulative_sides(cumulative_dividends(events)),
    ])
    full = scalars.price_limits(with_ttm_cash(matched), limits, rounding)
    close = F.when(F.col("close_price") >= 0, F.col("close_price"))

    def cap(shares_column: str):
        return F.when(F.col(shares_column) > 0, close * F.col(shares_column))

    return full.select(
        CODE, DATE, "open_price", "high_price", "low_price", "close_price", "prev_close_price", "prev_close_price_unadj",
        "prev_volume", "volume", "amount",
        scalars.safe_ratio("volume", "float_shares_a", 100).alias("turnover_rate_pct"),
        scalars.safe_ratio("volume", "free_float_shares", 100).alias("turnover_rate_free_float_pct"),
        scalars.amplitude_pct("high_price", "low_price", "prev_close_price").alias("amplitude_pct"),
        scalars.change_pct("close_price", "prev_close_price").alias("change_pct"),
        "limit_up_price", "limit_down_price",
        cap("shares").alias("market_cap"), cap("float_shares_a").alias("float_market_cap"),
        cap("free_float_shares").alias("free_float_market_cap"), "shares", "float_shares_a", "free_float_shares",
        scalars.safe_ratio("latest_annual_cash_dividend_per_share", "close_price", 100).alias("dy_static_pct"),
        scalars.safe_ratio("ttm_cash", "close_price", 100).alias("dy_ttm_pct"), "is_suspend", "is_st",
    )


def with_factors(quotes: DataFrame) -> DataFrame:
    """``quotes`` with backward and forward adjustment ratios and factors, from windows on its own partitioning."""
    before, reported = F.col("prev_close_price_unadj"), F.col("prev_close_price")
    valid = F.coalesce((before > 0) & (reported > 0), F.lit(False))
    ordered = Window.partitionBy(CODE).orderBy(DATE)
    ratios = quotes.select(
        "*", F.when(valid, before / reported).otherwise(1.0).alias("backward_adjustment_ratio"),
        F.when(valid, reported / before).otherwise(1.0).alias("forward_adjustment_ratio"),
    )
    return ratios.select(
        "*",
        F.exp(F.sum(F.log("backward_adjustment_ratio")).over(ordered.rowsBetween(*UP_TO))).alias("backward_adjustment_factor"),
        F.exp(
            F.coalesce(F.sum(F.log("forward_adjustment_ratio")).over(ordered.rowsBetween(*AFTER)), F.lit(0.0))
        ).alias("forward_adjustment_factor"),
    )


def adjustment_factors(quotes: DataFrame) -> DataFrame:
    """Backward and forward adjustment ratios and factors."""
    return with_factors(quotes.select(CODE, DATE, "prev_close_price_unadj", "prev_close_price"))


ADJUSTED_PRICES = ("open_price", "high_price", "low_price", "close_price", "prev_close_price")


def adjusted_columns() -> list:
    return [
        (F.col(p) * F.col(f"{way}_adjustment_factor")).alias(f"{p}_{way}_adj") for way in ("backward", "forward") for p in ADJUSTED_PRICES
    ]


def with_adjusted(quotes: DataFrame) -> DataFrame:
    """``quotes`` with its prices adjusted in both directions, in the same pass."""
    return with_factors(quotes).select(*quotes.columns, *adjusted_columns())


def quotes_adj(quotes: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Adjusted prices in both directions.

    Without a stored factor table the factors are windows over the quotes themselves; a given table
    is joined on its unique key.
    """
    if factors is None:
        return with_factors(quotes).select(CODE, DATE, *adjusted_columns())
    chosen = factors.select(CODE, DATE, "backward_adjustment_factor", "forward_adjustment_factor")
    return quotes.select(CODE, DATE, *ADJUSTED_PRICES).join(chosen, [CODE, DATE]).select(CODE, DATE, *adjusted_columns())


def financial_valuation(
    income_ytd: DataFrame, income_quarter: DataFrame, balance: DataFrame, quotes: DataFrame, shares: DataFrame,
    month_end_aware: bool = False,
) -> DataFrame:
    """Valuation ratios per security and report period (D05). Statements are unique per key."""
    key = [CODE, "report_date"]
    periods = tables.union_distinct(income_ytd.select(*key), balance.select(*key))
    annual = income_ytd.where(F.col("report_type") == scalars.ANNUAL_REPORT).select(
        CODE, "report_date", F.col("parent_netprofit").alias("annual_parent_netprofit")
    )
    latest = asof_many(periods, [CODE], "report_date", [
        Side(quotes, DATE, ("close_price",)),
        Side(shares, "effective_date", ("total_shares",), valid_to="expiry_date"),
        Side(annual, "report_date", ("annual_parent_netprofit",)),
        Side(balance, "report_date", ("total_assets", "total_parent_equity", "share_capital")),
    ])
    trailing = tables.ttm(income_quarter.select(*key, "parent_netprofit"), "parent_netprofit", month_end_aware).select(
        *key, F.col("ttm_parent_netprofit")
    )
    current = income_ytd.select(
        *key, F.col("parent_netprofit").alias("ytd"), scalars.annualize_ytd("parent_netprofit", "report_type").alias("forecast")
    )
    opening = balance.select(
        CODE, F.col("report_date").alias("_opening"), F.col("total_assets").alias("opening_assets"),
        F.col("total_parent_equity").alias("opening_equity"),
    )
    joined = (
        latest.join(trailing, key, "left").join(current, key, "left")
        .withColumn("_opening", scalars.prior_year_end("report_date")).join(opening, [CODE, "_opening"], "left")
    )
    cap = F.when((F.col("close_price") > 0) & (F.col("total_shares") > 0), F.col("close_price") * F.col("total_shares"))

    def mean_of(opening_column: str, closing: str):
        a, b = F.col(opening_column), F.col(closing)
        return F.when((a > 0) & (b > 0), (a + b) / 2)

    return joined.select(
        *key,
        scalars.safe_ratio(cap, "annual_parent_netprofit").alias("pe_static"),
        scalars.safe_ratio(cap, "ttm_parent_netprofit").alias("pe_ttm"),
        scalars.safe_ratio(cap, "forecast").alias("pe_forecast"),
        scalars.safe_ratio(cap, "total_parent_equity").alias("pb_mrq"),
        scalars.safe_ratio("total_parent_equity", "share_capital", require_positive_num=True).alias("book_value_per_share"),
        scalars.safe_ratio("ytd", "total_parent_equity").alias("roe"),
        scalars.safe_ratio("ytd", "total_assets").alias("roa"),
        scalars.safe_ratio("ytd", mean_of("opening_assets", "total_assets")).alias("roaa"),
        scalars.safe_ratio("ytd", mean_of("opening_equity", "total_parent_equity")).alias("roae"),
    )


def index_quotes(quotes: DataFrame, basics: DataFrame) -> DataFrame:
    """Quotes of indexes with their daily return."""
    indexes = codes.universe(basics, "index").select(CODE)
    return quotes.join(indexes, CODE, "left_semi").select(
        CODE, DATE, "open_price", "high_price", "low_price", "close_price", "prev_close_price",
        scalars.simple_return("close_price", "prev_close_price").alias("return_daily"), "volume", "amount",
    )


def benchmark_returns(index_quotes_: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Returns of the benchmark indexes."""
    return index_quotes_.join(benchmarks.select(CODE), CODE, "left_semi").select(
        CODE, DATE, "close_price", "prev_close_price", "return_daily"
    )


def risk_free_daily(calendar: DataFrame, yields: DataFrame, tenors: dict[str, str] | None = None, days: int = 252) -> DataFrame:
    """Daily risk-free rate on every trading day, the last known yield carried forward."""
    tenors = tenors or {"1y": "one_year_yield_pct"}
    series = yields.select("trade_date", *[F.col(c).alias(t) for t, c in tenors.items()]).unpivot(
        ["trade_date"], list(tenors), "source_tenor", "pct"
    ).where("pct is not null").select(
        "source_tenor", F.col("trade_date").alias("source_date"), (F.col("pct") / 100.0).alias("annual_rate")
    )
    days_grid = grid(calendar.select(DATE).distinct(), list(tenors), "source_tenor")
    filled = forward_fill(days_grid, series, ["source_tenor"], "source_date", ["source_date", "annual_rate"])
    return filled.select(
        DATE, "source_date", "source_tenor", "annual_rate", scalars.daily_rate("annual_rate", days).alias("daily_rate")
    )


PLAN_COLUMNS = (
    "security_code", "security_name_abbr", "notice_date", "report_period_label", "report_date", "assign_progress",
    "is_unassign", "impl_plan_profile", "impl_plan_newprofile", "new_profile", "equity_record_date", "ex_dividend_date",
)


def dividend_plans(main: DataFrame) -> DataFrame:
    """Distinct dividend plans with record and group keys."""
    plans = main.select(*PLAN_COLUMNS).distinct()
    return plans.select(
        scalars.record_key(PLAN_COLUMNS).alias("dividend_plan_record_key"),
        scalars.record_key(["security_code", "report_period_label"]).alias("dividend_plan_group_key"), *PLAN_COLUMNS,
    )
