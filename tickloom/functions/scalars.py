"""Scalar column functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.codes import as_column

# Text patterns, quarter words, board limits, anniversary of the rule change.
PER_TEN_PATTERNS = {
    "cash": "10派([0-9]+(?:\\.[0-9]+)?)元",
    "bonus": "10送([0-9]+(?:\\.[0-9]+)?)(?:股)?",
    "transfer": "10转([0-9]+(?:\\.[0-9]+)?)(?:股)?",
    "allotment": "每?10股配([0-9]+(?:\\.[0-9]+)?)股",
}
REPORT_QUARTERS = {"一季报": 1, "中报": 2, "三季报": 3, "年报": 4}
ANNUAL_REPORT = "年报"
MAIN_BOARDS = ("sse_main_board", "szse_main_board")
GROWTH_BOARDS = ("star_market", "chinext")


@dataclass(frozen=True)
class PriceLimitRules:
    main: float = 0.10
    special_before: float = 0.05
    special_from: float = 0.10
    special_change_date: str = "2026-07-06"
    growth: float = 0.20


@dataclass(frozen=True)
class FeeConfig:
    commission_rate: float = 0.0003
    commission_rate_max: float = 0.003
    commission_min: float = 5.0
    stamp_duty_rate: float = 0.0005
    transfer_fee_rate: float = 0.00001
    slippage_bps: float = 5.0


def safe_ratio(
    num: Column | str,
    den: Column | str,
    scale: float = 1.0,
    require_positive_num: bool = False,
) -> Column:
    """``num / den * scale``, NULL unless both exist and the denominator is positive."""
    n, d = as_column(num), as_column(den)
    ok = n.isNotNull() & (d > 0)
    if require_positive_num:
        ok = ok & (n > 0)
    return F.when(ok, n / d * scale if scale != 1.0 else n / d)


def price_limits(
    df: DataFrame, rules: PriceLimitRules = PriceLimitRules(), rounding: str = "half_even"
) -> DataFrame:
    """Limit ratio by board, special treatment and date; limit prices at 2 dp.

    ``rounding`` settles prices half a cent between two cents: ``half_even`` or ``half_up``.
    """
    cents = {"half_even": F.rint, "half_up": lambda c: F.floor(c + 0.5).cast("double")}[rounding]
    special = F.coalesce(F.col("is_st"), F.lit(False))
    before = F.col("trade_date") < F.lit(rules.special_change_date).cast("date")
    on_main = F.col("security_board").isin(*MAIN_BOARDS)
    ratio = (
        F.when(on_main & special & before, rules.special_before)
        .when(on_main & special, rules.special_from)
        .when(on_main, rules.main)
        .when(F.col("security_board").isin(*GROWTH_BOARDS), rules.growth)
    )
    reference = F.when(F.col("prev_close_price") > 0, F.col("prev_close_price"))
    return df.select(
        "*",
        ratio.alias("price_limit_ratio"),
        (cents(reference * (1 + ratio) * 100) / 100).alias("limit_up_price"),
        (cents(reference * (1 - ratio) * 100) / 100).alias("limit_down_price"),
    )


def parse_per_ten(column: Column | str, verb: str) -> Column:
    """Per-share quantity from "per ten shares" plan text, 0 where the text has none."""
    found = F.regexp_extract(F.coalesce(as_column(column), F.lit("")), PER_TEN_PATTERNS[verb], 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double") / 10, F.lit(0.0))


def blank_to_null(column: Column | str) -> Column:
    return F.nullif(as_column(column), F.lit(""))


def first_non_blank(*columns: Column | str) -> Column:
    """First column that is neither NULL nor the empty text."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def exrights_tag(has_cash: Column | str, has_right: Column | str) -> Column:
    """DR for cash and rights, XD for cash, XR for rights."""
    cash, right = as_column(has_cash), as_column(has_right)
    return F.when(cash & right, "DR").when(cash, "XD").when(right, "XR")


def record_key(columns: Sequence[str]) -> Column:
    """Upper-case SHA-256 over ``name=value`` pairs joined by ``|``, ``<NULL>`` for NULL."""
    pairs = [
        F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("<NULL>"))) for c in columns
    ]
    return F.upper(F.sha2(F.concat_ws("|", *pairs), 256))


def daily_rate(column: Column | str, days: int = 252) -> Column:
    """Annual to daily rate."""
    return F.pow(1 + as_column(column), F.lit(1.0 / days)) - 1


def simple_return(price: Column | str, previous: Column | str) -> Column:
    """``price / previous - 1`` where the previous price is positive."""
    return safe_ratio(price, previous) - 1


def change_pct(price: Column | str, previous: Column | str) -> Column:
    return safe_ratio(as_column(price) - as_column(previous), previous, 100)


def amplitude_pct(high: Column | str, low: Column | str, previous: Column | str) -> Column:
    return safe_ratio(as_column(high) - as_column(low), previous, 100)


def prior_year_end(column: Column | str) -> Column:
    """31 December of the year before."""
    return F.make_date(F.year(as_column(column)) - 1, F.lit(12), F.lit(31))


def add_years(column: Column | str, n: int) -> Column:
    return F.add_months(as_column(column), 12 * n)


def quarter_number(column: Column | str) -> Column:
    c = as_column(column)
    result = F.lit(None).cast("int")
    for word, number in REPORT_QUARTERS.items():
        result = F.when(c == word, number).otherwise(result)
    return result


def annualize_ytd(value: Column | str, report_type: Column | str) -> Column:
    """Full-year forecast of a year-to-date value (P20)."""
    return as_column(value) * (4.0 / quarter_number(report_type))


def select_ohlc(df: DataFrame, adjustment: str = "none", prefix: str = "") -> DataFrame:
    """Open, high, low and close of one adjustment, all NULL if any leg is."""
    suffix = {"none": "", "forward": "_forward_adj", "backward": "_backward_adj"}[adjustment]
    legs = [f"{leg}_price{suffix}" for leg in ("open", "high", "low", "close")]
    whole = F.col(legs[0]).isNotNull()
    for leg in legs[1:]:
        whole = whole & F.col(leg).isNotNull()
    return df.select(
        "*",
        *[
            F.when(whole, F.col(leg)).alias(f"{prefix}{name}")
            for leg, name in zip(legs, ("open", "high", "low", "close"), strict=True)
        ],
    )


def trade_costs(
    df: DataFrame, fees: FeeConfig = FeeConfig(), price: str = "reference_price"
) -> DataFrame:
    """Slippage price, gross amount and fee breakdown per trade."""
    selling = F.col("side") == "sell"
    slip = fees.slippage_bps / 10000.0
    gross = F.col("execution_price") * F.col("quantity")
    commission = F.greatest(
        F.col("gross_amount") * min(fees.commission_rate, fees.commission_rate_max),
        F.lit(fees.commission_min),
    )
    duty = F.when(selling, F.col("gross_amount") * fees.stamp_duty_rate).otherwise(0.0)
    transfer = F.col("gross_amount") * fees.transfer_fee_rate
    return (
        df.withColumn(
            "execution_price",
            F.col(price) * F.when(selling, F.lit(1.0 - slip)).otherwise(F.lit(1.0 + slip)),
        )
        .withColumn("gross_amount", gross)
        .select("*", commission.alias("commission"), duty.alias("stamp_duty"), transfer.alias("transfer_fee"))
        .withColumn("total_fee", F.col("commission") + F.col("stamp_duty") + F.col("transfer_fee"))
        .withColumn(
            "slippage_cost", F.abs(F.col("execution_price") - F.col(price)) * F.col("quantity")
        )
    )


def floor_to_lot(column: Column | str, lot: int = 100) -> Column:
    """Whole lots of a quantity, 0 below one lot."""
    return F.greatest(F.floor(as_column(column) / lot) * lot, F.lit(0)).cast("double")


def target_weight(reserve: Column, max_positions: Column, cap: Column) -> Column:
    """``min((1 - reserve) / max_positions, cap)``."""
    return F.least((1 - reserve) / max_positions, cap)


def statement_start(latest: Column, live_start: Column, key: Column) -> Column:
    """Start of a statement period, clipped to the live start."""
    raw = (
        F.when(key == "month", F.trunc(latest, "month"))
        .when(key == "3m", F.add_months(latest, -3))
        .when(key == "6m", F.add_months(latest, -6))
        .when(key == "ytd", F.trunc(latest, "year"))
        .when(key == "all", live_start)
    )
    return F.greatest(raw, live_start)
