"""Wide marts keyed (security_code, trade_date)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import indicators
from tickloom.operators.scans import asof_join
from tickloom.operators.tables import with_prev

KEY = ["security_code", "trade_date"]


def add_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the mart key, leaving out columns the left side has."""
    extra = [c for c in right.columns if c not in left.columns]
    return left.join(right.select(*KEY, *extra), KEY, "left")


def momentum_mart(rsi: DataFrame, kdj: DataFrame) -> DataFrame:
    """RSI with KDJ beside it."""
    return add_columns(rsi, kdj)


def trend_mart(averages: DataFrame, bands: DataFrame, macd: DataFrame, previous: Sequence[str]) -> DataFrame:
    """Averages, bands and MACD with previous-day values; the joins keep the partitioning by key."""
    return with_prev(add_columns(add_columns(averages, bands), macd), previous)


def quotes_mart(
    quotes: DataFrame, valuation: DataFrame, kdj: DataFrame, adjusted: DataFrame | None = None, asof_col: str = "report_date"
) -> DataFrame:
    """Quotes with adjusted prices, the latest valuation and KDJ.

    Adjusted prices are columns of ``quotes`` (``with_adjusted``) or come from a stored table.
    ``asof_col`` is the valuation date; ``report_date`` looks ahead of publication by design.
    """
    with_adjusted = quotes if adjusted is None else add_columns(quotes, adjusted)
    values = [c for c in valuation.columns if c not in ("security_code", asof_col)]
    valued = asof_join(
        with_adjusted, valuation.withColumnRenamed(asof_col, "valuation_date"), ["security_code"], "trade_date", "valuation_date",
        columns=["valuation_date", *values], right_unique=True, bounded=True,
    )
    return add_columns(valued, kdj)


def price_pattern_mart(bars: DataFrame) -> DataFrame:
    """Streaks and the N-structure of the last 20 valid bars under their mart names (I14); ``bars`` carry the previous close."""
    shown = {
        "is_valid_n_structure": "n_structure_20_is_valid", "n_structure_stage": "n_structure_20_stage", "higher_low_ratio": "n_structure_20_higher_low_ratio",
        "pullback_depth": "n_structure_20_pullback_depth", "rebound_ratio": "n_structure_20_rebound_ratio",
    }
    return indicators.price_pattern(bars).select(
        "security_code", "trade_date", "close_direction", "close_up_streak_days", "close_down_streak_days", *[F.col(c).alias(n) for c, n in shown.items()]
    )


def volume_mart(bars: DataFrame, windows: Sequence[int] = indicators.VOLUME_MA_WINDOWS) -> DataFrame:
    """Volume averages."""
    return indicators.means(bars, "volume", {n: f"volume_ma_{n}" for n in windows}).drop("volume")
