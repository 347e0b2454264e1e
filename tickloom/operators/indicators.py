"""Technical indicators over one row per (security_code, trade_date).

Everything that is a frame stays a native window; all frames of one validity flag share one
partitioning and one sort. True recurrences go through one Arrow grouped map (``recurrences``), so
one shuffle by security serves them all. A group holds one row per trading day: its size is bounded
by the calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.quality import require_finite

CODE, DATE = "security_code", "trade_date"

# Indicator windows and pattern thresholds.
PRICE_MA_WINDOWS = (3, 5, 6, 10, 12, 14, 20, 24, 28, 30, 57, 60, 114, 250)
VOLUME_MA_WINDOWS = (5, 10, 20, 60)
COMPOSITE_MAS = ((3, 6, 12, 24), (14, 28, 57, 114))
EMA_WINDOW = 10
BOLLINGER_CONFIGS = ((10, 1.5), (20, 2.0), (50, 2.5))
RSI_WINDOWS = (6, 12, 14, 24, 25, 50)
MACD_WINDOWS = (12, 26, 9)
KDJ_WINDOWS = (9, 3, 3)
KDJ_START = (50.0, 50.0)
STRUCTURE_WINDOW = 20
MIN_FIRST_LEG = 0.08
MIN_HIGHER_LOW = 1.01
PULLBACK_RANGE = (0.25, 0.75)
MIN_REBOUND = 1.03
STAGES = ("none", "higher_low", "rebound", "breakout")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def by_security(df: DataFrame) -> DataFrame:
    """One placement by security. It serves every window over (security, validity) and the grouped
    map after them, which would each ask for a shuffle of their own otherwise."""
    return df.repartition(CODE)


def valid_order(valid: Column):
    """Rows of a security in date order, valid and invalid ones apart."""
    return Window.partitionBy(CODE, valid).orderBy(DATE)


def over_valid(agg: Column, valid: Column, n: int) -> Column:
    """A frame aggregate that skips invalid rows and is NULL until ``n`` valid rows were seen."""
    order = valid_order(valid)
    return F.when(valid & (F.row_number().over(order) >= n), agg.over(order.rowsBetween(-(n - 1), 0)))


def checked(df: DataFrame, columns: Sequence[str], strict: bool) -> DataFrame:
    """``df``, failing at a NaN or infinity in the columns if ``strict``; NULL is a missing value and passes."""
    return require_finite(df, columns) if strict else df


def means(df: DataFrame, column: str, names: dict[int, str], strict: bool = True) -> DataFrame:
    """Means of the last ``n`` valid values for several ``n`` at once (I01); one sort serves them all.

    Every width is a frame of its own, so a value depends on its ``n`` rows alone: a run that starts
    ``n`` valid rows earlier gives the same bits as the full history.
    """
    return placed_means(by_security(checked(df, [column], strict)), column, names)


def placed_means(df: DataFrame, column: str, names: dict[int, str]) -> DataFrame:
    flagged = df.withColumn("_ok", F.col(column).isNotNull())
    return flagged.select("*", *[over_valid(F.avg(column), F.col("_ok"), n).alias(name) for n, name in names.items()]).drop("_ok")


def sma(df: DataFrame, column: str, n: int, name: str | None = None, strict: bool = True) -> DataFrame:
    """Mean of the last ``n`` valid values."""
    return means(df, column, {n: name or f"sma_{n}"}, strict)


def rolling_stddev(df: DataFrame, column: str, n: int, name: str | None = None, strict: bool = True) -> DataFrame:
    """Population standard deviation of the last ``n`` valid values."""
    flagged = by_security(checked(df, [column], strict)).withColumn("_ok", F.col(column).isNotNull())
    return flagged.withColumn(name or f"stddev_{n}", over_valid(F.stddev_pop(column), F.col("_ok"), n)).drop("_ok")


def moving_averages(
    df: DataFrame,
    price: str = "close_price",
    volume: str = "volume",
    price_windows: Sequence[int] = PRICE_MA_WINDOWS,
    volume_windows: Sequence[int] = VOLUME_MA_WINDOWS,
    strict: bool = True,
) -> DataFrame:
    """Price and volume moving averages and their composites."""
    result = placed_means(by_security(checked(df, [price, volume], strict)), price, {n: f"price_ma_{n}" for n in price_windows})
    result = placed_means(result, volume, {n: f"volume_ma_{n}" for n in volume_windows})
    for members in COMPOSITE_MAS:
        if set(members) <= set(price_windows):
            total = F.col(f"price_ma_{members[0]}")
            for n in members[1:]:
                total = total + F.col(f"price_ma_{n}")
            label = "_".join(str(n) for n in members)
            result = result.withColumn(f"price_avg_ma_{label}", total / len(members))
    return result


def bollinger(df: DataFrame, column: str = "close_price", configs=BOLLINGER_CONFIGS, strict: bool = True) -> DataFrame:
    """Middle band and ``k`` population sigmas around it."""
    flagged = by_security(checked(df, [column], strict)).withColumn("_ok", F.col(column).isNotNull())
    valid = F.col("_ok")
    mids = [over_valid(F.avg(column), valid, n).alias(f"boll_mid_{n}") for n, _ in configs]
    sigmas = [over_valid(F.stddev_pop(column), valid, n).alias(f"_sigma_{n}") for n, _ in configs]
    bands = []
    for n, k in configs:
        bands.append((F.col(f"boll_mid_{n}") + k * F.col(f"_sigma_{n}")).alias(f"boll_upper_{n}"))
        bands.append((F.col(f"boll_mid_{n}") - k * F.col(f"_sigma_{n}")).alias(f"boll_lower_{n}"))
    return flagged.select("*", *mids, *sigmas).select("*", *bands).drop("_ok", *[f"_sigma_{n}" for n, _ in configs])


def bar_is_valid(high: str, low: str, close: str) -> Column:
    return (
        is_finite(F.col(high)) & is_finite(F.col(low)) & is_finite(F.col(close))
        & (F.col(high) >= F.col(low))
    )


def rsv(
    df: DataFrame, n: int = KDJ_WINDOWS[0], high="high_price", low="low_price", close="close_price",
) -> DataFrame:
    """Place of the close in the range of the last ``n`` valid bars, flat = 50."""
    flagged = by_security(df).withColumn("_ok", F.coalesce(bar_is_valid(high, low, close), F.lit(False)))
    valid = F.col("_ok")
    framed = flagged.select(
        "*",
        over_valid(F.max(high), valid, n).alias("_top"),
        over_valid(F.min(low), valid, n).alias("_bottom"),
    )
    spread = F.col("_top") - F.col("_bottom")
    value = F.when(spread == 0, 50.0).otherwise((F.col(close) - F.col("_bottom")) / spread * 100)
    return framed.withColumn("rsv", value).drop("_top", "_bottom", "_ok")


def close_direction(close: str, previous: str) -> Column:
    return F.when(F.col(close).isNotNull() & F.col(previous).isNotNull(), F.signum(F.col(close) - F.col(previous)).cast("int"))


def streaks(df: DataFrame, close: str = "close_price", previous: str = "prev_close_price") -> DataFrame:
    """Direction of the close and length of the current up or down run.

    A flat day sets both runs to 0; a day without direction has NULL runs and breaks the run.
    """
    ordered = Window.partitionBy(CODE).orderBy(DATE)
    directed = df.withColumn("close_direction", close_direction(close, previous))
    starts = ~F.col("close_direction").eqNullSafe(F.lag("close_direction").over(ordered))
    island = directed.withColumn(
        "_island", F.sum(F.when(starts, 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    )
    place = F.row_number().over(Window.partitionBy(CODE, "_island").orderBy(DATE))
    known = F.col("close_direction").isNotNull()
    return island.withColumn("_place", place).select(
        *df.columns,
        "close_direction",
        F.when(known, F.when(F.col("close_direction") == 1, F.col("_place")).otherwise(0)).alias("close_up_streak_days"),
        F.when(known, F.when(F.col("close_direction") == -1, F.col("_place")).otherwise(0)).alias("close_down_streak_days"),
    )


# --- recurrences -----------------------------------------------------------------------------


def smooth(values: np.ndarray, alpha: float, state: float | None, seed: int) -> np.ndarray:
    """``a*x + (1-a)*prev`` from a state, or from the mean of the first ``seed`` values."""
    out = np.full(len(values), np.nan)
    if state is not None:
        if len(values):
            run = pd.Series(np.concatenate(([state], values))).ewm(alpha=alpha, adjust=False).mean()
            out[:] = run.to_numpy()[1:]
        return out
    if len(values) >= seed:
        head = values[:seed].sum() / seed
        run = pd.Series(np.concatenate(([head], values[seed:]))).ewm(alpha=alpha, adjust=False).mean()
        out[seed - 1 :] = run.to_numpy()
    return out


def spread_back(valid: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(len(valid), np.nan)
    out[valid] = values
    return out


class Series:
    """Columns of one security sorted by date, NULL as NaN, with its start state."""

    def __init__(self, table: pa.Table):
        dates = table.column(DATE).to_numpy()
        order = np.argsort(dates, kind="stable")
        self.table = table.take(pa.array(order))
        self.dates = dates[order]
        if len(self.dates) > 1 and not (self.dates[1:] > self.dates[:-1]).all():
            raise ValueError(f"{DATE} must be strictly increasing within a security")
        self.after_state = np.ones(len(self.dates), dtype=bool)
        self.state_date = self.state("state_date")
        if self.state_date is not None:
            self.after_state = self.dates > np.datetime64(self.state_date)

    def values(self, name: str) -> np.ndarray:
        column = self.table.column(name)
        if column.null_count < len(column):
            present = column.drop_null().to_numpy()
            if not np.isfinite(present).all():
                raise ValueError(f"{name} must be finite")
        return column.to_numpy(zero_copy_only=False).astype(float)

    def state(self, name: str):
        if f"_state_{name}" not in self.table.column_names:
            return None
        return self.table.column(f"_state_{name}")[0].as_py()


def ema_outputs(s: Series, column: str, n: int, name: str, state_name: str | None = None) -> dict:
    x = s.values(column)
    live = ~np.isnan(x) & s.after_state
    return {name: spread_back(live, smooth(x[live], 2.0 / (n + 1), s.state(state_name or name), n))}


def ema2_outputs(s: Series, column: str, n: int) -> dict:
    """EMA of the EMA, with both states."""
    x = s.values(column)
    live = ~np.isnan(x) & s.after_state
    alpha = 2.0 / (n + 1)
    first = smooth(x[live], alpha, s.state(f"price_ema1_{n}_state"), n)
    known = ~np.isnan(first)
    second = spread_back(known, smooth(first[known], alpha, s.state(f"price_ema2_{n}_state"), n))
    return {
        f"price_ema1_{n}_state": spread_back(live, first),
        f"price_ema2_{n}": spread_back(live, second),
        f"price_ema2_{n}_state": spread_back(live, second),
    }


def rsi_outputs(s: Series, column: str, windows: Sequence[int]) -> dict:
    """Wilder averages of gains and losses and the RSI from them."""
    x = s.values(column)
    live = ~np.isnan(x) & s.after_state
    closes = x[live]
    previous = s.state("previous_close")
    if previous is None:
        change = np.diff(closes)
        moved = np.flatnonzero(live)[1:]
    else:
        change = np.diff(np.concatenate(([previous], closes)))
        moved = np.flatnonzero(live)
    gain, loss = np.maximum(change, 0.0), np.maximum(-change, 0.0)
    out = {}
    for n in windows:
        up = smooth(gain, 1.0 / n, s.state(f"avg_gain_{n}_state"), n)
        down = smooth(loss, 1.0 / n, s.state(f"avg_loss_{n}_state"), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = 100.0 - 100.0 / (1.0 + up / down)
        value = np.where(up == 0.0, 0.0, value)
        value = np.where(down == 0.0, np.where(up == 0.0, 50.0, 100.0), value)
        for name, column_values in (
            (f"rsi_{n}", value), (f"avg_gain_{n}_state", up), (f"avg_loss_{n}_state", down),
        ):
            full = np.full(len(x), np.nan)
            full[moved] = column_values
            out[name] = full
    return out


def macd_outputs(s: Series, column: str, windows: Sequence[int]) -> dict:
    """DIF, DEA and histogram."""
    fast_n, slow_n, signal_n = windows
    x = s.values(column)
    live = ~np.isnan(x) & s.after_state
    closes = x[live]
    fast = smooth(closes, 2.0 / (fast_n + 1), s.state(f"ema_fast_{fast_n}_state"), fast_n)
    slow = smooth(closes, 2.0 / (slow_n + 1), s.state(f"ema_slow_{slow_n}_state"), slow_n)
    dif = fast - slow
    known = ~np.isnan(dif)
    dea = spread_back(known, smooth(dif[known], 2.0 / (signal_n + 1), s.state("macd_dea_state"), signal_n))
    return {
        f"ema_fast_{fast_n}_state": spread_back(live, fast),
        f"ema_slow_{slow_n}_state": spread_back(live, slow),
        "macd_dif": spread_back(live, dif),
        "macd_dea": spread_back(live, dea),
        "macd_dea_state": spread_back(live, dea),
        "macd_histogram": spread_back(live, dif - dea),
    }


def kdj_outputs(s: Series, column: str, windows: Sequence[int]) -> dict:
    """K, D and J from the RSV column."""
    _, k_n, d_n = windows
    x = s.values(column)
    live = ~np.isnan(x) & s.after_state
    k_start, d_start = s.state("k_value"), s.state("d_value")
    k = smooth(x[live], 1.0 / k_n, KDJ_START[0] if k_start is None else k_start, 1)
    d = smooth(k, 1.0 / d_n, KDJ_START[1] if d_start is None else d_start, 1)
    return {
        "k_value": spread_back(live, k),
        "d_value": spread_back(live, d),
        "j_value": spread_back(live, 3.0 * k - 2.0 * d),
    }


def structure_outputs(s: Series, high: str, low: str, window: int) -> dict:
    """Best low-high-higher-low shape among the last ``window`` valid bars.

    The earlier bars of a window are lagged copies of the series, so each (low, high, higher low)
    choice is tested for every bar of the security at once.
    """
    top, bottom = s.values(high), s.values(low)
    with np.errstate(invalid="ignore"):
        valid = ~np.isnan(top) & ~np.isnan(bottom) & (bottom > 0) & (top >= bottom)
    h, lo = top[valid], bottom[valid]
    m, back = len(h), window - 1
    stage = np.zeros(m, dtype=np.int8)
    picked = {name: np.full(m, np.nan) for name in ("higher_low_ratio", "pullback_depth", "rebound_ratio")}
    if m >= 4:
        # lag[b] holds the bar b+1 places before the current one; NaN before the series starts.
        pad = np.full(back, np.nan)
        h_lag = [np.concatenate((pad, h))[back - b - 1 : back - b - 1 + m] for b in range(back)]
        l_lag = [np.concatenate((pad, lo))[back - b - 1 : back - b - 1 + m] for b in range(back)]
        with np.errstate(invalid="ignore", divide="ignore"):
            for b2 in range(back - 2):  # later second lows first, then later highs, then earlier lows
                rebound = h / l_lag[b2]
                for bh in range(b2 + 1, back - 1):
                    h1, l2 = h_lag[bh], l_lag[b2]
                    rank = np.where(h >= h1, 3, np.where(rebound >= MIN_REBOUND, 2, 1))
                    open_rows = rank > stage
                    if not open_rows.any():
                        continue
                    for b1 in range(back - 1, bh, -1):
                        l1 = l_lag[b1]
                        leg = h1 - l1
                        depth = (h1 - l2) / leg
                        hit = (
                            open_rows & (h1 / l1 - 1.0 >= MIN_FIRST_LEG) & (leg > 0)
                            & (l2 / l1 >= MIN_HIGHER_LOW)
                            & (depth >= PULLBACK_RANGE[0]) & (depth <= PULLBACK_RANGE[1])
                        )
                        if hit.any():
                            stage[hit] = rank[hit]
                            picked["higher_low_ratio"][hit] = (l2 / l1)[hit]
                            picked["pullback_depth"][hit] = depth[hit]
                            picked["rebound_ratio"][hit] = rebound[hit]
                            open_rows = open_rows & ~hit
    # A row without a valid bar shows the window as the last valid bar left it.
    last = np.cumsum(valid) - 1
    seen = last >= 0
    stages = np.zeros(len(valid), dtype=np.int8)
    stages[seen] = stage[last[seen]]
    out = {
        "is_valid_n_structure": stages >= 2,
        "n_structure_stage": np.array(STAGES, dtype=object)[stages],
    }
    for name, column_values in picked.items():
        full = np.full(len(valid), np.nan)
        full[seen] = column_values[last[seen]]
        out[name] = full
    return out


@dataclass(frozen=True)
class Recurrence:
    """One member of the grouped map: what it reads, what it adds, which state starts it."""

    inputs: tuple[str, ...]
    outputs: tuple[tuple[str, T.DataType], ...]
    states: tuple[str, ...]
    compute: object


DOUBLE = T.DoubleType()


def ema_step(column: str = "close_price", n: int = 12, name: str | None = None) -> Recurrence:
    label = name or f"ema_{n}"
    return Recurrence((column,), ((label, DOUBLE),), (label,), lambda s: ema_outputs(s, column, n, label))


def ema2_step(column: str = "close_price", n: int = EMA_WINDOW) -> Recurrence:
    names = (f"price_ema1_{n}_state", f"price_ema2_{n}", f"price_ema2_{n}_state")
    return Recurrence(
        (column,), tuple((x, DOUBLE) for x in names), (names[0], names[2]),
        lambda s: ema2_outputs(s, column, n),
    )


def rsi_step(column: str = "close_price", windows: Sequence[int] = RSI_WINDOWS) -> Recurrence:
    names = [x for n in windows for x in (f"rsi_{n}", f"avg_gain_{n}_state", f"avg_loss_{n}_state")]
    states = ("previous_close", *[x for x in names if x.endswith("_state")])
    return Recurrence(
        (column,), tuple((x, DOUBLE) for x in names), states, lambda s: rsi_outputs(s, column, windows)
    )


def macd_step(column: str = "close_price", windows: Sequence[int] = MACD_WINDOWS) -> Recurrence:
    fast, slow = f"ema_fast_{windows[0]}_state", f"ema_slow_{windows[1]}_state"
    names = (fast, slow, "macd_dif", "macd_dea", "macd_dea_state", "macd_histogram")
    return Recurrence(
        (column,), tuple((x, DOUBLE) for x in names), (fast, slow, "macd_dea_state"),
        lambda s: macd_outputs(s, column, windows),
    )


def kdj_step(column: str = "rsv", windows: Sequence[int] = KDJ_WINDOWS) -> Recurrence:
    return Recurrence(
        (column,), tuple((x, DOUBLE) for x in ("k_value", "d_value", "j_value")), ("k_value", "d_value"),
        lambda s: kdj_outputs(s, column, windows),
    )


def structure_step(high="high_price", low="low_price", window: int = STRUCTURE_WINDOW) -> Recurrence:
    outputs = (
        ("is_valid_n_structure", T.BooleanType()), ("n_structure_stage", T.StringType()),
        ("higher_low_ratio", DOUBLE), ("pullback_depth", DOUBLE), ("rebound_ratio", DOUBLE),
    )
    return Recurrence((high, low), outputs, (), lambda s: structure_outputs(s, high, low, window))


def recurrences(
    df: DataFrame,
    steps: Sequence[Recurrence],
    state: DataFrame | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Run every given recurrence of a security in one grouped map, one shuffle for all.

    ``state`` has one row per security: ``state_date`` and the state columns of the steps. Rows at
    or before the state date get no output; the recurrence continues after it. A security without
    state starts from its history. ``keep`` limits the pass-through columns.
    """
    inputs = list(dict.fromkeys(c for step in steps for c in step.inputs))
    passed = [c for c in (keep or df.columns) if c not in (CODE, DATE)]
    source = df.select(CODE, DATE, *dict.fromkeys([*passed, *inputs]))
    if state is not None:
        names = list(dict.fromkeys(x for step in steps for x in step.states))
        have = [c for c in ("state_date", *names) if c in state.columns]
        source = source.join(
            state.select(CODE, *[F.col(c).alias(f"_state_{c}") for c in have]), CODE, "left"
        )
    added = [T.StructField(n, t) for step in steps for n, t in step.outputs]
    schema = T.StructType([df.select(CODE, DATE, *passed).schema[c] for c in (CODE, DATE, *passed)] + added)

    def compute(table: pa.Table) -> pa.Table:
        series = Series(table)
        columns = {c: series.table.column(c) for c in (CODE, DATE, *passed)}
        for step in steps:
            for name, values in step.compute(series).items():
                if values.dtype == float:
                    columns[name] = pa.array(values, from_pandas=True)
                else:
                    columns[name] = pa.array(values)
        return pa.table(columns)

    return source.groupBy(CODE).applyInArrow(compute, schema)


def ema(df, column="close_price", n=12, state=None, name=None) -> DataFrame:
    """EMA seeded by the mean of the first ``n`` valid values."""
    return recurrences(df, [ema_step(column, n, name)], state)


def ema2(df, column="close_price", n=EMA_WINDOW, state=None) -> DataFrame:
    """EMA of the EMA."""
    return recurrences(df, [ema2_step(column, n)], state)


def rsi(df, column="close_price", windows=RSI_WINDOWS, state=None) -> DataFrame:
    """RSI with Wilder smoothing."""
    return recurrences(df, [rsi_step(column, windows)], state)


def macd(df, column="close_price", windows=MACD_WINDOWS, state=None) -> DataFrame:
    """MACD (I09)."""
    return recurrences(df, [macd_step(column, windows)], state)


def kdj(df, windows=KDJ_WINDOWS, state=None, high="high_price", low="low_price", close="close_price") -> DataFrame:
    """KDJ on the RSV of the last valid bars."""
    return recurrences(rsv(df, windows[0], high, low, close), [kdj_step("rsv", windows)], state)


def n_structure(df, window: int = STRUCTURE_WINDOW, high="high_price", low="low_price") -> DataFrame:
    """N-structure of the last valid bars."""
    return recurrences(df, [structure_step(high, low, window)])


def price_pattern(
    df: DataFrame, close="close_price", previous="prev_close_price", high="high_price", low="low_price"
) -> DataFrame:
    """Streaks and N-structure together."""
    return streaks(n_structure(df, STRUCTURE_WINDOW, high, low), close, previous)
