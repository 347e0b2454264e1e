"""Indicators (I operators). Recurrences are checked against their closed weighted sums."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.tables import compose, define
from tickloom.operators import indicators as ind
from tickloom.operators import tables
from tickloom.plans import marts
from tickloom.sources import market

KEY = ("security_code", "trade_date")


def frame(column: str, aggregate: str, n: int) -> str:
    """Aggregate over the last ``n`` valid rows, NULL until they exist."""
    return (
        f"CASE WHEN {column} IS NOT NULL AND count(*) OVER (PARTITION BY security_code, {column} IS NULL ORDER BY trade_date ROWS {n - 1} PRECEDING) = {n}"
        f" THEN {aggregate}({column}) OVER (PARTITION BY security_code, {column} IS NULL ORDER BY trade_date ROWS {n - 1} PRECEDING) END"
    )


def smooth_sql(source: str, column: str, n: int, alpha: str, name: str) -> str:
    """Seeded smoothing of the non-NULL rows of ``source`` as a weighted running sum."""
    q = f"(1e0 - {alpha})"
    return f"""
SELECT security_code, trade_date, CASE WHEN i >= {n} THEN pow({q}, i) * (seed * pow({q}, -{n}) + {alpha} * coalesce(tail, 0)) END AS {name} FROM (
  SELECT security_code, trade_date, i, sum(CASE WHEN i <= {n} THEN x END) OVER (PARTITION BY security_code) / {n} AS seed,
    sum(CASE WHEN i > {n} THEN x * pow({q}, -i) END) OVER (PARTITION BY security_code ORDER BY i ROWS UNBOUNDED PRECEDING) AS tail FROM (
    SELECT security_code, trade_date, {column} AS x, row_number() OVER (PARTITION BY security_code ORDER BY trade_date) AS i
    FROM {source} WHERE {column} IS NOT NULL))"""


def started_sql(source: str, column: str, start: float, alpha: str, name: str) -> str:
    """Smoothing from a start value."""
    q = f"(1e0 - {alpha})"
    return f"""
SELECT security_code, trade_date, pow({q}, i) * ({start}e0 + {alpha} * sum({column} * pow({q}, -i)) OVER (PARTITION BY security_code ORDER BY i ROWS UNBOUNDED PRECEDING)) AS {name}
FROM (SELECT *, row_number() OVER (PARTITION BY security_code ORDER BY trade_date) AS i FROM {source} WHERE {column} IS NOT NULL)"""


define("ema_12", smooth_sql("gap_bars", "close_price", 12, "(2e0 / 13)", "ema_12"), ["gap_bars"])
define("ema_26", smooth_sql("gap_bars", "close_price", 26, "(2e0 / 27)", "ema_26"), ["gap_bars"])
define("ema1_10", smooth_sql("gap_bars", "close_price", 10, "(2e0 / 11)", "ema1"), ["gap_bars"])
define("ema2_10", smooth_sql("ema1_10", "ema1", 10, "(2e0 / 11)", "ema2"), ["ema1_10"])
define("dif", "SELECT security_code, trade_date, ema_12, ema_26, ema_12 - ema_26 AS dif FROM ema_12 LEFT JOIN ema_26 USING (security_code, trade_date)", ["ema_12", "ema_26"])
define("dea", smooth_sql("dif", "dif", 9, "(2e0 / 10)", "dea"), ["dif"])
define("macd", """
SELECT b.security_code, b.trade_date, ema_12 AS ema_fast_12_state, ema_26 AS ema_slow_26_state, dif AS macd_dif, dea AS macd_dea, dif - dea AS macd_histogram
FROM gap_bars b LEFT JOIN dif USING (security_code, trade_date) LEFT JOIN dea USING (security_code, trade_date)""", ["gap_bars", "dif", "dea"])
define("changes", """
SELECT security_code, trade_date, greatest(c, 0) AS gain, greatest(-c, 0) AS loss FROM (SELECT security_code, trade_date,
  close_price - lag(close_price) OVER (PARTITION BY security_code ORDER BY trade_date) AS c FROM gap_bars WHERE close_price IS NOT NULL) WHERE c IS NOT NULL""", ["gap_bars"])
for n in ind.RSI_WINDOWS:
    define(f"gain_{n}", smooth_sql("changes", "gain", n, f"(1e0 / {n})", "g"), ["changes"])
    define(f"loss_{n}", smooth_sql("changes", "loss", n, f"(1e0 / {n})", "l"), ["changes"])
define("rsi", "SELECT b.security_code, b.trade_date, " + ", ".join(
    f"CASE WHEN g{n}.g = 0 AND l{n}.l = 0 THEN 50e0 WHEN l{n}.l = 0 THEN 100e0 WHEN g{n}.g = 0 THEN 0e0 ELSE 100 - 100 / (1 + g{n}.g / l{n}.l) END AS rsi_{n}"
    for n in ind.RSI_WINDOWS
) + " FROM gap_bars b " + " ".join(
    f"LEFT JOIN gain_{n} g{n} ON g{n}.security_code = b.security_code AND g{n}.trade_date = b.trade_date "
    f"LEFT JOIN loss_{n} l{n} ON l{n}.security_code = b.security_code AND l{n}.trade_date = b.trade_date" for n in ind.RSI_WINDOWS
), ["gap_bars", *[f"{k}_{n}" for n in ind.RSI_WINDOWS for k in ("gain", "loss")]])
define("rsv", f"""
SELECT security_code, trade_date, CASE WHEN top = bottom THEN 50e0 ELSE (close_price - bottom) / (top - bottom) * 100 END AS rsv FROM (
  SELECT security_code, trade_date, close_price, {frame('high_price', 'max', 9)} AS top, {frame('low_price', 'min', 9)} AS bottom FROM gap_bars)""", ["gap_bars"])
define("k_line", started_sql("rsv", "rsv", 50, "(1e0 / 3)", "k_value"), ["rsv"])
define("d_line", started_sql("k_line", "k_value", 50, "(1e0 / 3)", "d_value"), ["k_line"])
define("kdj", """
SELECT r.security_code, r.trade_date, rsv, k_value, d_value, 3 * k_value - 2 * d_value AS j_value FROM rsv r LEFT JOIN k_line USING (security_code, trade_date)
LEFT JOIN d_line USING (security_code, trade_date)""", ["rsv", "k_line", "d_line"])


@query("I01_sma", f"SELECT security_code, trade_date, {frame('close_price', 'avg', 20)} AS sma_20 FROM gap_bars", ["gap_bars"], ("sma_20",), digits=4)
def sma(spark, folder):
    return ind.sma(market.gap_bars(spark, folder).select(*KEY, "close_price"), "close_price", 20).drop("close_price")


MA_COLUMNS = [f"price_ma_{n}" for n in ind.PRICE_MA_WINDOWS] + [f"volume_ma_{n}" for n in ind.VOLUME_MA_WINDOWS]
MA_SQL = ", ".join(
    [f"{frame('close_price', 'avg', n)} AS price_ma_{n}" for n in ind.PRICE_MA_WINDOWS]
    + [f"{frame('volume', 'avg', n)} AS volume_ma_{n}" for n in ind.VOLUME_MA_WINDOWS]
)
define("averages", f"SELECT security_code, trade_date, {MA_SQL} FROM gap_bars", ["gap_bars"])


@query("I02_moving_averages", "SELECT * FROM averages", ["averages"], MA_COLUMNS, digits=3)
def moving_averages(spark, folder):
    b = market.gap_bars(spark, folder).select(*KEY, "close_price", "volume")
    return ind.moving_averages(b).select(*KEY, *MA_COLUMNS)


COMPOSITES = ("price_avg_ma_3_6_12_24", "price_avg_ma_14_28_57_114")


@query("I03_composite_averages", """
SELECT security_code, trade_date, (price_ma_3 + price_ma_6 + price_ma_12 + price_ma_24) / 4 AS price_avg_ma_3_6_12_24,
  (price_ma_14 + price_ma_28 + price_ma_57 + price_ma_114) / 4 AS price_avg_ma_14_28_57_114 FROM averages""", ["averages"], COMPOSITES, digits=3)
def composites(spark, folder):
    b = market.gap_bars(spark, folder).select(*KEY, "close_price", "volume")
    return ind.moving_averages(b).select(*KEY, *COMPOSITES)


@query("I04_ema", "SELECT b.security_code, b.trade_date, ema_12 FROM gap_bars b LEFT JOIN ema_12 USING (security_code, trade_date)",
    ["gap_bars", "ema_12"], ("ema_12",), digits=3)
def ema(spark, folder):
    return ind.ema(market.gap_bars(spark, folder).select(*KEY, "close_price"), n=12).drop("close_price")


@query("I05_ema2", """
SELECT b.security_code, b.trade_date, ema1 AS price_ema1_10_state, ema2 AS price_ema2_10 FROM gap_bars b
LEFT JOIN ema1_10 USING (security_code, trade_date) LEFT JOIN ema2_10 USING (security_code, trade_date)""", ["gap_bars", "ema1_10", "ema2_10"],
    ("price_ema1_10_state", "price_ema2_10"), digits=3)
def ema2(spark, folder):
    return ind.ema2(market.gap_bars(spark, folder).select(*KEY, "close_price")).select(*KEY, "price_ema1_10_state", "price_ema2_10")


@query("I06_rolling_stddev", f"SELECT security_code, trade_date, {frame('close_price', 'stddev_pop', 20)} AS stddev_20 FROM gap_bars",
    ["gap_bars"], ("stddev_20",), digits=4)
def rolling_stddev(spark, folder):
    return ind.rolling_stddev(market.gap_bars(spark, folder).select(*KEY, "close_price"), "close_price", 20).drop("close_price")


BANDS = [f"boll_{b}_{n}" for n, _ in ind.BOLLINGER_CONFIGS for b in ("mid", "upper", "lower")]
define("bollinger", "SELECT security_code, trade_date, " + ", ".join(
    f"m{n} AS boll_mid_{n}, m{n} + {k}e0 * s{n} AS boll_upper_{n}, m{n} - {k}e0 * s{n} AS boll_lower_{n}" for n, k in ind.BOLLINGER_CONFIGS
) + " FROM (SELECT security_code, trade_date, " + ", ".join(
    f"{frame('close_price', 'avg', n)} AS m{n}, {frame('close_price', 'stddev_pop', n)} AS s{n}" for n, _ in ind.BOLLINGER_CONFIGS
) + " FROM gap_bars)", ["gap_bars"])


@query("I07_bollinger", "SELECT * FROM bollinger", ["bollinger"], BANDS, digits=3)
def bollinger(spark, folder):
    return ind.bollinger(market.gap_bars(spark, folder).select(*KEY, "close_price")).select(*KEY, *BANDS)


RSI_COLUMNS = [f"rsi_{n}" for n in ind.RSI_WINDOWS]


@query("I08_rsi", "SELECT * FROM rsi", ["rsi"], RSI_COLUMNS)
def rsi(spark, folder):
    return ind.rsi(market.gap_bars(spark, folder).select(*KEY, "close_price")).select(*KEY, *RSI_COLUMNS)


MACD_COLUMNS = ("ema_fast_12_state", "ema_slow_26_state", "macd_dif", "macd_dea", "macd_histogram")


@query("I09_macd", "SELECT * FROM macd", ["macd"], MACD_COLUMNS, digits=3)
def macd(spark, folder):
    return ind.macd(market.gap_bars(spark, folder).select(*KEY, "close_price")).select(*KEY, *MACD_COLUMNS)


BAR = ("high_price", "low_price", "close_price")


@query("I10_rsv", "SELECT * FROM rsv", ["rsv"], ("rsv",))
def rsv(spark, folder):
    return ind.rsv(market.gap_bars(spark, folder).select(*KEY, *BAR)).select(*KEY, "rsv")


@query("I11_kdj", "SELECT * FROM kdj", ["kdj"], ("rsv", "k_value", "d_value", "j_value"))
def kdj(spark, folder):
    return ind.kdj(market.gap_bars(spark, folder).select(*KEY, *BAR)).select(*KEY, "rsv", "k_value", "d_value", "j_value")


STREAKS = """
SELECT security_code, trade_date, d AS close_direction, CASE WHEN d IS NOT NULL THEN CASE WHEN d = 1 THEN place ELSE 0 END END::INT AS close_up_streak_days,
  CASE WHEN d IS NOT NULL THEN CASE WHEN d = -1 THEN place ELSE 0 END END::INT AS close_down_streak_days FROM (
  SELECT *, row_number() OVER (PARTITION BY security_code, island ORDER BY trade_date) AS place FROM (
    SELECT *, sum(CASE WHEN d IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY security_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, lag(d) OVER (PARTITION BY security_code ORDER BY trade_date) AS p FROM (
        SELECT security_code, trade_date, CAST(sign(close_price - prev) AS INT) AS d FROM (
          SELECT *, lag(close_price) OVER (PARTITION BY security_code ORDER BY trade_date) AS prev FROM gap_bars)))))"""


@query("I12_streaks", STREAKS, ["gap_bars"])
def streaks(spark, folder):
    b = tables.with_prev(market.gap_bars(spark, folder).select(*KEY, "close_price"), ["close_price"])
    return ind.streaks(b, "close_price", "prev_close_price").drop("close_price", "prev_close_price")


define("structure_bars", """
SELECT *, row_number() OVER (PARTITION BY security_code ORDER BY trade_date) AS i FROM gap_bars WHERE low_price > 0 AND high_price >= low_price""", ["gap_bars"])
define("structures", """
SELECT security_code, trade_date, max((stage, p2, p1, -p0, l2 / l1, (h1 - l2) / (h1 - l1), h / l2)) AS best FROM (
  SELECT security_code, trade_date, h, p0, p1, p2, ls[p0] AS l1, hs[p1] AS h1, ls[p2] AS l2,
    CASE WHEN h >= hs[p1] THEN 3 WHEN h / ls[p2] >= 1.03e0 THEN 2 ELSE 1 END AS stage
  FROM (SELECT security_code, trade_date, high_price AS h, list(high_price) OVER w AS hs, list(low_price) OVER w AS ls FROM structure_bars
    WINDOW w AS (PARTITION BY security_code ORDER BY i ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)) v,
    (SELECT a.k AS p0, b.k AS p1, d.k AS p2 FROM range(1, 20) a(k), range(1, 20) b(k), range(1, 20) d(k) WHERE a.k < b.k AND b.k < d.k) o
  WHERE p2 <= len(hs) AND hs[p1] / ls[p0] - 1 >= 0.08e0 AND hs[p1] - ls[p0] > 0 AND ls[p2] / ls[p0] >= 1.01e0
    AND (hs[p1] - ls[p2]) / (hs[p1] - ls[p0]) BETWEEN 0.25e0 AND 0.75e0) GROUP BY ALL""", ["structure_bars"])


STRUCTURE_SQL = """
SELECT security_code, trade_date, coalesce(best[1], 0) >= 2 AS is_valid_n_structure,
  CASE coalesce(best[1], 0) WHEN 3 THEN 'breakout' WHEN 2 THEN 'rebound' WHEN 1 THEN 'higher_low' ELSE 'none' END AS n_structure_stage,
  best[5] AS higher_low_ratio, best[6] AS pullback_depth, best[7] AS rebound_ratio FROM (
  SELECT g.security_code, g.trade_date, s.best FROM gap_bars g ASOF LEFT JOIN structure_bars v ON g.security_code = v.security_code AND g.trade_date >= v.trade_date
  LEFT JOIN structures s ON s.security_code = v.security_code AND s.trade_date = v.trade_date)"""


@query("I13_n_structure", STRUCTURE_SQL, ["structures"],
    ("higher_low_ratio", "pullback_depth", "rebound_ratio"), digits=6)
def n_structure(spark, folder):
    return ind.n_structure(market.gap_bars(spark, folder).select(*KEY, "high_price", "low_price")).drop("high_price", "low_price")


define("pattern_structures", STRUCTURE_SQL, ["structures"])
PATTERN_RATIOS = ("n_structure_20_higher_low_ratio", "n_structure_20_pullback_depth", "n_structure_20_rebound_ratio")


@query("I14_price_pattern_mart", f"""
SELECT k.*, is_valid_n_structure AS n_structure_20_is_valid, n_structure_stage AS n_structure_20_stage, higher_low_ratio AS n_structure_20_higher_low_ratio,
  pullback_depth AS n_structure_20_pullback_depth, rebound_ratio AS n_structure_20_rebound_ratio FROM ({STREAKS}) k JOIN pattern_structures p USING (security_code, trade_date)""",
    ["gap_bars", "pattern_structures"], PATTERN_RATIOS, digits=6)
def price_pattern_mart(spark, folder):
    b = tables.with_prev(market.gap_bars(spark, folder).select(*KEY, "close_price", "high_price", "low_price"), ["close_price"])
    return marts.price_pattern_mart(b)


@query("I14_volume_mart", "SELECT security_code, trade_date, " + ", ".join(f"volume_ma_{n}" for n in ind.VOLUME_MA_WINDOWS) + " FROM averages", ["averages"],
    tuple(f"volume_ma_{n}" for n in ind.VOLUME_MA_WINDOWS), digits=4)
def volume_mart(spark, folder):
    return marts.volume_mart(market.gap_bars(spark, folder).select(*KEY, "volume"))


@query("I14_momentum_mart", """
SELECT security_code, trade_date, rsi_6, rsi_14, k_value, d_value, j_value FROM rsi LEFT JOIN kdj USING (security_code, trade_date)""", ["rsi", "kdj"],
    ("rsi_6", "rsi_14", "k_value", "d_value", "j_value"))
def momentum_mart(spark, folder):
    from tickloom.plans.marts import momentum_mart as mart

    b = market.gap_bars(spark, folder).select(*KEY, *BAR)
    m = mart(ind.rsi(b, windows=(6, 14)), ind.kdj(b))
    return m.select(*KEY, "rsi_6", "rsi_14", "k_value", "d_value", "j_value")


TREND = ("price_ma_5", "volume_ma_5", "boll_mid_20", "boll_upper_20", "macd_dif")


@query("I14_trend_mart", "SELECT security_code, trade_date, " + ", ".join(
    f"{c}, lag({c}) OVER (PARTITION BY security_code ORDER BY trade_date) AS prev_{c}" for c in TREND
) + """ FROM averages LEFT JOIN bollinger USING (security_code, trade_date) LEFT JOIN macd USING (security_code, trade_date)""",
    ["averages", "bollinger", "macd"], [c for t in TREND for c in (t, f"prev_{t}")], digits=3)
def trend_mart(spark, folder):
    from tickloom.plans.marts import trend_mart as mart

    b = market.gap_bars(spark, folder)
    m = mart(ind.moving_averages(b.select(*KEY, "close_price", "volume")), ind.bollinger(b.select(*KEY, "close_price")), ind.macd(b.select(*KEY, "close_price")), TREND)
    return m.select(*KEY, *TREND, *[f"prev_{c}" for c in TREND])


@query("I14_one_pass", """
SELECT security_code, trade_date, rsi_6, macd_dif, k_value, ema2 AS price_ema2_10 FROM rsi LEFT JOIN macd USING (security_code, trade_date)
LEFT JOIN kdj USING (security_code, trade_date) LEFT JOIN ema2_10 USING (security_code, trade_date)""", ["rsi", "macd", "kdj", "ema2_10"],
    ("rsi_6", "macd_dif", "k_value", "price_ema2_10"), digits=3)
def one_pass(spark, folder):
    """Every recurrence of a security in one grouped map: one shuffle serves them all."""
    b = ind.rsv(market.gap_bars(spark, folder).select(*KEY, *BAR))
    steps = [ind.rsi_step(), ind.macd_step(), ind.kdj_step(), ind.ema2_step()]
    return ind.recurrences(b, steps, keep=[]).select(*KEY, "rsi_6", "macd_dif", "k_value", "price_ema2_10")
