"""Signals, ledger, performance and reports (X operators) and metric ranks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.screening_rule import CATALOG, RULE, SIGNALS, signal_base
from tickloom.catalog.scalar_queries import SCORE
from tickloom.catalog.table_queries import TARGETS, targets
from tickloom.catalog.tables import define
from tickloom.functions import scalars
from tickloom.operators import indicators, tables
from tickloom.plans import ledger, performance, quotes, reports, rule_tables, screening, search
from tickloom.session import checkpoint
from tickloom.sources import market

CASH = 500_000_000.0
SERIES = ("run_id", "attempt_id", "security_code")
POOL = f"""SELECT security_code, trade_date, score, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, security_code)::INT AS rank_no
FROM (SELECT *, {SCORE} AS score FROM ({SIGNALS})) WHERE price_ma_20 > price_ma_60 AND prev_price_ma_20 <= prev_price_ma_60
  AND volume > 0.8 * volume_ma_5 AND trade_date BETWEEN DATE '1995-06-01' AND DATE '2001-06-30'"""
RANGE = ("1995-06-01", "2001-06-30")
define("pool", POOL, ["bars"])


def days(spark, folder):
    return tables.trade_calendar(market.calendar(spark, folder))


@query("X01_screen", """
SELECT security_code, trade_date, score, rank_no, rank_no <= 5 AS is_buy_signal FROM pool""", ["pool"], ("score",))
def screen(spark, folder):
    return screening.screen(signal_base(spark, folder), RULE, CATALOG, *RANGE).select(
        "security_code", "trade_date", "score", "rank_no", "is_buy_signal"
    )


@query("X02_signals", "SELECT * FROM pool WHERE rank_no <= 1", ["pool"], ("score",))
def signals(spark, folder):
    return screening.signals(signal_base(spark, folder), RULE, CATALOG, *RANGE, top_n=1)


@query("X03_preview", """
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY trade_date) AS pool_count FROM pool) WHERE rank_no <= 2""", ["pool"], ("score",))
def preview(spark, folder):
    return screening.preview(signal_base(spark, folder), RULE, CATALOG, *RANGE, limit=2)


@query("X04_next_open_signals", f"""
SELECT t.run_id, t.signal_date, t.security_code, t.rank_no, d.next_trade_date AS execution_date, CASE WHEN d.next_trade_date IS NULL THEN 'no_next_trade_date'
  WHEN d.next_trade_date > DATE '2001-06-30' THEN 'after_end_date' END AS drop_reason FROM ({TARGETS}) t JOIN trade_days d ON t.signal_date = d.trade_date""",
    ["trades", "trade_days"])
def next_open_signals(spark, folder):
    return ledger.next_open_signals(targets(spark, folder).drop("score"), days(spark, folder), "2001-06-30")


@query("X04_dropped_signals", f"""
SELECT run_id, CASE WHEN d.next_trade_date IS NULL THEN 'no_next_trade_date' ELSE 'after_end_date' END AS drop_reason, count(*) AS signal_count
FROM ({TARGETS}) t JOIN trade_days d ON t.signal_date = d.trade_date WHERE d.next_trade_date IS NULL OR d.next_trade_date > DATE '2001-06-30' GROUP BY ALL""",
    ["trades", "trade_days"])
def dropped_signals(spark, folder):
    return ledger.dropped_signals(next_open_signals(spark, folder))


RULES = (
    ledger.StopLoss(0.5), ledger.TakeProfit(1.0), ledger.TimeStop(30, 0.05),
    ledger.IndicatorStop("price_ma_20", "cross_below_metric"),
)


def adjusted_bars(spark, folder):
    """Bars in the shape the exit rules read; unadjusted prices stand in for both adjustments."""
    b = indicators.sma(market.bars(spark, folder).select("security_code", "trade_date", "open_price", "close_price"), "close_price", 20, "price_ma_20")
    return b.select(
        "security_code", "trade_date", F.col("open_price").alias("open_price_backward_adj"),
        F.col("close_price").alias("close_price_backward_adj"), F.col("close_price").alias("close_price_forward_adj"), "price_ma_20",
    )


def held_lots(spark, folder):
    """A lot per security opened on its first bar of each year and held to the year's end."""
    b = market.bars(spark, folder).select("security_code", "trade_date", "open_price")
    b = b.join(days(spark, folder).select("trade_date", "day_no"), "trade_date")
    w = Window.partitionBy("security_code", F.year("trade_date"))
    first = F.min_by(F.struct("trade_date", "open_price", "day_no"), "trade_date").over(w)
    return b.withColumn("_e", first).select(
        F.lit("held").alias("run_id"), F.lit("held-1").alias("attempt_id"), "security_code", F.col("_e.trade_date").alias("entry_date"),
        F.col("_e.open_price").alias("entry_price"), "trade_date", (F.col("day_no") - F.col("_e.day_no")).alias("holding_days"),
    )


@query("X05_exit_events", """
SELECT run_id, attempt_id, security_code, entry_date, min(trade_date) FILTER (reason IS NOT NULL) AS trigger_date,
  arg_min(reason, trade_date) FILTER (reason IS NOT NULL) AS exit_reason, count(*) FILTER (ma IS NULL) AS missing_indicator_days FROM (
  SELECT *, CASE WHEN gain <= -0.5e0 THEN 'fixed_stop_loss' WHEN gain >= 1e0 THEN 'take_profit' WHEN holding_days >= 30 AND gain < 0.05e0 THEN 'time_stop_loss'
    WHEN close_price < ma AND prev_close >= prev_ma THEN 'indicator_stop_loss' END AS reason FROM (
    SELECT 'held' AS run_id, 'held-1' AS attempt_id, security_code, trade_date, first_value(trade_date) OVER w AS entry_date, close_price, ma,
      CASE WHEN on_time THEN prev_close END AS prev_close, CASE WHEN on_time THEN prev_ma END AS prev_ma,
      close_price / first_value(open_price) OVER w - 1 AS gain, day_no - first_value(day_no) OVER w AS holding_days FROM (
      SELECT *, lag(trade_date) OVER c = prev_trade_date AS on_time, lag(close_price) OVER c AS prev_close, lag(ma) OVER c AS prev_ma FROM (
        SELECT b.*, d.day_no, d.prev_trade_date, CASE WHEN row_number() OVER c >= 20 THEN avg(close_price) OVER (c ROWS 19 PRECEDING) END AS ma
        FROM bars b JOIN trade_days d USING (trade_date) WINDOW c AS (PARTITION BY security_code ORDER BY trade_date))
      WINDOW c AS (PARTITION BY security_code ORDER BY trade_date))
    WINDOW w AS (PARTITION BY security_code, year(trade_date) ORDER BY trade_date))) GROUP BY ALL""", ["bars", "trade_days"])
def exit_events(spark, folder):
    return ledger.exit_events(held_lots(spark, folder), adjusted_bars(spark, folder), days(spark, folder), RULES)


FEES = scalars.FeeConfig()
define("exit_bars", """
SELECT *, CASE WHEN on_time THEN lag_close END AS prev_close, CASE WHEN on_time THEN lag_ma END AS prev_ma FROM (
  SELECT *, lag(trade_date) OVER c = prev_trade_date AS on_time, lag(close_price) OVER c AS lag_close, lag(ma) OVER c AS lag_ma,
    lead(trade_date) OVER c AS next_date, lead(open_price) OVER c AS next_open FROM (
    SELECT b.security_code, b.trade_date, open_price, close_price, d.day_no, d.prev_trade_date,
      CASE WHEN row_number() OVER c >= 20 THEN avg(close_price) OVER (c ROWS 19 PRECEDING) END AS ma
    FROM bars b JOIN trade_days d USING (trade_date) WINDOW c AS (PARTITION BY security_code ORDER BY trade_date))
  WINDOW c AS (PARTITION BY security_code ORDER BY trade_date))""", ["bars", "trade_days"])
define("candidates", f"""
SELECT security_code, entry_date, open_price, arg_min(next_date, trade_date) FILTER (reason IS NOT NULL) AS exit_date,
  arg_min(next_open, trade_date) FILTER (reason IS NOT NULL) AS exit_price, arg_min(reason, trade_date) FILTER (reason IS NOT NULL) AS reason FROM (
  SELECT e.security_code, e.trade_date AS entry_date, e.open_price, h.trade_date, h.next_date, h.next_open,
    CASE WHEN h.close_price / (e.open_price * {1 + FEES.slippage_bps / 10000!r}) - 1 <= -0.5e0 THEN 'fixed_stop_loss'
      WHEN h.close_price / (e.open_price * {1 + FEES.slippage_bps / 10000!r}) - 1 >= 1e0 THEN 'take_profit'
      WHEN h.day_no - e.day_no >= 30 AND h.close_price / (e.open_price * {1 + FEES.slippage_bps / 10000!r}) - 1 < 0.05e0 THEN 'time_stop_loss'
      WHEN h.close_price < h.ma AND h.prev_close >= h.prev_ma THEN 'indicator_stop_loss' END AS reason
  FROM (SELECT DISTINCT p.security_code, d.next_trade_date FROM pool p JOIN trade_days d ON d.trade_date = p.trade_date WHERE p.rank_no <= 1) s
  JOIN exit_bars e ON e.security_code = s.security_code AND e.trade_date = s.next_trade_date
  JOIN exit_bars h ON h.security_code = e.security_code AND h.trade_date >= e.trade_date) GROUP BY ALL""", ["pool", "trade_days", "exit_bars"])
COSTS = ("quantity", "reference_price", "execution_price", "gross_amount", "commission", "stamp_duty", "transfer_fee", "total_fee", "slippage_cost")


@query("X06_signal_trades", f"""
WITH RECURSIVE following AS (
  SELECT e.security_code, e.entry_date, min(n.entry_date) AS next_entry FROM candidates e
  JOIN candidates n ON n.security_code = e.security_code AND n.entry_date >= e.exit_date GROUP BY ALL
), chain AS (
  SELECT security_code, min(entry_date) AS entry_date FROM candidates GROUP BY 1
  UNION ALL SELECT c.security_code, f.next_entry FROM chain c JOIN following f ON f.security_code = c.security_code AND f.entry_date = c.entry_date
), lots AS (
  SELECT l.*, floor(1000000e0 / open_price / 100) * 100 AS quantity FROM candidates l JOIN chain c ON c.security_code = l.security_code AND c.entry_date = l.entry_date
), legs AS (
  SELECT security_code, entry_date, quantity, 'buy' AS side, entry_date AS trade_date, open_price AS reference_price, 'signal' AS reason,
    open_price * {1 + FEES.slippage_bps / 10000!r} AS execution_price FROM lots WHERE quantity > 0
  UNION ALL SELECT security_code, entry_date, quantity, 'sell', exit_date, exit_price, reason, exit_price * {1 - FEES.slippage_bps / 10000!r} FROM lots
  WHERE quantity > 0 AND exit_date IS NOT NULL
)
SELECT 'rule-1' AS run_id, 'rule-1-1' AS attempt_id, *, commission + stamp_duty + transfer_fee AS total_fee, abs(execution_price - reference_price) * quantity AS slippage_cost FROM (
  SELECT *, greatest(gross_amount * {min(FEES.commission_rate, FEES.commission_rate_max)!r}, {float(FEES.commission_min)!r}) AS commission,
    CASE side WHEN 'sell' THEN gross_amount * {FEES.stamp_duty_rate!r} ELSE 0 END AS stamp_duty, gross_amount * {FEES.transfer_fee_rate!r} AS transfer_fee FROM (
    SELECT *, execution_price * quantity AS gross_amount FROM legs))""", ["candidates"], COSTS, digits=4)
def signal_trades(spark, folder):
    sig = signals(spark, folder).select(
        F.lit("rule-1").alias("run_id"), F.lit("rule-1-1").alias("attempt_id"), "security_code", F.col("trade_date").alias("signal_date")
    )
    mapped = ledger.next_open_signals(sig, days(spark, folder), RANGE[1])
    return ledger.signal_trades(mapped, adjusted_bars(spark, folder), days(spark, folder), RULES)


define("matched", """
SELECT *, sold - greatest(max(sold - bought) OVER (PARTITION BY run_id, security_code ORDER BY trade_date, trade_seq ROWS UNBOUNDED PRECEDING), 0) AS matched FROM (
  SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) OVER w AS bought, sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) OVER w AS sold
  FROM trades WINDOW w AS (PARTITION BY run_id, security_code ORDER BY trade_date, trade_seq ROWS UNBOUNDED PRECEDING))""", ["trades"])
define("closed", """
SELECT *, exit_gross_amount - entry_gross_amount - entry_fee - exit_fee AS realized_pnl FROM (
  SELECT b.run_id, b.attempt_id, b.security_code, b.attempt_id || '-closed-' || s.trade_seq || '-' || b.trade_seq AS closed_trade_id,
    b.attempt_id || '-lot-' || b.trade_seq AS position_lot_id, b.trade_seq AS entry_trade_seq, s.trade_seq AS exit_trade_seq, b.trade_date AS entry_date,
    s.trade_date AS exit_date, q AS quantity, b.gross_amount * (q / b.quantity) AS entry_gross_amount, s.gross_amount * (q / s.quantity) AS exit_gross_amount,
    b.total_fee * (q / b.quantity) AS entry_fee, s.total_fee * (q / s.quantity) AS exit_fee, s.reason AS exit_reason, (d2.day_no - d1.day_no)::INT AS holding_days
  FROM (SELECT *, bought AS hi, bought - quantity AS lo FROM matched WHERE side = 'buy') b
  JOIN (SELECT *, matched AS hi, coalesce(lag(matched) OVER (PARTITION BY run_id, security_code ORDER BY trade_date, trade_seq), 0) AS lo FROM matched WHERE side = 'sell') s
    ON b.run_id = s.run_id AND b.security_code = s.security_code AND b.lo < s.hi AND s.lo < b.hi
  JOIN trade_days d1 ON d1.trade_date = b.trade_date JOIN trade_days d2 ON d2.trade_date = s.trade_date,
  LATERAL (SELECT least(b.hi, s.hi) - greatest(b.lo, s.lo) AS q) WHERE q > 1e-9)""", ["matched", "trade_days"])
MONEY = ("quantity", "entry_gross_amount", "exit_gross_amount", "entry_fee", "exit_fee", "realized_pnl")


def closed(spark, folder):
    return ledger.fifo_closed_trades(market.trades(spark, folder), days(spark, folder))


@query("X07_fifo_closed_trades", "SELECT * FROM closed", ["closed"], MONEY, digits=4)
def fifo_closed_trades(spark, folder):
    return closed(spark, folder)


define("closed_view", """
SELECT *, entry_fee + exit_fee AS total_fee, CASE WHEN entry_gross_amount + entry_fee <> 0 THEN realized_pnl / (entry_gross_amount + entry_fee) END AS realized_return
FROM closed""", ["closed"])
define("trade_metrics", """
SELECT *, closed_trade_count - winning_trade_count - losing_trade_count AS breakeven_trade_count,
  CASE WHEN average_loss_return <> 0 THEN abs(average_win_return) / abs(average_loss_return) END AS profit_loss_ratio FROM (
  SELECT run_id, attempt_id, count(*) AS closed_trade_count, count(*) FILTER (realized_return > 1e-9) AS winning_trade_count,
    count(*) FILTER (realized_return < -1e-9) AS losing_trade_count, count(*) FILTER (realized_return > 1e-9) / count(*) AS win_rate_closed_trades,
    avg(realized_return) FILTER (realized_return > 1e-9) AS average_win_return, avg(realized_return) FILTER (realized_return < -1e-9) AS average_loss_return,
    avg(holding_days) AS average_holding_days, max(realized_return) FILTER (realized_return > 1e-9) AS largest_win_return,
    min(realized_return) FILTER (realized_return < -1e-9) AS largest_loss_return FROM closed_view GROUP BY ALL)""", ["closed_view"])


@query("X08_trade_metrics", "SELECT * FROM trade_metrics", ["trade_metrics"], (
    "win_rate_closed_trades", "average_win_return", "average_loss_return", "average_holding_days", "largest_win_return", "largest_loss_return", "profit_loss_ratio"))
def trade_metrics(spark, folder):
    return ledger.trade_metrics(closed(spark, folder))


define("risk_free", """
SELECT c.trade_date, y.work_date AS source_date, '1y' AS source_tenor, y.one_year_yield_pct / 100 AS annual_rate,
  pow(1 + y.one_year_yield_pct / 100, 1e0 / 252) - 1 AS daily_rate
FROM calendar c ASOF LEFT JOIN (SELECT * FROM yields WHERE one_year_yield_pct IS NOT NULL) y ON c.trade_date >= y.work_date""", ["calendar", "yields"])


def risk_free(spark, folder):
    y = quotes.rename_select(market.yields(spark, folder), quotes.STAGING_MAPPINGS["government_bond"])
    return quotes.risk_free_daily(market.calendar(spark, folder), y)


define("perf_base", """
SELECT n.run_id, n.attempt_id, count(*) FILTER (ok) AS n, product(1 + p) FILTER (ok) - 1 AS hpr, product(1 + b) FILTER (ok) - 1 AS bh, product(1 + f) FILTER (ok) - 1 AS fh,
  stddev_samp(p) FILTER (ok) * sqrt(252) AS vol, sqrt(sum(pow(least(p, 0), 2)) FILTER (ok) / (count(*) FILTER (ok) - 1)) * sqrt(252) AS down,
  stddev_samp(p - b) FILTER (ok) * sqrt(252) AS te, covar_samp(p, b) FILTER (ok) / var_samp(b) FILTER (ok) AS beta, abs(least(min(drawdown), 0)) AS dd
FROM (SELECT *, p IS NOT NULL AND b IS NOT NULL AND f IS NOT NULL AS ok FROM (SELECT n.*, n.daily_return AS p, b.return_daily AS b, r.daily_rate AS f FROM nav_daily n
  LEFT JOIN benchmark_returns b ON n.trade_date = b.trade_date LEFT JOIN risk_free r ON n.trade_date = r.trade_date)) n GROUP BY ALL""",
    ["nav_daily", "benchmark_returns", "risk_free"])
define("perf", """
SELECT run_id, attempt_id, 'succeeded' AS metric_status, n AS observation_count, hpr AS holding_period_return, a AS annualized_return, vol AS annualized_volatility,
  dd AS max_drawdown, a / dd AS calmar_ratio, down AS downside_deviation, (a - f) / down AS sortino_ratio, (a - f) / vol AS sharpe_ratio,
  (a - bb) / te AS information_ratio, beta, a - (f + beta * (bb - f)) AS alpha, (a - f) / beta AS treynor_ratio
FROM (SELECT *, pow(1 + hpr, 252e0 / n) - 1 AS a, pow(1 + bh, 252e0 / n) - 1 AS bb, pow(1 + fh, 252e0 / n) - 1 AS f FROM perf_base)""", ["perf_base"])


def perf(spark, folder):
    return performance.performance(market.nav_daily(spark, folder), market.benchmark_returns(spark, folder), risk_free(spark, folder))


@query("X09_performance", "SELECT * FROM perf", ["perf"], performance.METRICS, digits=6)
def performance_query(spark, folder):
    return perf(spark, folder)


@query("X10_performance_status", """
SELECT run_id, attempt_id, metric_name, 'succeeded' AS metric_status, 'none' AS reason_code FROM (SELECT DISTINCT run_id, attempt_id FROM nav_daily),
(VALUES """ + ", ".join(f"('{m}')" for m in performance.METRICS) + ") v(metric_name)", ["nav_daily"])
def performance_status(spark, folder):
    return performance.performance_status(perf(spark, folder))


@query("X10_status_without_benchmark", """
SELECT run_id, attempt_id, metric_name, 'missing_benchmark' AS metric_status, 'benchmark_series_missing' AS reason_code FROM (SELECT DISTINCT run_id, attempt_id FROM nav_daily),
(VALUES """ + ", ".join(f"('{m}')" for m in performance.METRICS) + ") v(metric_name)", ["nav_daily"])
def status_without_benchmark(spark, folder):
    """A benchmark whose every return is NULL leaves no aligned day."""
    b = market.benchmark_returns(spark, folder).withColumn("return_daily", F.lit(None).cast("double"))
    return performance.performance_status(performance.performance(market.nav_daily(spark, folder), b, risk_free(spark, folder)))


@query("X11_closed_trade_view", "SELECT closed_trade_id, total_fee, realized_return FROM closed_view", ["closed_view"], ("total_fee", "realized_return"))
def closed_trade_view(spark, folder):
    return ledger.closed_trade_view(closed(spark, folder)).select("closed_trade_id", "total_fee", "realized_return")


define("lots", """
SELECT run_id, attempt_id, security_code, entry_trade_seq, entry_date, exit_date, quantity AS q, entry_gross_amount + entry_fee AS cost FROM closed
UNION ALL SELECT t.run_id, t.attempt_id, t.security_code, t.trade_seq, t.trade_date, NULL, t.quantity - coalesce(u.used, 0),
  (t.gross_amount + t.total_fee) * (t.quantity - coalesce(u.used, 0)) / t.quantity
FROM trades t LEFT JOIN (SELECT run_id, security_code, entry_trade_seq, sum(quantity) AS used FROM closed GROUP BY ALL) u
  ON u.run_id = t.run_id AND u.security_code = t.security_code AND u.entry_trade_seq = t.trade_seq
WHERE t.side = 'buy' AND t.quantity - coalesce(u.used, 0) > 1e-9""", ["closed", "trades"])
define("positions", """
SELECT *, cost_basis / quantity AS average_entry_price, quantity * close_price AS market_value, quantity * close_price - cost_basis AS unrealized_pnl,
  CASE WHEN cost_basis <> 0 THEN (quantity * close_price - cost_basis) / cost_basis END AS unrealized_return, false AS is_stale_price FROM (
  SELECT l.run_id, l.attempt_id, l.security_code, b.trade_date, sum(q) AS quantity, sum(cost) AS cost_basis, max(b.close_price) AS close_price,
    sum(q * (d.day_no - e.day_no)) / sum(q) AS holding_days
  FROM lots l JOIN bars b ON b.security_code = l.security_code AND b.trade_date >= l.entry_date AND (l.exit_date IS NULL OR b.trade_date < l.exit_date)
  JOIN trade_days d ON d.trade_date = b.trade_date JOIN trade_days e ON e.trade_date = l.entry_date GROUP BY ALL)""", ["lots", "bars", "trade_days"])


def positions(spark, folder):
    return positions_of(spark, folder, ledger.fifo_segments(market.trades(spark, folder)))


def positions_of(spark, folder, segments, keep_unpriced=False):
    return ledger.position_days(ledger.lots_of(segments), market.bars(spark, folder), days(spark, folder), keep_unpriced=keep_unpriced)


@query("X12_position_days", "SELECT * FROM positions", ["positions"], (
    "quantity", "cost_basis", "average_entry_price", "close_price", "market_value", "unrealized_pnl", "unrealized_return", "holding_days"), digits=3, fine=("unrealized_return",))
def position_days(spark, folder):
    return positions(spark, folder)


define("held", """
SELECT l.run_id, l.security_code, d.trade_date FROM lots l
JOIN trade_days d ON d.trade_date >= l.entry_date AND (l.exit_date IS NULL OR d.trade_date < l.exit_date) GROUP BY ALL""", ["lots", "trade_days"])
define("nav_from_trades", f"""
SELECT run_id, attempt_id, trade_date, cash_balance, position_market_value, total_equity, total_equity / {CASH} AS nav,
  total_equity / lag(total_equity) OVER w - 1 AS daily_return, total_equity / greatest({CASH}, max(total_equity) OVER (w ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown,
  position_market_value / total_equity AS gross_exposure, position_count, traded / total_equity AS turnover, fee_amount, warning_count FROM (
  SELECT *, cash_balance + position_market_value AS total_equity FROM (
    SELECT r.run_id, r.attempt_id, d.trade_date, {CASH} + sum(coalesce(flow, 0)) OVER (PARTITION BY r.run_id ORDER BY d.trade_date ROWS UNBOUNDED PRECEDING) AS cash_balance,
      coalesce(v.mv, 0) AS position_market_value, coalesce(v.n, 0) AS position_count, coalesce(v.unpriced, 0) AS warning_count, coalesce(traded, 0) AS traded, coalesce(fee, 0) AS fee_amount
    FROM (SELECT run_id, attempt_id, min(trade_date) AS first_day FROM trades GROUP BY ALL) r
    JOIN trade_days s ON s.trade_date = r.first_day JOIN trade_days d ON d.day_no >= greatest(s.day_no - 1, 1)
    LEFT JOIN (SELECT run_id, trade_date, sum(CASE WHEN side = 'buy' THEN -(gross_amount + total_fee) ELSE gross_amount - total_fee END) AS flow,
      sum(gross_amount) AS traded, sum(total_fee) AS fee FROM trades GROUP BY ALL) f ON f.run_id = r.run_id AND f.trade_date = d.trade_date
    LEFT JOIN (SELECT h.run_id, h.trade_date, sum(p.market_value) AS mv, count(*) AS n, count(*) - count(p.market_value) AS unpriced FROM held h
      LEFT JOIN positions p ON p.run_id = h.run_id AND p.security_code = h.security_code AND p.trade_date = h.trade_date GROUP BY ALL) v ON v.run_id = r.run_id AND v.trade_date = d.trade_date))
WINDOW w AS (PARTITION BY run_id ORDER BY trade_date)""", ["trades", "positions", "held", "trade_days"])


def nav(spark, folder):
    t = market.trades(spark, folder)
    return ledger.nav_series(t, positions_of(spark, folder, ledger.fifo_segments(t), keep_unpriced=True), days(spark, folder), CASH)


@query("X13_nav_series", "SELECT * FROM nav_from_trades", ["nav_from_trades"], (
    "cash_balance", "position_market_value", "total_equity", "nav", "daily_return", "drawdown", "gross_exposure", "turnover", "fee_amount"), digits=2,
    fine=("nav", "daily_return", "drawdown", "gross_exposure", "turnover"))
def nav_series(spark, folder):
    return nav(spark, folder)


@query("X14_run_totals", """
SELECT n.run_id, n.attempt_id, arg_max(total_equity, trade_date) AS ending_equity, arg_max(total_equity, trade_date) / 1e6 - 1 AS total_return,
  least(min(drawdown), 0) AS max_drawdown, (SELECT count(*) FROM trades t WHERE t.run_id = n.run_id) AS trade_count,
  (SELECT sum(total_fee) FROM trades t WHERE t.run_id = n.run_id) AS total_fee FROM nav_daily n GROUP BY ALL""", ["nav_daily", "trades"],
    ("ending_equity", "total_return", "max_drawdown", "total_fee"), digits=3, fine=("total_return", "max_drawdown"))
def run_totals(spark, folder):
    return ledger.run_totals(market.nav_daily(spark, folder), market.trades(spark, folder), 1e6)


@query("X15_rebase_nav", """
SELECT run_id, attempt_id, trade_date, nav, total_equity, daily_return, nav / greatest(1, max(nav) OVER (PARTITION BY run_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown
FROM (SELECT run_id, attempt_id, trade_date, total_equity, total_equity / first_value(total_equity) OVER w AS nav, total_equity / lag(total_equity) OVER w - 1 AS daily_return
  FROM nav_daily WHERE trade_date >= DATE '1998-06-15' WINDOW w AS (PARTITION BY run_id ORDER BY trade_date))""", ["nav_daily"],
    ("nav", "total_equity", "daily_return", "drawdown"), digits=3, fine=("nav", "daily_return", "drawdown"))
def rebase_nav(spark, folder):
    n = market.nav_daily(spark, folder)
    starts = n.where("trade_date >= date'1998-06-15'").groupBy("run_id", "attempt_id").agg(F.min("trade_date").alias("live_start_date"))
    return ledger.rebase_nav(n, starts).select(
        "run_id", "attempt_id", "trade_date", "nav", "total_equity", "daily_return", "drawdown"
    )


define("nav_points", """
SELECT run_id, attempt_id, trade_date, nav AS strategy_nav, CASE WHEN NOT broken THEN bn END AS benchmark_nav, CASE WHEN NOT broken THEN nav - bn END AS excess_return FROM (
  SELECT *, product(CASE WHEN rn = 1 THEN 1 ELSE 1 + return_daily END) OVER (w ROWS UNBOUNDED PRECEDING) AS bn,
    bool_or(rn > 1 AND return_daily IS NULL) OVER (w ROWS UNBOUNDED PRECEDING) AS broken FROM (
    SELECT n.*, b.return_daily, row_number() OVER (PARTITION BY run_id ORDER BY n.trade_date) AS rn FROM nav_daily n LEFT JOIN benchmark_returns b ON b.trade_date = n.trade_date)
  WINDOW w AS (PARTITION BY run_id ORDER BY trade_date))""", ["nav_daily", "benchmark_returns"])


@query("X16_nav_vs_benchmark", "SELECT * FROM nav_points", ["nav_points"], ("strategy_nav", "benchmark_nav", "excess_return"), digits=6)
def nav_vs_benchmark(spark, folder):
    return reports.nav_vs_benchmark(market.nav_daily(spark, folder), market.benchmark_returns(spark, folder))


def facts(spark, folder):
    """Positions of the derived ledger and a NAV frame that carries turnover."""
    n = market.nav_daily(spark, folder).withColumn("turnover", F.col("gross_exposure"))
    segments = checkpoint(ledger.fifo_segments(market.trades(spark, folder)))  # matched once, for positions and closed lots
    return market.trades(spark, folder), positions_of(spark, folder, segments), ledger.closed_trades(segments, days(spark, folder)), n


define("last_days", "SELECT run_id, max(trade_date) AS trade_date, arg_max(total_equity, trade_date) AS total_equity FROM nav_daily GROUP BY 1", ["nav_daily"])


@query("X17_rebalance_rows", """
SELECT u.*, b.security_name FROM (
  SELECT t.run_id, t.attempt_id, t.security_code, 'buy' AS direction, t.quantity, p.holding_days, p.unrealized_return AS change_pct,
    coalesce(p.average_entry_price, t.execution_price) AS cost_price, p.close_price AS current_price, p.unrealized_pnl / e.total_equity AS contribution_pct, t.reason
  FROM trades t JOIN last_days e USING (run_id, trade_date) LEFT JOIN positions p ON p.run_id = t.run_id AND p.security_code = t.security_code AND p.trade_date = t.trade_date
  WHERE side = 'buy' UNION ALL
  SELECT p.run_id, p.attempt_id, p.security_code, 'hold', p.quantity, p.holding_days, p.unrealized_return, p.average_entry_price, p.close_price, p.unrealized_pnl / e.total_equity, NULL
  FROM positions p JOIN last_days e USING (run_id, trade_date) WHERE NOT EXISTS (SELECT 1 FROM trades t WHERE t.run_id = p.run_id AND t.security_code = p.security_code AND t.trade_date = p.trade_date)
  UNION ALL SELECT c.run_id, c.attempt_id, c.security_code, 'sell', c.quantity, c.holding_days, c.realized_return, c.entry_gross_amount / c.quantity, c.exit_gross_amount / c.quantity,
    c.realized_pnl / e.total_equity, c.exit_reason FROM closed_view c JOIN last_days e ON e.run_id = c.run_id AND e.trade_date = c.exit_date) u
LEFT JOIN basics b ON b.security_code = u.security_code""", ["trades", "positions", "closed_view", "last_days", "basics"],
    ("quantity", "holding_days", "change_pct", "cost_price", "current_price", "contribution_pct"))
def rebalance_rows(spark, folder):
    t, p, c, n = facts(spark, folder)
    return reports.rebalance_rows(t, p, c, n, reports.default_days(n), market.basics(spark, folder))


@query("X18_rebalance_summary", """
SELECT n.run_id, n.attempt_id, n.trade_date, coalesce(b, 0) AS buy_count, coalesce(s, 0) AS sell_count, greatest(n.position_count - coalesce(b, 0), 0) AS hold_count
FROM nav_daily n LEFT JOIN (SELECT run_id, trade_date, count(DISTINCT security_code) FILTER (side = 'buy') AS b, count(DISTINCT security_code) FILTER (side = 'sell') AS s
  FROM trades GROUP BY ALL) t ON t.run_id = n.run_id AND t.trade_date = n.trade_date""", ["nav_daily", "trades"])
def rebalance_summary(spark, folder):
    return reports.rebalance_summary(market.nav_daily(spark, folder), market.trades(spark, folder))


PERIOD = ("1997-01-01", "1998-12-31")
WITHIN = "BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"


@query("X19_statement_summary", f"""
SELECT n.run_id, n.attempt_id, avg(gross_exposure) AS average_position_pct, count(*) FILTER (position_count > 0) AS holding_days,
  (SELECT count(DISTINCT security_code) FROM trades t WHERE t.run_id = n.run_id AND t.trade_date {WITHIN}) AS traded_security_count,
  (SELECT count(*) FROM trades t WHERE t.run_id = n.run_id AND t.trade_date {WITHIN}) AS trade_count,
  (SELECT avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) FROM (SELECT t.run_id, t.security_code, t.trade_seq, sum(coalesce(c.realized_pnl, 0)) AS pnl FROM trades t LEFT JOIN closed c
    ON c.run_id = t.run_id AND c.security_code = t.security_code AND c.exit_trade_seq = t.trade_seq WHERE t.side = 'sell' AND t.trade_date {WITHIN} GROUP BY ALL) x
    WHERE x.run_id = n.run_id) AS trade_win_rate,
  (SELECT count(*) FROM (SELECT run_id, security_code FROM closed WHERE exit_date {WITHIN} GROUP BY ALL HAVING sum(realized_pnl) > 0) x WHERE x.run_id = n.run_id) AS winning_security_count,
  (SELECT count(*) FROM (SELECT run_id, security_code FROM closed WHERE exit_date {WITHIN} GROUP BY ALL HAVING sum(realized_pnl) < 0) x WHERE x.run_id = n.run_id) AS losing_security_count
FROM nav_daily n WHERE trade_date {WITHIN} GROUP BY n.run_id, n.attempt_id""", ["nav_daily", "trades", "closed"], ("average_position_pct", "trade_win_rate"), digits=6)
def statement_summary(spark, folder):
    return reports.statement_summary(market.nav_daily(spark, folder), market.trades(spark, folder), closed(spark, folder), *PERIOD)


@query("X20_statement_operations", f"""
SELECT t.run_id, t.attempt_id, t.security_code, t.trade_seq, trade_date, side, execution_price, t.quantity, 100 AS lot_size, t.quantity / 100 AS lot_count, gross_amount,
  total_fee, balance AS position_balance_quantity, c.pnl AS realized_pnl, reason FROM (
  SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER (PARTITION BY run_id, security_code ORDER BY trade_date, trade_seq ROWS UNBOUNDED PRECEDING) AS balance FROM trades) t
LEFT JOIN (SELECT run_id, security_code, exit_trade_seq, sum(realized_pnl) AS pnl FROM closed GROUP BY ALL) c ON c.run_id = t.run_id AND c.security_code = t.security_code
  AND c.exit_trade_seq = t.trade_seq WHERE trade_date {WITHIN}""", ["trades", "closed"],
    ("execution_price", "quantity", "lot_count", "gross_amount", "total_fee", "position_balance_quantity", "realized_pnl"), digits=4)
def statement_operations(spark, folder):
    return reports.statement_operations(market.trades(spark, folder), closed(spark, folder), *PERIOD)


@query("X21_statement_period", """
SELECT run_id, key, greatest(CASE key WHEN 'month' THEN date_trunc('month', b)::DATE WHEN '3m' THEN (b - INTERVAL 3 MONTH)::DATE WHEN '6m' THEN (b - INTERVAL 6 MONTH)::DATE
  WHEN 'ytd' THEN date_trunc('year', b)::DATE ELSE a END, a) AS start_date, b AS end_date
FROM (SELECT run_id, min(trade_date) AS a, max(trade_date) AS b FROM nav_daily GROUP BY 1), (VALUES ('month'), ('3m'), ('6m'), ('ytd'), ('all')) v(key)""", ["nav_daily"])
def statement_period(spark, folder):
    runs = market.nav_daily(spark, folder).groupBy("run_id").agg(F.min("trade_date").alias("live_start_date"), F.max("trade_date").alias("latest_date"))
    keyed = runs.withColumn("key", F.explode(F.array(*[F.lit(k) for k in ("month", "3m", "6m", "ytd", "all")])))
    return reports.statement_period(keyed, F.col("key")).select("run_id", "key", "start_date", "end_date")


@query("X22_range_options", """
SELECT k AS period_key, (SELECT min(trade_date) FROM calendar WHERE trade_date >= (d - to_years(y))::DATE AND trade_date <= d) AS resolved_start_date, d AS resolved_end_date
FROM (SELECT max(trade_date) AS d FROM calendar WHERE trade_date IN (SELECT trade_date FROM benchmark_returns)), (VALUES ('1y', 1), ('2y', 2), ('3y', 3)) v(k, y)""",
    ["calendar", "benchmark_returns"])
def range_options(spark, folder):
    return reports.range_options(market.executions(spark, folder), market.benchmark_returns(spark, folder))


@query("X23_security_series", """
SELECT b.security_code, b.trade_date, b.open_price AS open, b.high_price AS high, b.low_price AS low, b.close_price AS close, a.price_ma_20,
  k_value, d_value, j_value FROM gap_bars b LEFT JOIN averages a USING (security_code, trade_date) LEFT JOIN kdj k USING (security_code, trade_date)
WHERE b.trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND b.security_code IN (SELECT security_code FROM basics WHERE security_board = 'chinext')""",
    ["gap_bars", "averages", "kdj", "basics"], ("open", "high", "low", "close", "price_ma_20", "k_value", "d_value", "j_value"), digits=4)
def security_series(spark, folder):
    b = market.gap_bars(spark, folder)
    codes = market.basics(spark, folder).where("security_board = 'chinext'").select("security_code")
    trend = indicators.moving_averages(b.select("security_code", "trade_date", "close_price", "volume"))
    momentum = indicators.kdj(b.select("security_code", "trade_date", "high_price", "low_price", "close_price"))
    return reports.security_series(b, trend, momentum, codes, *PERIOD, overlays=["price_ma_20"])


@query("X24_signals_by_date", """
SELECT trade_date, count(*) AS signal_count, string_agg(p.rank_no || ':' || p.security_code || ':' || b.security_name, ',' ORDER BY p.rank_no) AS signals
FROM pool p LEFT JOIN basics b ON b.security_code = p.security_code WHERE rank_no <= 5 GROUP BY 1""", ["pool", "basics"])
def signals_by_date(spark, folder):
    sig = screening.signals(signal_base(spark, folder), RULE, CATALOG, *RANGE)
    nested = screening.signals_by_date(sig, market.basics(spark, folder), RULE.top_n)
    text = F.transform("signals", lambda x: F.concat_ws(":", x["rank_no"].cast("string"), x["security_code"], x["security_name"]))
    return nested.select("trade_date", "signal_count", F.array_join(text, ",").alias("signals"))


@query("X25_read_facts", """
SELECT run_id, security_code, trade_seq, side, quantity FROM trades t WHERE side = 'buy' AND run_id IN ('A', 'R')
  AND trade_date = (SELECT max(trade_date) FROM trades x WHERE x.run_id = t.run_id AND x.side = 'buy')""", ["trades"], ("quantity",))
def read_facts(spark, folder):
    return reports.read_facts(market.trades(spark, folder), default_latest=True, run_id=["A", "R"], side="buy").select(
        "run_id", "security_code", "trade_seq", "side", "quantity"
    )


@query("X26_price_bars", """
SELECT b.security_code, b.trade_date, b.open_price, b.close_price, a.price_ma_60 FROM gap_bars b LEFT JOIN averages a USING (security_code, trade_date)
WHERE b.trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND b.security_code IN (SELECT security_code FROM basics WHERE security_type = 'stock')""",
    ["gap_bars", "averages", "basics"], ("open_price", "close_price", "price_ma_60"), digits=4)
def price_bars(spark, folder):
    b = market.gap_bars(spark, folder)
    trend = indicators.moving_averages(b.select("security_code", "trade_date", "close_price", "volume"))
    codes = market.basics(spark, folder).where("security_type = 'stock'").select("security_code")
    return reports.price_bars(b, trend, codes, *PERIOD, ["open_price", "close_price"], ["price_ma_60"])


@query("X27_signal_timeline", f"""
SELECT signal_date, count(*) AS target_count, signal_date >= ((SELECT max(signal_date) FROM ({TARGETS})) - INTERVAL 3 MONTH)::DATE AS in_trend FROM ({TARGETS}) GROUP BY 1""", ["trades"])
def signal_timeline(spark, folder):
    return screening.signal_timeline(targets(spark, folder))


@query("X28_search", """
SELECT 'strict' AS run_id, * FROM pool WHERE rank_no <= 1 UNION ALL SELECT 'wide', * FROM pool WHERE rank_no <= 3""", ["pool"], ("score",))
def search_signals(spark, folder):
    from dataclasses import replace

    grid = {"strict": replace(RULE, top_n=1), "wide": replace(RULE, top_n=3)}
    return search.signals_of(signal_base(spark, folder), rule_tables.tables_of(spark, grid, CATALOG), *RANGE)


SETTINGS = {
    "fixed": (ledger.StopLoss(0.3), ledger.TakeProfit(0.5)),
    "timed": (ledger.TimeStop(30, 0.05), ledger.TakeProfit(0.5)),
    "average": (ledger.IndicatorStop("price_ma_20", "cross_below_metric"),),
}
define("setting_exits", f"""
SELECT security_code, entry_date, setting_id, open_price, arg_min(next_date, trade_date) FILTER (hit) AS exit_date, arg_min(next_open, trade_date) FILTER (hit) AS exit_price FROM (
  SELECT e.security_code, e.trade_date AS entry_date, e.open_price, s.setting_id, h.trade_date, h.next_date, h.next_open, coalesce(CASE s.setting_id
    WHEN 'fixed' THEN h.close_price / (e.open_price * {1 + FEES.slippage_bps / 10000!r}) - 1 <= -0.3e0 OR h.close_price / (e.open_price * {1 + FEES.slippage_bps / 10000!r}) - 1 >= 0.5e0
    WHEN 'timed' THEN (h.day_no - e.day_no >= 30 AND h.close_price / (e.open_price * {1 + FEES.slippage_bps / 10000!r}) - 1 < 0.05e0)
      OR h.close_price / (e.open_price * {1 + FEES.slippage_bps / 10000!r}) - 1 >= 0.5e0
    ELSE h.close_price < h.ma AND h.prev_close >= h.prev_ma END, false) AS hit
  FROM (SELECT DISTINCT p.security_code, d.next_trade_date FROM pool p JOIN trade_days d ON d.trade_date = p.trade_date WHERE p.rank_no <= 3) a
  JOIN exit_bars e ON e.security_code = a.security_code AND e.trade_date = a.next_trade_date
  JOIN exit_bars h ON h.security_code = e.security_code AND h.trade_date >= e.trade_date, (VALUES ('fixed'), ('timed'), ('average')) s(setting_id)) GROUP BY ALL""",
    ["pool", "trade_days", "exit_bars"])


@query("X28_search_settings", f"""
WITH RECURSIVE options AS (
  SELECT v.run_id, x.* FROM pool p JOIN (VALUES ('strict', 1), ('wide', 3)) v(run_id, top_n) ON p.rank_no <= v.top_n
  JOIN trade_days d ON d.trade_date = p.trade_date JOIN setting_exits x ON x.security_code = p.security_code AND x.entry_date = d.next_trade_date
), following AS (
  SELECT e.run_id, e.setting_id, e.security_code, e.entry_date, min(n.entry_date) AS next_entry FROM options e
  JOIN options n ON n.run_id = e.run_id AND n.setting_id = e.setting_id AND n.security_code = e.security_code AND n.entry_date >= e.exit_date GROUP BY ALL
), chain AS (
  SELECT run_id, setting_id, security_code, min(entry_date) AS entry_date FROM options GROUP BY ALL
  UNION ALL SELECT c.run_id, c.setting_id, c.security_code, f.next_entry FROM chain c JOIN following f USING (run_id, setting_id, security_code, entry_date)
), held_lots AS (
  SELECT o.*, floor(1000000e0 / open_price / 100) * 100 AS quantity FROM options o JOIN chain USING (run_id, setting_id, security_code, entry_date)
), legs AS (
  SELECT run_id, setting_id, entry_date AS trade_date, 'buy' AS side, open_price * {1 + FEES.slippage_bps / 10000!r} * quantity AS gross FROM held_lots WHERE quantity > 0
  UNION ALL SELECT run_id, setting_id, exit_date, 'sell', exit_price * {1 - FEES.slippage_bps / 10000!r} * quantity FROM held_lots WHERE quantity > 0 AND exit_date IS NOT NULL
), flows AS (
  SELECT run_id, setting_id, trade_date, sum(CASE WHEN side = 'buy' THEN -gross - fee ELSE gross - fee END) AS flow FROM (
    SELECT *, greatest(gross * {min(FEES.commission_rate, FEES.commission_rate_max)!r}, {float(FEES.commission_min)!r}) + CASE side WHEN 'sell' THEN gross * {FEES.stamp_duty_rate!r} ELSE 0 END
      + gross * {FEES.transfer_fee_rate!r} AS fee FROM legs) GROUP BY ALL
), worth AS (
  SELECT l.run_id, l.setting_id, b.trade_date, sum(l.quantity * b.close_price) AS mv FROM held_lots l
  JOIN bars b ON b.security_code = l.security_code AND b.trade_date >= l.entry_date AND (l.exit_date IS NULL OR b.trade_date < l.exit_date) GROUP BY ALL
), equity AS (
  SELECT r.run_id, r.setting_id, d.trade_date, {CASH} + sum(coalesce(flow, 0)) OVER (PARTITION BY r.run_id, r.setting_id ORDER BY d.trade_date ROWS UNBOUNDED PRECEDING) + coalesce(mv, 0) AS total
  FROM (SELECT run_id, setting_id, min(trade_date) AS first_day FROM flows GROUP BY ALL) r JOIN trade_days s ON s.trade_date = r.first_day JOIN trade_days d ON d.day_no >= greatest(s.day_no - 1, 1)
  LEFT JOIN flows f ON f.run_id = r.run_id AND f.setting_id = r.setting_id AND f.trade_date = d.trade_date
  LEFT JOIN worth w ON w.run_id = r.run_id AND w.setting_id = r.setting_id AND w.trade_date = d.trade_date
), returns AS (
  SELECT *, total / lag(total) OVER w - 1 AS p, total / greatest({CASH}, max(total) OVER (w ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM equity
  WINDOW w AS (PARTITION BY run_id, setting_id ORDER BY trade_date)
), measured AS (
  SELECT run_id, setting_id, count(*) FILTER (ok) AS n, product(1 + p) FILTER (ok) - 1 AS hpr, product(1 + f) FILTER (ok) - 1 AS fh, stddev_samp(p) FILTER (ok) * sqrt(252) AS vol, abs(least(min(drawdown), 0)) AS dd FROM (
    SELECT r.*, y.daily_rate AS f, p IS NOT NULL AND b.return_daily IS NOT NULL AND y.daily_rate IS NOT NULL AS ok FROM returns r
    LEFT JOIN benchmark_returns b ON b.trade_date = r.trade_date LEFT JOIN risk_free y ON y.trade_date = r.trade_date) GROUP BY ALL
), long AS (
  SELECT run_id, setting_id, 'holding_period_return' AS metric_name, hpr AS metric_value, hpr AS best FROM measured WHERE n >= 20
  UNION ALL SELECT run_id, setting_id, 'max_drawdown', dd, -dd FROM measured WHERE n >= 20
  UNION ALL SELECT run_id, setting_id, 'sharpe_ratio', (pow(1 + hpr, 252e0 / n) - pow(1 + fh, 252e0 / n)) / vol AS s, s FROM measured WHERE n >= 20
)
SELECT run_id, setting_id, metric_name, metric_value, row_number() OVER (PARTITION BY metric_name ORDER BY best DESC, run_id, setting_id) AS metric_rank FROM long WHERE metric_value IS NOT NULL""",
    ["pool", "trade_days", "setting_exits", "bars", "benchmark_returns", "risk_free"], ("metric_value",), digits=6)
def search_settings(spark, folder):
    """Two rules under three risk settings, ranked by return, drawdown and Sharpe ratio."""
    nav_all = search.settings_nav(search_signals(spark, folder), adjusted_bars(spark, folder), market.bars(spark, folder), days(spark, folder), SETTINGS, RANGE[1], CASH)
    return search.ranked_settings(nav_all, market.benchmark_returns(spark, folder), risk_free(spark, folder))


@query("X29_security_display", """
SELECT security_code, security_name, exchange_code, security_board FROM basics WHERE security_code IN (SELECT security_code FROM pool WHERE rank_no <= 5)""", ["basics", "pool"])
def security_display(spark, folder):
    codes = screening.signals(signal_base(spark, folder), RULE, CATALOG, *RANGE)
    return reports.security_display(market.basics(spark, folder), codes)


@query("X30_dashboard", f"""
SELECT n.run_id, n.attempt_id, max(n.trade_date) AS latest_date, arg_max(n.nav, n.trade_date) AS latest_nav, arg_max(n.daily_return, n.trade_date) AS recent_change,
  arg_max(p.excess_return, n.trade_date) FILTER (p.excess_return IS NOT NULL) AS excess_return,
  avg(CASE WHEN daily_return > 0 THEN 1e0 WHEN daily_return IS NOT NULL THEN 0e0 END) AS win_rate, {", ".join(f"any_value(f.{m}) AS {m}" for m in performance.METRICS)},
  any_value(g.top_targets) AS top_targets
FROM nav_daily n JOIN nav_points p ON p.run_id = n.run_id AND p.trade_date = n.trade_date JOIN perf f ON f.run_id = n.run_id
JOIN (SELECT run_id, string_agg(t.security_code || coalesce(' ' || b.security_name, ''), ',' ORDER BY rank_no) AS top_targets FROM ({TARGETS}) t
  LEFT JOIN basics b ON b.security_code = t.security_code WHERE rank_no <= 5 AND signal_date = (SELECT max(trade_date) FROM trades x
  WHERE x.side = 'buy' AND x.run_id = t.run_id) GROUP BY 1) g ON g.run_id = n.run_id GROUP BY n.run_id, n.attempt_id""", ["nav_daily", "nav_points", "perf", "trades", "basics"],
    ("latest_nav", "recent_change", "excess_return", "win_rate", *performance.METRICS), digits=6)
def dashboard(spark, folder):
    return reports.dashboard(
        market.nav_daily(spark, folder), market.benchmark_returns(spark, folder), perf(spark, folder), targets(spark, folder), market.basics(spark, folder)
    )


def rank_sql(source: str, directions: dict[str, str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT run_id, attempt_id, '{m}' AS metric_name, {m}::DOUBLE AS metric_value, '{d}' AS rank_direction FROM {source}" for m, d in directions.items() if d != "none"
    )
    return f"""SELECT *, dense_rank() OVER (PARTITION BY metric_name ORDER BY CASE WHEN rank_direction = 'desc' THEN metric_value ELSE -metric_value END DESC, run_id, attempt_id) AS metric_rank
FROM ({parts}) WHERE metric_value IS NOT NULL"""


@query("D09_performance_rank", rank_sql("perf", tables.PERFORMANCE_DIRECTIONS), ["perf"], ("metric_value",), digits=6)
def performance_rank(spark, folder):
    return performance.performance_rank(perf(spark, folder))


@query("D09_trade_rank", rank_sql("trade_metrics", tables.TRADE_DIRECTIONS), ["trade_metrics"], ("metric_value",), digits=6)
def trade_rank(spark, folder):
    return performance.trade_rank(ledger.trade_metrics(closed(spark, folder)))
