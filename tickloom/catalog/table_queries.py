"""Joins, aggregates, windows, top-k, sets and reshaping (J, A, W, T, U operators)."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.scalar_queries import SCORE
from tickloom.catalog.screening_rule import RULE, CATALOG, SIGNALS, signal_base
from tickloom.catalog.tables import define
from tickloom.functions import rules
from tickloom.operators import indicators, joins, scans, sketches, tables
from tickloom.plans import quotes
from tickloom.session import scratch_path
from tickloom.sources import market

PRICES = ("open_price", "high_price", "low_price", "close_price")

# Further SQL tables the checks share.
define("quotes", """
SELECT substr(code, 4, 6) || '.' || upper(substr(code, 1, 2)) AS security_code, date AS trade_date, open AS open_price,
  high AS high_price, low AS low_price, close AS close_price, preclose AS prev_close_price, volume, amount,
  tradestatus = 0 AS is_suspend, "isST" AS is_st FROM raw_quotes""", ["raw_quotes"])
define("major_holders", """
SELECT security_code, end_date, coalesce(sum(CASE WHEN ratio > 5 THEN shares END), 0)::DOUBLE AS major_holder_a_float_shares,
  count(*) FILTER (ratio > 5) AS major_holder_count FROM (
  SELECT security_code, report_date AS end_date, holder_identifier, holder_name, max(free_float_hold_shares) AS shares,
    max(free_float_holdnum_ratio_pct) AS ratio FROM freeholders WHERE shares_type = 'A股' GROUP BY ALL) GROUP BY ALL""", ["freeholders"])
define("shares_history", """
SELECT security_code, effective_date, (lead(effective_date) OVER (PARTITION BY security_code ORDER BY effective_date) - 1)::DATE AS expiry_date,
  source_equity_end_date, source_freeholders_end_date, total_shares, unlimited_shares AS float_shares,
  CASE WHEN listed_a_shares IS NOT NULL OR limited_a_shares IS NOT NULL THEN coalesce(listed_a_shares, 0) + coalesce(limited_a_shares, 0) END AS shares,
  listed_a_shares AS float_shares_a,
  CASE WHEN listed_a_shares IS NOT NULL THEN greatest(0, listed_a_shares - coalesce(major_holder_a_float_shares, 0)) END AS free_float_shares,
  coalesce(major_holder_a_float_shares, 0) AS major_holder_a_float_shares, coalesce(major_holder_count, 0) AS major_holder_count
FROM (SELECT e.*, m.end_date AS source_freeholders_end_date, m.major_holder_a_float_shares, m.major_holder_count FROM (
  SELECT c.security_code, c.effective_date, h.end_date AS source_equity_end_date, total_shares, unlimited_shares, listed_a_shares, limited_a_shares
  FROM (SELECT security_code, end_date AS effective_date FROM equity_history UNION SELECT security_code, end_date FROM major_holders) c
  ASOF JOIN equity_history h ON c.security_code = h.security_code AND c.effective_date >= h.end_date) e
  ASOF LEFT JOIN major_holders m ON e.security_code = m.security_code AND e.effective_date >= m.end_date)""",
    ["equity_history", "major_holders"])


@query("J01_inner_join", """
SELECT q.security_code, count(*) AS n, min(trade_date) AS first_day FROM quotes q JOIN basics b ON q.security_code = b.security_code
WHERE security_type = 'index' GROUP BY 1""", ["quotes", "basics"])
def inner_join(spark, folder):
    q = quotes.stage_quotes(market.raw_quotes(spark, folder))
    b = market.basics(spark, folder).where("security_type = 'index'").select("security_code")
    return q.join(b, ["security_code"]).groupBy("security_code").agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_day"))


@query("J02_left_any", """
SELECT l.security_code, l.trade_date, o.o_orderkey, o.o_orderpriority FROM bars l LEFT JOIN (
  SELECT o_orderdate::DATE AS d, max((o_totalprice, o_orderkey, o_orderpriority)) AS best FROM orders GROUP BY 1) r ON l.trade_date = r.d
LEFT JOIN orders o ON o.o_orderkey = r.best[2]""", ["bars"])
def left_any(spark, folder):
    o = market.table(spark, folder, "orders").select(
        F.col("o_orderdate").cast("date").alias("trade_date"), "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    b = market.bars(spark, folder).select("security_code", "trade_date")
    return joins.left_any(b, o, ["trade_date"], ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@query("J03_asof_join", """
SELECT t.run_id, t.security_code, t.trade_date, t.trade_seq, r.report_date, r.total_assets FROM trades t
ASOF LEFT JOIN reports r ON t.security_code = r.security_code AND t.trade_date >= r.report_date""", ["trades", "reports"],
    ("total_assets",), digits=3)
def asof_join(spark, folder):
    """Raw ledger rows to reports: a security's trades may lie in any number of partitions."""
    t = market.trades(spark, folder).select("run_id", "security_code", "trade_date", "trade_seq")
    r = market.reports(spark, folder).select("security_code", "report_date", "total_assets")
    return scans.asof_join(t, r, ["security_code"], "trade_date", "report_date", right_unique=True)


@query("J04_asof_inner", """
SELECT b.security_code, b.trade_date, r.report_date FROM bars b JOIN LATERAL (SELECT max(report_date) AS report_date FROM reports r
  WHERE r.security_code = b.security_code AND r.report_date <= b.trade_date) r ON true WHERE r.report_date IS NOT NULL""", ["bars", "reports"])
def asof_inner(spark, folder):
    b = market.bars(spark, folder).select("security_code", "trade_date")
    r = market.reports(spark, folder).select("security_code", "report_date")
    return scans.asof_join(b, r, ["security_code"], "trade_date", "report_date", how="inner", bounded=True)


@query("J05_asof_valid_to", """
SELECT b.security_code, b.trade_date, CASE WHEN s.expiry_date IS NULL OR b.trade_date <= s.expiry_date - 10 THEN s.shares END AS shares
FROM bars b ASOF LEFT JOIN shares_history s ON b.security_code = s.security_code AND b.trade_date >= s.effective_date""",
    ["bars", "shares_history"], ("shares",))
def asof_valid_to(spark, folder):
    """Histories cut ten days short, so that matches lapse."""
    b = market.bars(spark, folder).select("security_code", "trade_date")
    s = quotes.shares_history(market.equity_history(spark, folder), market.freeholders(spark, folder)).select(
        "security_code", "effective_date", F.date_sub("expiry_date", 10).alias("expiry_date"), "shares"
    )
    return scans.asof_join(
        b, s, ["security_code"], "trade_date", "effective_date", columns=["shares"], valid_to="expiry_date"
    )


@query("J06_demand_join", """
SELECT b.security_code, b.trade_date, b.close_price FROM bars b JOIN (
  SELECT security_code, min(trade_date) AS d FROM trades WHERE side = 'buy' GROUP BY 1) f
ON b.security_code = f.security_code AND b.trade_date >= f.d""", ["bars", "trades"], ("close_price",))
def demand_join(spark, folder):
    demand = market.trades(spark, folder).where("side = 'buy'").select("security_code", F.col("trade_date").alias("start_date"))
    return joins.demand_join(market.bars(spark, folder).select("security_code", "trade_date", "close_price"), demand)


@query("J07_grid", "SELECT trade_date, tenor FROM calendar, (VALUES ('1y'), ('3y'), ('10y')) v(tenor)", ["calendar"])
def grid(spark, folder):
    return joins.grid(market.calendar(spark, folder), ["1y", "3y", "10y"], "tenor")


@query("J08_forward_fill", """
SELECT c.trade_date, c.source_tenor, y.work_date AS source_date, y.one_year_yield_pct AS pct FROM (SELECT trade_date, '1y' AS source_tenor FROM calendar) c
ASOF LEFT JOIN (SELECT * FROM yields WHERE one_year_yield_pct IS NOT NULL) y ON c.trade_date >= y.work_date""", ["calendar", "yields"], ("pct",))
def forward_fill(spark, folder):
    y = market.yields(spark, folder).where("one_year_yield_pct is not null").select(
        F.lit("1y").alias("source_tenor"), F.col("work_date").alias("source_date"), F.col("one_year_yield_pct").alias("pct")
    )
    days = joins.grid(market.calendar(spark, folder), ["1y"], "source_tenor")
    return joins.forward_fill(days, y, ["source_tenor"], "source_date", ["source_date", "pct"])


@query("J09_anti", """
SELECT trade_date, 'left' AS side FROM calendar WHERE trade_date NOT IN (SELECT trade_date FROM benchmark_returns)
UNION ALL SELECT trade_date, 'right' FROM benchmark_returns WHERE trade_date NOT IN (SELECT trade_date FROM calendar)""",
    ["calendar", "benchmark_returns"])
def anti(spark, folder):
    return joins.anti(market.calendar(spark, folder), market.benchmark_returns(spark, folder), ["trade_date"])


@query("J10_complete_attempts", """
SELECT t.run_id, count(*) AS n FROM trades t WHERE attempt_id IN (SELECT attempt_id FROM nav_daily GROUP BY 1
  HAVING min(drawdown) < -0.02 AND count(*) > 100) GROUP BY 1""", ["trades", "nav_daily"])
def complete_attempts(spark, folder):
    snapshot = market.nav_daily(spark, folder).groupBy("run_id", "attempt_id").agg(
        F.when((F.min("drawdown") < -0.02) & (F.count(F.lit(1)) > 100), "succeeded").otherwise("failed").alias("status")
    )
    return joins.complete_attempts(market.trades(spark, folder), snapshot).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("J11_null_safe", """
SELECT l.security_code, l.trade_date, l.close_price, r.close_price AS other_close_price FROM bars l JOIN gap_bars r
USING (security_code, trade_date) WHERE l.close_price IS DISTINCT FROM r.close_price""", ["bars", "gap_bars"],
    ("close_price", "other_close_price"))
def null_safe(spark, folder):
    return joins.changed_rows(
        market.bars(spark, folder), market.gap_bars(spark, folder), ["security_code", "trade_date"], ["close_price"]
    )


@query("J12_assemble_marts", f"""
SELECT q.security_code, q.trade_date, q.is_st, q.is_suspend, q.close_price AS close, s.price_ma_20 AS ma FROM quotes q LEFT JOIN ({SIGNALS}) s
USING (security_code, trade_date) WHERE q.trade_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""", ["quotes"], ("close", "ma"))
def assemble_marts(spark, folder):
    marts = {
        "quotes": quotes.stage_quotes(market.raw_quotes(spark, folder)), "trend": signal_base(spark, folder),
        "unused": market.nav_daily(spark, folder),
    }
    metrics = {"close": ("quotes", "close_price"), "ma": ("trend", "price_ma_20")}
    return joins.assemble_marts(marts, "quotes", metrics, "1997-01-01", "1998-12-31")


# --- aggregates ------------------------------------------------------------------------------


@query("A01_group_aggregate", """
SELECT security_code, sum(volume) AS volume, min(low_price) AS low, max(high_price) AS high, avg(close_price) AS mean_close, count(*) AS n
FROM bars GROUP BY 1""", ["bars"], ("volume", "low", "high", "mean_close"))
def group_aggregate(spark, folder):
    return market.bars(spark, folder).groupBy("security_code").agg(
        F.sum("volume").alias("volume"), F.min("low_price").alias("low"), F.max("high_price").alias("high"),
        F.avg("close_price").alias("mean_close"), F.count(F.lit(1)).alias("n"),
    )


@query("A02_conditional", """
SELECT run_id, security_code, coalesce(sum(quantity) FILTER (side = 'buy'), 0) AS bought, count(*) FILTER (side = 'sell') AS sells
FROM trades GROUP BY ALL""", ["trades"], ("bought",))
def conditional(spark, folder):
    return market.trades(spark, folder).groupBy("run_id", "security_code").agg(
        tables.sum_if("quantity", F.col("side") == "buy").alias("bought"), tables.count_if(F.col("side") == "sell").alias("sells")
    )


@query("A03_rebalance_counts", """
SELECT run_id, attempt_id, trade_date, count(DISTINCT CASE WHEN side = 'buy' THEN security_code END) AS buy_count,
  count(DISTINCT CASE WHEN side = 'sell' THEN security_code END) AS sell_count FROM trades GROUP BY ALL""", ["trades"])
def rebalance_counts(spark, folder):
    return tables.rebalance_counts(market.trades(spark, folder))


@query("A04_duplicate_keys", """
SELECT year(l_shipdate)::INT AS part, count(*) AS row_count, count(DISTINCT (l_orderkey, l_linenumber)) AS key_count,
  count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_count FROM lineitem GROUP BY 1""")
def duplicate_keys(spark, folder):
    return tables.duplicate_keys(market.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], F.year("l_shipdate"))


@query("A05_approx_distinct", "SELECT true AS close_enough, count(DISTINCT l_orderkey) AS exact FROM lineitem")
def approx_distinct(spark, folder):
    """Within 10 % of the exact count at 2 % relative error.

    Two aggregates: beside an exact distinct count in the same one, Spark keeps a sketch for every key.
    """
    li = market.table(spark, folder, "lineitem")
    exact = li.select("l_orderkey").distinct().agg(F.count("l_orderkey").alias("exact"))
    both = tables.approx_distinct(li, "l_orderkey").crossJoin(exact)
    return both.select((F.abs(F.col("approx_distinct") - F.col("exact")) <= F.col("exact") * 0.1).alias("close_enough"), "exact")


@query("A05_stored_sketches", """
SELECT year(d)::INT AS year, count(*) AS row_count, count(DISTINCT l_orderkey) AS exact, true AS distinct_close, true AS median_close FROM (SELECT *, l_shipdate::DATE AS d FROM lineitem)
WHERE year(d) BETWEEN 1994 AND 1996 GROUP BY 1""")
def stored_sketches(spark, folder):
    """Years profiled from the stored sketches of their days, and held against exact counts and ranks."""
    li = market.table(spark, folder, "lineitem").withColumn("day", F.col("l_shipdate").cast("date")).where(F.year("day").between(1994, 1996))
    path = scratch_path(spark, "sketches")
    for last in (False, True):  # the last year is added later, and the days before it are not read again
        part = li.where((F.year("day") == 1996) == F.lit(last))
        sketches.store_days(sketches.daily_sketches(part, "day", ["l_orderkey"], ["l_extendedprice"]), path)
    found = sketches.measured(sketches.merged(sketches.stored(spark, path).withColumn("year", F.year("day")), ["year"]))
    keys = found.where("column_name = 'l_orderkey'").select("year", "row_count", "distinct_count")
    medians = found.where("column_name = 'l_extendedprice'").select("year", F.col("quantiles")[1].alias("median"))
    rows = li.withColumn("year", F.year("day")).join(medians, "year")
    exact = rows.groupBy("year").agg(
        F.count_distinct("l_orderkey").alias("exact"), F.avg((F.col("l_extendedprice") <= F.col("median")).cast("double")).alias("share_upto"),
        F.avg((F.col("l_extendedprice") < F.col("median")).cast("double")).alias("share_below"),
    )
    return keys.join(exact, "year").select(
        "year", "row_count", "exact", (F.abs(F.col("distinct_count") - F.col("exact")) <= F.col("exact") * sketches.DISTINCT_ERROR + 1).alias("distinct_close"),
        ((F.col("share_below") <= 0.5 + sketches.RANK_ERROR) & (F.col("share_upto") >= 0.5 - sketches.RANK_ERROR)).alias("median_close"),
    )


@query("A06_latest_by", """
SELECT security_code, max(trade_date) AS trade_date, arg_max(close_price, trade_date) AS close_price FROM bars GROUP BY 1""",
    ["bars"], ("close_price",))
def latest_by(spark, folder):
    return tables.latest_by(market.bars(spark, folder), ["security_code"], "trade_date", ["close_price"])


@query("A07_first_valid", """
SELECT security_code, arg_min(close_price, trade_date) FILTER (close_price IS NOT NULL) AS first_close,
  arg_max(close_price, trade_date) FILTER (close_price IS NOT NULL) AS last_close FROM gap_bars GROUP BY 1""",
    ["gap_bars"], ("first_close", "last_close"))
def first_valid(spark, folder):
    return market.gap_bars(spark, folder).groupBy("security_code").agg(
        tables.first_valid("close_price", "trade_date").alias("first_close"), tables.last_valid("close_price", "trade_date").alias("last_close")
    )


@query("A08_major_holders", "SELECT * FROM major_holders", ["major_holders"], ("major_holder_a_float_shares",))
def major_holders(spark, folder):
    return tables.major_holders(market.freeholders(spark, folder))


def events(spark, folder):
    return quotes.exrights_events(market.dividend_main(spark, folder), market.dividend_allotment(spark, folder))


PER_TEN = "coalesce(try_cast(nullif(regexp_extract(coalesce({t}, ''), '{p}', 1), '') AS DOUBLE) / 10, 0)"
define("exrights_events", f"""
SELECT *, CASE WHEN has_cash_dividend AND has_share_right THEN 'DR' WHEN has_cash_dividend THEN 'XD' WHEN has_share_right THEN 'XR' END AS event_tag
FROM (SELECT *, cash_dividend_per_share > 0 AS has_cash_dividend,
  bonus_share_per_share > 0 OR transfer_share_per_share > 0 OR allotment_share_per_share > 0 AS has_share_right FROM (
  SELECT security_code, ex_dividend_date, min(equity_record_date) AS equity_record_date, max(notice_date) AS notice_date,
    max(report_date) AS report_date, arg_max(report_period_label, (notice_date, report_period_label)) FILTER (report_period_label IS NOT NULL) AS report_period_label,
    max(cash) AS cash_dividend_per_share, max(bonus) AS bonus_share_per_share, max(transfer) AS transfer_share_per_share,
    max(allot) AS allotment_share_per_share, max(price) AS allotment_price_yuan, bool_or(is_main) AS source_has_dividend_main,
    bool_or(NOT is_main) AS source_has_allotment,
    arg_max(plan_text, (notice_date, plan_text)) FILTER (plan_text IS NOT NULL) AS source_plan_text,
    arg_max(allot_text, (notice_date, allot_text)) FILTER (allot_text IS NOT NULL) AS source_allotment_text
  FROM (SELECT security_code, ex_dividend_date, equity_record_date, notice_date, report_date, report_period_label, plan_text,
      NULL::VARCHAR AS allot_text, {PER_TEN.format(t='plan_text', p='10派([0-9]+(?:\\.[0-9]+)?)元')} AS cash,
      {PER_TEN.format(t='plan_text', p='10送([0-9]+(?:\\.[0-9]+)?)(?:股)?')} AS bonus,
      {PER_TEN.format(t='plan_text', p='10转([0-9]+(?:\\.[0-9]+)?)(?:股)?')} AS transfer, 0::DOUBLE AS allot, NULL::DOUBLE AS price, true AS is_main
    FROM (SELECT *, coalesce(nullif(new_profile, ''), nullif(impl_plan_profile, ''), nullif(impl_plan_newprofile, '')) AS plan_text
      FROM dividend_main WHERE assign_progress = '实施方案' AND NOT is_unassign AND ex_dividend_date IS NOT NULL)
    UNION ALL SELECT security_code, ex_dividend_date, equity_record_date, notice_date, NULL, NULL, NULL, event_explain, 0, 0, 0,
      {PER_TEN.format(t='event_explain', p='每?10股配([0-9]+(?:\\.[0-9]+)?)股')}, issue_price, false FROM dividend_allotment)
  GROUP BY security_code, ex_dividend_date)) WHERE has_cash_dividend OR has_share_right""", ["dividend_main", "dividend_allotment"])
define("annual_dividends", """
SELECT security_code, report_date, sum(cash_dividend_per_share) AS latest_annual_cash_dividend_per_share, max(ex_dividend_date) AS latest_ex_dividend_date
FROM exrights_events WHERE has_cash_dividend AND month(report_date) = 12 AND day(report_date) = 31 GROUP BY ALL""", ["exrights_events"])
define("cumulative_dividends", """
SELECT security_code, ex_dividend_date, sum(cash) OVER (PARTITION BY security_code ORDER BY ex_dividend_date ROWS UNBOUNDED PRECEDING) AS cumulative_cash
FROM (SELECT security_code, ex_dividend_date, sum(cash_dividend_per_share) AS cash FROM exrights_events WHERE has_cash_dividend GROUP BY ALL)""",
    ["exrights_events"])


@query("A09_annual_dividends", "SELECT * FROM annual_dividends", ["annual_dividends"], ("latest_annual_cash_dividend_per_share",), digits=6)
def annual_dividends(spark, folder):
    return quotes.annual_dividends(events(spark, folder))


@query("A10_exrights_events", "SELECT * FROM exrights_events", ["exrights_events"],
    ("cash_dividend_per_share", "bonus_share_per_share", "transfer_share_per_share", "allotment_share_per_share", "allotment_price_yuan"), digits=6)
def exrights_events(spark, folder):
    return events(spark, folder)


@query("A11_pool_timeline", f"""
SELECT trade_date, count(*) AS pool_count FROM ({SIGNALS}) WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
  AND price_ma_20 > price_ma_60 AND prev_price_ma_20 <= prev_price_ma_60 AND volume > 0.8 * volume_ma_5 GROUP BY 1""", ["bars"])
def pool_timeline(spark, folder):
    from tickloom.plans.screening import pool_timeline as timeline

    return timeline(signal_base(spark, folder), RULE, CATALOG, "1996-01-01", "2000-12-31")


@query("A12_settlement_date", """
SELECT least(max(b), max(y), max(r)) AS settlement_date, greatest(max(b), max(y), max(r)) AS newest_date, 3::BIGINT AS mart_count FROM (
  SELECT (SELECT max(trade_date) FROM bars) AS b, (SELECT max(work_date) FROM yields) AS y, (SELECT max(trade_date) FROM benchmark_returns) AS r)""",
    ["bars", "yields", "benchmark_returns"])
def settlement_date(spark, folder):
    return tables.settlement_date({
        "bars": (market.executions(spark, folder), "trade_date"), "yields": (market.yields(spark, folder), "work_date"),
        "benchmark": (market.benchmark_returns(spark, folder), "trade_date"),
    })


@query("A13_fact_counts", """
SELECT run_id, attempt_id, (SELECT count(*) FROM trades t WHERE t.attempt_id = n.attempt_id) AS trade_count, count(*) AS nav_count
FROM nav_daily n GROUP BY ALL""", ["trades", "nav_daily"])
def fact_counts(spark, folder):
    return tables.fact_counts({"trade": market.trades(spark, folder), "nav": market.nav_daily(spark, folder)})


@query("A14_daily_win_rate", """
SELECT run_id, attempt_id, avg(CASE WHEN daily_return > 0 THEN 1e0 WHEN daily_return IS NOT NULL THEN 0e0 END) AS win_rate,
  count(daily_return) AS observation_count, count(*) FILTER (daily_return > 0) AS winning_day_count FROM nav_daily GROUP BY ALL""",
    ["nav_daily"], ("win_rate",))
def daily_win_rate(spark, folder):
    return tables.daily_win_rate(market.nav_daily(spark, folder))


@query("A15_covariance", """
SELECT run_id, var_samp(b.return_daily) AS var_b, covar_samp(n.daily_return, b.return_daily) AS cov, covar_samp(n.daily_return, b.return_daily)
  / var_samp(b.return_daily) AS beta FROM nav_daily n JOIN benchmark_returns b USING (trade_date) WHERE daily_return IS NOT NULL GROUP BY 1""",
    ["nav_daily", "benchmark_returns"], ("var_b", "cov", "beta"), digits=9)
def covariance(spark, folder):
    n = market.nav_daily(spark, folder).where("daily_return is not null")
    j = n.join(market.benchmark_returns(spark, folder), "trade_date")
    cov, var = F.covar_samp("daily_return", "return_daily"), F.var_samp("return_daily")
    return j.groupBy("run_id").agg(var.alias("var_b"), cov.alias("cov"), F.when(var != 0, cov / var).alias("beta"))


@query("A16_compound", """
SELECT run_id, product(1 + daily_return) - 1 AS total_return FROM nav_daily WHERE daily_return IS NOT NULL GROUP BY 1""",
    ["nav_daily"], ("total_return",), digits=8)
def compound(spark, folder):
    return market.nav_daily(spark, folder).where("daily_return is not null").groupBy("run_id").agg(tables.compound("daily_return").alias("total_return"))


@query("A17_demand_summary", """
SELECT min(d) AS min_date, max(CASE WHEN rn = (n - 1) * 50 // 100 THEN d END) AS p50_date, max(CASE WHEN rn = (n - 1) * 90 // 100 THEN d END) AS p90_date,
  max(d) AS max_date, count(*) FILTER (d - lo <= (hi - lo) * 0.2) AS early_count, max(n) AS demand_count FROM (
  SELECT d, row_number() OVER (ORDER BY d) - 1 AS rn, count(*) OVER () AS n, min(d) OVER () AS lo, max(d) OVER () AS hi FROM (
    SELECT run_id, security_code, min(trade_date) AS d FROM trades GROUP BY ALL))""", ["trades"])
def demand_summary(spark, folder):
    demand = market.trades(spark, folder).groupBy("run_id", "security_code").agg(F.min("trade_date").alias("start_date"))
    return tables.demand_summary(demand)


SCREENED = f"""SELECT 'rule-1' AS run_id, security_code, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, security_code) <= 2 AS is_buy_signal
FROM (SELECT *, {SCORE} AS score FROM ({SIGNALS})) WHERE price_ma_20 > price_ma_60 AND prev_price_ma_20 <= prev_price_ma_60"""


def screened(spark, folder):
    hits = signal_base(spark, folder).where("price_ma_20 > price_ma_60 and prev_price_ma_20 <= prev_price_ma_60").select(
        F.lit("rule-1").alias("run_id"), "security_code", "trade_date", rules.rule_score(RULE, CATALOG).alias("score")
    )
    return tables.rank_signals(hits).withColumn("is_buy_signal", F.col("rank_no") <= 2)


@query("A18_run_day_counts", f"""
SELECT 'rule-1' AS run_id, c.trade_date, coalesce(n, 0) AS pool_count, coalesce(s, 0) AS signal_count FROM calendar c LEFT JOIN (
  SELECT trade_date, count(*) AS n, count(*) FILTER (is_buy_signal) AS s FROM ({SCREENED}) GROUP BY 1) d USING (trade_date)
WHERE c.trade_date BETWEEN (SELECT min(trade_date) FROM calendar) AND (SELECT max(trade_date) FROM calendar)""", ["bars", "calendar"])
def run_day_counts(spark, folder):
    days = market.calendar(spark, folder)
    runs = days.agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date")).withColumn("run_id", F.lit("rule-1"))
    return tables.run_day_counts(screened(spark, folder), days, runs)


@query("A18_run_totals", f"""
SELECT 'rule-1' AS run_id, (SELECT count(*) FROM calendar) AS day_count, count(*) AS pool_total, count(*) FILTER (is_buy_signal) AS signal_total
FROM ({SCREENED})""", ["bars", "calendar"])
def run_totals(spark, folder):
    return tables.run_totals_of_days(run_day_counts(spark, folder))


# --- windows ---------------------------------------------------------------------------------


@query("W01_with_prev", f"""
SELECT security_code, trade_date, prev_close_price, prev_price_ma_20, prev_price_ma_60 FROM ({SIGNALS})""", ["bars"],
    ("prev_close_price", "prev_price_ma_20", "prev_price_ma_60"))
def with_prev(spark, folder):
    return signal_base(spark, folder).select("security_code", "trade_date", "prev_close_price", "prev_price_ma_20", "prev_price_ma_60")


@query("W02_trade_calendar", "SELECT trade_date, prev_trade_date, next_trade_date, day_no::INT AS day_no FROM trade_days", ["trade_days"])
def trade_calendar(spark, folder):
    return tables.trade_calendar(market.calendar(spark, folder)).drop("day_count")


@query("W03_with_expiry", """
SELECT security_code, end_date, (lead(end_date) OVER (PARTITION BY security_code ORDER BY end_date) - 1)::DATE AS expiry_date FROM equity_history""",
    ["equity_history"])
def with_expiry(spark, folder):
    return tables.with_expiry(market.equity_history(spark, folder).select("security_code", "end_date"), ["security_code"], "end_date")


@query("W04_running_sum", """
SELECT run_id, trade_date, trade_seq, security_code, sum(gross_amount) OVER (PARTITION BY run_id ORDER BY trade_date, trade_seq, security_code ROWS UNBOUNDED PRECEDING) AS turnover
FROM trades""", ["trades"], ("turnover",), digits=2)
def running_sum(spark, folder):
    """A run is a third of all trades, so it is scanned in blocks."""
    t = market.trades(spark, folder).select("run_id", "trade_date", "trade_seq", "security_code", "gross_amount")
    return scans.running_sum(t, ["run_id"], ["trade_date", "trade_seq", "security_code"], "gross_amount", "turnover").drop("gross_amount")


def unadj_input(spark, folder):
    q = quotes.stage_quotes(market.raw_quotes(spark, folder))
    days = tables.trade_calendar(market.calendar(spark, folder))
    previous = q.select("security_code", F.col("trade_date").alias("prev_trade_date"), F.col("close_price").alias("prev_close_price_unadj"))
    return q.join(days.select("trade_date", "prev_trade_date"), "trade_date", "left").join(previous, ["security_code", "prev_trade_date"], "left")


define("unadj_pairs", """
SELECT q.*, p.close_price AS prev_close_price_unadj, p.volume AS prev_volume FROM quotes q LEFT JOIN trade_days t ON q.trade_date = t.trade_date
LEFT JOIN quotes p ON p.security_code = q.security_code AND p.trade_date = t.prev_trade_date""", ["quotes", "trade_days"])
define("factors", """
SELECT security_code, trade_date, prev_close_price_unadj, prev_close_price, b AS backward_adjustment_ratio,
  exp(sum(ln(b)) OVER (PARTITION BY security_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS backward_adjustment_factor,
  f AS forward_adjustment_ratio,
  exp(coalesce(sum(ln(f)) OVER (PARTITION BY security_code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS forward_adjustment_factor
FROM (SELECT *, CASE WHEN prev_close_price_unadj > 0 AND prev_close_price > 0 THEN prev_close_price_unadj / prev_close_price ELSE 1e0 END AS b,
  CASE WHEN prev_close_price_unadj > 0 AND prev_close_price > 0 THEN prev_close_price / prev_close_price_unadj ELSE 1e0 END AS f FROM unadj_pairs)""",
    ["unadj_pairs"])


@query("W05_backward_factor", "SELECT security_code, trade_date, backward_adjustment_ratio, backward_adjustment_factor FROM factors", ["factors"],
    ("backward_adjustment_ratio", "backward_adjustment_factor"), digits=7)
def backward_factor(spark, folder):
    f = quotes.adjustment_factors(unadj_input(spark, folder))
    return f.select("security_code", "trade_date", "backward_adjustment_ratio", "backward_adjustment_factor")


@query("W06_forward_factor", "SELECT security_code, trade_date, forward_adjustment_ratio, forward_adjustment_factor FROM factors", ["factors"],
    ("forward_adjustment_ratio", "forward_adjustment_factor"), digits=7)
def forward_factor(spark, folder):
    f = quotes.adjustment_factors(unadj_input(spark, folder))
    return f.select("security_code", "trade_date", "forward_adjustment_ratio", "forward_adjustment_factor")


@query("W07_ttm", """
SELECT security_code, report_date, CASE WHEN count(quarter_profit) OVER w = 4 AND lag(report_date, 3) OVER (PARTITION BY security_code ORDER BY report_date)
  = (report_date - INTERVAL 9 MONTH)::DATE THEN sum(quarter_profit) OVER w END AS ttm_quarter_profit FROM reports
WINDOW w AS (PARTITION BY security_code ORDER BY report_date ROWS 3 PRECEDING)""", ["reports"], ("ttm_quarter_profit",), digits=3)
def ttm(spark, folder):
    r = market.reports(spark, folder).select("security_code", "report_date", "quarter_profit")
    return tables.ttm(r, "quarter_profit").drop("quarter_profit")


@query("W08_rank_signals", f"""
SELECT security_code, trade_date, score, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, security_code)::INT AS rank_no
FROM (SELECT *, {SCORE} AS score FROM ({SIGNALS}))""", ["bars"], ("score",))
def rank_signals(spark, folder):
    s = signal_base(spark, folder).select("security_code", "trade_date", rules.rule_score(RULE, CATALOG).alias("score"))
    return tables.rank_signals(s)


@query("W09_pool_count", """
SELECT security_code, trade_date, count(*) OVER (PARTITION BY trade_date) AS pool_count FROM bars""", ["bars"])
def pool_count(spark, folder):
    return tables.with_pool_count(market.bars(spark, folder).select("security_code", "trade_date"))


define("ranked_metrics", """
SELECT security_code, report_date, metric_name, metric_value, direction FROM (SELECT security_code, report_date, 'roe' AS metric_name,
  quarter_profit / total_assets AS metric_value, 'desc' AS direction FROM reports UNION ALL
  SELECT security_code, report_date, 'size', share_capital, 'asc' FROM reports) WHERE metric_value IS NOT NULL""", ["reports"])


@query("W10_metric_rank", """
SELECT security_code, report_date, metric_name, dense_rank() OVER (PARTITION BY metric_name ORDER BY CASE WHEN direction = 'desc' THEN metric_value
  ELSE -metric_value END DESC, security_code, report_date) AS metric_rank FROM ranked_metrics""", ["ranked_metrics"])
def metric_rank(spark, folder):
    from tickloom.plans.performance import metric_rank as rank

    r = market.reports(spark, folder).select(
        "security_code", "report_date", (F.col("quarter_profit") / F.col("total_assets")).alias("roe"), F.col("share_capital").alias("size")
    )
    long = tables.unpivot_metrics(r, ["security_code", "report_date"], ["roe", "size"])
    directions = tables.rank_catalog(spark, {"roe": "desc", "size": "asc"})
    return rank(long, directions, [], ["security_code", "report_date"]).select("security_code", "report_date", "metric_name", "metric_rank")


@query("W11_position_balance", """
SELECT run_id, security_code, trade_date, trade_seq, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER (PARTITION BY run_id, security_code
  ORDER BY trade_date, trade_seq ROWS UNBOUNDED PRECEDING) AS position_balance_quantity FROM trades""", ["trades"], ("position_balance_quantity",))
def position_balance(spark, folder):
    return tables.position_balance(market.trades(spark, folder)).select(
        "run_id", "security_code", "trade_date", "trade_seq", "position_balance_quantity"
    )


@query("W12_lookback_start", """
SELECT min(trade_date) AS lookback_start FROM (SELECT trade_date, row_number() OVER (PARTITION BY security_code ORDER BY trade_date DESC) AS rn
  FROM bars WHERE trade_date < DATE '2000-01-01') WHERE rn <= 50""", ["bars"])
def lookback_start(spark, folder):
    return tables.lookback_start(market.bars(spark, folder), 50, "2000-01-01")


@query("W13_lookback_dates", """
SELECT min(trade_date) AS lookback_start FROM (SELECT trade_date FROM calendar WHERE trade_date <= DATE '2000-01-01' ORDER BY trade_date DESC LIMIT 27)""",
    ["calendar"])
def lookback_dates(spark, folder):
    return tables.lookback_start_dates(market.executions(spark, folder), 27, "2000-01-01")


# --- top-k, sets, reshaping ------------------------------------------------------------------


@query("T01_top_n", f"""
SELECT * FROM (SELECT security_code, trade_date, score, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, security_code)::INT AS rank_no
FROM (SELECT *, {SCORE} AS score FROM ({SIGNALS}))) WHERE rank_no <= 5""", ["bars"], ("score",))
def top_n(spark, folder):
    return tables.top_n_per_date(rank_signals(spark, folder), 5)


@query("T02_pool_page", f"""
SELECT security_code, trade_date, score, rank_no, pool_count FROM (SELECT security_code, trade_date, score,
  row_number() OVER (ORDER BY score DESC, security_code)::INT AS rank_no, count(*) OVER () AS pool_count FROM (
  SELECT *, {SCORE} AS score FROM ({SIGNALS})) WHERE trade_date = DATE '1998-06-15' AND price_ma_20 > 0)
ORDER BY rank_no LIMIT 4 OFFSET 2""", ["bars"], ("score",))
def pool_page(spark, folder):
    from tickloom.plans.screening import pool_page as page

    rule = rules.Rule(filters=rules.Compare(rules.Ref("price_ma_20"), "gt", 0.0), scoring=RULE.scoring)
    return page(signal_base(spark, folder), rule, CATALOG, "1998-06-15", limit=4, offset=2).select(
        "security_code", "trade_date", "score", "rank_no", "pool_count"
    )


@query("T03_latest_rows", """
SELECT security_code, trade_date, close_price FROM (SELECT *, row_number() OVER (PARTITION BY security_code ORDER BY trade_date DESC) AS rn
FROM bars WHERE trade_date <= DATE '1999-06-30') WHERE rn <= 30""", ["bars"], ("close_price",))
def latest_rows(spark, folder):
    b = market.bars(spark, folder).select("security_code", "trade_date", "close_price")
    return tables.latest_rows(b, 30, "1999-06-30")


TARGETS = """SELECT run_id, signal_date, security_code, row_number() OVER (PARTITION BY run_id, signal_date ORDER BY score DESC,
  security_code)::INT AS rank_no FROM (SELECT run_id, trade_date AS signal_date, security_code, sum(gross_amount) AS score FROM trades
  WHERE side = 'buy' GROUP BY ALL)"""


def targets(spark, folder):
    from pyspark.sql import Window

    g = market.trades(spark, folder).where("side = 'buy'").groupBy("run_id", F.col("trade_date").alias("signal_date"), "security_code").agg(
        F.sum("gross_amount").alias("score")
    )
    w = Window.partitionBy("run_id", "signal_date").orderBy(F.col("score").desc(), "security_code")
    return g.withColumn("rank_no", F.row_number().over(w))


@query("T04_latest_targets", f"""
SELECT * FROM ({TARGETS}) t WHERE rank_no <= 5 AND signal_date = (SELECT max(trade_date) FROM trades x WHERE x.side = 'buy' AND x.run_id = t.run_id)""",
    ["trades"])
def latest_targets(spark, folder):
    return tables.latest_targets(targets(spark, folder), 5).drop("score")


@query("T05_virtual_account", """
SELECT run_id, attempt_id, trade_date, total_equity, p AS previous_equity, total_equity - p AS daily_pnl,
  coalesce((SELECT count(*) FROM (SELECT security_code FROM trades t WHERE t.attempt_id = n.attempt_id AND t.trade_date = n.trade_date GROUP BY 1)), 0) AS position_count,
  (SELECT sum(gross_amount) FROM trades t WHERE t.attempt_id = n.attempt_id AND t.trade_date = n.trade_date) AS position_market_value
FROM (SELECT *, lag(total_equity) OVER w AS p, row_number() OVER (PARTITION BY run_id ORDER BY trade_date DESC) AS rn FROM nav_daily
  WINDOW w AS (PARTITION BY run_id ORDER BY trade_date)) n WHERE rn = 1""", ["nav_daily", "trades"],
    ("total_equity", "previous_equity", "daily_pnl", "position_market_value"), digits=3)
def virtual_account(spark, folder):
    positions = market.trades(spark, folder).groupBy("run_id", "attempt_id", "trade_date", "security_code").agg(F.sum("gross_amount").alias("market_value"))
    return tables.virtual_account(market.nav_daily(spark, folder), positions)


@query("T06_trade_dates", "SELECT trade_date FROM calendar WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", ["calendar"])
def trade_dates(spark, folder):
    return tables.trade_dates(market.executions(spark, folder), "1996-01-01", "1997-12-31")


for side, comparison, function in (("before", "<", "max"), ("on_or_before", "<=", "max"), ("after", ">", "min")):

    def nearest(spark, folder, side=side):
        y = market.yields(spark, folder).select("work_date", "one_year_yield_pct")
        return tables.nearest_trade_date(y, "work_date", market.calendar(spark, folder), side)

    query(f"T07_nearest_{side}", f"""
SELECT work_date, one_year_yield_pct, (SELECT {function}(trade_date) FROM calendar c WHERE c.trade_date {comparison} y.work_date) AS nearest_trade_date
FROM yields y""", ["yields", "calendar"], ("one_year_yield_pct",))(nearest)


@query("U01_union_all", """
SELECT source, count(*) AS n FROM (SELECT 'main' AS source, security_code FROM dividend_main UNION ALL
SELECT 'allotment', security_code FROM dividend_allotment) GROUP BY 1""", ["dividend_main", "dividend_allotment"])
def union_all(spark, folder):
    main = market.dividend_main(spark, folder).select("security_code", F.lit("main").alias("source"))
    allot = market.dividend_allotment(spark, folder).select(F.lit("allotment").alias("source"), "security_code")
    return main.unionByName(allot).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("U02_union_distinct", """
SELECT security_code, end_date AS d FROM equity_history UNION SELECT security_code, report_date FROM reports""", ["equity_history", "reports"])
def union_distinct(spark, folder):
    return tables.union_distinct(
        market.equity_history(spark, folder).select("security_code", F.col("end_date").alias("d")),
        market.reports(spark, folder).select("security_code", F.col("report_date").alias("d")),
    )


@query("U03_key_diff", """
SELECT security_code, d, 'left_only' AS side FROM (SELECT security_code, end_date AS d FROM equity_history EXCEPT SELECT security_code, report_date FROM reports)
UNION ALL SELECT security_code, d, 'right_only' FROM (SELECT security_code, report_date AS d FROM reports EXCEPT SELECT security_code, end_date FROM equity_history)""",
    ["equity_history", "reports"])
def key_diff(spark, folder):
    return tables.key_diff(
        market.equity_history(spark, folder).select("security_code", F.col("end_date").alias("d")),
        market.reports(spark, folder).select("security_code", F.col("report_date").alias("d")), ["security_code", "d"],
    )


@query("U04_distinct", """
SELECT DISTINCT security_code, report_date, holder_identifier, shares_type FROM freeholders""", ["freeholders"])
def distinct(spark, folder):
    return market.freeholders(spark, folder).select("security_code", "report_date", "holder_identifier", "shares_type").distinct()


@query("U05_unpivot_metrics", """
SELECT security_code, report_date, 'total_assets' AS metric_name, total_assets AS metric_value FROM reports
UNION ALL SELECT security_code, report_date, 'share_capital', share_capital FROM reports""", ["reports"], ("metric_value",), digits=3)
def unpivot_metrics(spark, folder):
    return tables.unpivot_metrics(market.reports(spark, folder), ["security_code", "report_date"], ["total_assets", "share_capital"])


@query("U06_rank_catalog", """
SELECT d.direction AS rank_direction, count(*) AS n, avg(m.metric_value) AS mean_value FROM ranked_metrics m JOIN (VALUES ('roe', 'desc'), ('size', 'asc'))
  d(metric_name, direction) USING (metric_name) GROUP BY 1""", ["ranked_metrics"], ("mean_value",), digits=4)
def rank_catalog(spark, folder):
    r = market.reports(spark, folder).select(
        "security_code", "report_date", (F.col("quarter_profit") / F.col("total_assets")).alias("roe"), F.col("share_capital").alias("size")
    )
    long = tables.unpivot_metrics(r, ["security_code", "report_date"], ["roe", "size"]).where("metric_value is not null")
    directions = tables.rank_catalog(spark, {"roe": "desc", "size": "asc"})
    return long.join(directions, "metric_name").groupBy("rank_direction").agg(F.count(F.lit(1)).alias("n"), F.avg("metric_value").alias("mean_value"))
