"""The market tables of ``tickloom.sources.market`` as SQL, for the side-by-side checks."""

from __future__ import annotations

from collections.abc import Sequence

CODE = (
    "(CASE CAST({k} % 4 AS INT) WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300' ELSE '688' END"
    " || printf('%03d', {k} // 4) || CASE WHEN {k} % 4 IN (0, 3) THEN '.SH' ELSE '.SZ' END)"
)


def code(key: str) -> str:
    return CODE.format(k=key)


STEP = 0.5137


def shown_sql(column: str, digits: int) -> str:
    """The rounding of ``registry.rounded`` in SQL; plain double arithmetic, the same bits."""
    return f'(floor("{column}" * 1e{digits} + {STEP}e0) / 1e{digits})'


QEND = "last_day(date_trunc('quarter', {d})::DATE + INTERVAL 2 MONTH)"

# name -> (tables it reads, SQL)
TABLES: dict[str, tuple[Sequence[str], str]] = {}


def define(name: str, sql: str, uses: Sequence[str] = ()) -> None:
    TABLES[name] = (uses, sql)


def compose(sql: str, uses: Sequence[str]) -> str:
    """``sql`` with the tables it uses as leading CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in TABLES[name][0]:
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        add(name)
    if not ordered:
        return sql
    parts = ",\n".join(f"{name} AS ({TABLES[name][1]})" for name in ordered)
    text = sql.strip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(word):
            return f"{word}{parts},\n{text[len(word):]}"
    return f"WITH {parts}\n{text}"


define("executions", f"""
SELECT {code('l_suppkey')} AS security_code, l_shipdate::DATE AS trade_date, l_orderkey, l_linenumber, l_partkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem""")
define("bars", """
SELECT security_code, trade_date,
  arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS open_price,
  max(l_extendedprice / l_quantity) AS high_price, min(l_extendedprice / l_quantity) AS low_price,
  arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS close_price,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, max(l_discount) AS top_discount
FROM executions GROUP BY ALL""", ["executions"])
define("gap_bars", """
SELECT security_code, trade_date, CASE WHEN volume >= 8 THEN open_price END AS open_price,
  CASE WHEN volume >= 8 THEN high_price END AS high_price, CASE WHEN volume >= 8 THEN low_price END AS low_price,
  CASE WHEN volume >= 8 THEN close_price END AS close_price, volume, amount FROM bars""", ["bars"])
define("raw_quotes", """
SELECT lower(substr(security_code, 8, 2)) || '.' || substr(security_code, 1, 6) AS code, trade_date AS date,
  open_price AS open, high_price AS high, low_price AS low, close_price AS close,
  floor(lag(close_price) OVER (PARTITION BY security_code ORDER BY trade_date)
    * CASE WHEN volume > 40 THEN 0.98::DOUBLE ELSE 1.0::DOUBLE END * 1e2 + 5e-1) / 1e2 AS preclose,
  volume, amount, 3 AS adjustflag, CASE WHEN volume < 8 THEN 0 ELSE 1 END AS tradestatus,
  top_discount >= 0.1 AS "isST" FROM bars""", ["bars"])
define("calendar", "SELECT DISTINCT trade_date FROM executions", ["executions"])
define("trade_days", """
SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev_trade_date,
  lead(trade_date) OVER (ORDER BY trade_date) AS next_trade_date,
  row_number() OVER (ORDER BY trade_date) AS day_no FROM calendar""", ["calendar"])
define("raw_basics", f"""
SELECT lower(substr(c, 8, 2)) || '.' || substr(c, 1, 6) AS code, s_name AS code_name,
  DATE '1994-01-01' + CAST(s_suppkey % 900 AS INT) AS "ipoDate",
  CASE WHEN s_suppkey % 11 = 10 THEN DATE '2000-01-01' + CAST(s_suppkey % 300 AS INT) END AS "outDate",
  CASE WHEN s_nationkey % 5 = 4 THEN 2 WHEN s_nationkey % 7 = 6 THEN 5 ELSE 1 END AS type,
  CASE WHEN s_suppkey % 11 = 10 THEN 0 ELSE 1 END AS status
FROM (SELECT *, {code('s_suppkey')} AS c FROM supplier)""")
define("basics", """
SELECT substr(code, 4, 6) || '.' || upper(substr(code, 1, 2)) AS security_code, substr(code, 4, 6) AS security_local_code,
  upper(substr(code, 1, 2)) AS exchange_code, trim(code_name) AS security_name, "ipoDate" AS ipo_date,
  "outDate" AS out_date, type AS security_type_code,
  CASE type WHEN 1 THEN 'stock' WHEN 2 THEN 'index' WHEN 3 THEN 'other' WHEN 4 THEN 'convertible_bond' WHEN 5 THEN 'etf'
    ELSE 'unknown' END AS security_type,
  CASE WHEN type = 1 AND code LIKE 'sh.68%' THEN 'star_market'
    WHEN type = 1 AND regexp_matches(code, '^sh\\.(600|601|603|605)') THEN 'sse_main_board'
    WHEN type = 1 AND code LIKE 'sz.30%' THEN 'chinext'
    WHEN type = 1 AND regexp_matches(code, '^sz\\.(000|001|002|003)') THEN 'szse_main_board' END AS security_board,
  status AS listing_status_code, CASE status WHEN 1 THEN 'listed' WHEN 0 THEN 'delisted' ELSE 'unknown' END AS listing_status,
  status = 1 AS is_listed FROM raw_basics""", ["raw_basics"])
define("equity_history", """
SELECT security_code, last_day(trade_date) AS end_date, sum(l_quantity) * 1000 AS total_shares,
  sum(l_quantity) * 800 AS unlimited_shares,
  sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity * 700 END) AS listed_a_shares,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity * 300 END) AS limited_a_shares
FROM executions GROUP BY ALL""", ["executions"])
define("freeholders", f"""
SELECT security_code, {QEND.format(d='trade_date')} AS report_date, l_returnflag || l_linestatus AS holder_identifier,
  'holder ' || l_returnflag AS holder_name, CASE WHEN l_linestatus = 'F' THEN 'A股' ELSE 'B股' END AS shares_type,
  l_quantity * 100 AS free_float_hold_shares, l_quantity / 5 AS free_float_holdnum_ratio_pct
FROM executions""", ["executions"])
define("dividend_groups", f"""
SELECT security_code, {QEND.format(d='trade_date')} AS report_date, l_returnflag, min(trade_date) AS first_day,
  max(trade_date) AS last_day, max(l_linenumber) AS n, CAST(max(l_quantity) AS INT) AS q
FROM executions GROUP BY ALL""", ["executions"])
define("dividend_main", """
SELECT security_code, 'name ' || substr(security_code, 1, 6) AS security_name_abbr, last_day + 20 AS notice_date,
  year(report_date) || 'Q' || quarter(report_date) AS report_period_label, report_date,
  CASE WHEN n >= 3 THEN '实施方案' ELSE '预案' END AS assign_progress, q < 10 AS is_unassign,
  CASE WHEN l_returnflag = 'A' THEN '10派' || CAST(CAST(q / 4 AS DECIMAL(8, 2)) AS VARCHAR) || '元' END AS impl_plan_profile,
  CASE WHEN l_returnflag = 'N' THEN '10送' || n || '股' || '10转' || (n + 1) || '股' ELSE '' END AS impl_plan_newprofile,
  CASE WHEN l_returnflag = 'R' THEN '10送' || n || '股' || '10派' || CAST(CAST(q / 4 AS DECIMAL(8, 2)) AS VARCHAR) || '元'
    ELSE '' END AS new_profile,
  last_day + 30 AS equity_record_date, CASE WHEN q % 9 <> 0 THEN last_day + 31 END AS ex_dividend_date
FROM dividend_groups""", ["dividend_groups"])
define("dividend_allotment", """
SELECT security_code, last_day + 20 AS notice_date, last_day + 30 AS equity_record_date, last_day + 31 AS ex_dividend_date,
  '每10股配' || n || '股' AS event_explain, q / 5 AS issue_price
FROM (SELECT security_code, max(trade_date) AS last_day, max(l_linenumber) AS n, max(l_quantity) AS q
  FROM executions GROUP BY security_code, year(trade_date))""", ["executions"])
define("reports", f"""
SELECT *, sum(quarter_profit) OVER (PARTITION BY security_code, year(report_date) ORDER BY report_date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ytd_profit FROM (
  SELECT *, CASE quarter(report_date) WHEN 1 THEN '一季报' WHEN 2 THEN '中报' WHEN 3 THEN '三季报' ELSE '年报' END AS report_type
  FROM (SELECT security_code, {QEND.format(d='trade_date')} AS report_date,
    sum(l_extendedprice * (l_discount - l_tax + 0.01)) AS quarter_profit, sum(l_extendedprice) AS total_assets,
    sum(l_extendedprice * (1 - l_discount * 11)) AS total_parent_equity, sum(l_quantity) AS share_capital
    FROM executions GROUP BY ALL))""", ["executions"])
define("yields", """
SELECT work_date, 'treasury' AS curve_name, CASE WHEN n % 7 <> 0 THEN floor((1 + p / 249999.7e0) * 1e4 + 5e-1) / 1e4 END AS one_year_yield_pct
FROM (SELECT o_orderdate::DATE AS work_date, avg(o_totalprice) AS p, count(*) AS n FROM orders GROUP BY 1)""")
define("benchmark_returns", """
SELECT o_orderdate::DATE AS trade_date, floor((avg(o_totalprice) / 249999.7e0 - 1) / 20 * 1e6 + 5e-1) / 1e6 AS return_daily
FROM orders GROUP BY 1""")
define("trades", """
SELECT *, gross_amount / quantity AS execution_price,
  CASE side WHEN 'sell' THEN 'time_stop_loss' ELSE 'signal' END AS reason FROM (
  SELECT l_returnflag AS run_id, l_returnflag || '-1' AS attempt_id, security_code, trade_date,
    date_diff('day', DATE '1990-01-01', trade_date)::BIGINT * 281474976710656 + (l_orderkey * 8 + l_linenumber) * 2 + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS trade_seq,
    CASE l_linestatus WHEN 'O' THEN 'sell' ELSE 'buy' END AS side, sum(l_quantity) AS quantity,
    sum(l_extendedprice) AS gross_amount, floor(sum(l_extendedprice * l_tax) / 99.97e0 * 1e4 + 5e-1) / 1e4 AS total_fee
  FROM executions GROUP BY ALL)""", ["executions"])
define("nav_daily", """
SELECT run_id, run_id || '-1' AS attempt_id, trade_date, nav * 1000000 AS total_equity, nav,
  CASE WHEN rn > 1 THEN r END AS daily_return,
  nav / max(nav) OVER (PARTITION BY run_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown,
  gross_exposure, position_count, fee_amount FROM (
  SELECT *, exp(sum(CASE WHEN rn > 1 THEN ln(1 + r) ELSE 0 END)
    OVER (PARTITION BY run_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS nav FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY trade_date) AS rn FROM (
      SELECT run_id, trade_date, floor(((d - t) / n - 1e0) / 500.03e0 * 1e6 + 5e-1) / 1e6 AS r, n AS position_count,
        t / 100e0 AS fee_amount, floor(d / n * 0.080003e0 * 1e6 + 5e-1) / 1e6 AS gross_exposure FROM (
        SELECT l_returnflag AS run_id, trade_date, sum(CAST(round(l_discount * 100) AS BIGINT))::BIGINT AS d,
          sum(CAST(round(l_tax * 100) AS BIGINT))::BIGINT AS t, count(*) AS n FROM executions GROUP BY ALL))))""", ["executions"])
