"""Scalar functions and filters (P operators)."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.screening_rule import CATALOG, RULE, SIGNALS, signal_base
from tickloom.functions import codes, rules, scalars
from tickloom.plans import rule_tables
from tickloom.sources import market

CODE_CTE = """
SELECT *, upper(substr(code, 1, 2)) AS exch, substr(code, 4, 6) AS digits FROM raw_basics"""


def layouts(spark, folder):
    b = market.raw_basics(spark, folder)
    digits = codes.local_code("code", codes.PREFIX)
    return b.select(
        "code",
        F.concat(digits, F.lit("."), F.substring("code", 1, 2)).alias("suffixed"),
        F.concat(F.substring("code", 1, 2), digits).alias("compact"),
        digits.alias("bare"),
    )


LOCAL_MARKET = """CASE WHEN regexp_matches(digits, '^(600|601|603|605|688|689)[0-9]{3}$') THEN 'SH'
  WHEN regexp_matches(digits, '^(000|001|002|003|300|301)[0-9]{3}$') THEN 'SZ'
  WHEN regexp_matches(digits, '^(43|83|87|88|92)[0-9]{4}$') THEN 'BJ' END"""


@query("P01_normalize_code", f"""
SELECT code, digits || '.' || exch AS from_suffix, digits || '.' || exch AS from_prefix, digits || '.' || exch AS from_compact,
  digits || '.' || {LOCAL_MARKET} AS from_local FROM ({CODE_CTE})""", ["raw_basics"])
def normalize_code(spark, folder):
    return layouts(spark, folder).select(
        "code",
        codes.normalize_code("suffixed", codes.SUFFIX).alias("from_suffix"),
        codes.normalize_code("code", codes.PREFIX).alias("from_prefix"),
        codes.normalize_code("compact", codes.COMPACT).alias("from_compact"),
        codes.normalize_code("bare", codes.LOCAL).alias("from_local"),
    )


@query("P02_local_code", f"""
SELECT code, digits AS from_suffix, digits AS from_prefix, digits AS from_compact, digits AS from_local
FROM ({CODE_CTE})""", ["raw_basics"])
def local_code(spark, folder):
    return layouts(spark, folder).select(
        "code",
        codes.local_code("suffixed", codes.SUFFIX).alias("from_suffix"),
        codes.local_code("code", codes.PREFIX).alias("from_prefix"),
        codes.local_code("compact", codes.COMPACT).alias("from_compact"),
        codes.local_code("bare", codes.LOCAL).alias("from_local"),
    )


@query("P03_exchange_code", f"""
SELECT code, exch AS from_suffix, exch AS from_prefix, exch AS from_compact, {LOCAL_MARKET} AS from_local
FROM ({CODE_CTE})""", ["raw_basics"])
def exchange_code(spark, folder):
    return layouts(spark, folder).select(
        "code",
        codes.exchange_code("suffixed", codes.SUFFIX).alias("from_suffix"),
        codes.exchange_code("code", codes.PREFIX).alias("from_prefix"),
        codes.exchange_code("compact", codes.COMPACT).alias("from_compact"),
        codes.exchange_code("bare", codes.LOCAL).alias("from_local"),
    )


@query("P04_vendor_code", f"""
SELECT code, digits || '.' || exch AS known, NULL::VARCHAR AS unknown FROM ({CODE_CTE})""", ["raw_basics"])
def vendor_code(spark, folder):
    return layouts(spark, folder).select(
        "code", codes.vendor_code("code").alias("known"),
        codes.vendor_code(F.concat(F.lit("xx."), "bare")).alias("unknown"),
    )


@query("P05_decode_security_basic", "SELECT * FROM basics", ["basics"])
def decode_basic(spark, folder):
    return market.basics(spark, folder)


STAGED = """
SELECT substr(code, 4, 6) || '.' || upper(substr(code, 1, 2)) AS security_code, date AS trade_date, open AS open_price,
  high AS high_price, low AS low_price, close AS close_price, preclose AS prev_close_price, volume, amount,
  tradestatus = 0 AS is_suspend, "isST" AS is_st FROM raw_quotes WHERE adjustflag = 3"""
PRICES = ("open_price", "high_price", "low_price", "close_price", "prev_close_price", "volume", "amount")


@query("P06_stage_quotes", STAGED, ["raw_quotes"], PRICES)
def stage_quotes(spark, folder):
    from tickloom.plans.quotes import stage_quotes as stage

    return stage(market.raw_quotes(spark, folder))


@query("P07_rename_select", """
SELECT security_code, report_date, report_type, ytd_profit AS parent_netprofit, total_assets, total_parent_equity, share_capital
FROM reports""", ["reports"], ("parent_netprofit", "total_assets", "total_parent_equity", "share_capital"), digits=3)
def rename_select(spark, folder):
    from tickloom.plans.quotes import STAGING_MAPPINGS, rename_select as rename

    return rename(market.reports(spark, folder), STAGING_MAPPINGS["income_ytd"])


@query("P08_passthrough_mart", """
SELECT security_code, end_date AS change_date, total_shares, unlimited_shares AS float_shares, listed_a_shares AS a_float_shares,
  limited_a_shares FROM equity_history""", ["equity_history"],
    ("total_shares", "float_shares", "a_float_shares", "limited_a_shares"))
def passthrough_mart(spark, folder):
    from tickloom.plans.quotes import MART_MAPPINGS, rename_select as rename

    return rename(market.equity_history(spark, folder), MART_MAPPINGS["share_capital_history"])


@query("P09_universe", """
SELECT 'stock' AS kind, count(*) AS n, min(security_code) AS first_code FROM basics WHERE security_type = 'stock'
UNION ALL SELECT 'index', count(*), min(security_code) FROM basics WHERE security_type = 'index'
UNION ALL SELECT 'benchmark', count(*), min(security_code) FROM basics WHERE security_type = 'index'
  AND security_code IN ('300003.SZ', '000004.SZ', '000300.SH', '600001.SH')""", ["basics"])
def universe(spark, folder):
    b = market.basics(spark, folder)
    parts = {
        "stock": codes.universe(b, "stock"), "index": codes.universe(b, "index"),
        "benchmark": codes.universe(b, "benchmark", ("300003.SZ", "000004.SZ", "000300.SH", "600001.SH")),
    }
    result = None
    for kind, part in parts.items():
        row = part.agg(F.count(F.lit(1)).alias("n"), F.min("security_code").alias("first_code")).withColumn("kind", F.lit(kind))
        result = row if result is None else result.unionByName(row)
    return result


@query("P10_apply_universe", f"""
SELECT security_code, count(*) AS n FROM ({STAGED}) WHERE NOT coalesce(is_st, false) AND NOT coalesce(is_suspend, false)
  AND security_code <> '600001.SH' GROUP BY 1""", ["raw_quotes"])
def apply_universe(spark, folder):
    spec = rules.Universe(exclude_st=True, exclude_suspend=True, exclude=("600001.SH",))
    kept = rules.apply_universe(stage_quotes(spark, folder), spec)
    return kept.groupBy("security_code").agg(F.count(F.lit(1)).alias("n"))


@query("P11_safe_ratio", """
SELECT security_code, report_date, CASE WHEN quarter_profit IS NOT NULL AND total_parent_equity > 0
  THEN quarter_profit / total_parent_equity * 100 END AS ratio,
  CASE WHEN total_assets IS NOT NULL AND quarter_profit > 0 AND total_assets > 0 THEN total_assets / quarter_profit END AS positive_ratio
FROM reports""", ["reports"], ("ratio", "positive_ratio"), digits=4)
def safe_ratio(spark, folder):
    return market.reports(spark, folder).select(
        "security_code", "report_date",
        scalars.safe_ratio("quarter_profit", "total_parent_equity", 100).alias("ratio"),
        scalars.safe_ratio("total_assets", "quarter_profit", require_positive_num=True).alias("positive_ratio"),
    )


@query("P12_price_limits", f"""
SELECT security_code, trade_date, r AS price_limit_ratio, round_even(p * (1 + r) * 100, 0) / 100 AS limit_up_price,
  round_even(p * (1 - r) * 100, 0) / 100 AS limit_down_price FROM (
  SELECT q.security_code, trade_date, CASE WHEN prev_close_price > 0 THEN prev_close_price END AS p,
    CASE WHEN security_board IN ('sse_main_board', 'szse_main_board') THEN CASE WHEN coalesce(is_st, false)
      AND trade_date < DATE '1999-01-01' THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END
      WHEN security_board IN ('star_market', 'chinext') THEN 0.2::DOUBLE END AS r
  FROM ({STAGED}) q JOIN basics b ON q.security_code = b.security_code)""", ["raw_quotes", "basics"],
    ("price_limit_ratio", "limit_up_price", "limit_down_price"), digits=2)
def price_limits(spark, folder):
    q = stage_quotes(spark, folder).join(
        market.basics(spark, folder).select("security_code", "security_board"), "security_code"
    )
    rules_ = scalars.PriceLimitRules(special_change_date="1999-01-01")
    return scalars.price_limits(q, rules_).select(
        "security_code", "trade_date", "price_limit_ratio", "limit_up_price", "limit_down_price"
    )


@query("P13_parse_per_ten", """
SELECT security_code, report_date, l_returnflag_text AS plan_text,
  coalesce(try_cast(nullif(regexp_extract(l_returnflag_text, '10派([0-9]+(?:\\.[0-9]+)?)元', 1), '') AS DOUBLE) / 10, 0) AS cash,
  coalesce(try_cast(nullif(regexp_extract(l_returnflag_text, '10送([0-9]+(?:\\.[0-9]+)?)(?:股)?', 1), '') AS DOUBLE) / 10, 0) AS bonus,
  coalesce(try_cast(nullif(regexp_extract(l_returnflag_text, '10转([0-9]+(?:\\.[0-9]+)?)(?:股)?', 1), '') AS DOUBLE) / 10, 0) AS transfer
FROM (SELECT *, coalesce(nullif(new_profile, ''), nullif(impl_plan_profile, ''), nullif(impl_plan_newprofile, '')) AS l_returnflag_text
  FROM dividend_main)""", ["dividend_main"], ("cash", "bonus", "transfer"), digits=6)
def parse_per_ten(spark, folder):
    text = scalars.first_non_blank("new_profile", "impl_plan_profile", "impl_plan_newprofile")
    return market.dividend_main(spark, folder).select(
        "security_code", "report_date", text.alias("plan_text"),
        *[scalars.parse_per_ten(text, verb).alias(verb) for verb in ("cash", "bonus", "transfer")],
    )


@query("P14_first_non_blank", """
SELECT source, count(*) AS n FROM (SELECT CASE WHEN t = nullif(new_profile, '') THEN 'new' WHEN t = impl_plan_profile THEN 'impl'
  ELSE 'implnew' END AS source FROM (SELECT *, coalesce(nullif(new_profile, ''), nullif(impl_plan_profile, ''),
  nullif(impl_plan_newprofile, '')) AS t FROM dividend_main)) GROUP BY 1""", ["dividend_main"])
def first_non_blank(spark, folder):
    t = scalars.first_non_blank("new_profile", "impl_plan_profile", "impl_plan_newprofile")
    source = F.when(t == F.col("new_profile"), "new").when(t == F.col("impl_plan_profile"), "impl").otherwise("implnew")
    return market.dividend_main(spark, folder).groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("P15_exrights_tag", """
SELECT CASE WHEN c AND r THEN 'DR' WHEN c THEN 'XD' WHEN r THEN 'XR' END AS tag, count(*) AS n FROM (
  SELECT coalesce(impl_plan_profile, '') || new_profile LIKE '%派%' AS c,
    impl_plan_newprofile || new_profile LIKE '%送%' AS r FROM dividend_main) GROUP BY 1""", ["dividend_main"])
def exrights_tag(spark, folder):
    cash = F.concat(F.coalesce("impl_plan_profile", F.lit("")), "new_profile").contains("派")
    right = F.concat("impl_plan_newprofile", "new_profile").contains("送")
    return market.dividend_main(spark, folder).groupBy(scalars.exrights_tag(cash, right).alias("tag")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("P16_record_key", """
SELECT upper(sha256('security_code=' || security_code || '|report_date=' || report_date::VARCHAR || '|impl_plan_profile='
  || coalesce(impl_plan_profile, '<NULL>') || '|is_unassign=' || is_unassign::VARCHAR)) AS record_key, security_code, report_date
FROM dividend_main""", ["dividend_main"])
def record_key(spark, folder):
    key = scalars.record_key(["security_code", "report_date", "impl_plan_profile", "is_unassign"])
    return market.dividend_main(spark, folder).select(key.alias("record_key"), "security_code", "report_date")


@query("P17_daily_rate", """
SELECT work_date, pow(1 + one_year_yield_pct / 100, 1e0 / 252) - 1 AS daily_rate FROM yields""", ["yields"], ("daily_rate",), digits=10)
def daily_rate(spark, folder):
    return market.yields(spark, folder).select("work_date", scalars.daily_rate(F.col("one_year_yield_pct") / 100).alias("daily_rate"))


@query("P18_returns", f"""
SELECT security_code, trade_date, CASE WHEN prev_close_price > 0 THEN close_price / prev_close_price - 1 END AS simple_return,
  CASE WHEN prev_close_price > 0 THEN (close_price - prev_close_price) / prev_close_price * 100 END AS change_pct,
  CASE WHEN prev_close_price > 0 THEN (high_price - low_price) / prev_close_price * 100 END AS amplitude_pct
FROM ({STAGED})""", ["raw_quotes"], ("simple_return", "change_pct", "amplitude_pct"))
def returns(spark, folder):
    return stage_quotes(spark, folder).select(
        "security_code", "trade_date", scalars.simple_return("close_price", "prev_close_price").alias("simple_return"),
        scalars.change_pct("close_price", "prev_close_price").alias("change_pct"),
        scalars.amplitude_pct("high_price", "low_price", "prev_close_price").alias("amplitude_pct"),
    )


@query("P19_date_arithmetic", """
SELECT trade_date, make_date(year(trade_date) - 1, 12, 31) AS year_end, (trade_date - INTERVAL 1 YEAR)::DATE AS anniversary
FROM calendar""", ["calendar"])
def date_arithmetic(spark, folder):
    return market.calendar(spark, folder).select(
        "trade_date", scalars.prior_year_end("trade_date").alias("year_end"), scalars.add_years("trade_date", -1).alias("anniversary")
    )


@query("P20_annualize_ytd", """
SELECT security_code, report_date, CAST(quarter(report_date) AS INT) AS quarter_no, ytd_profit * (4e0 / quarter(report_date)) AS forecast
FROM reports""", ["reports"], ("forecast",), digits=3)
def annualize_ytd(spark, folder):
    return market.reports(spark, folder).select(
        "security_code", "report_date", scalars.quarter_number("report_type").alias("quarter_no"),
        scalars.annualize_ytd("ytd_profit", "report_type").alias("forecast"),
    )


@query("P21_rule_filter", f"""
SELECT security_code, trade_date FROM ({SIGNALS}) WHERE (price_ma_20 > price_ma_60 OR close_price BETWEEN price_ma_20 * 0.9
  AND price_ma_20 * 1.1) AND NOT (volume <= 0.8 * volume_ma_5) AND prev_price_ma_20 IS NOT NULL""", ["bars"])
def rule_filter(spark, folder):
    r = rules
    node = r.All((
        r.Any_((
            r.Compare(r.Ref("price_ma_20"), "gt", r.Ref("price_ma_60")),
            r.Compare(r.Ref("close_price"), "between", r.Between(r.Times(r.Ref("price_ma_20"), 0.9), r.Times(r.Ref("price_ma_20"), 1.1))),
        )),
        r.Not(r.Compare(r.Ref("volume"), "lte", r.Times(0.8, r.Ref("volume_ma_5")))),
        r.Not(r.Compare(r.Ref("prev_price_ma_20"), "is_null")),
    ))
    return signal_base(spark, folder).where(r.rule_filter(node, CATALOG)).select("security_code", "trade_date")


@query("P22_crosses", f"""
SELECT security_code, trade_date, (price_ma_20 > price_ma_60 AND prev_price_ma_20 <= prev_price_ma_60) AS above,
  (close_price < 3000 AND prev_close_price >= 3000) AS below FROM ({SIGNALS})""", ["bars"])
def crosses(spark, folder):
    above = rules.Compare(rules.Ref("price_ma_20"), "crosses_above", rules.Ref("price_ma_60"))
    below = rules.Compare(rules.Ref("close_price"), "crosses_below", 3000.0)
    return signal_base(spark, folder).select(
        "security_code", "trade_date", rules.rule_filter(above, CATALOG).alias("above"), rules.rule_filter(below, CATALOG).alias("below")
    )


SCORE = """greatest(0e0, least(100e0, CASE WHEN price_ma_20 > price_ma_60 THEN 40e0 ELSE 0e0 END
  + CASE WHEN volume > 1.5 * volume_ma_5 THEN 25e0 ELSE 0e0 END + coalesce(volume, 0) * 0.5e0))"""


@query("P23_rule_score", f"SELECT security_code, trade_date, {SCORE} AS score FROM ({SIGNALS})", ["bars"], ("score",))
def rule_score(spark, folder):
    return signal_base(spark, folder).select("security_code", "trade_date", rules.rule_score(RULE, CATALOG).alias("score"))


@query("P24_rule_json", f"""
SELECT security_code, trade_date, CASE WHEN price_ma_20 > price_ma_60 THEN 40e0 ELSE 0e0 END AS trend,
  coalesce(volume, 0) * 0.5e0 AS weight FROM ({SIGNALS})""", ["bars"], ("trend", "weight"))
def rule_json(spark, folder):
    detail = signal_base(spark, folder).select("security_code", "trade_date", rules.rule_json(RULE, CATALOG)["score_breakdown"].alias("j"))
    parsed = F.from_json("j", "map<string, double>")
    return detail.select("security_code", "trade_date", parsed["trend"].alias("trend"), parsed["volume_weight"].alias("weight"))


def rule_grid() -> dict[str, rules.Rule]:
    """The shared rule, variants of it, and rules with one fault each."""
    from dataclasses import replace

    r = rules
    both = r.Any_((r.Compare(r.Ref("price_ma_20"), "lt", r.Ref("price_ma_60")), r.Not(r.Compare(r.Ref("close_price"), "between", r.Between(r.Times(r.Ref("price_ma_20"), 0.9), r.Times(1.1, r.Ref("price_ma_20")))))))
    return {
        "shared": RULE, "reversal": r.Rule(both, (r.Weighted("size", "volume", 0.25), r.Points("cross", r.Compare(r.Ref("close_price"), "crosses_below", r.Ref("price_ma_20")), 30)), clamp=(5, 60)),
        "no_average": r.Rule(r.Compare(r.Ref("price_ma_60"), "is_null")), "bad_metric": replace(RULE, outputs=("unheard_of",)), "bad_top": replace(RULE, top_n=0),
        "bad_clamp": replace(RULE, clamp=(50, 10)), "bad_cross": r.Rule(r.Compare(r.Ref("volume"), "crosses_above", r.Ref("volume_ma_5"))), "bad_kind": r.Rule(r.Compare(r.Ref("volume"), "gt", "many")),
    }


RULE_HITS = f"""
SELECT 'shared' AS rule_id, security_code, trade_date, {SCORE} AS score FROM ({SIGNALS}) WHERE price_ma_20 > price_ma_60 AND prev_price_ma_20 <= prev_price_ma_60 AND volume > 0.8 * volume_ma_5
UNION ALL SELECT 'reversal', security_code, trade_date, greatest(5e0, least(60e0, coalesce(volume, 0) * 0.25e0 + CASE WHEN close_price < price_ma_20 AND prev_close_price >= prev_price_ma_20 THEN 30e0 ELSE 0e0 END))
FROM ({SIGNALS}) WHERE price_ma_20 < price_ma_60 OR NOT (close_price BETWEEN price_ma_20 * 0.9e0 AND price_ma_20 * 1.1e0)
UNION ALL SELECT 'no_average', security_code, trade_date, 0e0 FROM ({SIGNALS}) WHERE price_ma_60 IS NULL"""


@query("P21_rules_as_rows", RULE_HITS, ["bars"], ("score",))
def rules_as_rows(spark, folder):
    """Hits and scores (P23) of all valid rules of a table of rules."""
    tables_ = rule_tables.tables_of(spark, rule_grid(), CATALOG)
    return rule_tables.screen_all(signal_base(spark, folder), tables_).select("rule_id", "security_code", "trade_date", "score")


@query("P25_validate_rule", f"""
SELECT rule_id, reason IS NULL AS valid, reason, place, coalesce(n, 0) AS hits FROM (VALUES ('shared', NULL, NULL), ('reversal', NULL, NULL), ('no_average', NULL, NULL),
  ('bad_metric', 'unknown_output', 'unheard_of'), ('bad_top', 'top_n_not_positive', 'top_n'), ('bad_clamp', 'clamp_out_of_range', 'clamp'),
  ('bad_cross', 'no_previous_metric', 'filter'), ('bad_kind', 'kinds_differ', 'filter')) v(rule_id, reason, place)
LEFT JOIN (SELECT rule_id, count(*) AS n FROM ({RULE_HITS}) GROUP BY 1) USING (rule_id)""", ["bars"])
def validate_rule(spark, folder):
    """Verdict of every rule, checked against the catalog as a job, and the rows that the valid ones accept."""
    tables_ = rule_tables.tables_of(spark, rule_grid(), CATALOG)
    hits = rule_tables.screen_all(signal_base(spark, folder), tables_).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    verdicts = rule_tables.rule_verdicts(tables_).join(hits, "rule_id", "left")
    return verdicts.select("rule_id", "valid", "reason", "place", F.coalesce("n", F.lit(0)).alias("hits"))


@query("P26_select_ohlc", """
SELECT security_code, trade_date, CASE WHEN w THEN open_price END AS open, CASE WHEN w THEN high_price END AS high,
  CASE WHEN w THEN low_price END AS low, CASE WHEN w THEN close_price END AS close FROM (
  SELECT *, open_price IS NOT NULL AND high_price IS NOT NULL AND low_price IS NOT NULL AND close_price IS NOT NULL AS w FROM gap_bars)""",
    ["gap_bars"], ("open", "high", "low", "close"))
def select_ohlc(spark, folder):
    return scalars.select_ohlc(market.gap_bars(spark, folder)).select("security_code", "trade_date", "open", "high", "low", "close")


@query("P27_trade_costs", """
SELECT *, commission + stamp_duty + transfer_fee AS total_fee FROM (
  SELECT run_id, security_code, trade_date, trade_seq, p AS execution_price, p * quantity AS gross_amount,
    greatest(p * quantity * 0.0003::DOUBLE, 5e0) AS commission,
    CASE WHEN side = 'sell' THEN p * quantity * 0.0005::DOUBLE ELSE 0e0 END AS stamp_duty, p * quantity * 0.00001::DOUBLE AS transfer_fee,
    abs(p - execution_price) * quantity AS slippage_cost
  FROM (SELECT *, execution_price * CASE WHEN side = 'sell' THEN 1e0 - 0.0005::DOUBLE ELSE 1e0 + 0.0005::DOUBLE END AS p FROM trades))""",
    ["trades"], ("execution_price", "gross_amount", "commission", "stamp_duty", "transfer_fee", "slippage_cost", "total_fee"))
def trade_costs(spark, folder):
    t = market.trades(spark, folder).withColumnRenamed("execution_price", "reference_price").drop("gross_amount", "total_fee")
    return scalars.trade_costs(t).select(
        "run_id", "security_code", "trade_date", "trade_seq", "execution_price", "gross_amount", "commission", "stamp_duty",
        "transfer_fee", "slippage_cost", "total_fee",
    )


@query("P28_floor_to_lot", """
SELECT security_code, trade_date, amount, greatest(floor(amount / 300) * 300, 0)::DOUBLE AS lots FROM bars""", ["bars"], ("amount", "lots"))
def floor_to_lot(spark, folder):
    return market.bars(spark, folder).select("security_code", "trade_date", "amount", scalars.floor_to_lot("amount", 300).alias("lots"))


@query("P29_target_weight", """
SELECT p_partkey, least((1 - p_size / 100e0) / (p_partkey % 9 + 1), p_size / 200e0) AS weight FROM part""", (), ("weight",), digits=8)
def target_weight(spark, folder):
    part = market.table(spark, folder, "part")
    return part.select(
        "p_partkey",
        scalars.target_weight(F.col("p_size") / 100.0, F.col("p_partkey") % 9 + 1, F.col("p_size") / 200.0).alias("weight"),
    )
