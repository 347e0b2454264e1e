"""Market tables derived from the given star-schema tables.

``lineitem`` is read as executions: the supplier is the security, the ship date the trading day,
extended price over quantity the price. Each function is a plain aggregation or projection over a
whole table, so its work grows with the data; ``bars`` and everything downstream hold one row per
security and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import codes

def by_day():
    return Window.partitionBy("security_code").orderBy("trade_date")


def fixed(c: Column, digits: int) -> Column:
    """Half-up rounding by plain double arithmetic, the same bits in every engine."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_code(key: Column) -> Column:
    """Prefix-layout code of a supplier key: number range by key modulo 4."""
    turn = key % 4
    market = F.when(turn.isin(0, 3), "sh.").otherwise("sz.")
    start = F.when(turn == 0, "600").when(turn == 1, "000").when(turn == 2, "300").otherwise("688")
    number = F.shiftright(key, 2)
    digits = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    return F.concat(market, start, digits)


def security_code(key: Column) -> Column:
    return codes.normalize_code(raw_code(key), codes.PREFIX)


def executions(spark, folder) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.select(
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("trade_date"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )


def bars(spark, folder) -> DataFrame:
    """Daily bars: open and close are the first and last execution of the day."""
    x = executions(spark, folder)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    daily = x.groupBy("l_suppkey", "trade_date").agg(
        F.min_by(price, seq).alias("open_price"),
        F.max(price).alias("high_price"),
        F.min(price).alias("low_price"),
        F.max_by(price, seq).alias("close_price"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
        F.max("l_discount").alias("top_discount"),
    )
    return daily.select(security_code(F.col("l_suppkey")).alias("security_code"), *daily.columns[1:])


def gap_bars(spark, folder) -> DataFrame:
    """Bars where a thin day has no prices: NULLs inside the series."""
    thin = F.col("volume") < 8
    b = bars(spark, folder)
    return b.select(
        "security_code", "trade_date",
        *[F.when(~thin, F.col(c)).alias(c) for c in ("open_price", "high_price", "low_price", "close_price")],
        "volume", "amount",
    )


def raw_quotes(spark, folder) -> DataFrame:
    """Quotes as a vendor would send them, with a reported previous close that shows ex-rights days."""
    b = bars(spark, folder)
    shift = F.when(F.col("volume") > 40, 0.98).otherwise(1.0)
    code = F.col("security_code")
    return b.select(
        F.concat(F.lower(codes.exchange_code(code)), F.lit("."), codes.local_code(code)).alias("code"),
        F.col("trade_date").alias("date"),
        F.col("open_price").alias("open"), F.col("high_price").alias("high"),
        F.col("low_price").alias("low"), F.col("close_price").alias("close"),
        fixed(F.lag("close_price").over(by_day()) * shift, 2).alias("preclose"),
        "volume", "amount",
        F.lit(3).alias("adjustflag"),
        F.when(F.col("volume") < 8, 0).otherwise(1).alias("tradestatus"),
        (F.col("top_discount") >= 0.1).alias("isST"),
    )


def calendar(spark, folder) -> DataFrame:
    return executions(spark, folder).select("trade_date").distinct()


def raw_basics(spark, folder) -> DataFrame:
    """Security basics in the prefix layout; every fifth nation lists indexes, every seventh funds."""
    s = table(spark, folder, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return s.select(
        raw_code(key).alias("code"),
        F.col("s_name").alias("code_name"),
        F.date_add(F.lit("1994-01-01").cast("date"), (key % 900).cast("int")).alias("ipoDate"),
        F.when(key % 11 == 10, F.date_add(F.lit("2000-01-01").cast("date"), (key % 300).cast("int"))).alias("outDate"),
        F.when(nation % 5 == 4, 2).when(nation % 7 == 6, 5).otherwise(1).alias("type"),
        F.when(key % 11 == 10, 0).otherwise(1).alias("status"),
    )


def basics(spark, folder) -> DataFrame:
    return codes.decode_security_basic(raw_basics(spark, folder))


def month_end(c: Column) -> Column:
    return F.last_day(c)


def quarter_end(c: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(c, "quarter"), 2))


def equity_history(spark, folder) -> DataFrame:
    """Share counts per security and month of filing."""
    x = executions(spark, folder)
    return x.groupBy(
        security_code(F.col("l_suppkey")).alias("security_code"), month_end(F.col("trade_date")).alias("end_date")
    ).agg(
        (F.sum("l_quantity") * 1000).alias("total_shares"),
        (F.sum("l_quantity") * 800).alias("unlimited_shares"),
        F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * 700)).alias("listed_a_shares"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 300)).alias("limited_a_shares"),
    )


def freeholders(spark, folder) -> DataFrame:
    """Top holders per security and quarter, with repeated filings."""
    x = executions(spark, folder)
    return x.select(
        security_code(F.col("l_suppkey")).alias("security_code"),
        quarter_end(F.col("trade_date")).alias("report_date"),
        F.concat("l_returnflag", "l_linestatus").alias("holder_identifier"),
        F.concat(F.lit("holder "), "l_returnflag").alias("holder_name"),
        F.when(F.col("l_linestatus") == "F", "A股").otherwise("B股").alias("shares_type"),
        (F.col("l_quantity") * 100).alias("free_float_hold_shares"),
        (F.col("l_quantity") / 5).alias("free_float_holdnum_ratio_pct"),
    )


def dividend_main(spark, folder) -> DataFrame:
    """Dividend plans: one text per execution batch of a security and quarter."""
    x = executions(spark, folder)
    g = x.groupBy(
        security_code(F.col("l_suppkey")).alias("security_code"),
        quarter_end(F.col("trade_date")).alias("report_date"), "l_returnflag",
    ).agg(
        F.min("trade_date").alias("first_day"), F.max("trade_date").alias("last_day"),
        F.max("l_linenumber").alias("n"), F.max("l_quantity").cast("int").alias("q"),
    )
    cash = F.concat(F.lit("10派"), (F.col("q") / 4).cast("decimal(8,2)").cast("string"), F.lit("元"))
    bonus = F.concat(F.lit("10送"), F.col("n").cast("string"), F.lit("股"))
    transfer = F.concat(F.lit("10转"), (F.col("n") + 1).cast("string"), F.lit("股"))
    return g.select(
        "security_code",
        F.concat(F.lit("name "), F.substring("security_code", 1, 6)).alias("security_name_abbr"),
        F.date_add("last_day", 20).alias("notice_date"),
        F.concat(F.year("report_date").cast("string"), F.lit("Q"), F.quarter("report_date").cast("string")).alias("report_period_label"),
        "report_date",
        F.when(F.col("n") >= 3, "实施方案").otherwise("预案").alias("assign_progress"),
        (F.col("q") < 10).alias("is_unassign"),
        F.when(F.col("l_returnflag") == "A", cash).alias("impl_plan_profile"),
        F.when(F.col("l_returnflag") == "N", F.concat(bonus, transfer)).otherwise(F.lit("")).alias("impl_plan_newprofile"),
        F.when(F.col("l_returnflag") == "R", F.concat(bonus, cash)).otherwise(F.lit("")).alias("new_profile"),
        F.date_add("last_day", 30).alias("equity_record_date"),
        F.when(F.col("q") % 9 != 0, F.date_add("last_day", 31)).alias("ex_dividend_date"),
    )


def dividend_allotment(spark, folder) -> DataFrame:
    x = executions(spark, folder)
    g = x.groupBy(
        security_code(F.col("l_suppkey")).alias("security_code"), F.trunc("trade_date", "year").alias("y")
    ).agg(
        F.max("trade_date").alias("last_day"), F.max("l_linenumber").alias("n"),
        F.max("l_quantity").alias("q"),
    )
    return g.select(
        "security_code",
        F.date_add("last_day", 20).alias("notice_date"),
        F.date_add("last_day", 30).alias("equity_record_date"),
        F.date_add("last_day", 31).alias("ex_dividend_date"),
        F.concat(F.lit("每10股配"), F.col("n").cast("string"), F.lit("股")).alias("event_explain"),
        (F.col("q") / 5).alias("issue_price"),
    )


def reports(spark, folder) -> DataFrame:
    """Quarterly statement items per security."""
    x = executions(spark, folder)
    g = x.groupBy(
        security_code(F.col("l_suppkey")).alias("security_code"), quarter_end(F.col("trade_date")).alias("report_date")
    ).agg(
        F.sum(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax") + 0.01)).alias("quarter_profit"),
        F.sum("l_extendedprice").alias("total_assets"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount") * 11)).alias("total_parent_equity"),
        F.sum("l_quantity").alias("share_capital"),
    )
    word = (
        F.when(F.quarter("report_date") == 1, "一季报").when(F.quarter("report_date") == 2, "中报")
        .when(F.quarter("report_date") == 3, "三季报").otherwise("年报")
    )
    ytd = Window.partitionBy("security_code", F.year("report_date")).orderBy("report_date").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return g.select(
        "*", word.alias("report_type"), F.sum("quarter_profit").over(ytd).alias("ytd_profit")
    )


def yields(spark, folder) -> DataFrame:
    """One-year yield per order day, in percent, with days that have none."""
    o = table(spark, folder, "orders")
    g = o.groupBy(F.col("o_orderdate").cast("date").alias("work_date")).agg(
        F.avg("o_totalprice").alias("p"), F.count(F.lit(1)).alias("n")
    )
    return g.select(
        "work_date", F.lit("treasury").alias("curve_name"),
        F.when(F.col("n") % 7 != 0, fixed(1 + F.col("p") / 249999.7, 4)).alias("one_year_yield_pct"),
    )


def benchmark_returns(spark, folder) -> DataFrame:
    """Daily benchmark return from the order book; order days only."""
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_orderdate").cast("date").alias("trade_date")).agg(
        fixed((F.avg("o_totalprice") / 249999.7 - 1) / 20, 6).alias("return_daily")
    )


def trades(spark, folder) -> DataFrame:
    """Trade ledger of one run per return flag; an execution of a day is one trade."""
    x = executions(spark, folder)
    selling = F.col("l_linestatus") == "O"
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2 + F.when(selling, 1).otherwise(0)
    # Later days have higher numbers; a line number alone repeats over days.
    seq = F.date_diff("trade_date", F.lit("1990-01-01").cast("date")).cast("long") * (1 << 48) + line
    return x.groupBy(
        F.col("l_returnflag").alias("run_id"),
        F.concat("l_returnflag", F.lit("-1")).alias("attempt_id"),
        security_code(F.col("l_suppkey")).alias("security_code"),
        "trade_date",
        seq.alias("trade_seq"),
        F.when(selling, "sell").otherwise("buy").alias("side"),
    ).agg(
        F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("gross_amount"),
        fixed(F.sum(F.col("l_extendedprice") * F.col("l_tax")) / 99.97, 4).alias("total_fee"),
    ).withColumn("execution_price", F.col("gross_amount") / F.col("quantity")).withColumn(
        "reason", F.when(F.col("side") == "sell", "time_stop_loss").otherwise("signal")
    )


def nav_daily(spark, folder) -> DataFrame:
    """NAV facts of one run per return flag and day."""
    x = executions(spark, folder)
    def hundredths(c: str) -> Column:
        return F.sum(F.round(F.col(c) * 100).cast("long"))

    sums = x.groupBy(F.col("l_returnflag").alias("run_id"), "trade_date").agg(
        hundredths("l_discount").alias("d"), hundredths("l_tax").alias("t"), F.count(F.lit(1)).alias("position_count")
    )
    n = F.col("position_count")
    daily = sums.select(
        "run_id", "trade_date", "position_count",
        fixed(((F.col("d") - F.col("t")) / n - 1.0) / 500.03, 6).alias("r"),
        (F.col("t") / 100.0).alias("fee_amount"),
        fixed(F.col("d") / n * 0.080003, 6).alias("gross_exposure"),
    )
    by_run = Window.partitionBy("run_id").orderBy("trade_date")
    up_to = by_run.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(by_run) == 1
    grown = daily.withColumn("_first", first)
    growth = F.exp(F.sum(F.when(F.col("_first"), 0.0).otherwise(F.log1p("r"))).over(up_to))
    nav = grown.select("*", growth.alias("nav"))
    peak = F.max("nav").over(up_to)
    return nav.select(
        "run_id", F.concat("run_id", F.lit("-1")).alias("attempt_id"), "trade_date",
        (F.col("nav") * 1000000).alias("total_equity"), "nav",
        F.when(~F.col("_first"), F.col("r")).alias("daily_return"),
        (F.col("nav") / peak - 1).alias("drawdown"),
        "gross_exposure", "position_count", "fee_amount",
    )
