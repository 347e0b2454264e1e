"""Readers, writers and incremental runs (S and C operators). Written tables go to the shared folder."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.scalar_queries import PRICES
from tickloom.operators import indicators as ind
from tickloom.operators import tables
from tickloom.plans import quotes
from tickloom.session import scratch_path
from tickloom.sources import contracts, io, market, versions
from tickloom.streaming import incremental as inc

KEY = ["security_code", "trade_date"]


def staged(spark, folder):
    return quotes.stage_quotes(market.raw_quotes(spark, folder))


@query("S01_read_snapshot", "SELECT * FROM basics", ["basics"])
def read_snapshot(spark, folder):
    b = market.basics(spark, folder)
    path = scratch_path(spark, "basics")
    io.write_snapshot(b, path)
    return io.read_snapshot(spark, path, contracts.contract_of(b, "basics"))


def yearly_quotes(spark, folder):
    path = scratch_path(spark, "quotes")
    counts = io.write_partitioned(staged(spark, folder).withColumn("year", F.year("trade_date")), path, "year", KEY)
    return path, counts


@query("S02_read_partitions", """
SELECT y AS year, count(trade_date) AS row_count, CASE WHEN count(trade_date) > 0 THEN 'read' ELSE 'missing' END AS status
FROM (VALUES (1996), (1998), (2050)) v(y) LEFT JOIN quotes ON year(trade_date) = y GROUP BY 1""", ["quotes"])
def read_partitions(spark, folder):
    path, _ = yearly_quotes(spark, folder)
    return io.read_partitions(spark, path, "year", [1996, 1998, 2050])[1]


@query("S03_existing_partitions", "SELECT DISTINCT year(trade_date)::INT AS year FROM quotes", ["quotes"])
def existing_partitions(spark, folder):
    path, _ = yearly_quotes(spark, folder)
    return io.existing_partitions(spark.read.parquet(path), "year")


@query("S04_write_snapshot", "SELECT * FROM equity_history", ["equity_history"],
    ("total_shares", "unlimited_shares", "listed_a_shares", "limited_a_shares"))
def write_snapshot(spark, folder):
    path = scratch_path(spark, "equity")
    io.write_snapshot(market.equity_history(spark, folder), path)
    return spark.read.parquet(path)


@query("S05_write_partitioned", "SELECT year(trade_date)::INT AS year, count(*) AS row_count FROM quotes GROUP BY 1", ["quotes"])
def write_partitioned(spark, folder):
    return yearly_quotes(spark, folder)[1]


def written_once(df, spark):
    """``df`` on files, for a query that reads it once per year."""
    path = scratch_path(spark, "source")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query("S06_sync_year", """
SELECT year(trade_date)::INT AS year, count(*) AS n, sum(volume) AS volume FROM quotes GROUP BY 1""", ["quotes"], ("volume",))
def sync_year(spark, folder):
    q = staged(spark, folder)
    contract = contracts.contract_of(q, "quotes", grain=tuple(KEY), order_by=tuple(KEY))
    path = scratch_path(spark, "raw-quotes")
    q = written_once(q, spark)
    for year in [r.year for r in q.select(F.year("trade_date").alias("year")).distinct().collect()]:
        io.sync_year(q.where(F.year("trade_date") == year), path, year, contract, "trade_date")
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


@query("S07_sync_snapshot", "SELECT security_code, security_type, is_listed FROM basics", ["basics"])
def sync_snapshot(spark, folder):
    b = market.basics(spark, folder).select("security_code", "security_type", "is_listed")
    path = scratch_path(spark, "basics-sync")
    contract = contracts.contract_of(b, "basics", grain=("security_code",))
    for _ in range(2):  # the second run replaces the first
        io.sync_snapshot(b, path, contract)
    return versions.read_published(spark, path)


@query("S08_reconcile_schema", """
SELECT security_code, trade_date, volume::BIGINT AS volume, close_price, is_st::INT AS is_st FROM quotes""", ["quotes"], ("close_price",))
def reconcile_schema(spark, folder):
    fields = (("security_code", "string"), ("trade_date", "date"), ("volume", "bigint"), ("close_price", "double"), ("is_st", "int"))
    contract = contracts.DatasetContract("quotes", tuple(contracts.Column(n, t) for n, t in fields))
    return contracts.reconcile_schema(staged(spark, folder), contract)


@query("S09_compact_year", "SELECT *, 1998 AS year FROM quotes WHERE year(trade_date) = 1998", ["quotes"], PRICES)
def compact_year(spark, folder):
    q = staged(spark, folder)
    contract = contracts.contract_of(q, "quotes")
    return io.compact_year(q, market.calendar(spark, folder), 1998, contract, KEY, KEY)


@query("S10_blank_to_null", """
SELECT nullif(impl_plan_newprofile, '') IS NULL AS no_new, nullif(new_profile, '') IS NULL AS no_profile, count(*) AS n FROM dividend_main GROUP BY ALL""", ["dividend_main"])
def blank_to_null(spark, folder):
    d = market.dividend_main(spark, folder).withColumns({c: io.blank_to_null(c) for c in ("impl_plan_newprofile", "new_profile")})
    return d.groupBy(F.col("impl_plan_newprofile").isNull().alias("no_new"), F.col("new_profile").isNull().alias("no_profile")).agg(F.count(F.lit(1)).alias("n"))


@query("S11_split_by_date", "SELECT trade_date, count(*) AS n FROM quotes GROUP BY 1", ["quotes"])
def split_by_date(spark, folder):
    q = io.split_by_date(staged(spark, folder), market.calendar(spark, folder))
    return q.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))


@query("S12_append_run_facts", """
SELECT 'run-7-1-trade-' || trade_seq || '-' || security_code AS trade_id, 'run-7' AS run_id, 'run-7-1' AS attempt_id, quantity FROM trades""", ["trades"], ("quantity",))
def append_run_facts(spark, folder):
    t = market.trades(spark, folder).select("security_code", "trade_seq", "quantity")
    path = scratch_path(spark, "facts")
    io.append_run_facts({"trade": t}, path, "run-7", "run-7-1", {"trade": ["trade_seq", "security_code"]})
    return spark.read.parquet(f"{path}/trade").select("trade_id", "run_id", "attempt_id", "quantity")


@query("S13_write_json_lines", "SELECT security_code, report_date::VARCHAR AS report_date, share_capital FROM reports", ["reports"], ("share_capital",))
def write_json_lines(spark, folder):
    path = scratch_path(spark, "json")
    io.write_json_lines(market.reports(spark, folder).select("security_code", "report_date", "share_capital"), path)
    return spark.read.schema("security_code string, report_date string, share_capital double").json(path)


@query("S14_upsert_results", """
SELECT run_id, trade_date, security_code, arg_max(gross_amount, version) AS amount, max(version) AS version FROM (
  SELECT run_id, trade_date, security_code, sum(gross_amount) AS gross_amount, 1 AS version FROM trades GROUP BY ALL
  UNION ALL SELECT run_id, trade_date, security_code, sum(gross_amount) * 2, 2 FROM trades WHERE side = 'buy' GROUP BY ALL) GROUP BY ALL""", ["trades"], ("amount",), digits=3)
def upsert_results(spark, folder):
    t = market.trades(spark, folder).withColumn("trade_date", F.col("trade_date").cast("date"))

    def version(df, number, factor):
        return df.groupBy("run_id", "trade_date", "security_code").agg((F.sum("gross_amount") * factor).alias("amount")).withColumn("version", F.lit(number))

    path = scratch_path(spark, "results")
    keys = ["run_id", "trade_date", "security_code"]
    # By run only: the default (run, day) makes thousands of folders here, twice, whose renames take 160 s on the smaller test tables.
    io.upsert_results(version(t, 1, 1), path, keys, parts=("run_id",))
    io.upsert_results(version(t.where("side = 'buy'"), 2, 2), path, keys, parts=("run_id",))
    return spark.read.parquet(path).select(*keys, "amount", "version")


# --- incremental runs ------------------------------------------------------------------------

CUT = "1999-01-01"
STATES = ["avg_gain_6_state", "avg_loss_6_state"]


def closes(spark, folder):
    return market.gap_bars(spark, folder).select(*KEY, "close_price")


def rsi_states(spark, folder):
    full = ind.rsi(closes(spark, folder), windows=(6,))
    return inc.load_state(full, CUT, STATES, closes(spark, folder), {"close_price": "previous_close"})


@query("C01_load_state", f"""
SELECT g.security_code, g.trade_date AS state_date, g.g AS avg_gain_6_state, l.l AS avg_loss_6_state, b.close_price AS previous_close
FROM gain_6 g JOIN loss_6 l USING (security_code, trade_date) JOIN gap_bars b USING (security_code, trade_date)
WHERE (g.security_code, g.trade_date) IN (SELECT security_code, max(trade_date) FROM gain_6 WHERE g IS NOT NULL AND trade_date < DATE '{CUT}' GROUP BY 1)""",
    ["gain_6", "loss_6", "gap_bars"], (*STATES, "previous_close"), digits=4)
def load_state(spark, folder):
    return rsi_states(spark, folder)


@query("C02_continue_series", f"SELECT security_code, trade_date, rsi_6 FROM rsi WHERE trade_date >= DATE '{CUT}'", ["rsi"], ("rsi_6",))
def continue_series(spark, folder):
    """Continued from stored state, the outputs equal those of the whole history."""
    out = inc.continue_series(closes(spark, folder), [ind.rsi_step(windows=(6,))], rsi_states(spark, folder), CUT)
    return out.select(*KEY, "rsi_6")


@query("C03_mixed_input", f"""
SELECT b.security_code, count(*) AS n, min(b.trade_date) AS first_day FROM gap_bars b LEFT JOIN (
  SELECT security_code, max(trade_date) AS d FROM gain_6 WHERE g IS NOT NULL AND trade_date < DATE '{CUT}' AND security_code LIKE '%.SH' GROUP BY 1) s USING (security_code)
WHERE s.d IS NULL OR b.trade_date >= s.d GROUP BY 1""", ["gap_bars", "gain_6"])
def mixed_input(spark, folder):
    some = rsi_states(spark, folder).where("security_code like '%.SH'")
    return inc.mixed_input(closes(spark, folder), some).groupBy("security_code").agg(F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("first_day"))


@query("C04_state_gaps", f"""
SELECT security_code, d AS state_date, count(DISTINCT trade_date) AS gap_days, min(trade_date) AS first_gap_date FROM bars JOIN (
  SELECT security_code, max(trade_date) AS d FROM gain_6 WHERE g IS NOT NULL AND trade_date < DATE '{CUT}' GROUP BY 1) s USING (security_code)
WHERE trade_date > d AND trade_date < DATE '1999-03-01' GROUP BY ALL""", ["bars", "gain_6"])
def state_gaps(spark, folder):
    return inc.state_gaps(closes(spark, folder), rsi_states(spark, folder), "1999-03-01")


@query("C05_append_latest", "SELECT security_code, trade_date, close_price FROM gap_bars", ["gap_bars"], ("close_price",))
def append_latest(spark, folder):
    c = closes(spark, folder)
    path = scratch_path(spark, "append")
    inc.rebuild_table(c.where(F.col("trade_date") < CUT), path)
    inc.append_latest(c, path, CUT)
    return versions.read_published(spark, path).drop("year")


@query("C06_replace_cascade", f"""
SELECT security_code, trade_date, CASE WHEN trade_date >= DATE '{CUT}' AND security_code LIKE '%.SZ' THEN close_price * 2 ELSE close_price END AS close_price FROM gap_bars""",
    ["gap_bars"], ("close_price",))
def replace_cascade(spark, folder):
    c = closes(spark, folder)
    path = scratch_path(spark, "cascade")
    inc.rebuild_table(c, path)
    doubled = c.where("security_code like '%.SZ'").withColumn("close_price", F.col("close_price") * 2)
    inc.replace_cascade(doubled, path, CUT)
    return versions.read_published(spark, path).drop("year")


@query("C07_materialize", "SELECT security_code, trade_date, k_value FROM kdj", ["kdj"], ("k_value",))
def materialize(spark, folder):
    bars = market.gap_bars(spark, folder).select(*KEY, "high_price", "low_price", "close_price")
    path = scratch_path(spark, "kdj")
    inc.materialize(lambda: ind.kdj(bars).select(*KEY, "k_value"), path, "rebuild_table")
    return versions.read_published(spark, path).drop("year")


@query("C08_run_summary", """
SELECT count(*) AS input_rows, count(close_price) AS valid_input_rows, count(*) AS output_rows, count(*) - count(rsi_14) AS null_indicator_rows
FROM gap_bars JOIN rsi USING (security_code, trade_date)""", ["gap_bars", "rsi"])
def run_summary(spark, folder):
    """One job: the table is written and counted at once."""
    path = scratch_path(spark, "rsi")
    counts = inc.observed_run(closes(spark, folder), lambda c: ind.rsi(c, windows=(14,)), lambda out: inc.rebuild_table(out, path), "rsi_14")
    return spark.createDataFrame([counts], "input_rows bigint, valid_input_rows bigint, output_rows bigint, null_indicator_rows bigint")


@query("C09_date_chunks", """
SELECT greatest(DATE '1996-03-01', make_date(y::INT, 1, 1)) AS chunk_start, least(DATE '1999-06-30', make_date(y::INT, 12, 31)) AS chunk_end, count(*) AS n
FROM (SELECT *, year(trade_date) AS y FROM bars WHERE trade_date BETWEEN DATE '1996-03-01' AND DATE '1999-06-30') GROUP BY ALL""", ["bars"])
def date_chunks(spark, folder):
    b = market.executions(spark, folder).select(market.security_code(F.col("l_suppkey")).alias("security_code"), "trade_date").distinct()
    result = None
    for start, end in inc.date_chunks("1996-03-01", "1999-06-30"):
        part = b.where(F.col("trade_date").between(start, end)).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(start).cast("date").alias("chunk_start"), F.lit(end).cast("date").alias("chunk_end"), "n"
        )
        result = part if result is None else result.unionByName(part)
    return result


@query("W12_warm_up_average", f"""
SELECT security_code, trade_date, price_ma_20 FROM averages WHERE trade_date >= DATE '{CUT}'""", ["averages"], ("price_ma_20",), digits=4)
def warm_up_average(spark, folder):
    """A window indicator needs no state: the rows since the lookback start give the same values."""
    c = closes(spark, folder).where("close_price is not null")
    start = tables.lookback_start(c, 20, CUT).select(F.col("lookback_start"))
    since = start.first().lookback_start
    recent = ind.sma(closes(spark, folder).where(F.col("trade_date") >= F.lit(since)), "close_price", 20, "price_ma_20")
    return recent.where(F.col("trade_date") >= CUT).select(*KEY, "price_ma_20")
