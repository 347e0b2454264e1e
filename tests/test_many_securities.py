"""Tables with more suppliers than six-digit codes of a number range: every security keeps a code of its own."""

import datetime as dt
import itertools

import pytest
from compare import compare
from pyspark.sql import functions as F

from tickloom.catalog import load
from tickloom.functions import codes
from tickloom.sources import market

#: Of each pair the codes were the same when cut to six digits.
KEYS = [3, 400, 4000, 4004, 4001, 4005, 40_003, 40_007, 400_002, 400_006]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("many")
    days = [dt.datetime(1998, 11, 2) + dt.timedelta(days=d) for d in range(90)]
    lines = [
        (i, 7, key, i % 4, 10.0 + i % 23, 1000.0 + (i * i) % 977, 0.01 * (i % 11), 0.01 * (i % 8), "ANR"[i % 3], "OF"[i % 2], day)
        for i, (key, day) in enumerate(itertools.product(KEYS, days))
    ]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
        " l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(
        [(k, f"Supplier {k}", 1, 0.0) for k in KEYS], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"
    ).coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


@pytest.fixture(scope="module")
def con(folder):
    import duckdb

    con = duckdb.connect()
    for name in ("lineitem", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def test_codes_of_any_length(spark):
    row = spark.range(1).select(
        codes.normalize_code(F.lit("sh.6001000"), codes.PREFIX).alias("prefix"), codes.normalize_code(F.lit("sz30010000"), codes.COMPACT).alias("compact"),
        codes.local_code(F.lit("6001000.SH")).alias("local"), codes.exchange_code(F.lit("6001000.sh")).alias("exchange"),
        codes.normalize_code(F.lit("sh.600100"), codes.PREFIX).alias("six"), codes.local_code(F.lit("600100.SH")).alias("six_local"),
        codes.exchange_code(F.lit("600100.sh")).alias("six_exchange"), codes.local_code(F.lit("sh.600100 x"), codes.PREFIX).alias("rest"),
        codes.local_code(F.lit("sh.6"), codes.PREFIX).alias("short"), codes.local_code(F.lit(None).cast("string"), codes.PREFIX).alias("none"),
    ).first()
    assert tuple(row) == ("6001000.SH", "30010000.SZ", "6001000", "SH", "600100.SH", "600100", "SH", "600100", "6", None)


def test_every_supplier_has_its_code(spark, folder):
    for table, name in ((market.bars, "security_code"), (market.basics, "security_code"), (market.raw_quotes, "code")):
        assert table(spark, folder).select(name).distinct().count() == len(KEYS), table.__name__
    basics = market.basics(spark, folder).select("security_code")
    assert market.bars(spark, folder).join(basics, "security_code", "left_anti").count() == 0


@pytest.mark.parametrize("name", [
    "C01_load_state", "C02_continue_series", "C03_mixed_input", "C04_state_gaps", "C05_append_latest", "C06_replace_cascade", "C07_materialize",
    "C08_run_summary", "I04_ema", "I05_ema2", "I08_rsi", "I09_macd", "I11_kdj", "I13_n_structure", "I14_momentum_mart", "I14_one_pass",
    "I14_price_pattern_mart", "I14_trend_mart", "table_bars", "table_equity_history",
])
def test_series_of_many_securities_agree_with_sql(spark, con, folder, name):
    queries, oracles = load()
    assert not compare(spark, con, folder, name, queries[name], oracles[name]).startswith("DIFF")


@pytest.mark.parametrize("name", ["S09_compact_year", "D03_quotes_adj", "I14_quotes_mart"])
def test_quotes_have_one_row_per_security_and_day(spark, folder, name):
    rows = load()[0][name](spark, folder).select("security_code", "trade_date").collect()
    assert len(rows) == len(set(rows)) and len({r.security_code for r in rows}) == len(KEYS)


def test_snapshot_of_many_securities(spark, folder):
    rows = load()[0]["S07_sync_snapshot"](spark, folder).collect()
    assert len({r.security_code for r in rows}) == len(rows) == len(KEYS)


def test_series_page_of_many_securities(spark, folder):
    chinext = load()[0]["X23_security_series"](spark, folder).select("security_code", "trade_date").collect()
    assert len(chinext) == len(set(chinext)) and {r.security_code for r in chinext} == {"300100000.SZ", "300100001.SZ"}
