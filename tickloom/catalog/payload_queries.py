"""Raw payloads to rows (R operators) and quality checks (Q operators)."""

from pyspark.sql import functions as F

from tickloom.catalog.registry import query
from tickloom.catalog.tables import define
from tickloom.functions import codes
from tickloom.operators import normalize as norm
from tickloom.operators import quality as q
from tickloom.operators import tables
from tickloom.plans import quotes
from tickloom.sources import contracts, market

KEY = ["security_code", "trade_date"]


def grouped_payload(spark, folder):
    """One JSON page per order: its group with the order and an optional article, and an empty group."""
    o = market.table(spark, folder, "orders")
    item = F.struct(
        F.col("o_orderkey").alias("code"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")).alias("reason"),
        F.when(F.col("o_orderstatus") != "O", F.struct(F.struct(F.col("o_custkey").alias("num"), F.col("o_orderstatus").alias("expound")).alias("action_info"))).alias("article"),
    )
    group = F.struct(
        F.col("o_orderpriority").alias("name"), F.col("o_orderdate").cast("date").cast("string").alias("date"), F.lit("group").alias("reason"),
        F.array(item).alias("list"),
    )
    empty = group.withField("list", F.filter(F.array(item), lambda x: F.lit(False)))
    return o.select(F.to_json(F.array(group, empty)).alias("payload"))


GROUP_SCHEMA = (
    "struct<name:string,date:string,reason:string,list:array<struct<code:bigint,reason:string,"
    "article:struct<action_info:struct<num:bigint,expound:string>>>>>"
)


@query("R01_flatten_grouped_events", """
SELECT o_orderpriority AS name, o_orderdate::DATE::VARCHAR AS date, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'group' END AS reason, o_orderkey AS code,
  CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS num, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS expound FROM orders""")
def flatten_grouped_events(spark, folder):
    return norm.flatten_grouped_events(
        grouped_payload(spark, folder), "payload", GROUP_SCHEMA, "list", ("article", "action_info"),
        ("name", "date", "reason", "code", "num", "expound"),
    )


def paged_payload(spark, folder):
    e = market.table(spark, folder, "events")
    page = F.struct(
        F.date_format("ts", "yyyyMMdd").alias("date"),
        F.array(F.struct(F.col("event_id").alias("code"), F.col("event_type").alias("name"), F.col("value").alias("latest"))).alias("info"),
    )
    return e.select("event_id", F.to_json(page).alias("payload"))


@query("R02_flatten_pages", "SELECT strftime(ts, '%Y%m%d') AS date, event_id AS code, event_type AS name, value AS latest FROM events", (), ("latest",))
def flatten_pages(spark, folder):
    schema = "struct<date:string,info:array<struct<code:bigint,name:string,latest:double>>>"
    return norm.flatten_pages(paged_payload(spark, folder), "payload", schema)


@query("R03_flatten_struct", """
SELECT event_id, event_type, value, (props->>'k')::BIGINT AS k, [event_id, event_id + 1] AS code FROM events""", (), ("value",))
def flatten_struct(spark, folder):
    e = market.table(spark, folder, "events")
    nested = e.select(
        "event_id", F.struct(F.struct("event_type", "value").alias("body"), F.from_json("props", "k bigint").alias("props")).alias("content"),
        F.array(F.struct(F.col("event_id").alias("code")), F.struct((F.col("event_id") + 1).alias("code"))).alias("items"),
    )
    return norm.flatten_struct(nested)


@query("R03_flatten_payload", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS kind, CASE WHEN event_id % 3 = 1 THEN [event_id, event_id + 1] END AS code,
  CASE WHEN event_id % 3 = 1 THEN [NULL, event_type] END AS note, CASE WHEN event_id % 3 = 2 THEN (props->>'k')::BIGINT END AS k FROM events""")
def flatten_payload(spark, folder):
    """Three shapes of objects in one column, and no schema."""
    e, i = market.table(spark, folder, "events"), F.col("event_id")
    item = F.struct(i.alias("code")), F.struct((i + 1).alias("code"), F.struct(F.col("event_type").alias("note")).alias("more"))
    shapes = (
        F.to_json(F.struct(F.struct(F.col("event_type").alias("kind")).alias("body"))),
        F.concat(F.lit('{"items":['), F.to_json(item[0]), F.lit(","), F.to_json(item[1]), F.lit("]}")),
        F.to_json(F.struct(F.struct(F.from_json("props", "k bigint").alias("deep")).alias("body"))),
    )
    texts_ = e.select("event_id", F.when(i % 3 == 0, shapes[0]).when(i % 3 == 1, shapes[1]).otherwise(shapes[2]).alias("payload"))
    return norm.flatten_payload(texts_, "payload", ["event_id"])


@query("R04_unknown_fields", """
SELECT sum(len(list_filter(json_keys(props), lambda x: x <> 'z')))::BIGINT AS unknown_field_count, 0::BIGINT AS not_an_object_count FROM events""")
def unknown_fields(spark, folder):
    return norm.unknown_fields(market.table(spark, folder, "events"), "props", ["z"])


def texts(spark, folder):
    """Typed values written out the way the vendors do, some broken."""
    e = market.table(spark, folder, "events")
    i = F.col("event_id")
    day = F.col("ts").cast("date")
    return e.select(
        "event_id",
        F.when(i % 4 == 0, F.date_format("ts", "yyyyMMdd")).when(i % 4 == 1, day.cast("string"))
        .when(i % 4 == 2, F.concat(day.cast("string"), F.lit(" 00:00:00"))).otherwise("  ").alias("d"),
        F.when(i % 5 == 0, F.lit("n/a")).otherwise(day.cast("string")).alias("bad_d"),
        F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("x"),
        F.when(i % 4 == 0, "YES").when(i % 4 == 1, "0").when(i % 4 == 2, "True").otherwise("").alias("b"),
        (i % 128).cast("string").alias("n"),
        F.when(i % 2 == 0, F.unix_timestamp("ts").cast("string")).otherwise(F.concat(F.unix_timestamp("ts").cast("string"), F.lit("000"))).alias("t"),
        F.date_format("ts", "H:m:s").alias("c"),
    )


@query("R05_to_typed", """
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN ts::DATE END AS d, CASE WHEN event_id % 3 <> 0 THEN value END AS x,
  CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS b, (event_id % 128)::TINYINT AS n,
  epoch(date_trunc('second', ts))::BIGINT AS t, strftime(ts, '%H:%M:%S') AS c FROM events""", (), ("x",))
def to_typed(spark, folder):
    kinds = {"d": "date32", "x": "float64", "b": "bool", "n": "int8", "t": "timestamp", "c": "time32"}
    typed = contracts.to_typed(texts(spark, folder).drop("bad_d"), kinds)
    return typed.withColumn("t", F.unix_seconds("t"))


@query("R06_lenient_date", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN ts::DATE END AS bad_d FROM events")
def lenient_date(spark, folder):
    return contracts.to_typed(texts(spark, folder).select("event_id", "bad_d"), {"bad_d": "date32"}, lenient=("bad_d",))


@query("R07_normalize_yield_curve", """
SELECT work_date, curve_name, one_year_yield_pct AS y1 FROM yields WHERE year(work_date) = 1998""", ["yields"], ("y1",))
def normalize_yield_curve(spark, folder):
    raw = market.yields(spark, folder).withColumn("one_year_yield_pct", F.coalesce(F.col("one_year_yield_pct").cast("string"), F.lit("")))
    mixed = raw.unionByName(raw.withColumn("curve_name", F.lit("other")))
    return norm.normalize_yield_curve(mixed, {"one_year_yield_pct": "y1"}, "treasury", 1998, strict=False)


@query("R07_strict_yield_curve", """
SELECT work_date, curve_name, one_year_yield_pct AS y1 FROM yields""", ["yields"], ("y1",))
def strict_yield_curve(spark, folder):
    """The strict path on sound rows of every year."""
    return norm.normalize_yield_curve(market.yields(spark, folder), {"one_year_yield_pct": "y1"}, "treasury")


@query("R08_normalize_extracted_rows", """
SELECT DISTINCT conv_id, role AS stock_name, 'a,' || role || ',turn' AS theme_path, trim(text) AS relation, CASE WHEN turn % 2 = 0 THEN 'web' ELSE '' END AS source FROM conversations""")
def normalize_extracted_rows(spark, folder):
    c = market.table(spark, folder, "conversations")
    row = F.create_map(
        F.lit("stock_name"), F.lit(" "), F.lit("公司"), F.concat(F.col("role"), F.lit(" ")),
        F.lit("主题"), F.concat(F.lit("a > "), F.col("role"), F.lit("、 、turn")),
        F.lit("说明"), F.col("text"), F.lit("信源"), F.when(F.col("turn") % 2 == 0, "web").otherwise(""),
    )
    # Every row arrives twice, with a row of blanks between.
    payload = F.to_json(F.array(row, F.create_map(F.lit("stock_name"), F.lit(" ")), row))
    return norm.normalize_extracted_rows(c.select("conv_id", payload.alias("payload")), "payload", ["conv_id"])


def objects(spark, folder):
    d = market.table(spark, folder, "documents")
    return d.select(F.concat(F.lit("doc-"), "doc_id").alias("object_name"), "doc_id", F.split("text", "\n").alias("rows"))


@query("R09_assemble_snapshot", """
SELECT object_name, doc_id, unnest(range(len(r)))::INT AS row_index, unnest(r) AS row_value FROM (
  SELECT 'doc-' || doc_id AS object_name, doc_id, string_split(text, chr(10)) AS r FROM documents)""")
def assemble_snapshot(spark, folder):
    o = objects(spark, folder)
    control = o.select("object_name", F.size("rows").alias("expected_rows"))
    return norm.assemble_snapshot(o, "object_name", "doc_id", "rows", control)[0]


@query("R09_control_totals", """
SELECT 'doc-' || doc_id AS object_name, 1::BIGINT AS expected_rows, len(string_split(text, chr(10))) AS found_rows FROM documents WHERE len(string_split(text, chr(10))) <> 1""")
def control_totals(spark, folder):
    o = objects(spark, folder)
    control = o.select("object_name", F.lit(1).cast("bigint").alias("expected_rows"))
    return norm.assemble_snapshot(o, "object_name", "doc_id", "rows", control)[1]


@query("R10_extract_urls", r"""
SELECT page_id, u AS url, CASE WHEN f IN ('', '.', '..') THEN sha256(u) || '.img' ELSE f END AS file_name FROM (
  SELECT page_id, u, regexp_extract(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS f FROM (
    SELECT page_id, unnest(list_distinct(regexp_extract_all(url || ' ' || html, 'https?://[^\s"''<>]+'))) AS u FROM pages))""")
def extract_urls(spark, folder):
    p = market.table(spark, folder, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("body"))
    return norm.extract_urls(p, "body", ["page_id"], norm.LINK_PATTERN)


@query("R11_page_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def page_duplicates(spark, folder):
    return norm.page_duplicates(market.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("R12_active_ranges", """
SELECT code, type::VARCHAR AS security_type, greatest(DATE '1995-01-01', "ipoDate", CASE type WHEN 1 THEN DATE '1990-12-19' ELSE DATE '1994-06-01' END) AS start_date,
  least(DATE '2000-06-30', "outDate") AS end_date FROM raw_basics WHERE type IN (1, 2) AND ("outDate" IS NULL OR "outDate" >= "ipoDate")
  AND greatest(DATE '1995-01-01', "ipoDate") <= least(DATE '2000-06-30', "outDate")""", ["raw_basics"])
def active_ranges(spark, folder):
    return norm.active_ranges(market.raw_basics(spark, folder), "1995-01-01", "2000-06-30", {"1": "1990-12-19", "2": "1994-06-01"})


@query("R13_counts_by", "SELECT l_returnflag, count(*) AS row_count FROM lineitem GROUP BY 1")
def counts_by(spark, folder):
    return norm.counts_by(market.table(spark, folder, "lineitem"), "l_returnflag")


define("requested", "SELECT DISTINCT o_orderdate::DATE AS trade_date FROM orders")


def requested(spark, folder):
    return market.table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date"))


@query("R14_select_trade_dates", """
SELECT trade_date FROM requested WHERE trade_date IN (SELECT trade_date FROM calendar) ORDER BY trade_date DESC LIMIT 200""", ["requested", "calendar"])
def select_trade_dates(spark, folder):
    return norm.select_trade_dates(requested(spark, folder), market.calendar(spark, folder), 200)[0]


@query("R14_skipped_dates", """
SELECT trade_date, CASE WHEN trade_date IN (SELECT trade_date FROM calendar) THEN 'over_limit' ELSE 'not_a_trading_day' END AS reason FROM requested
WHERE trade_date NOT IN (SELECT trade_date FROM requested WHERE trade_date IN (SELECT trade_date FROM calendar) ORDER BY trade_date DESC LIMIT 200)""", ["requested", "calendar"])
def skipped_dates(spark, folder):
    return norm.select_trade_dates(requested(spark, folder), market.calendar(spark, folder), 200)[1]


# --- quality ---------------------------------------------------------------------------------


@query("Q01_unique", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique(spark, folder):
    return q.check_unique(market.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("Q02_not_null", """
SELECT 'close_price' AS column_name, count(*) - count(close_price) AS null_count FROM gap_bars UNION ALL SELECT 'volume', count(*) - count(volume) FROM gap_bars""", ["gap_bars"])
def not_null(spark, folder):
    return q.check_not_null(market.gap_bars(spark, folder), ["close_price", "volume"])


@query("Q02_accepted_values", "SELECT event_type AS value, count(*) AS row_count FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def accepted_values(spark, folder):
    return q.check_accepted(market.table(spark, folder, "events"), "event_type", ["click", "view"])


@query("Q02_relationship", "SELECT l_orderkey, count(*) AS row_count FROM lineitem WHERE l_orderkey NOT IN (SELECT c_custkey FROM customer) GROUP BY 1")
def relationship(spark, folder):
    return q.check_relationship(market.table(spark, folder, "lineitem"), "l_orderkey", market.table(spark, folder, "customer"), "c_custkey")


@query("Q03_format", "SELECT code, count(*) AS row_count FROM raw_basics WHERE NOT regexp_matches(code, '^sh\\.6[0-9]{5}$') GROUP BY 1", ["raw_basics"])
def check_format(spark, folder):
    return q.check_format(market.raw_basics(spark, folder), "code", "^sh\\.6[0-9]{5}$")


@query("Q03_board", """
SELECT security_code, 'chinext' AS security_board, security_board AS expected_board FROM basics WHERE exchange_code = 'SH' AND security_type_code = 1""", ["basics"])
def check_board(spark, folder):
    wrong = F.when((F.col("exchange_code") == "SH") & (F.col("security_type_code") == 1), "chinext").otherwise(F.col("security_board"))
    return q.check_board(market.basics(spark, folder).withColumn("security_board", wrong))


@query("Q04_expression", "SELECT security_code, trade_date, close_price FROM bars WHERE NOT (close_price BETWEEN 500 AND 20000)", ["bars"], ("close_price",))
def expression(spark, folder):
    return q.check_expr(market.bars(spark, folder).select(*KEY, "close_price"), F.col("close_price").between(500, 20000))


@query("Q05_complete", """
SELECT DISTINCT o_orderdate::DATE AS trade_date FROM orders WHERE o_orderdate::DATE NOT IN (SELECT trade_date FROM bars)""", ["bars"])
def complete(spark, folder):
    """The days of the order book as the calendar: some have no bar."""
    days = market.table(spark, folder, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date")).distinct()
    return q.check_complete(market.bars(spark, folder), days)


@query("Q06_cardinality", "SELECT count(DISTINCT event_type) <= 20 AS within_limit FROM events")
def cardinality(spark, folder):
    return q.check_cardinality(market.table(spark, folder, "events"), "event_type", 20).select("within_limit")


@query("Q07_partition", """
SELECT year(trade_date)::INT AS part, min(year(trade_date))::INT AS min_year, max(year(trade_date))::INT AS max_year, count(*) AS row_count, true AS matches
FROM bars GROUP BY 1""", ["bars"])
def partition(spark, folder):
    return q.check_partition(market.bars(spark, folder).withColumn("part", F.year("trade_date")), "trade_date", "part")


@query("Q08_manifest", """
SELECT year(trade_date)::INT AS year, count(DISTINCT security_code) AS expected_rows, count(*) AS found_rows FROM bars GROUP BY 1 HAVING count(*) <> count(DISTINCT security_code)""", ["bars"])
def manifest(spark, folder):
    b = market.bars(spark, folder).select(*KEY)
    wrong = b.groupBy(F.year("trade_date").alias("year")).agg(F.count_distinct("security_code").alias("expected_rows"))
    return q.check_manifest(b, wrong, F.year("trade_date"))


@query("Q08_schema", """
WITH one AS (SELECT json_keys(to_json(b)) AS names, lower(typeof(b.amount)) AS kind FROM bars b LIMIT 1),
sides AS (SELECT list_filter(names, lambda x: x <> 'volume') AS found, list_filter(names, lambda x: x <> 'top_discount') AS wanted, kind FROM one)
SELECT 'missing ' || unnest(list_filter(wanted, lambda x: NOT list_contains(found, x))) AS problem FROM sides
UNION ALL SELECT 'unexpected ' || unnest(list_filter(found, lambda x: NOT list_contains(wanted, x))) FROM sides
UNION ALL SELECT 'amount: ' || kind || ' is not bigint' FROM sides WHERE kind <> 'bigint'""", ["bars"])
def schema(spark, folder):
    b = market.bars(spark, folder)
    wanted = [contracts.Column(f.name, "bigint" if f.name == "amount" else f.dataType.simpleString()) for f in b.schema.fields if f.name != "top_discount"]
    problems = q.check_schema(b.drop("volume"), contracts.DatasetContract("bars", tuple(wanted)))
    found = F.array(*[F.lit(p) for p in problems])
    return b.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.explode(found).alias("problem"))


@query("Q09_finite", """
SELECT 'close_price' AS column_name, count(*) AS non_finite_count FROM bars WHERE volume = 50 UNION ALL SELECT 'amount', 0""", ["bars"])
def finite(spark, folder):
    broken = F.when(F.col("volume") == 50, float("nan")).otherwise(F.col("close_price"))
    return q.check_finite(market.bars(spark, folder).withColumn("close_price", broken), ["close_price", "amount"])


@query("Q10_increasing", """
SELECT security_code, trade_date, count(*) AS row_count FROM executions GROUP BY ALL HAVING count(*) > 1""", ["executions"])
def increasing(spark, folder):
    x = market.executions(spark, folder)
    named = x.select(market.security_code(F.col("l_suppkey")).alias("security_code"), "trade_date")
    return q.check_increasing(named, ["security_code"], "trade_date")


@query("Q11_profile", """
WITH e AS (SELECT *, ts::DATE AS d FROM events)
SELECT 'table' AS subject, 'row_count' AS measure, count(*)::VARCHAR AS value FROM e UNION ALL SELECT 'd', 'min', min(d)::VARCHAR FROM e UNION ALL SELECT 'd', 'max', max(d)::VARCHAR FROM e
UNION ALL SELECT 'd', 'null_count', (count(*) - count(d))::VARCHAR FROM e UNION ALL SELECT 'd', 'placeholder_count', '0'
UNION ALL SELECT 'event_type', 'short_count', (count(*) FILTER (regexp_matches(event_type, '^.{4,5}$')))::VARCHAR FROM e
UNION ALL SELECT 'value', 'min_hundredths', floor(min(value) * 100 + 0.5e0)::BIGINT::VARCHAR FROM e UNION ALL SELECT 'value', 'max_hundredths', floor(max(value) * 100 + 0.5e0)::BIGINT::VARCHAR FROM e
UNION ALL SELECT 'value', 'zero_count', (count(*) FILTER (value = 0))::VARCHAR FROM e UNION ALL SELECT 'value', 'negative_count', (count(*) FILTER (value < 0))::VARCHAR FROM e
UNION ALL SELECT 'value', 'null_count', (count(*) - count(value))::VARCHAR FROM e
UNION ALL SELECT 'table', 'duplicate_rows', (count(*) - count(DISTINCT (user_id, event_type)))::VARCHAR FROM e
UNION ALL SELECT 'event_type', 'count of ' || event_type, count(*)::VARCHAR FROM e GROUP BY event_type""")
def profile(spark, folder):
    e = market.table(spark, folder, "events").withColumn("d", F.col("ts").cast("date"))
    return q.profile(e, keys=["user_id", "event_type"], dates=["d"], formats={"event_type": {"short": "^.{4,5}$"}}, enums=["event_type"], numerics=["value"])


@query("Q12_passthrough", """
SELECT 'close_price' AS column_name, (SELECT count(*) FROM bars WHERE volume < 8) AS differing_rows, true AS present
UNION ALL SELECT 'top_discount', NULL, false UNION ALL SELECT 'volume', 0, true""", ["bars", "calendar"])
def passthrough(spark, folder):
    up = market.bars(spark, folder).select(*KEY, "close_price", "volume", "top_discount")
    return q.check_passthrough(up, market.gap_bars(spark, folder), KEY)


@query("S09_contract_formats", """
SELECT count(*) FILTER (regexp_matches(security_code, '^[0-9]{6}\\.(SH|SZ|BJ)$')) AS canonical, count(*) AS n FROM basics""", ["basics"])
def contract_formats(spark, folder):
    b = market.basics(spark, folder)
    return b.agg(F.count_if(F.col("security_code").rlike(codes.CANONICAL_PATTERN)).alias("canonical"), F.count(F.lit(1)).alias("n"))


@query("J11_previous_volume", """
SELECT security_code, trade_date, prev_volume FROM (
  SELECT q.security_code, q.trade_date, q.volume, CASE WHEN lag(q.trade_date) OVER w = d.prev_trade_date THEN lag(q.volume) OVER w END AS prev_volume
  FROM quotes q LEFT JOIN trade_days d ON d.trade_date = q.trade_date WINDOW w AS (PARTITION BY q.security_code ORDER BY q.trade_date))
WHERE prev_volume IS DISTINCT FROM volume""", ["quotes", "trade_days"], ("prev_volume",))
def previous_volume(spark, folder):
    """Rows whose previous trading day's volume differs from the day's own, NULL included."""
    staged = quotes.stage_quotes(market.raw_quotes(spark, folder))
    days = tables.trade_calendar(market.calendar(spark, folder))
    before = staged.select("security_code", F.col("trade_date").alias("prev_trade_date"), F.col("volume").alias("prev_volume"))
    joined = staged.join(days.select("trade_date", "prev_trade_date"), "trade_date", "left").join(before, ["security_code", "prev_trade_date"], "left")
    return joined.where(~F.col("prev_volume").eqNullSafe(F.col("volume"))).select(*KEY, "prev_volume")
