"""The rule and the signal table the screening queries share."""

from tickloom.functions import rules
from tickloom.operators import indicators, tables
from tickloom.sources import market

PREVIOUS = ("close_price", "price_ma_20", "price_ma_60")
CATALOG = rules.Catalog(tuple(
    rules.Metric(n, "signals", n, previous=f"prev_{n}" if n in PREVIOUS else None)
    for n in ("close_price", "volume", "price_ma_20", "price_ma_60", "volume_ma_5", *[f"prev_{p}" for p in PREVIOUS])
))
RULE = rules.Rule(
    filters=rules.All((
        rules.Compare(rules.Ref("price_ma_20"), "crosses_above", rules.Ref("price_ma_60")),
        rules.Compare(rules.Ref("volume"), "gt", rules.Times(0.8, rules.Ref("volume_ma_5"))),
    )),
    scoring=(
        rules.Points("trend", rules.Compare(rules.Ref("price_ma_20"), "gt", rules.Ref("price_ma_60")), 40),
        rules.Points("volume_burst", rules.Compare(rules.Ref("volume"), "gt", rules.Times(1.5, rules.Ref("volume_ma_5"))), 25),
        rules.Weighted("volume_weight", "volume", 0.5),
    ),
    top_n=5,
    outputs=("close_price", "price_ma_20"),
)
SIGNALS = """
SELECT *, lag(close_price) OVER w AS prev_close_price, lag(price_ma_20) OVER w AS prev_price_ma_20,
  lag(price_ma_60) OVER w AS prev_price_ma_60 FROM (
  SELECT security_code, trade_date, close_price, volume,
    CASE WHEN row_number() OVER w >= 20 THEN avg(close_price) OVER (w ROWS 19 PRECEDING) END AS price_ma_20,
    CASE WHEN row_number() OVER w >= 60 THEN avg(close_price) OVER (w ROWS 59 PRECEDING) END AS price_ma_60,
    CASE WHEN row_number() OVER w >= 5 THEN avg(volume) OVER (w ROWS 4 PRECEDING) END AS volume_ma_5
  FROM bars WINDOW w AS (PARTITION BY security_code ORDER BY trade_date))
WINDOW w AS (PARTITION BY security_code ORDER BY trade_date)"""


def signal_base(spark, folder):
    """Averages of the rule and their previous-day values."""
    b = market.bars(spark, folder).select("security_code", "trade_date", "close_price", "volume")
    b = indicators.placed_means(indicators.by_security(b), "close_price", {n: f"price_ma_{n}" for n in (20, 60)})
    b = indicators.placed_means(b, "volume", {5: "volume_ma_5"})
    return tables.with_prev(b, PREVIOUS)
