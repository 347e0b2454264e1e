"""The derived market tables themselves."""

from tickloom.catalog.registry import query
from tickloom.sources import market

DOUBLES = {
    "bars": ("open_price", "high_price", "low_price", "close_price", "volume", "amount", "top_discount"),
    "raw_quotes": ("open", "high", "low", "close", "preclose", "volume", "amount"),
    "raw_basics": (),
    "equity_history": ("total_shares", "unlimited_shares", "listed_a_shares", "limited_a_shares"),
    "dividend_main": (),
    "dividend_allotment": ("issue_price",),
    "reports": ("quarter_profit", "total_assets", "total_parent_equity", "share_capital", "ytd_profit"),
    "yields": ("one_year_yield_pct",),
    "benchmark_returns": ("return_daily",),
    "trades": ("quantity", "gross_amount", "total_fee", "execution_price"),
    "nav_daily": ("total_equity", "nav", "daily_return", "drawdown", "gross_exposure", "fee_amount"),
}

for table_name, doubles in DOUBLES.items():
    query(f"table_{table_name}", f"SELECT * FROM {table_name}", [table_name], doubles, digits=2 if table_name == "nav_daily" else 4,
        fine=("nav", "daily_return", "drawdown", "gross_exposure") if table_name == "nav_daily" else ())(
        getattr(market, table_name)
    )
