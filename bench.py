"""Headline timings as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads. Every query runs to the end
into the no-op sink, so no rows travel to the driver and no column is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "D01_quotes_unadj", "D03_quotes_adj", "D05_financial_valuation", "I14_quotes_mart", "J03_asof_join",
    "I02_moving_averages", "I07_bollinger", "I08_rsi", "I09_macd", "I11_kdj", "I12_streaks", "I13_n_structure", "I14_one_pass",
    "X02_signals", "X06_signal_trades", "X07_fifo_closed_trades", "X09_performance", "X12_position_days", "C02_continue_series",
    "C07_materialize",
)


def main() -> None:
    from tickloom.catalog import load
    from tickloom.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        }
    )
    spark.sparkContext.setLogLevel("OFF")
    queries, _ = load()
    queries["table_bars"](spark, folder).write.format("noop").mode("overwrite").save()  # start workers and warm the code cache
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
