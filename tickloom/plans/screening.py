"""Screening: marts to filter, score, rank and buy flag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.rules import Catalog, Rule, apply_universe, dependencies, rule_filter, rule_json, rule_score, validate_rule
from tickloom.operators import tables
from tickloom.operators.joins import assemble_marts

KEYS = ("security_code", "trade_date")


def between(df: DataFrame, start: str, end: str, date: str = "trade_date") -> DataFrame:
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def metric_table(marts: dict[str, DataFrame], base: str, rule: Rule, catalog: Catalog, start: str, end: str) -> DataFrame:
    """Only the metrics a rule reads, from the marts that hold them, for the range."""
    validate_rule(rule, catalog)
    wanted = {m: (catalog.require(m).table, catalog.require(m).column) for m in sorted(dependencies(rule, catalog))}
    return assemble_marts(marts, base, wanted, start, end)


def pool(metrics: DataFrame, rule: Rule, catalog: Catalog) -> DataFrame:
    """Rows of the universe that pass the filter tree, with their score."""
    hits = apply_universe(metrics, rule.universe).where(rule_filter(rule.filters, catalog))
    return hits.withColumn("score", rule_score(rule, catalog))


def screen(metrics: DataFrame, rule: Rule, catalog: Catalog, start: str, end: str, top_n: int | None = None) -> DataFrame:
    """Ranked pool with buy flag and JSON detail."""
    ranked = tables.rank_signals(pool(between(metrics, start, end), rule, catalog))
    detail = rule_json(rule, catalog)
    return ranked.select(
        *KEYS, "score", "rank_no", (F.col("rank_no") <= (top_n or rule.top_n)).alias("is_buy_signal"),
        *[e.alias(n) for n, e in detail.items()],
    )


def signals(metrics: DataFrame, rule: Rule, catalog: Catalog, start: str, end: str, top_n: int | None = None) -> DataFrame:
    """Top-N signals only (X02); the rank filter becomes a group limit before the shuffle."""
    hits = pool(between(metrics, start, end), rule, catalog).select(*KEYS, "score")
    return tables.top_n_per_date(tables.rank_signals(hits), top_n or rule.top_n)


def preview(metrics: DataFrame, rule: Rule, catalog: Catalog, start: str, end: str, limit: int) -> DataFrame:
    """Best rows per date and the size of the pool (X03), in one pass; a date's pool is bounded by the universe."""
    hits = pool(between(metrics, start, end), rule, catalog).select(*KEYS, "score")
    return tables.top_n_per_date(tables.rank_signals(tables.with_pool_count(hits)), limit)


def pool_timeline(metrics: DataFrame, rule: Rule, catalog: Catalog, start: str, end: str) -> DataFrame:
    """Pool size per date."""
    return pool(between(metrics, start, end), rule, catalog).groupBy("trade_date").agg(F.count(F.lit(1)).alias("pool_count"))


def pool_page(
    metrics: DataFrame, rule: Rule, catalog: Catalog, date: str, limit: int, offset: int = 0, code: str | None = None
) -> DataFrame:
    """One page of a date's ranked pool with its size; a code filter applies after ranking."""
    hits = pool(between(metrics, date, date), rule, catalog)
    page = tables.with_pool_count(tables.rank_signals(hits))
    if code:
        page = page.where(F.col("security_code") == code)
    return page.orderBy("rank_no").offset(offset).limit(limit)


def signals_by_date(sig: DataFrame, names: DataFrame, top_n: int) -> DataFrame:
    """Top-N signals of each date as a list ordered by rank, with display names.

    ``top_n`` is the rule's own, so a list is as short as a date's signals.
    """
    shown = sig.where(F.col("rank_no") <= top_n).join(names.select("security_code", "security_name"), "security_code", "left")
    listed = F.array_sort(F.collect_list(F.struct("rank_no", "security_code", "security_name", "score")))
    return shown.groupBy("trade_date").agg(F.count(F.lit(1)).alias("signal_count"), listed.alias("signals"))


def signal_timeline(targets: DataFrame, months: int = 3, date: str = "signal_date") -> DataFrame:
    """Targets per signal date and whether the date lies in the trailing trend window."""
    counts = targets.groupBy(date).agg(F.count(F.lit(1)).alias("target_count"))
    whole = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per date remains here, so the maximum over all of them is a calendar-sized window.
    return counts.withColumn("in_trend", F.col(date) >= F.add_months(F.max(date).over(whole), -months))
