"""Joins (J01-J12). Spark and AQE pick the strategy and size-check any broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scans import asof_join


def one_per_key(df: DataFrame, keys: Sequence[str], prefer: Sequence[str] = ()) -> DataFrame:
    """One row per key: the largest ``prefer`` values, then the largest row.

    ``max`` of a struct combines map-side, so a key with many copies never reaches one task whole.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    order = list(dict.fromkeys([*prefer, *rest]))
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def left_any(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    prefer: Sequence[str] = (),
    right_unique: bool = False,
) -> DataFrame:
    """Left join that keeps the left row count (J02). ``right_unique`` skips the dedupe."""
    lookup = right if right_unique else one_per_key(right, keys, prefer)
    return left.join(lookup, list(keys), "left")


def demand_join(
    prices: DataFrame, demand: DataFrame, key: str = "security_code", start: str = "start_date",
    date: str = "trade_date",
) -> DataFrame:
    """Prices of each demanded security from its first needed date on."""
    first = demand.groupBy(key).agg(F.min(start).alias("_from"))
    return prices.join(first, key).where(F.col(date) >= F.col("_from")).drop("_from")


def grid(calendar: DataFrame, values: Sequence[str], name: str) -> DataFrame:
    """Every calendar row with every configured value (J07); the list is configuration."""
    return calendar.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def forward_fill(
    calendar: DataFrame,
    series: DataFrame,
    on: Sequence[str],
    series_date: str,
    columns: Sequence[str],
    date: str = "trade_date",
) -> DataFrame:
    """Latest known value per calendar row (J08); both sides hold one row per key and day."""
    return asof_join(calendar, series, on, date, series_date, columns=columns, bounded=True)


def anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, tagged with that side."""
    only_left = left.select(*keys).join(right.select(*keys), list(keys), "left_anti")
    only_right = right.select(*keys).join(left.select(*keys), list(keys), "left_anti")
    return only_left.withColumn("side", F.lit("left")).unionByName(
        only_right.withColumn("side", F.lit("right"))
    )


def complete_attempts(
    facts: DataFrame, snapshot: DataFrame, keys=("run_id", "attempt_id"), status: str = "succeeded"
) -> DataFrame:
    """Facts whose attempt is the finished one of its run."""
    return facts.join(snapshot.where(F.col("status") == status).select(*keys), list(keys), "left_semi")


def changed_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Joined rows whose values differ, NULL equal to NULL."""
    other = right.select(*keys, *[F.col(c).alias(f"other_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return left.select(*keys, *columns).join(other, list(keys)).where(~same)


def assemble_marts(
    marts: dict[str, DataFrame],
    base: str,
    metrics: dict[str, tuple[str, str]],
    start: str,
    end: str,
    keys=("security_code", "trade_date"),
    extra=("is_st", "is_suspend"),
) -> DataFrame:
    """Base mart with the chosen metric columns of the others.

    ``metrics`` maps a logical name to ``(mart, column)``. Every mart is pruned to its columns and
    filtered to the date range, so a mart partitioned by year reads those years only; a mart no
    metric needs is not read. Marts are unique on ``keys`` by contract.
    """
    code, date = keys

    def part(mart: str) -> DataFrame:
        chosen = [F.col(c).alias(n) for n, (m, c) in metrics.items() if m == mart]
        flags = [c for c in extra if mart == base and c in marts[mart].columns and c not in metrics]
        return marts[mart].where(
            F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        ).select(code, date, *flags, *chosen)

    result = part(base)
    for mart in marts:
        if mart != base and any(m == mart for m, _ in metrics.values()):
            result = result.join(part(mart), list(keys), "left")
    return result
