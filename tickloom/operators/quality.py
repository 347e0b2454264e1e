"""Data-quality checks and profiling (Q01-Q12). A check returns the offending rows or one verdict row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import codes


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row (Q01)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count of each column (Q02)."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return nulls.unpivot([], list(columns), "column_name", "null_count")


def check_accepted(df: DataFrame, column: str, accepted: Sequence) -> DataFrame:
    """Values outside the accepted list with their counts; NULL passes (Q02)."""
    return df.where(~F.col(column).isin(*accepted)).groupBy(F.col(column).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


def check_relationship(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values without a parent (Q02); distinct values are compared, not rows."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    return values.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def check_format(df: DataFrame, column: str, pattern: str = codes.CANONICAL_PATTERN) -> DataFrame:
    """Values that do not match the pattern (Q03)."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).rlike(pattern)).groupBy(column).agg(
        F.count(F.lit(1)).alias("row_count")
    )


def check_board(basics: DataFrame) -> DataFrame:
    """Securities whose board is not what type, exchange and number range give (Q03)."""
    expected = codes.board(F.col("security_type_code"), F.col("exchange_code"), F.col("security_local_code"))
    return basics.where(~F.col("security_board").eqNullSafe(expected)).select(
        "security_code", "security_board", expected.alias("expected_board")
    )


def check_expr(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that break a condition; NULL passes (Q04)."""
    return df.where(~condition)


def check_complete(df: DataFrame, calendar: DataFrame, date: str = "trade_date") -> DataFrame:
    """Calendar days the data does not have (Q05)."""
    return calendar.select(date).distinct().join(df.select(date).distinct(), date, "left_anti")


def check_cardinality(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Approximate distinct count against a limit (Q06)."""
    return df.agg(F.approx_count_distinct(column).alias("distinct_count")).select(
        "distinct_count", (F.col("distinct_count") <= limit).alias("within_limit")
    )


def check_partition(df: DataFrame, date: str, part: str) -> DataFrame:
    """Years found inside each partition value and whether they agree with it (Q07)."""
    year = F.year(date)
    return df.groupBy(part).agg(
        F.min(year).alias("min_year"), F.max(year).alias("max_year"), F.count(F.lit(1)).alias("row_count")
    ).withColumn(
        "matches", (F.col("min_year") == F.col(part)) & (F.col("max_year") == F.col(part))
    )


def check_schema(df: DataFrame, contract) -> list[str]:
    """Differences to the contract's columns and types (Q08); metadata only."""
    found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wanted = {f.name: f.type for f in contract.fields}
    problems = [f"missing {n}" for n in wanted if n not in found]
    problems += [f"unexpected {n}" for n in found if n not in wanted]
    problems += [
        f"{n}: {found[n]} is not {t}" for n, t in wanted.items() if n in found and found[n] != t
    ]
    return problems


def check_manifest(df: DataFrame, manifest: DataFrame, part: Column, name: str = "year") -> DataFrame:
    """Row counts per partition against a manifest, both sides kept (Q08)."""
    found = df.groupBy(part.alias(name)).agg(F.count(F.lit(1)).alias("found_rows"))
    return manifest.join(found, name, "full_outer").select(
        name, F.coalesce("expected_rows", F.lit(0)).alias("expected_rows"),
        F.coalesce("found_rows", F.lit(0)).alias("found_rows"),
    ).where("expected_rows <> found_rows")


def _finite(c: str) -> Column:
    return ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def check_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite count of each column (Q09)."""
    counts = df.agg(
        *[F.count_if(F.col(c).isNotNull() & ~_finite(c)).alias(c) for c in columns]
    )
    return counts.unpivot([], list(columns), "column_name", "non_finite_count")


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail the job at the first non-finite value."""
    return df.select(
        *[
            F.when(F.col(c).isNull() | _finite(c), F.col(c)).otherwise(
                F.raise_error(F.lit(f"{c} must be finite")).cast("double")
            ).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def check_increasing(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Rows whose date repeats within the series (Q10).

    A series is a set, so a date that does not increase is a date held twice: counting finds it
    without sorting any series.
    """
    return check_unique(df, [*keys, date]).select(*keys, date, "row_count")


def check_arrival_order(df: DataFrame, keys: Sequence[str], order: str, date: str) -> DataFrame:
    """Rows, in their stored order, whose date is not after the one before (Q10)."""
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("previous_date", F.lag(date).over(window)).where(F.col("previous_date") >= F.col(date))


def profile(
    df: DataFrame,
    keys: Sequence[str] = (),
    dates: Sequence[str] = (),
    formats: dict[str, dict[str, str]] | None = None,
    enums: Sequence[str] = (),
    numerics: Sequence[str] = (),
    placeholder: str = "1970-01-01",
    top: int = 5,
) -> DataFrame:
    """Table profile in long form: subject, measure, value (Q11).

    One wide aggregate reads the table once; keys and enum values take one grouped pass each.
    """
    text = lambda c: c.cast("string")
    measures: dict[str, Column] = {"table|row_count": text(F.count(F.lit(1)))}
    for c in dates:
        measures[f"{c}|min"] = text(F.min(c))
        measures[f"{c}|max"] = text(F.max(c))
        measures[f"{c}|null_count"] = text(F.count_if(F.col(c).isNull()))
        measures[f"{c}|placeholder_count"] = text(F.count_if(F.col(c) == F.lit(placeholder).cast("date")))
    for c, patterns in (formats or {}).items():
        for name, pattern in patterns.items():
            measures[f"{c}|{name}_count"] = text(F.count_if(F.col(c).rlike(pattern)))
    for c in numerics:
        # Text of whole hundredths reads the same from every engine.
        measures[f"{c}|min_hundredths"] = text(F.floor(F.min(c) * 100 + 0.5))
        measures[f"{c}|max_hundredths"] = text(F.floor(F.max(c) * 100 + 0.5))
        measures[f"{c}|zero_count"] = text(F.count_if(F.col(c) == 0))
        measures[f"{c}|negative_count"] = text(F.count_if(F.col(c) < 0))
        measures[f"{c}|null_count"] = text(F.count_if(F.col(c).isNull()))
    wide = df.agg(*[e.alias(n) for n, e in measures.items()])
    long = wide.unpivot([], list(measures), "name", "value").select(
        F.split_part("name", F.lit("|"), F.lit(1)).alias("subject"),
        F.split_part("name", F.lit("|"), F.lit(2)).alias("measure"), "value",
    )
    if keys:
        repeats = check_unique(df, keys).agg(F.coalesce(F.sum(F.col("row_count") - 1), F.lit(0)).alias("n"))
        long = long.unionByName(
            repeats.select(F.lit("table").alias("subject"), F.lit("duplicate_rows").alias("measure"), text(F.col("n")).alias("value"))
        )
    for c in enums:
        ranked = df.groupBy(F.coalesce(text(F.col(c)), F.lit("<NULL>")).alias("v")).agg(
            F.count(F.lit(1)).alias("n")
        ).orderBy(F.col("n").desc(), "v").limit(top)
        long = long.unionByName(
            ranked.select(F.lit(c).alias("subject"), F.concat(F.lit("count of "), "v").alias("measure"), text(F.col("n")).alias("value"))
        )
    return long


def check_passthrough(
    up: DataFrame, down: DataFrame, keys: Sequence[str], renamed: dict[str, str] | None = None
) -> DataFrame:
    """Coverage of upstream columns downstream: present or not, and differing rows (Q12)."""
    renamed = renamed or {}
    columns = [c for c in up.columns if c not in keys]
    present = [c for c in columns if renamed.get(c, c) in down.columns]
    other = down.select(*keys, *[F.col(renamed.get(c, c)).alias(f"_d_{c}") for c in present])
    counts = up.join(other, list(keys)).agg(
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_d_{c}"))).alias(c) for c in present],
        *[F.lit(None).cast("long").alias(c) for c in columns if c not in present],
    )
    return counts.unpivot([], columns, "column_name", "differing_rows").withColumn(
        "present", F.col("differing_rows").isNotNull()
    )
