"""Sketches kept per day and merged: profiles of a growing table that don't read its history.

A day's distinct counts (HyperLogLog) and quantiles (KLL) are a few kilobytes per column, whatever
the day holds. Adding a day writes its sketches only; any range of days is profiled by merging them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_CONFIG = 12
KLL_K = 200
#: Three standard errors of a merged HyperLogLog sketch of 2**12 registers, and the rank error of KLL at k = 200 with 99 % confidence.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_CONFIG / 2)
RANK_ERROR = 0.0165
STORED = "column_name string, row_count bigint, null_count bigint, distinct_sketch binary, quantile_sketch binary"


def daily_sketches(df: DataFrame, day: str, distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """day, column_name, row_count, null_count, distinct_sketch, quantile_sketch: one row per day and column, map-side combined.

    Columns of ``quantiles`` are numeric and get both sketches; NULL enters neither.
    """
    columns = list(dict.fromkeys([*distinct, *quantiles]))

    def of(c: str) -> Column:
        value = F.col(c)
        q = F.kll_sketch_agg_double(value.cast("double"), KLL_K) if c in quantiles else F.lit(None).cast("binary")
        return F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("row_count"), F.count_if(value.isNull()).alias("null_count"),
            F.hll_sketch_agg(value.cast("string"), LG_CONFIG).alias("distinct_sketch"), q.alias("quantile_sketch"),
        )

    wide = df.groupBy(F.col(day).alias("day")).agg(*[of(c).alias(f"s{i}") for i, c in enumerate(columns)])
    return wide.select("day", F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("day", "s.*")


def store_days(sketches: DataFrame, path: str) -> None:
    """Write the sketches of the days they hold; the sketches of other days are not read or touched."""
    sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{STORED}, day date").parquet(path)


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and ``by``) over all days of ``sketches``, its sketches still mergeable."""
    return sketches.groupBy(*by, "column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"),
    )


def measured(merged_sketches: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Estimates of merged sketches: distinct_count, and the quantiles at ``ranks`` (NULL where there is no such sketch)."""
    filled = F.col("quantile_sketch").isNotNull() & (F.coalesce(F.kll_sketch_get_n_double("quantile_sketch"), F.lit(0)) > 0)
    values = [F.when(filled, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(float(r)))) for r in ranks]
    kept = [c for c in merged_sketches.columns if not c.endswith("_sketch")]
    return merged_sketches.select(*kept, F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"), F.array(*values).alias("quantiles"))
