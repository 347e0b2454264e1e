"""Readers and writers of contract datasets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import blank_to_null
from tickloom.operators.joins import one_per_key
from tickloom.operators.quality import check_complete, check_schema, check_unique
from tickloom.sources.contracts import DatasetContract, reconcile_schema
from tickloom.sources.versions import publish


class DataError(ValueError):
    """Data does not keep its contract."""


def require_none(problems: DataFrame, message: str) -> None:
    """Fail with a few examples if a check found rows."""
    examples = problems.limit(5).collect()
    if examples:
        raise DataError(f"{message}: {[r.asDict() for r in examples]}")


def read_snapshot(spark: SparkSession, path: str, contract: DatasetContract | None = None) -> DataFrame:
    """Latest snapshot under its declared schema, no inference."""
    reader = spark.read.schema(contract.schema()) if contract else spark.read
    return reader.parquet(path)


def read_partitions(
    spark: SparkSession, path: str, key: str, values: Sequence, contract: DatasetContract | None = None
) -> tuple[DataFrame, DataFrame]:
    """Chosen partitions, and per wanted key whether it is ``read``, ``missing`` or ``empty``.

    The filter is on the partition column, so other partitions are not listed into the scan. A key
    whose folder exists without rows is empty. The wanted keys are configuration.
    """
    everything = read_snapshot(spark, path, contract)
    chosen = everything.where(F.col(key).isin(*values))
    wanted = spark.createDataFrame([(v,) for v in values], f"{key} {everything.schema[key].dataType.simpleString()}")
    counts = chosen.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))
    there = [v for v in values if path_exists(spark, f"{path.rstrip('/')}/{key}={v}")]
    found = F.col(key).isin(*there) if there else F.lit(False)
    report = wanted.join(counts, key, "left").select(
        key, F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.when(F.col("row_count") > 0, "read").when(found, "empty").otherwise("missing").alias("status"),
    )
    return chosen, report


def existing_partitions(df: DataFrame, key: str) -> DataFrame:
    """Partition values that exist (S03); only the partition column is read."""
    return df.select(key).distinct()


def write_snapshot(df: DataFrame, path: str, allow_empty: bool = False) -> None:
    """Replace a snapshot; an empty one is refused unless allowed."""
    if not allow_empty and df.isEmpty():
        raise DataError(f"refusing to write an empty snapshot to {path}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_partitioned(df: DataFrame, path: str, key: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Replace only the partitions the frame holds, and count rows per partition.

    Rows are range-partitioned by the key and the sort order: a large partition becomes several
    sorted files instead of one task, and small ones share a task. Which partitions were touched is
    observed on the write itself (one value per folder), and their rows are counted from the files'
    footers, so the frame is computed once.
    """
    touched = Observation()
    placed = df.repartitionByRange(key, *order_by).sortWithinPartitions(key, *order_by)
    placed = placed.observe(touched, F.collect_set(key).alias("keys"), F.count_if(F.col(key).isNull()).alias("without"))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(key).parquet(path)
    seen = touched.get
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    wanted = F.col(key).isin(*seen["keys"]) if seen["keys"] else F.lit(False)
    if seen["without"]:
        wanted = wanted | F.col(key).isNull()
    return rows.where(wanted).groupBy(key).agg(F.count(F.lit(1)).alias("row_count"))


def sync_year(df: DataFrame, path: str, year: int, contract: DatasetContract, date: str) -> int:
    """Validate one year in one aggregate, then replace that partition."""
    typed = reconcile_schema(df, contract)
    found = typed.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.year(date)).alias("lo"), F.max(F.year(date)).alias("hi")
    ).first()
    if found.n == 0 and not contract.allow_empty:
        raise DataError(f"{contract.name}: year {year} is empty")
    if found.n and (found.lo, found.hi) != (year, year):
        raise DataError(f"{contract.name}: years {found.lo} to {found.hi} in partition {year}")
    write_partitioned(typed.withColumn("year", F.lit(year)), path, "year", contract.order_by)
    return found.n


def sync_snapshot(df: DataFrame, path: str, contract: DatasetContract) -> int:
    """Write a new version, validate what was written, then publish it in one step (S07); read it with ``read_published``."""
    typed = reconcile_schema(df, contract)
    counted = Observation()

    def check(staged: DataFrame) -> None:
        if not contract.allow_empty and counted.get["rows"] == 0:
            raise DataError(f"refusing to publish an empty snapshot to {path}")
        problems = check_schema(staged, contract)
        if problems:
            raise DataError(f"{contract.name}: {problems}")
        if contract.grain:
            require_none(check_unique(staged, contract.grain), f"{contract.name}: duplicate keys")

    publish(typed.observe(counted, F.count(F.lit(1)).alias("rows")), path, check=check)
    return counted.get["rows"]


def compact_year(
    daily: DataFrame, calendar: DataFrame, year: int, contract: DatasetContract, unique_key: Sequence[str], sort_key: Sequence[str],
    date: str = "trade_date", require_complete: bool = True, refresh_until: str | None = None, blank_columns: Sequence[str] = (),
) -> DataFrame:
    """One year of daily partitions as one sorted table.

    Types follow the contract; days missing from the calendar and duplicate keys are errors. The
    current year is complete up to ``refresh_until``.
    """
    rows = daily.where(F.year(date) == year)
    wanted = calendar.where(F.year(date) == year).select(date)
    if refresh_until:
        limit = F.lit(refresh_until).cast("date")
        rows, wanted = rows.where(F.col(date) <= limit), wanted.where(F.col(date) <= limit)
    rows = reconcile_schema(rows, contract)
    if blank_columns:
        rows = rows.withColumns({c: blank_to_null(c) for c in blank_columns})
    if require_complete:
        require_none(check_complete(rows, wanted, date), f"{contract.name}: days without data in {year}")
    require_none(check_unique(rows, unique_key), f"{contract.name}: duplicate keys in {year}")
    return rows.withColumn("year", F.lit(year)).repartitionByRange(*sort_key).sortWithinPartitions(*sort_key)


def split_by_date(df: DataFrame, wanted: DataFrame, date: str = "trade_date") -> DataFrame:
    """A range extract ready for per-date partitions; a date outside the wanted set is an error."""
    require_none(unwanted_dates(df, wanted, date), "dates outside the requested set")
    return df


def unwanted_dates(df: DataFrame, wanted: DataFrame, date: str = "trade_date") -> DataFrame:
    return df.select(date).distinct().join(wanted.select(date).distinct(), date, "left_anti")


def stamp_run(df: DataFrame, run_id: str, attempt_id: str, kind: str, id_columns: Sequence[str]) -> DataFrame:
    """Run and attempt id, and a child id made from the row's own key."""
    stamped = df.withColumn("run_id", F.lit(run_id)).withColumn("attempt_id", F.lit(attempt_id))
    return stamped.withColumn(
        f"{kind}_id", F.concat_ws("-", "attempt_id", F.lit(kind), *[F.col(c).cast("string") for c in id_columns])
    )


def append_run_facts(
    facts: dict[str, DataFrame], folder: str, run_id: str, attempt_id: str, ids: dict[str, Sequence[str]]
) -> None:
    """Append the stamped fact tables of one attempt."""
    for kind, df in facts.items():
        stamp_run(df, run_id, attempt_id, kind, ids[kind]).write.mode("append").option("compression", "zstd").parquet(
            f"{folder}/{kind}"
        )


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)


def latest_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version per key."""
    return one_per_key(df, keys, [version])


def upsert_results(df: DataFrame, path: str, keys: Sequence[str], version: str = "version", parts=("run_id", "trade_date")) -> None:
    """Re-runnable write: the later version of a key wins, untouched partitions stay.

    The merged rows go to a sibling folder first, since a folder being read is not overwritten.
    """
    spark = df.sparkSession
    merged = df
    if path_exists(spark, path):
        stored = spark.read.schema(df.schema).parquet(path)
        touched = df.select(*parts).distinct()
        merged = stored.join(touched, list(parts), "left_semi").unionByName(df)
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex[:8]}"
    latest_version(merged, keys, version).write.mode("overwrite").parquet(staging)
    # placed by partition, so that a task opens the files of few partitions
    placed = spark.read.schema(merged.schema).parquet(staging).select(*df.columns).repartitionByRange(*parts)
    placed.write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).option("compression", "zstd").partitionBy(*parts).parquet(path)
    remove_folder(spark, staging)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a staging folder this package created."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
