"""Incremental indicator runs: state, mixed input, gaps and write modes.

Daily runs continue every series from its stored state columns; a security without state is
recomputed from its whole history in the same job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.indicators import Recurrence, recurrences
from tickloom.operators.quality import check_unique
from tickloom.operators.tables import latest_by
from tickloom.session import scratch_path
from tickloom.sources.io import DataError, remove_folder, require_none
from tickloom.sources.versions import publish, published, read_published

CODE, DATE = "security_code", "trade_date"
MODES = ("append_latest", "replace_cascade", "rebuild_table", "dry_run")


def day(value: str):
    return F.lit(value).cast("date")


def load_state(
    output: DataFrame, before: str, columns: Sequence[str], inputs: DataFrame | None = None, input_columns: dict[str, str] | None = None
) -> DataFrame:
    """Latest row per security before a date with every state column set.

    ``input_columns`` adds values of the same day from the input, as RSI needs its last close.
    """
    whole = output.where(F.col(DATE) < day(before)).select(CODE, DATE, *columns).dropna(subset=list(columns))
    state = latest_by(whole, [CODE], DATE, columns).withColumnRenamed(DATE, "state_date")
    if inputs is None:
        return state
    extra = inputs.select(CODE, F.col(DATE).alias("state_date"), *[F.col(c).alias(n) for c, n in (input_columns or {}).items()])
    joined = state.join(extra, [CODE, "state_date"])
    return joined.dropna(subset=list((input_columns or {}).values()))


def mixed_input(inputs: DataFrame, states: DataFrame, upto: str | None = None) -> DataFrame:
    """Rows from each state date on, and the whole history where there is no state."""
    rows = inputs.where(F.col(DATE) <= day(upto)) if upto else inputs
    joined = rows.join(states.select(CODE, "state_date"), CODE, "left")
    return joined.where(F.col("state_date").isNull() | (F.col(DATE) >= F.col("state_date"))).drop("state_date")


def continue_series(inputs: DataFrame, steps: Sequence[Recurrence], states: DataFrame, start: str, upto: str | None = None) -> DataFrame:
    """Outputs from ``start`` on, each series continued from its state."""
    return recurrences(mixed_input(inputs, states, upto), steps, states).where(F.col(DATE) >= day(start))


def state_gaps(inputs: DataFrame, states: DataFrame, start: str) -> DataFrame:
    """Securities with input between their state date and the requested start."""
    between = inputs.join(states.select(CODE, "state_date"), CODE).where(
        (F.col(DATE) > F.col("state_date")) & (F.col(DATE) < day(start))
    )
    return between.groupBy(CODE, "state_date").agg(
        F.count_distinct(DATE).alias("gap_days"), F.min(DATE).alias("first_gap_date")
    )


def observed_run(
    inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], indicator: str, value: str = "close_price"
) -> dict[str, int]:
    """Input, valid-input, output and NULL-indicator row counts of a run (C08), observed in the one job that computes it.

    ``compute`` reads its input once. ``write`` gets the computed rows from files.
    """
    before, after = Observation(), Observation()
    spark = inputs.sparkSession
    counted = inputs.observe(before, F.count(F.lit(1)).alias("input_rows"), F.count(value).alias("valid_input_rows"))
    outputs = compute(counted)
    # written as they come: placing rows by ranges samples its input first and would count it twice
    path = scratch_path(spark, "run-output")
    try:
        outputs.observe(after, F.count(F.lit(1)).alias("output_rows"), F.count_if(F.col(indicator).isNull()).alias("null_indicator_rows")).write.parquet(path)
        counts = {**before.get, **after.get}
        write(spark.read.schema(outputs.schema).parquet(path))
    finally:
        remove_folder(spark, path)
    return counts


def date_chunks(start: str, end: str, threshold_days: int = 366) -> list[tuple[str, str]]:
    """Calendar-year pieces of a long range, one piece when it is short."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if first > last:
        return []
    if (last - first).days < threshold_days:
        return [(start, end)]
    pieces = []
    while first <= last:
        stop = min(date(first.year, 12, 31), last)
        pieces.append((first.isoformat(), stop.isoformat()))
        first = stop + timedelta(days=1)
    return pieces


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year(DATE))


def read_table(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """The published table with the columns of ``df`` and the year."""
    return read_published(spark, path, with_year(df).schema)


def year_of(folder: str) -> int:
    return int(folder.rpartition("=")[2])


def publish_years(df: DataFrame, path: str, keep: Callable[[list[str]], list[str]], message: str, check: Callable[[DataFrame], None] = lambda staged: None) -> None:
    """Publish ``df`` by year, sorted by security and date, beside the folders ``keep`` chooses; duplicate keys are an error."""

    def checked(staged: DataFrame) -> None:
        require_none(check_unique(staged, [CODE, DATE]), message)
        check(staged)

    publish(df, path, keep, "year", checked, ("year", CODE, DATE))


def append_latest(df: DataFrame, path: str, start: str) -> None:
    """Append rows from ``start`` on; refused if a written security already has one there."""
    spark = df.sparkSession

    def apart(staged: DataFrame) -> None:
        if published(spark, path):
            later = read_table(spark, path, df).where((F.col("year") >= int(start[:4])) & (F.col(DATE) >= day(start)))
            require_none(
                later.join(staged.select(CODE).distinct(), CODE, "left_semi").select(CODE, DATE), "rows at or after the start already exist"
            )

    publish_years(with_year(df.where(F.col(DATE) >= day(start))), path, lambda folders: folders, "duplicate keys in the new rows", apart)


def cascade_rows(df: DataFrame, stored: DataFrame, start: str) -> DataFrame:
    """Contents of the affected years after a cascade: rows of other securities and earlier rows stay."""
    new = with_year(df.where(F.col(DATE) >= day(start)))
    replaced = new.select(CODE).distinct().withColumn("_new", F.lit(True))
    affected = stored.where(F.col("year") >= int(start[:4]))
    retained = affected.join(replaced, CODE, "left").where(F.col("_new").isNull() | (F.col(DATE) < day(start))).drop("_new")
    return retained.unionByName(new)


def replace_cascade(df: DataFrame, path: str, start: str) -> None:
    """Replace the written securities' rows from ``start`` on.

    The new contents of the start's year and all later ones are written and checked beside the
    table, then published together with the folders of the earlier years: a reader sees the old
    table or the new one. A year the new rows no longer reach loses its replaced rows as well.
    """
    spark, first = df.sparkSession, int(start[:4])
    if not published(spark, path):
        publish_years(with_year(df.where(F.col(DATE) >= day(start))), path, lambda folders: [], "duplicate keys after the cascade")
        return
    # computed once: the rows are read twice below
    fresh_path = scratch_path(spark, "cascade-new")
    try:
        df.where(F.col(DATE) >= day(start)).write.parquet(fresh_path)
        fresh = spark.read.schema(df.schema).parquet(fresh_path)
        rows = cascade_rows(fresh, read_table(spark, path, df), start)
        publish_years(rows, path, lambda folders: [f for f in folders if year_of(f) < first], "duplicate keys after the cascade")
    finally:
        remove_folder(spark, fresh_path)


def rebuild_table(df: DataFrame, path: str) -> None:
    """Write the whole table anew (C07): staged, checked as written, then published."""
    publish_years(with_year(df), path, lambda folders: [], "duplicate keys")


def materialize(compute: Callable[[], DataFrame], path: str, mode: str, start: str | None = None) -> DataFrame:
    """Run a computation in one of the write modes (C07); a dry run only computes."""
    if mode not in MODES:
        raise DataError(f"unknown mode: {mode}")
    df = compute()
    if mode == "append_latest":
        append_latest(df, path, start)
    elif mode == "replace_cascade":
        replace_cascade(df, path, start)
    elif mode == "rebuild_table":
        rebuild_table(df, path)
    return df
