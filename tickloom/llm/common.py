"""What several operators share: tables, word splitting, Arrow helpers."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_path

#: A word is a run without ASCII white space (space, tab to carriage return); ``bytes.split()`` cuts alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again, so that later jobs start from files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(work: Callable):
    """A function for Arrow batches or tables that hands freed memory back when it ends.

    Python workers are kept for later tasks, and what an earlier one had freed but not returned counts
    against the executor as long as the worker lives.
    """

    def give_back() -> None:
        import ctypes

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass

    if inspect.isgeneratorfunction(work):

        def stream(batches):
            try:
                yield from work(batches)
            finally:
                give_back()

        return stream

    def whole(*tables):
        try:
            return work(*tables)
        finally:
            give_back()

    # grouped functions are told apart by their number of arguments
    return (lambda table: whole(table)) if len(inspect.signature(work).parameters) == 1 else (lambda left, right: whole(left, right))


def per_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A ``mapInArrow`` function that turns each batch into one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return tidy(run)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; nulls become empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
