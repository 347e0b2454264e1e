"""Shards that all hold the mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; rank r of a source of n rows
lies at (r + u) / n of the whole, with one seeded offset u per source, and the rows are cut into
shards in that order. Between any two cuts a source therefore has its share of the rows, give or
take one, and sources of one row are spread instead of meeting in the middle. Both ranks come from
a sort over the whole cluster (``global_rank``), so a source may hold any share of the rows.

Law ``rows``: shards differ by one row at most. Copies of a text are rows like any other; keeping
them together would break both the law and the mixture.

Null, empty and repeated rows: a null text has no bytes and is sized 1, as an empty one; rows
without a source are a source; a null id is shuffled by its text. Rows equal in id, source and text
are ranked in either order, which the narrow result can't tell. An empty table gives no rows.
Extra columns travel in the struct ``row`` and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.scans import global_rank
from tickloom.session import scratch_path

SHARDS = 16
SEED = 7
#: Hexadecimal digits of a digest that make a long, and a fraction that a double holds exactly.
KEY_DIGITS, OFFSET_DIGITS = 15, 13


def digits(value: Column, count: int) -> Column:
    """The first ``count`` hexadecimal digits of the MD5 of ``value`` as a long."""
    return F.conv(F.substring(F.md5(value), 1, count), 16, 10).cast("long")


def stratified_shards(
    df: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", whole: bool = False
) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row; with ``whole`` also the input row as the struct ``row``.

    Without ``whole`` only a few numbers of each row are sorted; texts never leave the scan.
    """
    nested = df.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    ident, source = F.col("row")[id_col], F.col("row")[source_col]
    rows = nested.select(
        ident.alias("doc_id"), source.alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        digits(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), text), KEY_DIGITS).alias("shuffled"),
        *(["row"] if whole else []),
    )
    order = [F.col(c) for c in ("shuffled", "doc_id", "text_crc32", "size")]
    ranked = global_rank(rows, ["source"], order, "rank")
    sizes = nested.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    total = sizes.agg(F.sum("rows")).first()[0] or 1
    sizes = sizes.select(
        F.col("source").alias("of"), "rows",
        (digits(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source").cast("string"), F.lit(""))), OFFSET_DIGITS) / F.lit(float(16**OFFSET_DIGITS))).alias("offset"),
    )
    spread = ranked.join(sizes, F.col("source").eqNullSafe(F.col("of"))).withColumn("at", (F.col("rank") - 1 + F.col("offset")) / F.col("rows"))
    columns = ["doc_id", "source", "size", "text_crc32", *(["row"] if whole else [])]
    placed = global_rank(spread.select(*columns, "rank", "at"), [], [F.col("at"), F.col("source"), F.col("rank")], "place")
    cut = placed.withColumn("shard", F.expr(f"int((place - 1) * {shards} div {total})"))
    return cut.select(*columns, "shard", F.expr(f"place - 1 - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, rows_per_task: int = 200_000, **options) -> str:
    """Write the rows of ``df`` to ``path`` as one Parquet folder per shard, in slot order within each task's file.

    A shard is dealt to as many tasks as its rows need, by ranges of slots, so none gathers a whole shard.
    """
    placed = stratified_shards(df, shards, whole=True, **options).select("shard", "slot", "row")
    pieces = max(1, -(-placed.count() // rows_per_task))
    placed.repartitionByRange(pieces, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def sharded_table(df: DataFrame, **options) -> DataFrame:
    """Shards written below the shared folder and read again: shard, slot and the struct ``row``."""
    return df.sparkSession.read.parquet(write_shards(df, scratch_path(df.sparkSession, "shards"), **options))
