"""Joins of documents with word or n-gram tables by position, through chunks.

A row per word occurrence would be many times the size of the texts. So whole documents are packed
into chunks of bounded size, compressed. A chunk asks for its distinct keys only, one request per
hash part; each part of the key table answers in the order of the request; the answers meet their
chunk again and are put back by position. The chunks lie bucketed by their number, so that only
requests and answers are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import raw_texts, tidy
from tickloom.session import scratch_path

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 12_000_000


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def parts(spark: SparkSession) -> int:
    """Hash parts of a key table: as many as the session has shuffle partitions, which is set by the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of ``docs`` (an id column, then a text column): chunk, data.

    Written as a table bucketed by chunk. A chunk is numbered by the task that wrote it, which is
    safe because everything later reads the table and not ``docs``.
    """
    spark = docs.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made, held, size = 0, [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for piece in held:
                    out.write_batch(piece)
            return pa.RecordBatch.from_arrays([pa.array([task << 24 | made], pa.int64()), pa.array([squeeze(sink.getvalue().to_pybytes())], pa.binary())], ["chunk", "data"])

        for batch in batches:
            lengths = np.fromiter((len(x) for x in raw_texts(batch.column(1))), np.int64, batch.num_rows)
            first = 0
            for i, n in enumerate(lengths.tolist()):
                size += n
                if size >= chunk_bytes:
                    held.append(batch.slice(first, i + 1 - first))
                    yield flush()
                    made, held, size, first = made + 1, [], 0, i + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield flush()

    path, name = scratch_path(spark, "chunks"), f"chunks_{uuid.uuid4().hex}"
    packed = docs.mapInArrow(tidy(work), "chunk bigint, data binary")
    packed.write.format("parquet").option("path", path).bucketBy(2 * parts(spark), "chunk").saveAsTable(name)
    return spark.table(name)


def unpack(data: bytes) -> tuple[pa.Array, list[bytes]]:
    """Ids and texts of a chunk."""
    rows = pa.ipc.open_stream(unsqueeze(data)).read_all().combine_chunks()
    return rows.column(0).combine_chunks(), raw_texts(rows.column(1).combine_chunks())


def ask(chunks: DataFrame, request: Callable[[bytes], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """part, chunk, payload: what ``request`` makes of each chunk's data."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(request(data.as_py()))
                if rows:
                    part, payload = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(payload, pa.binary())], ["part", "chunk", "payload"]
                    )

    return chunks.select("chunk", "data").mapInArrow(tidy(work), "part int, chunk bigint, payload binary")


def answer(requests: DataFrame, resolve: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """``resolve`` sees all requests to a part at once and answers each of them."""

    def work(table: pa.Table) -> pa.Table:
        replies = resolve(table["payload"].to_pylist())
        return pa.table([table["part"], table["chunk"], pa.array(replies, pa.binary())], names=["part", "chunk", "payload"])

    return requests.groupBy("part").applyInArrow(tidy(work), "part int, chunk bigint, payload binary")


def meet(chunks: DataFrame, answers: DataFrame, finish: Callable[[bytes, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """``finish`` gets each chunk's data and its answers by part."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = dict(zip(right["part"].to_pylist(), right["payload"].to_pylist()))
        made = [finish(data, replies) for data in left["data"].to_pylist()]
        return pa.concat_tables(made)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy(work), schema)
