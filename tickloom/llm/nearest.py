"""Nearest vectors of a query set by inner product, exact, through int8 tiles.

Vectors are quantised to int8 with one scale each. A tile is the product of a block of queries with a
block of candidates; the norms of what quantisation lost bound its error, so that each tile keeps
only pairs that can be among the query's k best of the block. These are recomputed in double
precision and cut to k by a heap; the tiles' lists are merged by rank. Nothing is lost: the answer is
that of comparing every query with every candidate.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import written

CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 512
BLOCK = "dim int, block bigint, ids binary, vectors binary"


def sound(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0.0), F.lit(False))


def blocks(vectors: DataFrame, block_rows: int) -> DataFrame:
    """Vectors of one dimension, about ``block_rows`` to a row, as packed doubles."""
    n = max(1, -(-vectors.count() // block_rows))

    def pack(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy().astype(np.int64)
        order = np.argsort(ids)
        x = table["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        return pa.table([table["dim"][:1], table["block"][:1], pa.array([ids[order].tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["dim", "block", "ids", "vectors"])

    placed = vectors.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), "vec_id", "vector")
    return placed.groupBy("dim", "block").applyInArrow(pack, BLOCK)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the vectors as coded, norms of what the codes lose."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k best candidates of the block as (-score, id)."""
    q_codes, q_scale, q_norm, q_lost = quantised(q)
    c_codes, c_scale, c_norm, c_lost = quantised(c)
    whole = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64  # products of codes are exact whole numbers
    near = (q_codes.astype(whole) @ c_codes.astype(whole).T).astype(np.float64) * q_scale[:, None] * c_scale
    # <x, y> = <x', y'> + <x', y - y'> + <x - x', y>, with x', y' as coded
    error = (q_norm[:, None] * c_lost + q_lost[:, None] * (c_norm + c_lost)) * (1 + 1e-9) + 1e-12 * np.abs(near)
    own = q_ids[:, None] == c_ids
    low = np.where(own, -np.inf, near - error)
    bar = np.partition(low, -k, axis=1)[:, -k] if len(c_ids) > k else np.full(len(q_ids), -np.inf)
    alive = (near + error >= bar[:, None]) & ~own
    for i in range(len(q_ids)):
        at = np.flatnonzero(alive[i])
        exact = (c[at] * q[i]).sum(axis=1)
        yield int(q_ids[i]), heapq.nsmallest(k, zip((-exact).tolist(), c_ids[at].tolist()))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows query_id, rank, vec_id, score: for each query its ``k`` candidates of largest inner product, ties to the smaller id.

    ``queries``: condition on ``id_col``. Every sound vector is a candidate for every query but that of
    its own id, and only vectors of the same length are compared. Vectors that are null, zero, or hold
    null or non-finite components, and rows without an id, take no part. Of rows with the same id the
    one with the least vector counts. Fewer than ``k`` candidates are all returned; no query or no
    candidate gives no rows. Columns beside the two named are not read.
    """
    vector = F.col(vector_col).cast("array<double>")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & sound(F.col("vector")))
    single = written(named.groupBy("vec_id").agg(F.min("vector").alias("vector")), "nearest-vectors")
    candidates = written(blocks(single, CANDIDATE_BLOCK), "nearest-candidates")
    asked = written(blocks(single.where(queries), QUERY_BLOCK), "nearest-queries")
    # a block of queries goes to every block of candidates of its dimension
    targets = candidates.groupBy("dim").agg(F.collect_list("block").alias("targets"))
    sent = asked.join(targets, "dim").select("dim", F.explode("targets").alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    tiles = candidates.join(sent, ["dim", "block"]).select("dim", "q_ids", "q_vectors", "ids", "vectors")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, *packed in zip(*[c.to_pylist() for c in batch.columns]):
                q_ids, q, c_ids, c = (np.frombuffer(x, t) for x, t in zip(packed, (np.int64, np.float64) * 2))
                rows = [(i, b, -s) for i, best in tile(q_ids, q.reshape(-1, dim), c_ids, c.reshape(-1, dim), k) for s, b in best]
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = tiles.mapInArrow(work, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
