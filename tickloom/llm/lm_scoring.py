"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

The count table is partitioned by n-gram hash and each part is a sorted array. The n-grams of the
documents, distinct within a chunk, are sent to their parts, which add them up and answer with the
totals; the answers are joined back by position and summed per document. A document's own n-grams are
taken off the counts first, so that it isn't scored by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bpe import number_words
from tickloom.llm.chunks import answer, ask, meet, pack, parts, squeeze, unpack, unsqueeze
from tickloom.llm.common import word_count

ORDER = 3
BACKOFF = 0.4
#: Bits of an n-gram hash. Two of a billion n-grams share a hash about once in 4.5 million.
HASH_BITS = 52
#: Smaller chunks than for words: a worker holds all n-grams of one.
CHUNK_BYTES = 8_000_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def planes(numbers: np.ndarray) -> bytes:
    """Compressed unsigned numbers, byte by byte of their size, so that empty high bytes cost nothing."""
    return squeeze(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1).T.copy().view("<u8").reshape(-1)


class Grams:
    """The n-grams of a chunk: word codes, and for each order where its n-grams start and their place among the distinct hashes."""

    def __init__(self, data: bytes, order: int) -> None:
        import xxhash

        self.doc_ids, texts = unpack(data)
        words, codes, self.counts = number_words(texts)
        hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)[codes] if words else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(texts)), self.counts)
        found, self.starts, self.docs = [], [], []
        rolling = np.zeros(len(codes), np.uint64)
        for n in range(1, order + 1):
            m = max(len(codes) - n + 1, 0)
            rolling = mix(rolling[:m] * np.uint64(MULTIPLIERS[0]) + hashed[n - 1 :] + np.uint64(MULTIPLIERS[n % 5]))
            whole = np.flatnonzero(doc[:m] == doc[n - 1 :]) if m else np.zeros(0, np.int64)
            found.append(rolling[whole] >> np.uint64(64 - HASH_BITS))
            self.starts.append(whole)
            self.docs.append(doc[whole])
        every = np.concatenate(found)
        self.hashes, self.places, self.totals = np.unique(every, return_inverse=True, return_counts=True)
        self.places = np.split(self.places.reshape(-1), np.cumsum([len(f) for f in found])[:-1])

    def bounds(self, n_parts: int) -> np.ndarray:
        """Where each part's share of the sorted hashes starts."""
        edges = [(1 << HASH_BITS) * p // n_parts for p in range(n_parts)]
        return np.append(np.searchsorted(self.hashes, np.array(edges, np.uint64)), len(self.hashes))


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_words, log_score (sum over words of ln S), mean_log_score; one per input row.

    S of a word after its one or two predecessors in the text is count(n-gram) / count(context) where
    the n-gram occurs in other documents, else ``backoff`` times S with a shorter context; a word
    without context has count / words, and one that no other document has 1 / (words + 1). All counts
    are over all documents less this one.

    Null, empty and blank texts have n_words 0, log_score 0 and null mean. Repeated rows are separate
    documents, so that copies know each other's n-grams. A null id stays null; an empty table gives an
    empty table. Columns beside the two named are not read.
    """
    n_parts = parts(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    all_words = source.agg(F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0))).first()[0]
    chunks = pack(source, CHUNK_BYTES)

    def request(data: bytes) -> Iterator[tuple[int, bytes]]:
        grams = Grams(data, order)
        bounds = grams.bounds(n_parts)
        for part in np.flatnonzero(np.diff(bounds)).tolist():
            mine = slice(bounds[part], bounds[part + 1])
            steps, counts = planes(np.diff(grams.hashes[mine], prepend=np.uint64(0))), planes(grams.totals[mine])
            yield part, len(steps).to_bytes(4, "little") + steps + counts

    def resolve(payloads: list[bytes]) -> list[bytes]:
        asked, counts = [], []
        for p in payloads:
            n = int.from_bytes(p[:4], "little")
            asked.append(np.cumsum(numbers(p[4 : 4 + n]), dtype=np.uint64))
            counts.append(numbers(p[4 + n :]))
        table, place = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(place.reshape(-1), np.concatenate(counts).astype(np.float64), len(table)).astype(np.uint64)
        return [planes(totals[np.searchsorted(table, one)]) for one in asked]

    def finish(data: bytes, replies: dict[int, bytes]) -> pa.Table:
        grams = Grams(data, order)
        bounds = grams.bounds(n_parts)
        totals = np.zeros(len(grams.hashes), np.int64)
        for part in np.flatnonzero(np.diff(bounds)).tolist():
            totals[bounds[part] : bounds[part + 1]] = numbers(replies[part]).astype(np.int64)
        others = []  # by order: occurrences in other documents, at each n-gram's start
        n_docs, width = len(grams.counts), len(grams.hashes)
        for starts, place, doc in zip(grams.starts, grams.places, grams.docs):
            _, mine, own = np.unique(doc * width + place, return_inverse=True, return_counts=True)
            at = np.zeros(int(grams.counts.sum()), np.int64)
            at[starts] = totals[place] - own[mine.reshape(-1)]
            others.append(at)
        left = np.maximum(all_words - np.repeat(grams.counts, grams.counts), 0)
        s = np.where(others[0] > 0, others[0] / np.maximum(left, 1), 1 / (left + 1)) if len(left) else np.zeros(0)
        doc = np.repeat(np.arange(n_docs), grams.counts)
        place_in_doc = np.arange(len(doc)) - np.repeat(np.cumsum(grams.counts) - grams.counts, grams.counts)
        for n in range(2, order + 1):
            longer = np.flatnonzero(place_in_doc >= n - 1)
            seen, context = others[n - 1][longer - n + 1], others[n - 2][longer - n + 1]
            s[longer] = np.where(seen > 0, seen / np.maximum(context, 1), backoff * s[longer])
        sums = np.bincount(doc, np.log(s), n_docs) if len(doc) else np.zeros(n_docs)
        words = grams.counts
        means = np.divide(sums, words, out=np.zeros(n_docs), where=words > 0)
        return pa.table([grams.doc_ids, pa.array(words, pa.int64()), pa.array(sums), pa.array(means, mask=words == 0)], names=["doc_id", "n_words", "log_score", "mean_log_score"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return meet(chunks, answer(ask(chunks, request), resolve), finish, f"doc_id {kind}, n_words bigint, log_score double, mean_log_score double")
