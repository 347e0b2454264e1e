"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles, weight = count * idf. Improved consistent
weighted sampling draws from it SAMPLES (shingle, level) pairs; two texts draw the same pair with a
probability equal to their weighted Jaccard similarity. Bands of three samples are bucket keys.
Texts that share a bucket are candidates, and candidates are verified on the exact similarity.

The inverse document frequency is taken over hashed shingles (IDF_BUCKETS counters, a fixed size) of
all documents, and scaled to 1..2: a passage that many documents share counts half as much as an own
sentence, and a large group of copies doesn't make the few words in which its members differ count
for more than all they share.

Buckets are never expanded into rows of pairs. Members are first held against one leader; only
buckets whose members are still in several classes are looked at again, small ones pair by pair
across classes, larger ones in blocks of BLOCK members, each block against each: a task compares the
samples of two blocks, and the shingles of all pairs across classes that are left by matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.chunks import parts, squeeze, unsqueeze
from tickloom.llm.common import WORD, per_batch, raw_texts, tidy, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
IDF_BITS = 20
IDF_BUCKETS = 1 << IDF_BITS
SLICE = 256
#: Buckets up to this size are compared pair by pair across classes.
SMALL = 24
#: Of SAMPLES, a pair at the threshold shares at least so many but in one of a million cases.
LEAST_SHARED = 16
#: Members of a block of a larger bucket.
BLOCK = 256
#: Shingles of a matrix product, and how far its single precision may be off.
PRODUCT_COLUMNS, SINGLE = 4096, 1e-4
#: Shingles drawn from at a time, so that what is in work stays in a core's cache.
COLUMNS = 512

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes, with their counts. A text of one to four words is one shingle."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        words = text.split()
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = self.known
        if len(known) > 100_000:
            known.clear()
        codes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            codes.append(h)
        code = np.array(codes, np.uint64)
        width = min(WORDS, len(words))
        total = np.zeros(len(words) - width + 1, np.uint64)
        for i in range(width):
            total += code[i : len(code) - width + 1 + i] * MULTIPLIERS[i]
        return np.unique(mix(total), return_counts=True)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents per hashed shingle, and documents with words. Tasks send their counters in slices, which are summed slice by slice."""
    import zstandard

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, docs_seen, shingle = np.zeros(IDF_BUCKETS, np.int64), 0, Shingler()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in raw_texts(batch.column(0)):
                hashes, _ = shingle(text)
                if len(hashes):
                    docs_seen += 1
                    places = (hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)
                    held.append(places[np.diff(places, prepend=-1) > 0])  # a counter once per document; hashes come sorted
                    size += len(places)
                    if size > IDF_BUCKETS:
                        totals += np.bincount(np.concatenate(held), minlength=IDF_BUCKETS)
                        held, size = [], 0
        if held:
            totals += np.bincount(np.concatenate(held), minlength=IDF_BUCKETS)
        if docs_seen:
            slices = [zstandard.compress(x.tobytes()) for x in totals.reshape(-1, SLICE)]
            numbers = np.arange(len(slices), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(slices, pa.binary()), pa.array(np.where(numbers == 0, docs_seen, 0))], ["slice", "counts", "docs"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in table["counts"]:
            total += np.frombuffer(zstandard.decompress(x.as_py()), np.int64)
        return pa.table([table["slice"][:1], pa.array([total.tobytes()], pa.binary()), pa.array([sum(table["docs"].to_pylist())], pa.int64())], names=["slice", "counts", "docs"])

    schema = "slice int, counts binary, docs bigint"
    summed = docs.select(F.col(text_col).cast("string")).mapInArrow(tidy(count), schema).groupBy("slice").applyInArrow(add, schema).toArrow()
    frequencies = np.zeros(IDF_BUCKETS, np.int64)
    for number, counts in zip(summed["slice"].to_pylist(), summed["counts"].to_pylist()):
        frequencies[number * SLICE : (number + 1) * SLICE] = np.frombuffer(counts, np.int64)
    return frequencies, sum(summed["docs"].to_pylist())


def inverse_frequencies(frequencies: np.ndarray, n_docs: int) -> np.ndarray:
    """1 for a shingle in every document, up to 2 for one in none."""
    top = np.log1p(max(n_docs, 1))
    return (1 + np.clip(top - np.log1p(frequencies), 0, None) / top).astype(np.float32)


class Weigher:
    """The shingles of a text with their weights and their counts."""

    def __init__(self, idf: np.ndarray) -> None:
        self.idf, self.shingle = idf, Shingler()

    def __call__(self, text: bytes) -> tuple[np.ndarray, ...]:
        hashes, counts = self.shingle(text)
        return hashes, counts * self.idf[(hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)], counts


def weighted_jaccard(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Sum of the smaller over sum of the larger weights, the greatest over the kinds of weights given; 0 for two empty sets.

    A text has its TF-IDF weights and its counts: in a large group of copies idf takes weight off what
    all share, and texts whose plain shingles agree must not fall below the threshold for that.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    best = 0.0
    for x, y in zip(a[1:], b[1:]):
        common = float(np.minimum(x[i], y[j]).sum(dtype=np.float64))
        best = max(best, common / (float(x.sum(dtype=np.float64) + y.sum(dtype=np.float64)) - common))
    return best


class Sampler:
    """Improved consistent weighted sampling. Gamma(2, 1) draws come from tables of 65,536 quantiles, indexed by bits of a hash of shingle and sample."""

    def __init__(self) -> None:
        q = (np.arange(65536) + 0.5) / 65536
        x = np.full(65536, 1.7)
        low, high = np.zeros(65536), np.full(65536, 40.0)
        for _ in range(60):
            x = (low + high) / 2
            below = 1 - (1 + x) * np.exp(-x) < q
            low, high = np.where(below, x, low), np.where(below, high, x)
        self.gamma, self.log_gamma = x.astype(np.float32), np.log(x).astype(np.float32)
        self.seeds = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * MULTIPLIERS[0])[:, None]

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        best = np.full(SAMPLES, np.inf, np.float32)
        drawn = np.zeros(SAMPLES, np.uint64)
        log_weights = np.log(weights).astype(np.float32)
        every = np.arange(SAMPLES)
        for start in range(0, len(hashes), COLUMNS):
            mine = hashes[start : start + COLUMNS]
            bits = mine[None] ^ self.seeds
            bits *= MULTIPLIERS[1]
            bits ^= bits >> np.uint64(32)
            bits *= MULTIPLIERS[3]
            bits ^= bits >> np.uint64(29)
            fields = bits.view(np.uint16).reshape(SAMPLES, -1, 4)
            r = self.gamma[fields[:, :, 0]]
            level = fields[:, :, 2] * np.float32(1 / 65536)
            beta = level.copy()
            level += log_weights[start : start + COLUMNS] / r
            np.floor(level, out=level)
            beta -= level
            beta -= 1
            beta *= r
            cost = beta
            cost += self.log_gamma[fields[:, :, 1]]
            at = cost.argmin(axis=1)
            least = cost[every, at]
            better = least < best
            best = np.where(better, least, best)
            pair = mix(mine[at] + level[every, at].astype(np.int64).astype(np.uint64) * MULTIPLIERS[4])
            drawn = np.where(better, pair, drawn)
        return drawn.view(np.int64)


def sign(docs: DataFrame, idf: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (MD5 of the text), samples (null for a text without words), one per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, sample = Weigher(idf), Sampler()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            drawn = []
            for text in raw_texts(batch.column(2)):
                hashes, weights, _ = weigh(text)
                drawn.append(sample(hashes, weights) if len(hashes) else None)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(drawn, pa.list_(pa.int64()))], ["doc_id", "key", "samples"])

        yield from per_batch(work)(batches)

    source = keyed(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"doc_id {kind}, key binary, samples array<bigint>")


def keyed_by(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), keyed_by(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))


def bands(nodes: DataFrame) -> DataFrame:
    """bucket, key: a row for each node and band."""
    keys = [F.xxhash64(F.lit(b), *[F.element_at("samples", b * ROWS + r + 1) for r in range(ROWS)]) for b in range(BANDS)]
    return nodes.select(F.explode(F.array(*keys)).alias("bucket"), "key")


def stars(buckets: DataFrame, salts: Sequence[int]) -> DataFrame:
    """left, right: each member of a bucket of two or more with the bucket's leaders, one for each salt."""
    lead = [F.min(F.struct(F.xxhash64(F.lit(salt), "key").alias("h"), "key"))["key"] for salt in salts]
    leaders = buckets.groupBy("bucket").agg(F.array_distinct(F.array(*lead)).alias("leaders"), F.count("*").alias("n")).where("n > 1")
    leaders = written(leaders.select("bucket", F.explode("leaders").alias("leader")), "near-leaders")
    return buckets.join(leaders, "bucket").where("key <> leader").select(F.col("leader").alias("left"), F.col("key").alias("right"))


def one_way(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that share at least LEAST_SHARED samples."""
    drawn = nodes.select(F.col("key").alias("_k"), F.col("samples").alias("_s"))
    shown = pairs.join(drawn.alias("a"), F.col("left") == F.col("a._k")).join(drawn.alias("b"), F.col("right") == F.col("b._k"))
    shared = F.size(F.filter(F.zip_with("a._s", "b._s", lambda x, y: x == y), lambda same: same))
    return shown.where(shared >= LEAST_SHARED).select("left", "right")


def texts_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, text: each wanted text once."""
    return keyed(docs, id_col, text_col).select("key", "text").join(keys, "key", "left_semi").dropDuplicates(["key"])


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """left, right, similarity of the pairs at or above the threshold, from the whole texts."""
    right = texts.select(F.col("key").alias("right"), F.col("text").alias("right_text"))
    left = texts.select(F.col("key").alias("left"), F.col("text").alias("left_text"))
    joined = written(pairs.join(right, "right"), "near-sides").join(left, "left").select("left", "right", "left_text", "right_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(idf)
        last: tuple[bytes, tuple[np.ndarray, ...]] | None = None
        for batch in batches:
            keep, scores = [], []
            for i, (key, a, b) in enumerate(zip(batch.column(0).to_pylist(), raw_texts(batch.column(2)), raw_texts(batch.column(3)))):
                if last is None or last[0] != key:
                    last = key, weigh(a)
                score = weighted_jaccard(last[1], weigh(b))
                if score >= threshold:
                    keep.append(i)
                    scores.append(score)
            if keep:
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(keep)) for c in (0, 1)], pa.array(scores, pa.float64())], ["left", "right", "similarity"])

    return joined.mapInArrow(tidy(run), "left binary, right binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component. Labels spread along edges and jump to their label's label."""
    both = written(edges.select("left", "right").union(edges.select(F.col("right").alias("left"), F.col("left").alias("right"))), "near-edges")
    labels = both.groupBy(F.col("left").alias("node")).agg(F.min("right").alias("label"))
    labels = written(labels.select("node", F.least("node", "label").alias("label")), "near-labels")
    while True:
        spread = both.join(labels, both["left"] == labels["node"]).groupBy("right").agg(F.min("label").alias("heard"))
        heard = written(labels.join(spread, labels["node"] == spread["right"], "left").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old")), "near-heard")
        target = heard.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        jumped = heard.join(target, heard["label"] == target["_node"], "left").select("node", F.least("label", "_label").alias("label"), "old")
        jumped = written(jumped, "near-labels")
        moved = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels


def mixed_only(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, key, label) of buckets whose members are in several classes, with the members n."""
    kinds = rows.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).where("a <> b")
    kinds = written(kinds.select("bucket", "n"), "near-mixed")
    return written(rows.join(kinds, "bucket"), "near-members")


def across(pairs: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs of different classes that share enough samples."""
    known = labels.select(F.col("node").alias("_k"), F.col("label").alias("_l"))
    apart = one_way(pairs).join(known.alias("a"), F.col("left") == F.col("a._k"), "left").join(known.alias("b"), F.col("right") == F.col("b._k"), "left").where(
        F.coalesce(F.col("a._l"), F.col("left")) != F.coalesce(F.col("b._l"), F.col("right"))
    )
    return plausible(apart.select("left", "right"), nodes)


def labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets whose members are in several classes: bucket, key, label, n."""
    known = labels.select(F.col("node").alias("_k"), F.col("label").alias("_l"))
    return mixed_only(buckets.join(known, F.col("key") == F.col("_k"), "left").select("bucket", "key", F.coalesce("_l", "key").alias("label")))


def second_looks(mixed: DataFrame) -> DataFrame:
    """All pairs across classes of the small buckets."""
    small = mixed.where(F.col("n") <= SMALL)
    mates = small.select("bucket", F.col("key").alias("right"), F.col("label").alias("right_label"))
    return small.join(mates, "bucket").where("key < right AND label <> right_label").select(F.col("key").alias("left"), "right")


class Block:
    """Members of a bucket: keys, labels, samples (a row each) and texts."""

    def __init__(self, data: bytes) -> None:
        rows = pa.ipc.open_stream(unsqueeze(data)).read_all().combine_chunks()
        self.keys, self.labels = rows["key"].to_pylist(), rows["label"].to_pylist()
        self.samples = np.array(rows["samples"].to_pylist(), np.int64).reshape(-1, SAMPLES)
        self.texts = raw_texts(rows["text"].combine_chunks())


def likely(a: Block, b: Block, same: bool) -> np.ndarray:
    """Which pairs of two blocks of a bucket to compare: of different classes, sharing enough samples, and meeting in no bucket of an earlier band."""
    names: dict[bytes, int] = {}
    left, right = (np.array([names.setdefault(x, len(names)) for x in block.labels]) for block in (a, b))
    wanted = left[:, None] != right[None]
    if same:
        wanted = np.triu(wanted, 1)
    if not wanted.any():
        return wanted
    every = np.concatenate([a.samples, b.samples])
    agreed = (every == every[0]).all(axis=0).reshape(BANDS, ROWS).all(axis=1)
    mine = int(agreed.argmax())  # the band of this bucket, or an earlier one that all share as well
    shared = np.zeros(wanted.shape, np.uint8)
    for band in range(BANDS):
        equal = [a.samples[:, None, s] == b.samples[None, :, s] for s in range(band * ROWS, (band + 1) * ROWS)]
        shared += np.sum(equal, axis=0, dtype=np.uint8)
        if band < mine:
            wanted &= ~np.all(equal, axis=0)
    return wanted & (shared >= LEAST_SHARED)


def occurrences(weighed: Sequence[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts, one entry per occurrence of a shingle: hash of shingle and number of the occurrence, idf, text."""
    hashes, weights, counts = (np.concatenate(x) for x in zip(*weighed))
    text = np.repeat(np.arange(len(weighed)), [len(x[0]) for x in weighed])
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(hashes, counts) + number.astype(np.uint64) * MULTIPLIERS[4]), np.repeat(weights / counts, counts), np.repeat(text, counts)


def all_similarities(left: Sequence[tuple[np.ndarray, ...]], right: Sequence[tuple[np.ndarray, ...]]) -> np.ndarray:
    """``weighted_jaccard`` of each text with each, to within SINGLE."""
    sides = [occurrences(left), occurrences(right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    idf = np.zeros(len(common))
    found = []
    for features, weights, text in sides:
        at = np.searchsorted(common, features)
        known = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == features) if len(common) else np.zeros(0, np.int64)
        known = known[np.argsort(at[known], kind="stable")]
        idf[at[known]] = weights[known]
        found.append((at[known], text[known]))
    plain, weighted = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)))
    for start in range(0, len(common), PRODUCT_COLUMNS):
        stop = min(start + PRODUCT_COLUMNS, len(common))
        x, y = (np.zeros((len(side), stop - start), np.float32) for side in (left, right))
        for matrix, (at, text) in zip((x, y), found):
            here = slice(*np.searchsorted(at, [start, stop]))
            matrix[text[here], at[here] - start] = 1
        plain += x @ y.T
        weighted += (x * idf[start:stop].astype(np.float32)) @ y.T
    best = np.zeros(plain.shape)
    for kind, both in ((1, weighted), (2, plain)):
        a, b = (np.array([float(x[kind].sum(dtype=np.float64)) for x in side]) for side in (left, right))
        best = np.maximum(best, both / (a[:, None] + b[None] - both))
    return best


def links_of_blocks(a: Block, b: Block, same: bool, weigh: Weigher, threshold: float) -> list[tuple[bytes, bytes, float]]:
    """Links across classes between two blocks, as many as join what all their links join."""
    wanted = likely(a, b, same)
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(rows):
        return []
    left, right = [weigh(a.texts[i]) for i in rows], [weigh(b.texts[j]) for j in columns]
    near = np.where(wanted[np.ix_(rows, columns)], all_similarities(left, right), 0)
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    links = []
    for i, j in zip(*np.nonzero(near >= threshold - SINGLE)):
        p, q = root(a.labels[rows[i]]), root(b.labels[columns[j]])
        if p != q and (score := weighted_jaccard(left[i], right[j])) >= threshold:
            parent[p] = q
            links.append((*sorted((a.keys[rows[i]], b.keys[columns[j]])), score))
    return links


def block_links(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """left, right, similarity: what links the classes of the larger buckets, from all pairs across classes.

    A bucket of m blocks makes about m * m / 2 rows, each of two blocks; a block is the first of half of its rows.
    """
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = mixed.where(F.col("n") > SMALL).select("bucket", "key", "label", n_blocks.alias("m"))
    placed = large.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "key"), F.col("m")).cast("int"))
    members = placed.join(nodes.select("key", "samples"), "key").join(texts, "key").select("bucket", "block", "key", "label", "samples", "text")

    def gather(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        rows = table.select(["key", "label", "samples", "text"])
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return pa.table([table["bucket"][:1], table["block"][:1], pa.array([squeeze(sink.getvalue().to_pybytes())], pa.binary())], names=["bucket", "block", "data"])

    blocks = written(members.groupBy("bucket", "block").applyInArrow(gather, "bucket bigint, block int, data binary"), "near-blocks")
    firsts = large.select("bucket", "m").distinct().select("bucket", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("first"))
    met = firsts.select("bucket", "m", "first", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 2).cast("int"))).alias("step"))
    met = met.where("2 * step < m OR first < step").select("bucket", "first", F.pmod(F.col("first") + F.col("step"), F.col("m")).alias("second"))
    one = blocks.select("bucket", F.col("block").alias("first"), F.col("data").alias("a"))
    other = blocks.select("bucket", F.col("block").alias("second"), F.col("data").alias("b"))
    sides = met.join(one, ["bucket", "first"]).join(other, ["bucket", "second"])
    # a row is little data and much work, so that sizes must not decide on the number of tasks
    sides = sides.repartition(parts(mixed.sparkSession), "bucket", "first", "second").select((F.col("first") == F.col("second")).alias("same"), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = Weigher(idf)
        for batch in batches:
            for same, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                links = links_of_blocks(Block(a.as_py()), Block(b.as_py()), same, weigh, threshold)
                if links:
                    left, right, scores = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(scores, pa.float64())], ["left", "right", "similarity"])

    return sides.mapInArrow(tidy(run), "left binary, right binary, similarity double")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows doc_id, class_id, kept, key, one per row of ``docs``: the least id of the document's class, whether the row is the one to keep, the MD5 of its text.

    Documents with the same text are one class; so are texts linked by a similarity of at least
    ``threshold``, directly or through others. Null, empty and blank texts are in no such class: each
    row is its own and kept. A text under five words is one shingle, so that only its copies match.
    Of several rows with the least id one is kept. Null ids come after all others. An
    empty table gives an empty table. Columns beside the two named are not read.
    """
    frequencies, n_docs = document_frequencies(docs, text_col)
    idf = inverse_frequencies(frequencies, n_docs)
    signed = written(sign(docs, idf, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    nodes = signed.where("samples IS NOT NULL").groupBy("key").agg(F.first("samples").alias("samples"))
    nodes = written(nodes, "near-nodes")
    buckets = written(bands(nodes), "near-buckets")
    shared = written(buckets.groupBy("bucket").count().where("count > 1").select("bucket"), "near-shared")
    buckets = written(buckets.join(shared, "bucket"), "near-buckets")
    texts = written(texts_of(docs, buckets.select("key").distinct(), id_col, text_col), "near-texts")
    tested = written(plausible(one_way(stars(buckets, [0])), nodes), "near-pairs")
    links = written(verify(tested, texts, idf, threshold), "near-links")
    labels = components(links)
    mixed = labelled(buckets, labels)
    pairs = written(across(second_looks(mixed), labels, nodes).join(tested, ["left", "right"], "left_anti"), "near-pairs")
    found = written(verify(pairs, texts, idf, threshold).union(block_links(mixed, nodes, texts, idf, threshold)), "near-links")
    if found.take(1):
        labels = components(links.union(found))
    best = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    ids = signed.where("samples IS NOT NULL").groupBy("key").agg(F.min(best).alias("best"))
    ids = ids.join(labels, ids["key"] == labels["node"], "left").select("key", "best", F.coalesce("label", "key").alias("label"))
    ids = written(ids, "near-ids")
    lead = written(ids.groupBy(F.col("label").alias("_label")).agg(F.min("best").alias("lead")), "near-lead")
    classes = ids.join(lead, ids["label"] == lead["_label"]).select(F.col("key").alias("_key"), "lead")
    classes = written(classes, "near-classes")
    joined = signed.select("doc_id", "key", "row", F.col("samples").isNotNull().alias("wordy")).join(classes, F.col("key") == F.col("_key"), "left")
    return joined.select(
        "doc_id", F.when(F.col("wordy"), F.col("lead.doc_id")).otherwise(F.col("doc_id")).alias("class_id"),
        (~F.col("wordy") | (F.col("row") == F.col("lead.row"))).alias("kept"), "key",
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, that ``near_duplicates`` keeps."""
    found = near_duplicates(docs, threshold, id_col, text_col)
    stay = written(found.where("kept").select(F.col("doc_id").alias("stay_id"), F.col("key").alias("stay_key")), "near-stay")
    nested = docs.select(F.struct("*").alias("row"))
    text = F.col("row")[text_col].cast("string")
    marked = nested.withColumns({"id": F.col("row")[id_col], "key": keyed_by(text), "worded": F.coalesce(text.rlike(WORD), F.lit(False))})
    kept = marked.where("worded").join(stay, (F.col("key") == F.col("stay_key")) & F.col("id").eqNullSafe(F.col("stay_id")), "left_semi")
    return kept.dropDuplicates(["id", "key"]).select("row.*").union(marked.where("NOT worded").select("row.*"))
