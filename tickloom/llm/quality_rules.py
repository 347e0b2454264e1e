"""Quality rules: counts of a text, and perplexity bands of a modified Kneser-Ney model over words.

The model is one of word pairs. Documents are packed into chunks of word codes. A chunk sends the hashes
of its distinct pairs and their counts to hash parts; a part is a sorted array of hashes with the totals of
all documents, and answers with them. It also names one chunk as the owner of each pair, so that every
distinct pair is counted once when the chunks then add up, word by word, how many words were seen before
and behind it. Those sums lie in sorted arrays of word hashes, by parts too. Only sums over the whole
corpus (a handful of counts of counts) reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.chunks import parts, squeeze, unsqueeze
from tickloom.llm.common import raw_texts, tidy, written
from tickloom.llm.lm_scoring import MULTIPLIERS, mix, numbers, planes
from tickloom.session import scratch_path

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS = 50
#: Documents of all languages that stand behind the band of each: a language of n documents weighs n to this.
PRIOR_DOCS = 30.0
#: Bytes of text in a chunk; a longer document ends the chunk it is in.
CHUNK_BYTES = 10_000_000
#: Bytes of packed chunks behind each hash part.
PART_BYTES = 64_000_000
#: Bits of a pair's hash beyond those that number the words of the corpus: one pair in 8,192 shares its hash at most, at any size.
SPARE_BITS = 13
WORD_BITS = 48
#: Stands before the first word of a text.
START = 0x5BD1E995A5A5
CELLS = ["docs", "hashes", "codes"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """0, D1, D2, D3+ from how many entries occur 1, 2, 3, 4 times; the usual 0.5, 1, 1.5 where one of them is none."""
    n = [0.0, *map(float, counts_of_counts)]
    if min(n[1:]) == 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([0.0, *[min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]])


@dataclass
class Totals:
    """Sums over the corpus: distinct pairs, words with a pair before them, and the discounts of both levels."""

    pairs: int
    words: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_mass: float

    def word_probability(self, before: np.ndarray) -> np.ndarray:
        """p(word) by the number of distinct words before it; the mass left goes to all words and one unknown alike."""
        if not self.pairs:
            return np.ones(len(before))
        return (before - self.word_discounts[np.minimum(before, 3)] + self.word_mass / (self.words + 1)) / self.pairs

    def nats(self, pair: np.ndarray, context: np.ndarray, left: np.ndarray, before: np.ndarray) -> np.ndarray:
        """-log p(word | word before): count of the pair, count and discounted mass of its context, words before the word."""
        lower = self.word_probability(before)
        total = np.maximum(context, 1)
        p = np.where(context > 0, (pair - self.pair_discounts[np.minimum(pair, 3)] + left * lower) / total, lower)
        return -np.log(p)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    place: dict[bytes, int] = {}
    code = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, n)
    if len(place) == n:
        return 0
    if len(place) < 2**20:
        window = (code[:-2] << 40) | (code[1:-1] << 20) | code[2:]
    else:
        pair = np.unique(code[:-1] * len(place) + code[1:], return_inverse=True)[1]
        window = pair[:-1] * len(place) + code[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def text_counts(text: bytes, kinds: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. ``kinds``: 1 starts a code point of a word, 3 also is a symbol."""
    words = text.split()
    if not words:
        return 0, 0, 0, 0, 0
    kind = kinds[np.frombuffer(text, np.uint8)]
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(words), int(np.count_nonzero(kind)), int(np.count_nonzero(kind == 3)), len(lines) - len(set(lines)), repeated_words(words)


def byte_kinds() -> np.ndarray:
    kinds = np.ones(256, np.uint8)
    kinds[0x80:0xC0] = 0
    kinds[list(SPACES)] = 0
    kinds[list(SYMBOLS)] = 3
    return kinds


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that made them has written its table, which is all that later jobs read."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def bundle(*arrays: np.ndarray) -> bytes:
    """Unsigned numbers, array by array."""
    packed = [planes(a) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in packed)


def unbundle(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(numbers(data[at + 8 : at + 8 + n]).astype(np.int64))
        at += 8 + n
    return out


def pack(source: DataFrame) -> DataFrame:
    """chunk, words (their number), docs, hashes, codes: rows and counts of whole documents, hashes of their distinct words, words as codes.

    A table bucketed by chunk. Everything later reads it, so that a chunk may be numbered by its task.
    """
    import xxhash

    spark = source.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, kinds = TaskContext.get().partitionId(), byte_kinds()
        place: dict[bytes, int] = {}
        rows: list[pa.RecordBatch] = []
        codes: list[np.ndarray] = []
        made = size = 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema) as out:
                for piece in rows:
                    out.write_batch(piece)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in place), np.uint64, len(place)) >> np.uint64(64 - WORD_BITS)
            every = np.concatenate(codes)
            order = np.lexsort((hashes, -np.bincount(every, minlength=len(place))))  # frequent words get small codes, rare ones near hashes
            code = np.empty(len(order), np.uint32)
            code[order] = np.arange(len(order), dtype=np.uint32)
            steps = np.diff(hashes[order], prepend=np.uint64(0)) & np.uint64((1 << WORD_BITS) - 1)
            cells = [[task << 24 | made], [len(every)], [squeeze(sink.getvalue().to_pybytes())], [planes(steps)], [planes(code[every])]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), *[pa.binary()] * 3))], ["chunk", "words", *CELLS])

        for batch in batches:
            first, counts = 0, []

            def keep(stop: int) -> None:
                kept = [batch.column(k).slice(first, stop - first) for k in (0, 1, 3, 4)]
                columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
                rows.append(pa.RecordBatch.from_arrays([*kept, *columns], ["doc_id", "lang", "counted", "judged", *COUNTS]))

            for i, text in enumerate(raw_texts(batch.column(2))):
                words = text.split()
                counts.append(text_counts(text, kinds))
                codes.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.uint32, len(words)))
                size += len(text)
                if size >= CHUNK_BYTES:
                    keep(i + 1)
                    yield flush()
                    made, size, first, counts = made + 1, 0, i + 1, []
                    place, rows, codes = {}, [], []
            if counts:
                keep(batch.num_rows)
        if rows:
            yield flush()

    path, name = scratch_path(spark, "quality-chunks"), f"quality_{uuid.uuid4().hex}"
    packed = source.mapInArrow(tidy(work), "chunk bigint, words bigint, docs binary, hashes binary, codes binary")
    packed.write.format("parquet").option("path", path).bucketBy(2 * parts(spark), "chunk").saveAsTable(name)
    return spark.table(name)


class Chunk:
    """Pairs of a chunk: distinct hashes, the codes of each one's words, its count here, and the place of every word's pair."""

    def __init__(self, bits: int, docs: bytes, hashes: bytes, codes: bytes) -> None:
        self.docs = pa.ipc.open_stream(unsqueeze(docs)).read_all().combine_chunks()
        self.lengths = self.docs["n_words"].to_numpy()
        self.words = np.append(np.cumsum(numbers(hashes), dtype=np.uint64) & np.uint64((1 << WORD_BITS) - 1), np.uint64(START))
        self.codes = numbers(codes).astype(np.int64)
        before = np.append(len(self.words) - 1, self.codes[:-1])[: len(self.codes)]
        before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = len(self.words) - 1
        key = mix(self.words[before] * np.uint64(MULTIPLIERS[0]) + self.words[self.codes] * np.uint64(MULTIPLIERS[1]) + np.uint64(MULTIPLIERS[2]))
        self.hashes, first, place = np.unique(key >> np.uint64(64 - bits), return_index=True, return_inverse=True)
        self.place = place.reshape(-1)
        self.left, self.right = before[first], self.codes[first]
        seen = np.repeat(self.docs["counted"].to_numpy(zero_copy_only=False), self.lengths)
        self.n = np.bincount(self.place[seen], minlength=len(self.hashes))
        keys = self.words >> np.uint64(WORD_BITS - min(bits, WORD_BITS))
        self.word_order = np.argsort(keys, kind="stable")
        self.word_keys = keys[self.word_order]

    def by_document(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair and how often, for the distinct pairs of each document."""
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        both, times = np.unique(doc * len(self.hashes) + self.place, return_counts=True)
        return both // max(len(self.hashes), 1), both % max(len(self.hashes), 1), times

    def sums(self, values: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whole-number sums by word, in the order of ``word_keys``."""
        return np.bincount(code, values, len(self.words)).astype(np.int64)[self.word_order]


def slices(keys: np.ndarray, bits: int, n_parts: int) -> Iterator[tuple[int, slice]]:
    """Hash parts that sorted keys touch, and where."""
    edges = np.array([(1 << bits) * p // n_parts for p in range(n_parts)], np.uint64)
    bounds = np.append(np.searchsorted(keys, edges), len(keys))
    for part in np.flatnonzero(np.diff(bounds)).tolist():
        yield part, slice(bounds[part], bounds[part + 1])


def requests(keys: np.ndarray, values: list[np.ndarray], bits: int, n_parts: int) -> Iterator[tuple[int, bytes]]:
    for part, mine in slices(keys, bits, n_parts):
        yield part, bundle(np.diff(keys[mine], prepend=np.uint64(0)), *[v[mine] for v in values])


def replies(keys: np.ndarray, by_part: dict[int, bytes], width: int, bits: int, n_parts: int) -> list[np.ndarray]:
    """The answers to ``requests`` in the order of the keys, ``width`` values each."""
    out = [np.zeros(len(keys), np.int64) for _ in range(width)]
    for part, mine in slices(keys, bits, n_parts):
        for whole, piece in zip(out, unbundle(by_part[part])):
            whole[mine] = piece
    return out


def summed(asked: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """The part's sorted table: place of every key asked for, sums of each value by key, first of the askers of each key."""
    arrays = [unbundle(a) for a in asked]
    _, first, place = np.unique(np.concatenate([np.cumsum(a[0]) for a in arrays]), return_index=True, return_inverse=True)
    totals = [np.bincount(place.reshape(-1), np.concatenate(v), len(first)).astype(np.int64) for v in list(zip(*arrays))[1:]]
    cuts = np.cumsum([len(a[0]) for a in arrays])[:-1]
    return np.split(place.reshape(-1), cuts), totals, first


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


ROW = "part int, chunk bigint, payload binary, sums array<bigint>"


def rows_of(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, kinds)], names=["part", "chunk", "payload", "sums"])


def grouped(asked: DataFrame, n_parts: int, work) -> DataFrame:
    """``work`` of all requests to each part, in the order of their chunks, so that it answers alike when run again."""

    def resolve(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        return rows_of(work(table["part"][0].as_py(), table["chunk"].to_pylist(), table["payload"].to_pylist()))

    return asked.select("part", "chunk", "payload").repartition(n_parts, "part").groupBy("part").applyInArrow(tidy(resolve), ROW)


def pair_totals(part: int, chunks: list[int], asked: list[bytes]) -> list[tuple]:
    """Twice the total of each pair, and one more for the chunk that owns it; under chunk -1 the distinct pairs and their counts of counts."""
    places, (totals,), first = summed(asked)
    ends = np.cumsum([len(p) for p in places])
    out = []
    for chunk, place, end in zip(chunks, places, ends.tolist()):
        owned = first[place] == np.arange(end - len(place), end)
        out.append((part, chunk, bundle(totals[place] * 2 + owned), None))
    return [*out, (part, -1, None, [int((totals > 0).sum()), *counts_of_counts(totals)])]


def word_totals(part: int, chunks: list[int], asked: list[bytes]) -> list[tuple]:
    """Sums of each word; beside them, under chunk -1, what the discounts of words need."""
    places, totals, _ = summed(asked)
    before = totals[-1]
    out = [(part, chunk, bundle(*[t[place] for t in totals]), None) for chunk, place in zip(chunks, places)]
    kinds = np.bincount(np.minimum(before, 3), minlength=4)[1:4].tolist()
    return [*out, (part, -1, None, [*kinds, *counts_of_counts(before)])]


def score_texts(source: DataFrame) -> DataFrame:
    """Rows of ``source`` (doc_id, lang, text, counted, judged) that are judged: doc_id, lang, the counts, nats and nats_others.

    nats is the mean negative log probability of a word, null without words. Texts marked ``counted`` are the model's.
    nats_others is the same with the text's own pairs taken off the counts of pairs and contexts.
    """
    spark = source.sparkSession
    chunks = pack(source)
    n_words, size = chunks.agg(F.sum("words"), F.sum(F.length("codes") + F.length("hashes"))).first()
    bits = min((n_words or 0).bit_length() + SPARE_BITS, 60)
    n_parts = max(parts(spark), -(-(size or 0) // PART_BYTES))
    layout, word_layout = (bits, n_parts), (min(bits, WORD_BITS), n_parts)
    chunks = chunks.select("chunk", *CELLS)

    def opened(table) -> Iterator[tuple[int, Chunk]]:
        for chunk, *cells in zip(*[c.to_pylist() for c in table.columns]):
            yield chunk, Chunk(bits, *cells)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, mine in opened(batch):
                yield from rows_of([(part, chunk, payload, None) for part, payload in requests(mine.hashes, [mine.n], *layout)]).to_batches()

    def ask_words(left: pa.Table, right: pa.Table) -> pa.Table:
        by_part = dict(zip(right["part"].to_pylist(), right["payload"].to_pylist()))
        out = []
        for chunk, mine in opened(left):
            (reply,) = replies(mine.hashes, by_part, 1, *layout)
            new = np.where(reply & 1, reply >> 1, 0)  # pairs counted here, as this chunk owns them
            words = [mine.sums(mine.n, mine.left), *[mine.sums(k, mine.left) for k in (new == 1, new == 2, new > 2)], mine.sums(new > 0, mine.right)]
            out += [(part, chunk, payload, None) for part, payload in requests(mine.word_keys, words, *word_layout)]
        return rows_of(out)

    def total(df: DataFrame, width: int) -> list[int]:
        return [x or 0 for x in df.where("chunk < 0").agg(*[F.sum(F.col("sums")[k]) for k in range(width)]).first()]

    def answers(df: DataFrame, part: str) -> DataFrame:
        return df.where("chunk >= 0").selectExpr(f"{part} AS part", "chunk", "payload")

    with shuffles_dropped(spark):
        pairs = written(grouped(chunks.mapInArrow(tidy(ask), ROW), n_parts, pair_totals), "quality-pairs")
        asked = chunks.groupBy("chunk").cogroup(answers(pairs, "part").groupBy("chunk")).applyInArrow(tidy(ask_words), ROW)
        words = written(grouped(asked, n_parts, word_totals), "quality-words")

    n_pairs, *of_pairs = total(pairs, 5)
    *kinds, w1, w2, w3, w4 = total(words, 7)
    of_words = discounts([w1, w2, w3, w4])
    model = Totals(n_pairs, sum(kinds), discounts(of_pairs), of_words, float(of_words[1:] @ np.array(kinds, float)))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        by_part = dict(zip(right["part"].to_pylist(), right["payload"].to_pylist()))
        by_word = {-1 - part: payload for part, payload in by_part.items() if part < 0}
        out = []
        for _, mine in opened(left):
            total = replies(mine.hashes, by_part, 1, *layout)[0] >> 1
            sums = np.zeros((5, len(mine.words)), np.int64)
            sums[:, mine.word_order] = replies(mine.word_keys, by_word, 5, *word_layout)
            mass = model.pair_discounts[1:] @ sums[1:4]
            doc, pair, times = mine.by_document()
            before = sums[4][mine.right][pair]
            nats = model.nats(total, sums[0][mine.left], mass[mine.left], sums[4][mine.right])[pair]
            # the same without the document's own pairs: its counts come off those of the pair and of the context
            own = np.where(mine.docs["counted"].to_numpy(zero_copy_only=False)[doc], times, 0)
            rest, gone = total[pair] - own, model.pair_discounts[np.minimum(total[pair], 3)]
            _, at = np.unique(doc * len(mine.words) + mine.left[pair], return_inverse=True)
            context = sums[0][mine.left[pair]] - np.bincount(at, own).astype(np.int64)[at]
            left_mass = mass[mine.left[pair]] - np.bincount(at, gone - model.pair_discounts[np.minimum(rest, 3)])[at]
            others = model.nats(rest, context, left_mass, before)
            rows, n = mine.docs, mine.lengths
            for name, values in (("nats", nats), ("nats_others", others)):
                added = np.bincount(doc, values * times, len(n)) if len(doc) else np.zeros(len(n))
                rows = rows.append_column(name, pa.array(added / np.maximum(n, 1), mask=n == 0))
            out.append(rows.filter(rows["judged"]).select(["doc_id", "lang", *COUNTS, "nats", "nats_others"]))
        return pa.concat_tables(out)

    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, {', '.join(f'{n} bigint' for n in COUNTS)}, nats double, nats_others double"
    every = answers(pairs, "part").unionByName(answers(words, "-1 - part"))
    return chunks.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(tidy(finish), schema)


def perplexity_bands(scored: DataFrame, low: float, high: float, prior_docs: float = PRIOR_DOCS, column: str = "nats") -> DataFrame:
    """lang, floor, ceiling of ``column``: the language's median less ``low`` and plus ``high`` robust deviations.

    A deviation is 1.4826 times the median distance from the median, over the documents that pass the
    base rules. Median and deviation are drawn towards those of all documents, as if ``prior_docs`` of
    these stood beside the language's own: a small language has nearly the common band, a large one its own,
    and no size at which a verdict jumps.
    """
    usable = scored.where(~F.col("base_failed") & F.col(column).isNotNull()).select("lang", F.col(column).alias("nats"))

    every = usable.agg(F.percentile_approx("nats", 0.5, 10_000)).first()[0] or 0.0
    s = usable.agg(F.percentile_approx(F.abs(F.col("nats") - every), 0.5, 10_000)).first()[0] or 0.0
    middle = usable.groupBy(F.col("lang").alias("band_lang")).agg(F.percentile_approx("nats", 0.5, 10_000).alias("median"), F.count("*").alias("docs"))
    middle = written(middle, "quality-medians")
    apart = usable.join(middle, usable["lang"].eqNullSafe(middle["band_lang"]))
    spread = apart.groupBy("band_lang", "median", "docs").agg(F.percentile_approx(F.abs(F.col("nats") - F.col("median")), 0.5, 10_000).alias("s"))
    own = F.col("docs") / (F.col("docs") + F.lit(float(prior_docs)))
    bands = spread.select(
        "band_lang", (own * F.col("median") + (1 - own) * every).alias("m"), F.greatest((own * F.col("s") + (1 - own) * s) * 1.4826, F.lit(1e-3)).alias("s"),
    )
    return bands.select("band_lang", (F.col("m") - low * F.col("s")).alias("floor"), (F.col("m") + high * F.col("s")).alias("ceiling"))


def quality_rules(
    docs: DataFrame, low: float = 12.0, high: float = 5.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    prior_docs: float = PRIOR_DOCS, reference: DataFrame | None = None,
) -> DataFrame:
    """Counts, verdict of the base rules, perplexity and verdict of each document.

    doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, nats,
    nats_others, perplexity (of a word), floor, ceiling (the language's band of nats), ceiling_others (of
    nats_others), kept. A null, empty or blank
    text has no words, fails the base rules and has null nats. A null language is a language. Equal
    rows are judged alike, each in its own row; an empty table gives an empty table. Columns beside
    the three named are not read.

    The model counts ``docs``, and the bands are theirs. With ``reference``, a table with the same three
    columns, model and bands are those of the reference and ``docs`` are only judged by them.

    The floor lies far below the median: copies make each other's words likely, and are not a fault of
    a text. Under it are texts that go on repeating a few words. The ceiling on ``nats_others`` finds
    what no other text of the corpus resembles, such as strings of words met nowhere else, which their
    own counts would make likely.
    """

    def rows(df: DataFrame, counted: bool, judged: bool) -> DataFrame:
        named = [F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")]
        return df.select(*named, F.lit(counted).alias("counted"), F.lit(judged).alias("judged"))

    def based(scored: DataFrame, name: str) -> DataFrame:
        failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        return written(scored.withColumn("base_failed", failed), name)

    if reference is None:
        scored = fitted = based(score_texts(rows(docs, True, True)), "quality-scores")
    else:
        fitted = based(score_texts(rows(reference, True, True)), "quality-reference")
        scored = based(score_texts(rows(docs, False, True).unionByName(rows(reference, True, False))), "quality-scores")
    bands = perplexity_bands(fitted, low, high, prior_docs)
    unlike = perplexity_bands(fitted, low, high, prior_docs, "nats_others").select(F.col("band_lang").alias("l"), F.col("ceiling").alias("ceiling_others"))
    bands = written(bands.join(unlike, F.col("band_lang").eqNullSafe(F.col("l"))).drop("l"), "quality-bands")
    judged = scored.join(bands, scored["lang"].eqNullSafe(bands["band_lang"]), "left")
    inside = F.coalesce(F.col("nats").between(F.col("floor"), F.col("ceiling")), F.lit(False)) & (F.col("nats_others") <= F.col("ceiling_others"))
    return judged.select(
        *scored.columns, F.exp("nats").alias("perplexity"), "floor", "ceiling", "ceiling_others", F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept")
    )
