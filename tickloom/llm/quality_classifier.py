"""Quality classifier by co-training two views of a document.

The content view sees what the text is made of (kinds of characters, repetition, hashed words); the
metadata view sees the page around it (source, language, length, layout of lines). Each is a logistic
model. In every round both score all unlabelled documents, and each hands the other the documents it
is surest of as pseudo-labels. At the end each view is calibrated on labelled documents that neither
has trained on, and the calibrated views are combined there to the final score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import per_batch, raw_texts, tidy, written

#: Labelled documents used at most, of each class: three quarters train, one quarter calibrates.
MAX_LABELLED = 4000
#: Pseudo-labelled documents a view is handed at most, of each class and in each round.
MAX_PSEUDO = 1000
ROUNDS = 3
SURE = 0.97
WORD_BUCKETS = 48
SOURCE_BUCKETS = 16
LANG_BUCKETS = 8

CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&", b"|<>", b"!?", b".,;:", b"'\"()[]{}", b"=/\\_@~^+-", b" \t\r\x0b\x0c")


def class_matrix() -> np.ndarray:
    m = np.zeros((256, len(CLASSES) + 1))
    for i, members in enumerate(CLASSES):
        m[list(members), i] = 1
    m[128:, len(CLASSES)] = 1
    return m


def content_features(text: bytes, kinds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(CLASSES) + 8 + WORD_BUCKETS)
    words = text.split()
    if not words:
        return out
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ kinds / len(text)
    out[: len(shares)] = np.sqrt(shares)
    counts = Counter(words)
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[len(shares) : len(shares) + 7] = (
        len(counts) / n, max(counts.values()) / n, sum(w.isupper() for w in words) / n, min(sum(map(len, words)) / n / 10, 5),
        1 - len(set(lines)) / len(lines), sum(1 for a, b in zip(words, words[1:]) if a == b) / n, np.log1p(n) / 10,
    )
    hashed = np.bincount([zlib.crc32(w) % WORD_BUCKETS for w in counts], list(counts.values()), WORD_BUCKETS)
    out[-WORD_BUCKETS:] = np.sqrt(hashed / n)
    return out


def metadata_features(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    out = np.zeros(6 + LANG_BUCKETS + SOURCE_BUCKETS)
    lengths = np.array([len(x) for x in text.split(b"\n")], float)
    out[:6] = np.log1p(len(text)) / 10, np.log1p(len(lengths)) / 5, np.log1p(lengths.mean()) / 10, np.log1p(lengths.std()) / 10, np.log1p(lengths.max()) / 10, (lengths < 20).mean()
    out[6 + zlib.crc32((lang or "").encode()) % LANG_BUCKETS] = 1
    out[6 + LANG_BUCKETS + zlib.crc32((source or "").encode()) % SOURCE_BUCKETS] = 1
    return out


def featurize(texts: list[bytes], langs: list, sources: list) -> tuple[np.ndarray, np.ndarray]:
    kinds = class_matrix()
    content = np.array([content_features(t, kinds) for t in texts], np.float32)
    return content, np.array([metadata_features(t, x, s) for t, x, s in zip(texts, langs, sources)], np.float32)


@dataclass
class Logistic:
    """Logistic regression on standardised features; ``logits`` are clipped to what calibration can use."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
        x = x.astype(np.float64)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            gradient = z.T @ (p - y) + penalty * w
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(penalty), gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:], -12, 12)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class CoTrained:
    """Both views with their calibration (slope, offset) and the combination of their calibrated logits."""

    content: Logistic
    metadata: Logistic
    calibration: tuple[Logistic, Logistic]
    combination: Logistic

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = self.calibration[0].logits(self.content.logits(content)[:, None])
        m = self.calibration[1].logits(self.metadata.logits(metadata)[:, None])
        return sigmoid(c), sigmoid(m), sigmoid(self.combination.logits(np.column_stack([c, m])))


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """doc_id, content, metadata of every row, from whole texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, metadata = featurize(raw_texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist())
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32())) for x in (content, metadata)]
        return pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "content", "metadata"])

    source = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).cast("string").alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(per_batch(work), f"doc_id {kind}, content array<float>, metadata array<float>")


def gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bounded set of rows (content, metadata, y) as arrays, in the order of their hash."""
    table = rows.orderBy("mark", "doc_id").select("content", "metadata", "y").toArrow()

    def stacked(name: str) -> np.ndarray:
        return np.array(table[name].to_pylist(), np.float32)

    return stacked("content"), stacked("metadata"), np.array(table["y"].to_pylist(), np.float64)


def some_of_each(rows: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` rows of each class: those with the least hashes, which is a random sample and the same in every run."""
    either = [rows.where(F.col("y") == y).orderBy("mark", "doc_id").limit(most) for y in (0, 1)]
    return either[0].union(either[1])


def co_train(
    table: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED, max_pseudo: int = MAX_PSEUDO, sure: float = SURE,
    label_col: str = "quality", label_id_col: str = "doc_id",
) -> CoTrained | None:
    """The co-trained views from a table of ``features`` and labels; None if a class has fewer than four labelled documents.

    Repeated labels of a document count by their majority, and an even split as no label. Models are
    fitted on the driver on bounded samples: at most ``max_labelled`` labelled and, a round, at most
    ``max_pseudo`` pseudo-labelled documents of each class. Each round scores all documents.
    """
    votes = labels.where(F.col(label_id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id_col).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("vote"))
    votes = votes.where("vote <> 0.5").select("_id", (F.col("vote") > 0.5).cast("int").alias("y"))
    marked = table.withColumn("mark", F.xxhash64("doc_id", F.lit(7)))
    labelled = written(marked.join(votes, marked["doc_id"] == votes["_id"]).drop("_id"), "quality-labelled")
    content, metadata, y = gathered(some_of_each(labelled, max_labelled))
    if not len(y) or min((y == 0).sum(), (y == 1).sum()) < 4:
        return None
    held = np.arange(len(y)) % 4 == 3
    extra: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    unlabelled = marked.join(votes, marked["doc_id"] == votes["_id"], "left_anti") if rounds else marked
    unlabelled = written(unlabelled, "quality-unlabelled")
    views = (content, metadata)
    models: list[Logistic] = []
    for turn in range(rounds + 1):
        models = []
        for view in (0, 1):
            x = np.concatenate([views[view][~held], *[e[0] for e in extra[view]]])
            models.append(Logistic.fit(x, np.concatenate([y[~held], *[e[1] for e in extra[view]]])))
        if turn == rounds:
            break
        both = scored_views(unlabelled, models)
        for view, giver in ((0, "m"), (1, "c")):  # each view learns from what the other is sure of
            picked = both.where((F.col(giver) >= sure) | (F.col(giver) <= 1 - sure)).withColumn("y", (F.col(giver) > 0.5).cast("int"))
            given = gathered(some_of_each(picked, max_pseudo))
            if len(given[2]):
                extra[view] = [(given[view], given[2])]  # the latest opinion replaces the earlier one
    c, m = (models[v].logits(views[v][held])[:, None] for v in (0, 1))
    calibration = (Logistic.fit(c, y[held]), Logistic.fit(m, y[held]))
    joint = np.column_stack([calibration[0].logits(c), calibration[1].logits(m)])
    return CoTrained(models[0], models[1], calibration, Logistic.fit(joint, y[held]))


def scored_views(table: DataFrame, models: list[Logistic]) -> DataFrame:
    """``table`` with c and m, the views' own probabilities."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [sigmoid(models[v].logits(stacked(batch.column(batch.schema.get_field_index(name))))) for v, name in enumerate(("content", "metadata"))]
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.float64()) for x in values]], [*batch.schema.names, "c", "m"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return written(table.mapInArrow(per_batch(work), f"{fields}, c double, m double"), "quality-views")


def stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Rows doc_id, content_score, metadata_score, score, kept: calibrated probabilities of good quality, and score >= ``threshold``.

    One row per input row, equal rows alike. Null text counts as empty, null source or language as the
    empty string; an empty text is judged by its metadata and the absence of content. Without enough
    labels of both classes all scores are null and everything is kept. An empty table gives an empty
    table. Columns beside the four named are not read.
    """
    table = written(features(docs, id_col, text_col, lang_col, source_col), "quality-features")
    model = co_train(table, labels)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        content, metadata = stacked(batch.column(1)), stacked(batch.column(2))
        scores = model.scores(content, metadata) if model else [[None] * batch.num_rows] * 3
        arrays = [pa.array(x, pa.float64()) for x in scores]
        kept = pa.array(scores[2] >= threshold) if model else pa.array([True] * batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays, kept], ["doc_id", "content_score", "metadata_score", "score", "kept"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(per_batch(work), f"doc_id {kind}, content_score double, metadata_score double, score double, kept boolean")


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify`` keeps."""
    model = co_train(written(features(docs, id_col, text_col, lang_col, source_col), "quality-features"), labels)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                text, lang, source = (batch.column(batch.schema.get_field_index(c)) for c in (text_col, lang_col, source_col))
                good = model.scores(*featurize(raw_texts(text), lang.to_pylist(), source.to_pylist()))[2] >= threshold
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(tidy(run), docs.schema)
