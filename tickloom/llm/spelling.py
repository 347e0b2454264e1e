"""Spelling variants: words one edit apart, found by search schemes in a two-way FM-index.

The vocabulary is counted over all texts, partial counts per task first. Two words are one edit
apart if they agree on one half of the shorter one exactly and differ by one edit in the other.
So each word is placed by its halves, once as text to be searched and once (for the target one
letter shorter) as a query, and only words that share a half meet. A half that very many words
share is cut again: the free half is halved, one part of it must agree as well, and so on, until
a place holds few enough words; no pair is lost by that and none is found twice.

Each task indexes the words of its places in both directions: the ranks of all suffixes of the
delimited words and the letters before them. A query starts from the delimiter at the exact end,
narrows its interval of suffix ranks letter by letter, and spends one error within the part that is
free: another letter out of the interval (at most the alphabet, whatever the interval holds) or a
letter left out. Of a run of equal letters the last one is left out, so every pair has one place.

Null, empty, long and repeated texts: a null text has no words, a null id counts as the empty
string in the hash. Words of any length are kept whole. Of equally frequent forms the smallest in
code-point order is taken. An empty table, or one without words, gives no rows. Only the id and
the text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import raw_texts, written

#: A, Z, a, z and the letters from U+00C0 to U+00FF (the fixed alphabet of the contract, after A-Z became lower case).
RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LETTERS, LEAST_COUNT, FORM_RATIO = 7, 2, 10
DELETE_EVERY = 31
#: Entries of partial counts a task holds before it passes them on.
HELD = 200_000
#: Words a place holds before it is cut again, and rows a task indexes on average.
PLACE_WORDS, TASK_ROWS = 20_000, 20_000
#: Letters of a batch of queries, and the interval up to which its letters are read one by one.
BATCH_LETTERS, NARROW = 400_000, 64


def changed(run: str, crc: int) -> str:
    """The run, without one letter where its hash asks for it."""
    if crc % DELETE_EVERY:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: partial counts of words of at least seven letters."""
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            seed = zlib.crc32(f"{'' if ident is None else ident}:".encode())
            # bytes.lower() touches A-Z only
            for run, n in Counter(RUN.findall(text.lower().decode())).items():
                if len(run) >= LEAST_LETTERS and len(word := changed(run, zlib.crc32(run.encode(), seed))) >= LEAST_LETTERS:
                    counts[word] += n
            if len(counts) >= HELD:
                yield out()
                counts.clear()
    if counts:
        yield out()


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: the words of at least seven letters that occur at least twice."""
    parts = df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(counted_words, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- places --------------------------------------------------------------------------------


def with_key(rows: DataFrame) -> DataFrame:
    """Key of the letters that must agree: all but the free ones from ``e0`` to ``e1`` of the target."""
    return rows.withColumn("key", F.expr("xxhash64(length(word) - gone, e0, e1, substring(word, 1, e0), substring(word, e1 + gone + 1))"))


def halves(words: DataFrame) -> DataFrame:
    """word, n, gone (1: target one letter shorter), e0, e1 (the free letters of the target), key: two to four places of each word."""
    size = F.length("word")
    places = []
    for gone in (0, 1):
        target = size - gone
        half = F.floor(target / 2).cast("int")
        for e0, e1 in ((half, target), (F.lit(0), half)):
            place = F.struct(F.lit(gone).alias("gone"), e0.cast("int").alias("e0"), e1.cast("int").alias("e1"))
            places.append(F.when(target >= LEAST_LETTERS, place))
    listed = words.select("word", "n", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p"))
    return with_key(listed.select("word", "n", "p.gone", "p.e0", "p.e1"))


def placed(words: DataFrame, most: int = PLACE_WORDS) -> DataFrame:
    """Places of at most ``most`` words to search, but for those with two free letters or fewer, which the alphabet bounds."""
    rows = halves(words)
    while True:
        crowded = rows.where("gone = 0 AND e1 - e0 > 2").groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > most)
        crowded = written(crowded.select("key"), "spelling-crowded")
        if crowded.isEmpty():
            return rows
        inside = rows.join(crowded, "key", "left_semi").drop("key")
        middle = F.floor((F.col("e0") + F.col("e1")) / 2).cast("int")
        cut = inside.withColumn("p", F.explode(F.array(F.struct(middle.alias("a"), F.col("e1").alias("b")), F.struct(F.col("e0").alias("a"), middle.alias("b")))))
        finer = with_key(cut.select("word", "n", "gone", F.col("p.a").alias("e0"), F.col("p.b").alias("e1")))
        rows = written(rows.join(crowded, "key", "left_anti").unionByName(finer), "spelling-places")


# --- index and search within a task -------------------------------------------------------


class Index:
    """Suffix ranks of delimited words, searched from the first letter to the last.

    ``letters`` are the words one after another, each followed by the delimiter 0. An entry stands for
    a prefix of a word; entries are sorted by their letters read backwards, equal ones by word, so that
    entries with the same last letters are an interval, and one letter more leads to another interval.
    """

    def __init__(self, words: list[bytes]):
        sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
        self.words = len(words)
        self.letters = np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8).astype(np.int64)
        total = len(self.letters)
        depth = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]), sizes + 1)
        rank = np.where(depth > 0, np.concatenate([[0], self.letters[:-1]]), 0)
        step, kinds = 1, 0
        while step <= sizes.max(initial=0):
            before = np.where(depth >= step, np.concatenate([np.zeros(min(step, total), np.int64), rank[:-step]]) + 1, 0)
            found, rank = np.unique(rank * (max(total, 256) + 2) + before, return_inverse=True)
            if len(found) == kinds:
                break
            kinds, step = len(found), step * 2
        order = np.argsort(rank, kind="stable")
        self.next = self.letters[order]
        self.word = np.repeat(np.arange(len(words)), sizes + 1)[order]
        self.span = total + 1
        self.table = np.sort(self.next * self.span + np.arange(total))
        self.alphabet = np.unique(self.next[self.next > 0])

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one letter more."""
        base = letter * self.span
        return np.searchsorted(self.table, base + low), np.searchsorted(self.table, base + high)

    def others(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State number and letter for each other letter that may follow."""
        wide = high - low > min(NARROW, len(self.alphabet))
        few, many = np.flatnonzero(~wide), np.flatnonzero(wide)
        width = (high - low)[few]
        inside = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        near = np.unique(np.repeat(few, width) * 256 + self.next[np.repeat(low[few], width) + inside])
        far = (many[:, None] * 256 + self.alphabet[None, :]).ravel()
        both = np.concatenate([near, far])
        state, other = both >> 8, both & 255
        kept = (other > 0) & (other != letter[state])
        return state[kept], other[kept]

    def ends(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State number and word where the interval holds a whole word."""
        first, last = np.searchsorted(self.table, low), np.searchsorted(self.table, high)
        first, last = np.minimum(first, self.words), np.minimum(last, self.words)
        hit = np.flatnonzero(last > first)
        return hit, self.word[self.table[first[hit]]]


def search(index: Index, letters: np.ndarray, sizes: np.ndarray, gone: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query number and word of all words at one edit: a replaced letter, or where ``gone`` a letter left out, at a ``free`` place."""
    none = np.zeros(0, np.int64)
    query, low, high = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), np.full(len(sizes), index.words)
    spent = np.zeros(len(sizes), bool)
    last_free = np.where(free.any(axis=1), free.shape[1] - 1 - free[:, ::-1].argmax(axis=1), -1)
    found: list[tuple[np.ndarray, np.ndarray]] = [(none, none)]
    for at in range(letters.shape[1] + 1):
        over = sizes[query] == at
        done = over & spent
        hit, word = index.ends(low[done], high[done])
        found.append((query[done][hit], word))
        going = ~over & (spent | (last_free[query] >= at))
        query, low, high, spent = query[going], low[going], high[going], spent[going]
        if not len(query):
            break
        letter = letters[query, at]
        may = ~spent & free[query, at]
        skip, other = np.flatnonzero(may & gone[query]), np.flatnonzero(may & ~gone[query])
        state, put = index.others(letter[other], low[other], high[other])
        state = other[state]
        from_state = np.concatenate([np.arange(len(query)), state])
        new_low, new_high = index.extend(np.concatenate([letter, put]), low[from_state], high[from_state])
        error = np.concatenate([spent, np.ones(len(state), bool)])
        kept = new_high > new_low
        query, low, high, spent = (
            np.concatenate([query[from_state][kept], query[skip]]), np.concatenate([new_low[kept], low[skip]]),
            np.concatenate([new_high[kept], high[skip]]), np.concatenate([error[kept], np.ones(len(skip), bool)]),
        )
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def grid(words: list[bytes]) -> np.ndarray:
    """One row per word, padded with 0."""
    width = max(map(len, words))
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width).astype(np.int64)


def near_pairs(words: list[bytes], gone: np.ndarray, e0: np.ndarray, e1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of queries and of words one edit away, each ordered pair once; letters are Latin-1 bytes."""
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    target = sizes - gone
    from_left = e0 >= target - e1
    for left in (True, False):
        side = np.flatnonzero(from_left == left)
        turned = {}  # each text once, in the order in which it is read
        for i in side[gone[side] == 0].tolist():
            turned.setdefault(words[i] if left else words[i][::-1], i)
        if not turned:
            continue
        index, rows = Index(list(turned)), np.fromiter(turned.values(), np.int64, len(turned))
        side = side[np.argsort(sizes[side], kind="stable")]
        start = 0
        while start < len(side):
            stop = start + 1
            while stop < len(side) and (stop + 1 - start) * sizes[side[stop]] <= BATCH_LETTERS:
                stop += 1
            part = side[start:stop]
            start = stop
            letters, size = grid([words[i] for i in part]), sizes[part][:, None]
            place = np.arange(letters.shape[1])[None, :]
            final = place == size - 1
            free = (place >= e0[part][:, None]) & (place < e1[part][:, None])
            following = np.concatenate([letters[:, 1:], np.zeros((len(part), 1), np.int64)], axis=1)
            left_out = (free | (final & (e1[part] == target[part])[:, None])) & (final | (following != letters))
            free = np.where((gone[part] == 1)[:, None], left_out, free)
            if not left:
                back = np.clip(size - 1 - place, 0, None)
                letters, free = np.take_along_axis(letters, back, 1), np.take_along_axis(free, back, 1) & (place < size)
            hit, word = search(index, letters, sizes[part], gone[part] == 1, free)
            yield part[hit], rows[word]


def found_forms(table: pa.Table) -> pa.Table:
    """word, n_near, form_n, form of one task's rows: near words found here and the most frequent of them."""
    texts = table.column("word").to_pylist()
    n, gone, e0, e1 = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "gone", "e0", "e1"))
    names, of = np.unique(np.array(texts, dtype=object), return_inverse=True)  # Latin-1 letters sort by code point
    count = np.zeros(len(names), np.int64)
    count[of] = n
    best_n, best, near = np.full(len(names), -1), np.full(len(names), len(names)), np.zeros(len(names), np.int64)
    for query, word in near_pairs([t.encode("latin-1") for t in texts], gone, e0, e1):
        back = gone[query] == 1  # the shorter word doesn't ask for the longer one
        a = np.concatenate([of[query], of[word][back]])
        b = np.concatenate([of[word], of[query][back]])
        near += np.bincount(a, minlength=len(names))
        order = np.lexsort((b, -count[b], a))
        a, b = a[order], b[order]
        first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        a, b = a[first], b[first]
        better = (count[b] > best_n[a]) | ((count[b] == best_n[a]) & (b < best[a]))
        best_n[a[better]], best[a[better]] = count[b[better]], b[better]
    rows = np.flatnonzero(near)
    return pa.table({
        "word": pa.array(names[rows].tolist(), pa.string()), "n_near": pa.array(near[rows]), "form_n": pa.array(best_n[rows]),
        "form": pa.array(names[best[rows]].tolist(), pa.string()),
    })


# --- forms ---------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word and root of the words with a form; each round doubles the steps followed, and counts rise tenfold with each step."""
    links = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-links")
        if longer.where("moved").isEmpty():
            return longer.select("word", "root")
        links = longer.select("word", "root")


def spelling_forms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = FORM_RATIO, place_words: int = PLACE_WORDS, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least seven letters that occurs at least twice."""
    words = written(vocabulary(df, id_col, text_col), "spelling-words")
    rows = placed(words, place_words)
    tasks = max(1, -(-4 * words.count() // task_rows))
    dealt = rows.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))).repartition(tasks, "task")
    found = dealt.groupBy("task").applyInArrow(found_forms, "word string, n_near bigint, form_n bigint, form string")
    known = words.select("word", "n", F.lit(0).cast("long").alias("n_near"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    merged = known.unionByName(found, allowMissingColumns=True).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= ratio * F.col("n")
    forms = written(merged.select("word", "n", "n_near", F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
