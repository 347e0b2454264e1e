"""Personal data in texts: exact base patterns, and further spans by weak supervision.

Base spans (email, ip, card, phone) are found by rule and always stay. For everything less certain,
loose patterns propose candidates, and labelers (format, checksum, gazetteer, context) vote yes, no or
nothing on each. Expectation-maximisation over the counts of vote patterns, taken over all documents,
estimates how far each labeler can be trusted and how likely each pattern is personal data. These
soft labels train a logistic classifier over the discrete features of a span, which decides.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import per_batch

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("written_email", "local_phone", "national_id", "iban", "secret", "person")
KINDS = BASE_KINDS + ADDED_KINDS
RANK = {kind: i for i, kind in enumerate(KINDS)}

# Gazetteers and cue words.
MAIL_HOSTS = frozenset("gmail hotmail outlook yahoo aol icloud proton gmx web mail example".split())
FIRST_NAMES = frozenset(
    "Alice Anna Anne Antonio Barbara Carlos Charles Christine Claire Daniel David Elena Elizabeth Emma Eva Francois Hans Heinz Isabel James "
    "Jean Jennifer Jens John Jose Juan Julia Karl Klaus Laura Linda Louis Lucia Luis Maria Marie Martin Mary Michael Miguel Monika Nathalie "
    "Patricia Paul Pedro Peter Petra Philippe Pierre Robert Sabine Sarah Sofia Sophie Stefan Susan Susanne Thomas Ursula William Wolfgang".split()
)
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-", "hf_")
CUES = {
    "written_email": ("mail", "contact", "write", "reach"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "cell", "handy"),
    "national_id": ("ssn", "social", "passport", "national", "identity", "tax"),
    "iban": ("iban", "account", "konto", "bank", "compte", "cuenta"),
    "secret": ("key", "token", "secret", "password", "passwd", "pwd", "bearer", "credential"),
    "person": ("mr", "mrs", "ms", "dr", "name", "herr", "frau", "monsieur", "madame", "señor", "dear", "contact"),
}
COUNTER_CUES = ("version", "isbn", "issn", "order", "page", "total", "figure", "price", "item", "ref", "hash", "commit", "sha", "md5")

AT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive runs of digits: a match of the plain pattern starts at the start of a run and eats whole runs
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

NUMBER = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}+(?![0-9A-Za-z])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
WRITTEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\.)\s?[A-Za-z0-9-]{2,63})+"
)
SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+(?![A-Za-z0-9_+/=-])")
#: A word that may be capitalised, of any script; accents may follow their letter.
CAPITALISED = re.compile(r"[^\W\d_a-z](?<!\w.)[\w\u0300-\u036F]*")
NATIONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
GROUPED_PHONE = re.compile(r"\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}")
SPACED = re.compile(r"[^\x20\t\n\r]{20}")
LABELERS = ("format", "checksum", "gazetteer", "context")

CANDIDATE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()),
    T.StructField("votes", T.StringType()), T.StructField("shape", T.StringType()),
])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in time linear in the text: each ``@`` has one possible match."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := AT_DOMAIN.match(text, at + 1)):
            found.append((start, domain.end()))
            last = domain.end()
        else:
            last = max(last, at + 1)  # the text before a failing @ can't belong to a later match
        at = text.find("@", last)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base spans by start, then kind as listed."""
    spans = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            spans += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x := part.lstrip("0")) < 4 and int(x or "0") <= 255 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            spans += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[0], RANK[s[2]]))


def context_vote(text: str, start: int, kind: str) -> str:
    before = re.findall(r"\w+", text[max(0, start - 40) : start].lower())[-4:]
    if any(w.startswith(cue) if len(cue) > 3 else w == cue for w in before for cue in CUES[kind]):
        return "1"
    return "0" if any(w.startswith(c) for w in before for c in COUNTER_CUES) else "-"


def bucket(n: int) -> str:
    return next(str(b) for b in (4, 8, 10, 12, 16, 24, 40, 10**9) if n <= b)


def people(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, first word is in the gazetteer) of pairs of capitalised words, a space between them, that may be a name.

    Pairs overlap as proposed, from the gazetteer or after a person cue; a cue itself is no name. Of
    overlapping pairs those with a known first name come first, then the earlier.
    """
    words: list[tuple[int, int]] = []
    for m in CAPITALISED.finditer(text):
        if not m[0][0].isupper() or any(c.isdigit() or c == "_" for c in m[0]):
            continue
        if words and m.start() == words[-1][1] + 1 and text[words[-1][1]] in "'’-":
            words[-1] = words[-1][0], m.end()  # O'Neill, Jean-Pierre
        else:
            words.append((m.start(), m.end()))
    pairs = []
    for (start, stop), (second, end) in zip(words, words[1:]):
        if second != stop + 1 or text[stop] != " ":
            continue
        first = text[start:stop]
        if first.isupper() or text[second:end].isupper() or first.lower() in CUES["person"]:
            continue
        known = unicodedata.normalize("NFC", first) in FIRST_NAMES
        if known or context_vote(text, start, "person") == "1":
            pairs.append((start, end, known))
    chosen: list[tuple[int, int, bool]] = []
    for i, (start, end, known) in enumerate(pairs):
        if chosen and start < chosen[-1][1]:
            continue
        if not known and i + 1 < len(pairs) and pairs[i + 1][0] < end and pairs[i + 1][2]:
            continue
        chosen.append((start, end, known))
    return chosen


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, votes, shape) of possible further spans; none overlaps a base span or an earlier candidate."""
    proposals: list[tuple[int, int, str, str, str]] = []
    digits = bool(DIGIT.search(text))
    if digits:
        for m in IBAN.finditer(text):
            body = m[0].replace(" ", "")
            sound = int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1
            proposals.append((m.start(), m.end(), "iban", ("1" if 15 <= len(body) <= 34 else "0") + "01"[sound] + "-", bucket(len(body))))
        for m in NUMBER.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            kind = "national_id" if NATIONAL.fullmatch(m[0]) else "local_phone"
            form = "1" if kind == "national_id" or GROUPED_PHONE.fullmatch(m[0]) and 7 <= n <= 12 else "0"
            valid = "-" if kind == "local_phone" else "01"[m[0][:3] not in ("000", "666") and m[0][0] != "9"]
            proposals.append((m.start(), m.end(), kind, form + valid + "-", bucket(n)))
    if "at" in text and ("[at]" in text or "(at)" in text or "{at}" in text):
        for m in WRITTEN.finditer(text):
            host = re.split(r"\]|\)|\}", m[0])[1].strip().split("[")[0].split("(")[0].split(".")[0].strip().lower()
            proposals.append((m.start(), m.end(), "written_email", "1-" + ("1" if host in MAIL_HOSTS else "-"), bucket(len(m[0]))))
    if SPACED.search(text):
        for m in SECRET.finditer(text):
            word = m[0]
            kinds = sum(any(f(c) for c in word) for f in (str.isdigit, str.isupper, str.islower))
            if kinds >= 2 and any(c.isdigit() for c in word):
                varied = len(set(word)) >= 0.4 * min(len(word), 32)
                known = word.startswith(KEY_PREFIXES)
                proposals.append((m.start(), m.end(), "secret", ("1" if kinds == 3 else "0") + "01"[varied] + ("1" if known else "-"), bucket(len(word))))
    proposals += [(start, end, "person", "--" + ("1" if known else "-"), bucket(end - start)) for start, end, known in people(text)]
    if not proposals:
        return []
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, b, _ in base), max))  # the furthest end of the base spans so far
    out, last = [], 0
    for start, end, kind, votes, shape in sorted(proposals, key=lambda p: (p[0], RANK[p[2]])):
        before = bisect_left(starts, end)
        if start >= last and not (before and start < reach[before - 1]):
            out.append((start, end, kind, votes + context_vote(text, start, kind), shape))
            last = end
    return out


def propose(docs: DataFrame, text_col: str) -> DataFrame:
    """Every candidate of all whole texts: kind, votes, shape (a row each, without its place)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [c[2:] for text in batch.column(0).to_pylist() if text for c in candidates(text, base_spans(text))]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "votes", "shape"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(per_batch(work), "kind string, votes string, shape string")


def reliabilities(patterns: list[tuple[str, str, float]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability of personal data per (kind, votes), by expectation-maximisation.

    ``patterns``: kind, votes, count. Each labeler has, over all kinds, a rate of yes on personal
    data and on other spans (with a weak prior that it is right more often than not); each kind has
    its own share of personal data.
    """
    kinds = sorted({k for k, _, _ in patterns})
    kind = np.array([kinds.index(k) for k, _, _ in patterns])
    counts = np.array([c for _, _, c in patterns], float)
    yes = np.array([[v == "1" for v in votes] for _, votes, _ in patterns], float)
    no = np.array([[v == "0" for v in votes] for _, votes, _ in patterns], float)
    hit, false = np.full(len(LABELERS), 0.8), np.full(len(LABELERS), 0.2)
    share = np.full(len(kinds), 0.5)
    truth = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        a = np.log(share[kind]) + yes @ np.log(hit) + no @ np.log(1 - hit)
        b = np.log(1 - share[kind]) + yes @ np.log(false) + no @ np.log(1 - false)
        truth = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        of, others = counts * truth, counts * (1 - truth)
        hit = (of @ yes + 8) / (of @ (yes + no) + 10)
        false = (others @ yes + 2) / (others @ (yes + no) + 10)
        for i in range(len(kinds)):
            mine = kind == i
            share[i] = (of[mine].sum() + 2) / (counts[mine].sum() + 4)
    return {(k, v): float(t) for (k, v, _), t in zip(patterns, truth)}


def features(kind: str, votes: str, shape: str) -> list[str]:
    return ["bias", f"kind={kind}", f"shape={kind}/{shape}", *[f"{name}={kind}/{v}" for name, v in zip(LABELERS, votes)], *[f"{name}={v}" for name, v in zip(LABELERS, votes)]]


def train(rows: list[tuple[str, str, str, float]], rounds: int = 300) -> dict[str, float]:
    """Weights of the span classifier from counts of (kind, votes, shape): logistic regression on the EM labels.

    The number of distinct rows is bounded by the kinds, vote patterns and shapes there are (under
    6 * 81 * 8), whatever the corpus. No candidate at all gives no weights, and nothing is added.
    """
    if not rows:
        return {}
    by_votes: dict[tuple[str, str], float] = {}
    for kind, votes, _, n in rows:
        by_votes[kind, votes] = by_votes.get((kind, votes), 0) + n
    truth = reliabilities([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    names = sorted({f for kind, votes, shape, _ in rows for f in features(kind, votes, shape)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (kind, votes, shape, _) in enumerate(rows):
        x[i, [place[f] for f in features(kind, votes, shape)]] = 1
    target = np.array([truth[k, v] for k, v, _, _ in rows])
    mass = np.array([n for *_, n in rows], float)
    mass /= mass.sum()
    mass = 0.5 * mass + 0.5 / len(rows)  # rare combinations count too
    w = np.zeros(len(names))
    for _ in range(rounds):  # Newton steps would be few, but these are cheap and can't diverge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ (mass * (p - target)) + 1e-5 * w)
    return dict(zip(names, w.tolist()))


def span_model(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The span classifier, from the candidates of all documents; only counts of feature combinations reach the driver."""
    counts = propose(docs, text_col).groupBy("kind", "votes", "shape").count().orderBy("kind", "votes", "shape")
    return train([(r.kind, r.votes, r.shape, r["count"]) for r in counts.collect()])


def all_spans(text: str, model: dict[str, float], threshold: float) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, all) spans of a text."""
    base = base_spans(text)
    spans = list(base)
    if model:
        for start, end, kind, votes, shape in candidates(text, base):
            score = sum(model.get(f, 0.0) for f in features(kind, votes, shape))
            if 1 / (1 + np.exp(-score)) >= threshold:
                spans.append((start, end, kind))
        spans.sort(key=lambda s: (s[0], RANK[s[2]]))
    return base, spans


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def find_pii(docs: DataFrame, model: dict[str, float] | None = None, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, base_spans, spans (arrays of kind, start, stop in code points), one per input row.

    Texts are read whole, twice: once for the counts that train the classifier and once to decide.
    A null or empty text has no spans. Equal rows give equal rows; a null id stays null. Spans of
    different base kinds may overlap, as each kind is matched by itself; added spans overlap none.
    An empty table gives an empty table. Columns beside the two named are not read.
    """
    model = span_model(docs, text_col) if model is None else model

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [all_spans(text, model, threshold) if text else ([], []) for text in batch.column(1).to_pylist()]
        lists = [
            pa.array([[{"kind": k, "start": a, "stop": b} for a, b, k in pair[i]] for pair in found], pa.list_(SPAN)) for i in (0, 1)
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "base_spans", "spans"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return source.mapInArrow(per_batch(work), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, base_spans {span}, spans {span}")


def merged(spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Overlapping spans as one, named after the first."""
    start = end = 0
    name = ""
    for a, b, kind in spans:
        if name and a < end:
            end = max(end, b)
            continue
        if name:
            yield start, end, name
        start, end, name = a, b, kind
    if name:
        yield start, end, name


def redact(docs: DataFrame, model: dict[str, float] | None = None, threshold: float = 0.9, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in its text replaced by ``<KIND>``; other columns as they are.

    Null texts stay null; the number and order of columns stay.
    """
    model = span_model(docs, text_col) if model is None else model

    def hide(text: str) -> str:
        _, spans = all_spans(text, model, threshold)
        if not spans:
            return text
        parts, last = [], 0
        for a, b, kind in merged(spans):
            parts += [text[last:a], f"<{kind.upper()}>"]
            last = b
        return "".join([*parts, text[last:]])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        i = batch.schema.get_field_index(text_col)
        texts = pa.array([hide(x) if x else x for x in batch.column(i).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([texts if k == i else c for k, c in enumerate(batch.columns)], schema=batch.schema.set(i, pa.field(text_col, pa.string())))

    return docs.mapInArrow(per_batch(work), docs.schema)
