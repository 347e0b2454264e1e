"""Spelling variants, whitening and shards against plain Python, numpy and SQL."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from tickloom.llm import sharding, spelling, whitening
from tickloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def docs(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")


# --- spelling variants -----------------------------------------------------------------------


def plain_words(rows):
    """Counts of the words of the contract, letter by letter."""
    counts = Counter()
    for ident, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                if len(word) >= 7:
                    counts[word] += 1
                run = ""
    return {w: n for w, n in counts.items() if n >= 2}


def plain_forms(counts):
    """All pairs by their patterns with one letter masked or left out."""
    near = defaultdict(set)
    masked = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            masked[w[:i], w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in masked.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, others in near.items():
        if not others:
            continue
        best = min(others, key=lambda o: (-counts[o], o))
        if counts[best] >= 10 * counts[w]:
            form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), counts.get(form.get(w)))
    return out


def shown(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_query(spark):
    rows = [(r.doc_id, r.text) for r in docs(spark).collect()]
    want = plain_forms(plain_words(rows))
    df = QUERIES["op11_spelling_variants"](spark, FOLDER)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert shown(df) == want and any(v[0] for v in want.values())


@pytest.mark.parametrize("place_words, task_rows", [(20_000, 20_000), (3, 40)])
def test_spelling_of_crowded_places(spark, place_words, task_rows):
    """Few letters, many words with the same half, runs of equal letters, chains of forms; small places are cut again."""
    rng = random.Random(5)
    counts = {}
    for _ in range(900):
        counts["".join(rng.choice("aab") for _ in range(rng.choice((7, 8, 9))))] = rng.choice((2, 3, 25, 300))
    for _ in range(200):
        counts["prefixes" + "".join(rng.choice("abéÿ") for _ in range(rng.randrange(5)))] = rng.choice((2, 40))
    counts |= {"x" * 3000: 2, "x" * 2999: 20, "x" * 2998: 200, "y" + "x" * 2999: 2000}
    text = [(None, " ".join([w] * n)) for w, n in counts.items()]
    table = spark.createDataFrame(text + [(1, None), (2, ""), (3, "1 2 -- kurz")], "doc_id long, text string").withColumn("word", F.lit("extra"))
    want = plain_forms(plain_words(text))
    assert shown(spelling.spelling_forms(table, place_words=place_words, task_rows=task_rows)) == want
    assert any(v[0] and v[1] != v[0] for v in want.values())
    assert spelling.spelling_forms(table.where("text IS NULL")).count() == 0


def test_places_hold_few_words_and_lose_none(spark):
    words = spark.createDataFrame([(f"{'a' * 8}{i:06d}".translate(str.maketrans("0123456789", "bcdefghijk")), 2) for i in range(400)], "word string, n long")
    rows = spelling.placed(words, 50)
    held = rows.where("gone = 0 AND e1 - e0 > 2").groupBy("key").count().agg(F.max("count")).first()[0]
    assert held <= 50
    assert rows.where("gone = 0").select("word").distinct().count() == 400


def test_hash_takes_ids_and_lower_case(spark):
    run = next(w for w in ("wordsome" + chr(97 + i) + chr(97 + j) for i in range(26) for j in range(26)) if zlib.crc32(f"7:{w}".encode()) % 31 == 0)
    at = zlib.crc32(f"7:{run}".encode()) % len(run)
    table = spark.createDataFrame([(7, run.upper() + " " + run)], "doc_id int, text string")
    assert shown(spelling.spelling_forms(table)) == {run[:at] + run[at + 1 :]: (None, run[:at] + run[at + 1 :], 2, 0, None)}
    # only A-Z become lower case
    table = spark.createDataFrame([(None, "ÉCOLIERS écoliers Écoliers")], "doc_id int, text string")
    assert set(shown(spelling.spelling_forms(table))) == {"Écoliers"}


# --- whitening -------------------------------------------------------------------------------


def plain_whitening(vectors, count=4):
    """x, n, S, components and shares by an eigen decomposition of the covariance."""
    x = [tuple(math.floor(256 * float(c)) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=float)
    n, sums = len(fit), [sum(int(v) for v in column) for column in fit.T]
    centred = fit - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:count]
    return x, n, sums, values[order], axes[:, order], values.sum()


def test_whitening_query(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = table.collect()
    x, n, sums, values, axes, trace = plain_whitening([r.embedding for r in rows])
    got = defaultdict(dict)
    for r in QUERIES["op12_whitening"](spark, FOLDER).collect():
        got[r.vec_id][r.component] = r
    assert len(got) == len(rows) and all(set(v) == {1, 2, 3, 4} for v in got.values())
    signs = None
    for row, v in zip(rows, x, strict=True):
        mine = got[row.vec_id]
        want = (np.array(v) - np.array(sums) / n) @ axes / np.sqrt(values)
        have = np.array([mine[c].whitened for c in (1, 2, 3, 4)])
        signs = np.sign(want * have) if signs is None else signs
        assert have * signs == pytest.approx(want, rel=1e-8, abs=1e-9)
        for c in (1, 2, 3, 4):
            assert mine[c].n == n and mine[c].deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            assert mine[c].explained == pytest.approx(values[c - 1] / trace, rel=1e-9) and 0 <= mine[c].identity_error <= 1e-9


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("?") for c in ("id", "x", "v", "s", "dim", "cell", "value", "deviation", "n")})


def test_whitening_of_odd_rows(spark):
    """Null and ragged vectors go, copies count once, flat and repeated dimensions have no variance."""
    rng = np.random.default_rng(3)
    good = []
    for i in range(300):
        a, b = rng.normal(size=2)
        good.append((i, [float(a), float(b / 50), 1.5, float(a)]))  # the third is constant, the fourth a copy
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0]), (1003, [1.0, float("nan"), 1.0, 1.0]), (1004, [1.0, float("-inf"), 1.0, 1.0]), (1005, [1.0, 2.0]), (1006, [1e300, 0.0, 0.0, 0.0])]
    rows = [(None, good[0][1]), *good, *good[:50] * 20, *odd]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 4 * (301 + 1000) and {r.vec_id for r in got} == {None, *range(300)}
    x, n, sums, values, axes, trace = plain_whitening([v for _, v in good])
    by = {(r.vec_id, r.component): r for r in got}
    assert all(r.n == n and r.identity_error < 1e-8 for r in got)
    for c in (1, 2):
        assert by[0, c].explained == pytest.approx(values[c - 1] / trace, rel=1e-8)
        assert abs(by[5, c].whitened) == pytest.approx(abs((np.array(x[5]) - np.array(sums) / n) @ axes[:, c - 1] / np.sqrt(values[c - 1])), rel=1e-6)
    assert all(by[5, c].whitened is None for c in (3, 4))


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    same = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in same] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)] * 2
    two = whitening.whiten(vectors(spark, [(1, [0.0, 0.0, 3.0]), (2, [1.0, 0.0, 3.0])])).collect()
    assert sorted(r.whitened for r in two if r.component == 1) == pytest.approx([-1.0, 1.0]) and all(r.whitened is None for r in two if r.component > 1)


def test_whitening_of_badly_conditioned_rows(spark):
    """Dimensions that differ by six orders of magnitude and far from the origin."""
    rng = np.random.default_rng(8)
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    plain = (rng.normal(size=(400, 6)) * [1e5, 1e4, 1e3, 1e2, 1e1, 1e0]) @ turn + 1e6
    table = vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(plain)])
    x, n, sums, values, axes, trace = plain_whitening(plain)
    got = whitening.fit_whitening(whitening.quantised(table, "vec_id", "embedding"), 6)
    assert got.explained == pytest.approx(values_of(x, n) / trace, rel=1e-6) and got.identity_error < 1e-8 and got.gram_passes >= 3
    assert np.abs(got.axes.T @ got.axes - np.eye(6)).max() < 1e-12


def values_of(x, n):
    centred = np.array(x, dtype=float) - np.mean(np.array(x, dtype=float), axis=0)
    return np.linalg.svd(centred, compute_uv=False) ** 2 / n


def test_large_deviations_stay_exact(spark):
    big = [(1, [2.0**40, 0.0]), (2, [-(2.0**40), 1.0]), (3, [0.0, 5.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, big)).collect()}
    x = [[int(256 * c) for c in v] for _, v in big]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for i, v in zip((1, 2, 3), x, strict=True):
        want = sum((3 * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert got[i] == (want if want < 2**63 else None)
    assert got[1] is None and got[3] is not None


# --- shards ----------------------------------------------------------------------------------


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_shards_query_agrees_with_sql(spark, folder):
    assert compare(spark, connect(folder), folder, "op13", QUERIES["op13_interleaved_shards"], ORACLES["op13_interleaved_shards"]) == ""


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 40}", f"text {i}") for i in range(3000)] + [(9000 + i, f"only{i}", "") for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sharding.stratified_shards(table).collect()
    assert sorted(got) == sorted(sharding.stratified_shards(table.repartition(3)).collect())
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    share = Counter(r.source for r in got)
    mixed = Counter((r.source, r.shard) for r in got)
    for source, n in share.items():
        if n >= 32:
            assert all(abs(mixed[source, s] - n / 16) <= 0.03 * n / 16 + 2 for s in range(16))
    alone = Counter(r.shard for r in got if r.source.startswith("only"))
    assert max(alone.values()) < 75  # 600 sources of one row each, spread and not piled up
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows)
    assert sharding.stratified_shards(table, seed=8).orderBy("shard", "slot").collect() != sorted(got, key=lambda r: (r.shard, r.slot))


def test_shards_of_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (1, "a", "éé"), (1, "a", "éé"), (2, "b", "x" * 100_000)]
    extra = {c: F.lit("?") for c in ("row", "rank", "at", "place", "shard", "slot", "size", "rows", "offset", "of", "_pos", "_part", "_n", "_first", "_skip", "shuffled", "text_crc32")}
    table = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumns(extra)
    got = sharding.stratified_shards(table).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, _, t in rows)
    assert all(r.slot == 0 for r in got) and len({r.shard for r in got}) == 5
    assert sharding.stratified_shards(table.where("false")).count() == 0
    whole = sharding.stratified_shards(table, whole=True).select("row.*")
    assert whole.columns == table.columns and sorted(map(str, whole.collect())) == sorted(map(str, table.collect()))


def test_written_shards_hold_the_texts(spark):
    table = docs(spark)
    back = sharding.sharded_table(table, shards=4, rows_per_task=30)
    assert sorted(map(str, back.select("row.*").collect())) == sorted(map(str, table.collect()))
    want = {(r.doc_id, r.shard, r.slot) for r in sharding.stratified_shards(table, 4).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.select("row.doc_id", "shard", "slot").collect()} == want
