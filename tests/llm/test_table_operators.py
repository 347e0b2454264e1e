"""Near duplicates, mixing, chat windows, nearest vectors, licence scans and the pipeline against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat, licenses, mixing, near_duplicates, nearest
from tickloom.llm.queries import CONTROL_TEXT, QUERIES

FOLDER = "/root/testdata/sf0.001"


def docs(spark, folder=FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")


def find(parent, a):
    while parent[a] != a:
        a = parent[a]
    return a


# --- near duplicates -------------------------------------------------------------------------


def plain_classes(rows, idf):
    """Least id of each component of exact weighted similarity 0.8, over all pairs that share a shingle."""
    weigh = near_duplicates.Weigher(idf)
    sets = {i: weigh((t or "").encode()) for i, t in rows}
    by_shingle = defaultdict(list)
    parent = {i: i for i in sets}
    for i, (hashes, *_) in sets.items():
        for h in hashes.tolist():
            by_shingle[h].append(i)
    links = {(a, b) for members in by_shingle.values() for k, a in enumerate(members) for b in members[k + 1 :]}
    for a, b in links:
        if near_duplicates.weighted_jaccard(sets[a], sets[b]) >= near_duplicates.THRESHOLD:
            parent[find(parent, a)] = find(parent, b)
    groups = defaultdict(list)
    for i in sets:
        groups[find(parent, i)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_near_duplicate_query(spark):
    folder = "/root/testdata/sf0.01"
    table = docs(spark, folder)
    got = {r.doc_id: r for r in QUERIES["op10_near_duplicates"](spark, folder).collect()}
    idf = near_duplicates.inverse_frequencies(*near_duplicates.document_frequencies(table))
    want = plain_classes([(r.doc_id, r.text) for r in table.collect()], idf)
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in got.items())


def test_large_group_of_near_copies_and_shared_passage(spark):
    """Members differ from each other more than from their source, and strangers share a passage."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    source = [rnd.choice(vocabulary) for _ in range(200)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(150):
        words = list(source)
        for k in rnd.sample(range(200), 2):
            words[k] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(240))) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(table).collect()}
    assert {got[i] for i in range(150)} == {0}
    assert all(got[i] == i for i in got if i >= 1000)


def test_second_looks_find_what_the_leader_misses(spark):
    """Texts that all share a bucket: pairs across classes are offered from a small bucket, and leaders from a large one."""
    rows = [(1, bytes([k])) for k in range(10)] + [(2, bytes([k])) for k in range(100, 160)] + [(3, bytes([k])) for k in range(5)]
    buckets = spark.createDataFrame(rows, "bucket bigint, key binary")
    labels = spark.createDataFrame([(bytes([k]), bytes([0])) for k in range(8)], "node binary, label binary")
    mixed = near_duplicates.labelled(buckets, labels)
    assert {(r.bucket, r.n) for r in mixed.collect()} == {(1, 10), (2, 60)}  # all of bucket 3 are in one class
    offered = {(r.left[0], r.right[0]) for r in near_duplicates.second_looks(mixed).collect()}
    assert offered == {(a, b) for a in range(10) for b in (8, 9) if a < b}
    met = {(r.left[0], r.right[0]) for r in near_duplicates.stars(mixed.where("n > 24").select("bucket", "key"), range(1, 9)).collect()}
    leaders = {a for a, _ in met}
    assert 5 <= len(leaders) <= 8 and met == {(a, b) for a in leaders for b in range(100, 160) if a != b}


def template_pages(n_pages, n_pairs):
    """Pages of one template, strangers below the threshold, and pages with a twin above it."""
    rnd = random.Random(12)
    template = [f"t{k}" for k in range(400)]

    def changed(words, n):
        words = list(words)
        for k in rnd.sample(range(len(words)), n):
            words[k] = f"x{rnd.randrange(10**9)}"
        return words

    pages = [changed(template, 7) for _ in range(n_pages)]
    twins = [changed(pages[i], 4) for i in range(n_pairs)]
    return [(i, " ".join(words)) for i, words in enumerate(pages + twins)]


def test_sparse_pairs_among_pages_of_one_template(spark, monkeypatch):
    """Buckets hold hundreds of strangers; blocks are small, so that pairs lie within and across them."""
    rows = template_pages(600, 60)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    idf = near_duplicates.inverse_frequencies(*near_duplicates.document_frequencies(table))
    weigh = near_duplicates.Weigher(idf)
    sets = [weigh(t.encode()) for _, t in rows]
    exact = near_duplicates.all_similarities(sets, sets)
    for i, j in [(0, 1), (0, 600), (5, 605), (3, 3), (599, 7)]:
        assert exact[i, j] == pytest.approx(near_duplicates.weighted_jaccard(sets[i], sets[j]), abs=near_duplicates.SINGLE / 10)
    want = list(range(len(rows)))
    for i, j in zip(*np.nonzero(np.triu(exact, 1) >= near_duplicates.THRESHOLD)):
        want[find(want, int(j))] = find(want, int(i))
    want = {i: find(want, i) for i in range(len(rows))}
    assert 50 <= sum(want[600 + i] == want[i] for i in range(60)) and len(set(want.values())) > 500
    monkeypatch.setattr(near_duplicates, "BLOCK", 64)
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(table).collect()}
    assert len(set(got.values())) == len(set(want.values()))
    assert [got[i] == got[i + 600] for i in range(60)] == [want[i] == want[i + 600] for i in range(60)]


def test_duplicate_edges(spark):
    same = "one two three four five six seven"
    rows = [(3, same), (1, same), (1, same), (None, same), (4, None), (4, None), (5, ""), (6, " \n"), (7, "short"), (8, "short"), (9, "short text"), (10, "w " * 20000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("?") for c in ("key", "row", "samples", "label", "kept", "node", "left", "right", "bucket", "_key")})
    got = near_duplicates.near_duplicates(table).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter([(3, 1), (1, 1), (1, 1), (None, 1), (4, 4), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7), (9, 9), (10, 10)])
    assert sum(r.kept for r in got if r.class_id == 1) == 1
    assert [r.kept for r in got if r.doc_id in (4, 5, 6)] == [True] * 4
    table = table.withColumns({c: F.lit("?") for c in ("id", "worded", "stay_id", "stay_key", "_id")})
    kept = near_duplicates.drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert all(set(r[2:]) == {"?"} for r in kept.collect())
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 4, 5, 6, 7, 9, 10]


def test_components_of_chain_star_and_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200)]
    frame = spark.createDataFrame([(bytes([0, a]), bytes([0, b])) for a, b in edges], "left binary, right binary")
    got = {r.node[1]: r.label[1] for r in near_duplicates.components(frame).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, **{i: 200 for i in range(200, 203)}}


def test_sampling_estimates_weighted_similarity():
    rnd = np.random.default_rng(4)
    sampler, shared = near_duplicates.Sampler(), []
    for _ in range(60):
        hashes = np.sort(rnd.integers(0, 2**63, 300).astype(np.uint64))
        a, b = (1 + rnd.random(300)).astype(np.float32), (1 + rnd.random(300)).astype(np.float32)
        left, right = (hashes[:260], a[:260]), (hashes[40:], b[40:])
        shared.append((np.mean(sampler(*left) == sampler(*right)), near_duplicates.weighted_jaccard(left, right)))
    estimates, truth = map(np.array, zip(*shared))
    assert abs(estimates.mean() - truth.mean()) < 0.03


# --- mixing ----------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def check_mix(rows, documents, pieces):
    sizes, taken = Counter(), Counter()
    for r in documents:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert len(documents) == len(rows)
    want = plain_targets(dict(sizes))
    for r in documents:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1
    assert sum(p.n_words for p in pieces) == sum(taken.values())


def test_mix_query_and_rerun(spark):
    rows = docs(spark).collect()
    documents, pieces = mixing.mix_sources(docs(spark))
    check_mix(rows, documents.collect(), pieces.collect())
    one = sorted(tuple(r) for r in QUERIES["op9_mix_sources"](spark, FOLDER).collect())
    spread = mixing.mix_sources(docs(spark).repartition(7))[0]
    assert sorted(tuple(r) for r in spread.select("doc_id", "size", "source_size", "target", "taken").collect()) == one


def test_every_stretch_of_the_schedule_follows_the_shares(spark):
    targets = spark.createDataFrame([(i, float(t)) for i, t in enumerate((500_000, 200_000, 90_000, 10_000, 0))], "source_no int, target double")
    slots = sorted((r.slot, r.source_no, r.words) for r in mixing.schedule(targets, 256).collect())
    total = Counter()
    for _, s, words in slots:
        total[s] += words
    assert total == {0: 500_000, 1: 200_000, 2: 90_000, 3: 10_000}
    for n in (100, 500, 1000, 2000):
        for s, t in enumerate((500_000, 200_000, 90_000, 10_000)):
            assert abs(sum(1 for x in slots[:n] if x[1] == s) - n * t / 800_000) < 8


def test_mix_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d " * 400, None), (None, "e f", "y"), (5, "g", "é"), (6, "h i", "Z")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit("?") for c in ("size", "mark", "bucket", "taken", "slot", "block", "target", "row_no", "_n")})
    documents, pieces = mixing.mix_sources(table)
    check_mix(rows, documents.collect(), pieces.collect())
    table = table.withColumns({c: F.lit("?") for c in ("_key", "_drawn", "_first", "key", "row", "drawn", "first", "n", "text_", "epoch")})
    mixed = mixing.mixed(table)
    assert mixed.columns == table.columns
    assert all(set(r[3:]) == {"?"} for r in mixed.collect())
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert words == Counter({s: sum(r.taken for r in documents.collect() if r.source == s) for s in words})
    assert [f.count() for f in mixing.mix_sources(table.where("false"))] == [0, 0]


# --- chat ------------------------------------------------------------------------------------


def plain_turns(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in talks.items()}


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_turns(rows + [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)])
    got = {r.conv_id: r for r in QUERIES["op5_chat_windows"](spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def random_talk(rnd, n):
    parts = [*chat.CONTROLS, "\\", "<", "[", "|", "a b", "é🙂", "\n", " ", ">", "]", "\\<"]
    return [(7, k, "system" if k == 0 else ("user", "assistant")[k % 2], "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 12)))) for k in range(n)]


def test_windows_repeat_and_mask(spark):
    rows = random_talk(random.Random(6), 60)
    made = chat.windows(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 40, 15).orderBy("window").collect()
    assert len(made) > 3
    turns = plain_turns(rows)[7]
    news = []
    for w in made:
        kinds = [t.kind for t in w.turns]
        assert kinds == sorted(kinds, key=["system", "history", "new"].index)
        assert (kinds[0] == "system") == (w.window > 0)
        for t in w.turns:
            assert w.formatted[t.start : t.start + t.chars] + chat.END == w.formatted[t.start : t.start + t.chars + len(chat.END)]
        assert sum(w.formatted.count(c) for c in chat.CONTROLS) == 3 * len(w.turns)  # the template's own marks only
        history = sum(len(turns[i][1].split()) + 1 for i in range(len(news) - kinds.count("history"), len(news)))
        assert history <= 15
        fresh = [t for t in w.turns if t.kind == "new"]
        news += fresh
        assert [(m.start, m.chars) for m in w.loss] == [(t.start, t.chars) for t in fresh if t.role == "assistant"]
    assert [t.role for t in news] == [r for r, _ in turns]


def test_chat_edges(spark):
    rows = [(None, 1, "user", "x"), (None, None, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (1, 2, "user", "same"), (1, 2, "user", "same"), (2, 0, "we\nird<|text|>", "w " * 2000), (2, 10**12, "assistant", "far")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit("?") for c in ("run", "tokens", "span", "window", "loss", "turns", "at", "p")})
    read = {r.conv_id: r for r in chat.read_back(chat.windows(table)).collect()}
    for c, turns in plain_turns(rows).items():
        assert [(t.role, t.text) for t in read[c].turns] == turns
        assert read[c].loss == "".join(t for r, t in turns if r == "assistant")
    assert chat.windows(table.where("false")).count() == 0


# --- nearest ---------------------------------------------------------------------------------


def plain_nearest(vectors, k):
    out = []
    for q in sorted(i for i in vectors if i % 20 == 0):
        scores = sorted((-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def test_nearest_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    want = plain_nearest({r.vec_id: np.array(r.embedding, np.float64) for r in rows}, 20)
    assert [tuple(r) for r in QUERIES["op7_nearest"](spark, FOLDER).orderBy("query_id", "rank").collect()] == want


def test_nearest_over_many_tiles_with_ties(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATE_BLOCK", 37)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 3)
    rnd = np.random.default_rng(5)
    vectors = {i: rnd.integers(-3, 4, 6) * (100.0 if i % 7 else 1e-3) for i in range(400)}
    vectors = {i: v for i, v in vectors.items() if v.any()} | {i: np.ones(6) for i in range(400, 460)}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id bigint, embedding array<double>")
    got = nearest.nearest(table, F.col("vec_id") % 20 == 0, 9).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == plain_nearest(vectors, 9)


def test_nearest_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (20, [1.0, 1.0]), (40, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("?") for c in ("vector", "dim", "block", "ids", "score", "rank")})
    got = [tuple(r) for r in nearest.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 4.0), (0, 2, 20, 3.0), (20, 1, 0, 3.0), (20, 2, 1, 3.0)]
    assert nearest.nearest(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# --- licences --------------------------------------------------------------------------------


def test_licence_query_finds_the_planted_notices(spark):
    folder = "/root/testdata/sf0.01"
    notices = {"Released under the MIT License.": "MIT", "GNU General Public License, version 3": "GPL-3.0", "Apache License, Version 2.0": "Apache-2.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0"}
    got = {r.doc_id: r for r in QUERIES["op6_license_scan"](spark, folder).collect()}
    rows = docs(spark, folder).collect()
    assert len(got) == len(rows)
    for r in rows:
        said = {name for notice, name in notices.items() if notice in r.text}
        mine = got[r.doc_id]
        assert (mine.origin == "own") == bool(said)
        if said:
            assert mine.licence in said


def plain_cosine(passages, passage, notice):
    def terms(text):
        import re

        words = re.findall(r"[^\W_]+(?:[.\-/][^\W_]+)*", text.lower())
        return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:]))

    frequency = Counter(t for p in passages for t in terms(p))
    frequency = Counter(t for p in passages for t in set(terms(p)))

    def weights(text):
        return {t: n * (np.log((1 + len(passages)) / (1 + frequency[t])) + 1) for t, n in terms(text).items()}

    a, b = weights(passage), weights(notice)
    return sum(w * b.get(t, 0) for t, w in a.items()) / np.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


def test_licence_similarity_against_plain_python(spark):
    passages = ["Licensed under the Apache License, Version 2.0", "licensed under the apache license 2.0 or later", "This file is released under the MIT License.", "no licence here at all", "Licensed under CC BY-NC 4.0."]
    table = spark.createDataFrame([(p, 1) for p in passages], "passage string, n bigint")
    got = {r.passage: (r.licence, r.similarity) for r in licenses.matches(table, 0.3).collect()}
    for p in passages:
        best = max((round(plain_cosine(passages, p, notice), 9), -i, name) for i, (name, notice) in enumerate(licenses.TEMPLATES))
        if best[0] >= 0.3:
            assert got[p] == (best[2], pytest.approx(best[0], abs=2e-9))
        else:
            assert p not in got


def test_nearest_directory_is_inherited(spark):
    mit, gpl = "Released under the MIT License", "This work is licensed under the GNU General Public License, version 3"
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/code.py", "x = 1"), (3, "a/b/COPYING", gpl), (4, "a/b/c/own.py", f"x = 2\n{mit}\n" + "y = 3\n" * 50), (5, "z/none.py", "x"),
        (6, None, None), (7, "a/b/c", ""), (8, "a/other.py", "x"), (8, "a/other.py", "x"), (9, "a//odd", "x"),
    ]
    table = spark.createDataFrame(rows, "doc_id int, path string, text string").withColumns({c: F.lit("?") for c in ("folder", "file", "words", "licence", "passages", "similarity")})
    got = Counter((r.doc_id, r.licence, r.origin, r.inherited_from) for r in licenses.scan_licenses(table).collect())
    assert got == Counter([
        (1, "MIT", "own", None), (2, "GPL-3.0", "directory", "a/b"), (3, "GPL-3.0", "own", None), (4, "MIT", "own", None), (5, None, None, None),
        (6, None, None, None), (7, "GPL-3.0", "directory", "a/b"), (8, "MIT", "directory", "a"), (8, "MIT", "directory", "a"), (9, "MIT", "directory", "a"),
    ])
    assert licenses.scan_licenses(table.where("false")).count() == 0


def commented(text, mark, width=60, opening="", closing=""):
    import textwrap

    lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""]][:-1]
    return "\n".join([*([opening] if opening else []), *[f"{mark}{line}".rstrip() for line in lines], *([closing] if closing else [])])


APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL2 = """Tool for things, written by Some Body.

This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
GPL3 = GPL2.replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3")
BSD = "Copyright 2011 The Authors. All rights reserved. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."


def test_wrapped_headers_in_comments_are_found(spark):
    code = "\nimport os\n\nvalue = os.getcwd()\n" + "value = other(value)\n" * 40
    rows = [
        ("Apache-2.0", commented(APACHE, " * ", opening="/*", closing=" */") + code), ("Apache-2.0", commented(APACHE, "// ") + code),
        ("GPL-2.0", commented(GPL2, "# ") + code), ("GPL-2.0", "#!/bin/sh\n" + commented(GPL2, "## ", 40) + code), ("GPL-2.0", "/* " + commented(GPL2, "   ").strip() + " */" + code),
        ("GPL-3.0", commented(GPL3, "-- ") + code), ("GPL-3.0", commented(GPL3, "; ", 72).replace("\n", "\r\n") + code), ("GPL-3.0", '"""\n' + commented(GPL3, "") + '\n"""' + code),
        ("BSD-3-Clause", commented(BSD, "// ", 70) + code), ("MIT", "// SPDX-License-Identifier: MIT" + code), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */" + code),
        (None, "# You need a fishing licence, and a driving\n# license too, to get there" + code), (None, code),
    ]
    table = spark.createDataFrame([(i, f"d{i}/x", text) for i, (_, text) in enumerate(rows)], "doc_id int, path string, text string")
    got = {r.doc_id: (r.licence, r.origin) for r in licenses.scan_licenses(table).collect()}
    assert got == {i: (name, "own" if name else None) for i, (name, _) in enumerate(rows)}
    # a header, even over next to no code, doesn't cover the directory
    table = spark.createDataFrame([(1, "d/__init__.py", commented(APACHE, "# ")), (2, "d/x.py", "x")], "doc_id int, path string, text string")
    assert {r.doc_id: r.licence for r in licenses.scan_licenses(table).collect()} == {1: "Apache-2.0", 2: None}


def test_licence_texts_cover_their_directory(spark):
    texts = {name: text.replace("Copyright (c)", "Copyright (c) 2019 Some Body <some@body.org>") for name, text in licenses.TEXTS}
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "The words of a very long text that nobody reads.\n\n" * 300
    files = [(f"{name}/terms.txt", commented(text, "", 72)) for name, text in texts.items()]
    files += [("GPL-3.0/about.txt", gpl), ("Apache-2.0/LICENSE.md", "Our terms, in many more words than needed, are these, as far as anyone here knows.\n\nLicensed under the Apache License, Version 2.0")]
    files += [("none/readme", "How it works\n\nLicensed under the Apache License, Version 2.0\n\n" + "Many words about how it works. " * 30)]
    folders = [path.split("/")[0] for path, _ in files]
    rows = [(path, path, text) for path, text in files] + [(f"{f}/src/x.py", f"{f}/src/x.py", "x = 1") for f in folders]
    got = {r.doc_id: (r.licence, r.origin, r.inherited_from) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, path string, text string")).collect()}
    for path, _ in files:
        assert got[path] == ("Apache-2.0" if path == "none/readme" else path.split("/")[0], "own", None)
    for f in folders:
        assert got[f"{f}/src/x.py"] == ((None, None, None) if f == "none" else (f, "directory", f))


def test_paragraphs_by_hand(spark):
    text = "// a\n// b\n//\n// c\nd = 1\ne = 2\n\n/* f\n * g */ h\n# i\n\n \n\tj\r\nk"
    row = spark.createDataFrame([(text,)], "text string").select(licenses.paragraphs(F.col("text"))).first()[0]
    assert row == ["a b", "c", "d = 1 e = 2", "f g", "h", "i", "j k"]


@pytest.mark.parametrize("name", ["op5_chat_windows", "op6_license_scan"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# --- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    source = docs(spark)
    rows = {r.doc_id: r for r in source.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "pii", "mix_sources", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    frame = source
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame.collect(), corpus_pipeline.written(stage(spark, frame, FOLDER), f"test-{name}")
        if name != "bpe":
            assert frame.columns == source.columns
        after = frame.collect()
        if name == "quality_classifier":
            assert {r.doc_id for r in after} < {r.doc_id for r in before}
            assert all(r == rows[r.doc_id] for r in after)
        elif name == "near_duplicates":
            assert len({r.text for r in after}) == len(after) < len(before)
        elif name == "pii":
            assert len(after) == len(before)
            assert not any("@mail" in r.text for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "mix_sources":
            assert sum(len(r.text.split()) for r in after) == pytest.approx(1.5 * sum(len(r.text.split()) for r in before), abs=25)
            assert max(Counter(r.doc_id for r in after).values()) == 2
        else:
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
            assert all(r.n_tokens == len(r.ids) for r in after)


def test_pipeline_stages_on_odd_tables(spark):
    """Null and empty texts, null ids and sources, repeated rows, extra columns and no rows at all go through every stage."""
    import corpus_pipeline

    names = ("key", "row", "id", "worded", "n", "first", "drawn", "_key", "_n", "decoded", "ids", "label", "samples", "size", "target")
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "write to a@mail.example today and then again", "en", None, 44)]
    good = docs(spark).limit(60)
    table = good.union(spark.createDataFrame(rows, good.schema)).withColumns({c: F.lit("?") for c in names})
    for frame in (table, table.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            columns, frame = frame.columns, corpus_pipeline.written(stage(spark, frame, FOLDER), f"odd-{name}")
            assert name == "bpe" or frame.columns == columns
            if name != "bpe":
                assert all(set(r) <= {"?"} for r in frame.select(*names).collect())


def test_entry_survives_without_the_folder(tmp_path):
    """With the folder and the pipeline gone, the entry still imports and lists the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/tickloom", tmp_path / "tickloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert all(int(n) > 150 for n in said.stdout.split())
