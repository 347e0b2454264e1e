"""License scans: sparse TF-IDF cosine to templates, and inheritance along directories. DataFrame functions only.

Lines, paragraphs (comment marks off, wrapped lines joined) and sentences that speak of licences are
compared with template notices and headers, whole files with licence texts. A file covers its
directory if it is a licence text, opens with the title of one, is named like one and holds a notice,
or consists mostly of notices; a file without a notice of its own takes the licence of the nearest
directory above it that has one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import word_count, written

# Sentences that stand for each licence.
SENTENCES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
# The usual headers of source files, a paragraph each. What both BSD licences share stands for the stricter one.
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
IDENTIFIERS = tuple((name, f"SPDX-License-Identifier: {written_as}") for name, written_as in (
    ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("ISC", "ISC"),
    ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0-1.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    *((f"{kind}-{version}", f"{kind}-{version}{how}") for kind, version in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")) for how in ("", "-only", "-or-later")),
))
# First paragraphs of long licence texts.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
TEMPLATES = SENTENCES + HEADERS + IDENTIFIERS + TITLES
#: Templates from this one on are titles.
FIRST_TITLE = len(TEMPLATES) - len(TITLES)
# Short licence texts.
WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
)
CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
)
ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEXTS = (
    ("MIT", "\n\n".join((
        "MIT License", "Copyright (c)", HEADERS[2][1],
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ))),
    ("BSD-3-Clause", "\n\n".join(("BSD 3-Clause License", "Copyright (c)", *CONDITIONS, ENDORSEMENT, WARRANTY))),
    ("BSD-2-Clause", "\n\n".join(("BSD 2-Clause License", "Copyright (c)", *CONDITIONS, WARRANTY))),
    ("ISC", "\n\n".join((
        "ISC License", "Copyright (c)", HEADERS[-1][1],
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ))),
    ("Unlicense", "\n\n".join((
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ))),
)
CUE = r"(?i)licen[sc]e|redistribut|permission is hereby|permission to use|public domain|free software|mozilla public|spdx"
THRESHOLD = 0.7
#: Share of a file's words in licence sentences from which it is a licence file.
FILE_SHARE = 0.5
LICENSE_NAME = r"(?i)(?:^|/)(?:(?:un)?licen[sc]e|copying)(?:[.\-_][^/]*)?$"
#: Replacements, in order, that take comment marks off: (pattern, what it becomes). Character 1 marks a comment line meanwhile.
UNMARK = (
    (r"\r", ""),
    (r'/\*+!?|\*+/|<!--|-->|"""', "\n\n"),
    (r"\n[ \t]*\*+[ \t]*", "\n"),
    (r"\n[ \t]*(?://+!?|#+|--+|;+|%+|dnl )[ \t]*", "\n\x01"),
    (r"\n\x01([^\n]*)\n([^\x01\n])", "\n\x01$1\n\n$2"),
    (r"\n([^\x01\n][^\n]*)\n\x01", "\n$1\n\n\x01"),
    (r"\x01", ""),
)
BLANK_LINES = r"\n(?:[ \t]*\n)+"


def sentences(text: Column) -> Column:
    """Lines, cut after sentence ends, without outer white space."""
    return F.transform(F.split(text, r"\n|(?<=[.!?])[\x20\t\r]+", -1), lambda s: F.trim(s))


def paragraphs(text: Column) -> Column:
    """Paragraphs that are not blank, each on one line, without comment marks.

    Blank lines end one, empty comment lines too, and so does a change between comment and code.
    """
    plain = F.concat(F.lit("\n"), text)
    for pattern, becomes in UNMARK:
        plain = F.regexp_replace(plain, pattern, becomes)
    joined = F.transform(F.split(plain, BLANK_LINES, -1), lambda p: F.trim(F.regexp_replace(p, r"[ \t\n]+", " ")))
    return F.filter(joined, lambda p: p != "")


def terms(text: Column) -> Column:
    """Lower-case words and numbers (``by-nc`` and ``4.0`` are one term each) and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-/][\p{L}\p{N}]+)*"), F.lit(0))
    pairs = F.when(
        F.size(words) > 1, F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """(folder, depth) of a directory and all above it, up to the empty one."""
    steps = F.split(folder, "/", -1)
    depth = F.when(folder == "", 0).otherwise(F.size(steps))
    return F.transform(F.sequence(F.lit(0), depth), lambda d: F.struct(F.array_join(F.slice(steps, 1, d), "/").alias("folder"), d.alias("depth")))


def similar(counted: DataFrame, templates: Sequence[tuple[str, str]], threshold: float) -> DataFrame:
    """key, template, licence, similarity: the best template of each key of ``counted`` (key, n, term, tf) at or above ``threshold``.

    Document frequencies are over all keys, each n times; a template's terms are weighted by the same
    frequencies. Only terms of templates, a fixed few thousand, meet the templates. Ties go to the
    earlier template.
    """
    spark = counted.sparkSession
    rows = spark.createDataFrame([(i, licence, text) for i, (licence, text) in enumerate(templates)], "template int, licence string, notice string")
    counted = written(counted, "license-terms")
    total = counted.select("key", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequency = written(counted.groupBy("term").agg(F.sum("n").alias("df")), "license-frequencies")

    def weight(df: Column) -> Column:
        return F.log((1 + F.lit(float(total))) / (1 + df)) + 1

    weighed = counted.join(frequency, "term").withColumn("w", F.col("tf") * weight(F.col("df")))
    weighed = written(weighed.select("key", "term", "w"), "license-weights")
    own = rows.select("template", "licence", F.explode(paragraphs(F.col("notice"))).alias("notice"))
    own = own.select("template", "licence", F.explode(terms(F.col("notice"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    own = own.join(frequency, "term", "left").withColumn("v", F.col("tf") * weight(F.coalesce(F.col("df"), F.lit(0))))
    size = own.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("template_norm"))
    own = written(own.join(size, "template").select("template", "licence", "term", (F.col("v") / F.col("template_norm")).alias("v")), "license-templates")
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(own, "term").groupBy("key", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norms, "key").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("similarity") >= threshold)
    best = scored.groupBy("key").agg(F.max(F.struct("similarity", (-F.col("template")).alias("order"), "licence")).alias("best"))
    return best.select("key", (-F.col("best.order")).alias("template"), "best.licence", "best.similarity")


def matches(passages: DataFrame, threshold: float, key: str = "passage", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``key``, template, licence, similarity of distinct passages (``key``, passage, n), each n times in the files."""
    counted = passages.select(F.col(key).alias("key"), "n", F.explode(terms(F.col("passage"))).alias("term")).groupBy("key", "n", "term").agg(F.count("*").alias("tf"))
    return similar(counted, templates, threshold).withColumnRenamed("key", key)


def whole_matches(texts: DataFrame, threshold: float) -> DataFrame:
    """text_key, licence, similarity of whole texts (text_key, paragraphs, n) to licence texts; terms are counted by paragraph and added."""
    pieces = texts.select(F.col("text_key").alias("key"), "n", F.explode("paragraphs").alias("piece"))
    counted = pieces.select("key", "n", F.explode(terms(F.col("piece"))).alias("term")).groupBy("key", "n", "term").agg(F.count("*").alias("tf"))
    return similar(counted, TEXTS, threshold).select(F.col("key").alias("text_key"), "licence", "similarity")


def scan_licenses(files: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """Rows doc_id, path, licence, similarity, origin, inherited_from; one per input row.

    origin is "own" for a notice in the file, "directory" for one inherited (inherited_from names the
    directory, which may be the file's own) and null without a licence. A match of
    the whole text counts before those of passages; of several notices the most similar counts, ties
    to the greater licence name; of several licence files in a directory the most
    similar, ties to the lesser licence name. Whole texts are searched.

    A null or empty text has no notice and can inherit; a null path counts as empty, the top directory.
    Equal rows give equal rows. An empty table gives an empty table. Columns beside the three named are
    not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    speaks = text.rlike(CUE)
    scanned = files.select(
        F.col(id_col).alias("doc_id"), path.alias("path"), directory(path).alias("folder"),
        F.when(speaks, F.filter(sentences(text), lambda s: s.rlike(CUE))).alias("lines"), F.when(speaks, paragraphs(text)).alias("paragraphs"),
        # a file that speaks of licences is known by its text, others by their path, which spreads them
        F.when(speaks, F.md5(F.concat_ws("\u0000", path, text).cast("binary"))).otherwise(path).alias("file"),
        F.when(speaks, word_count(text)).alias("words"),
    )
    scanned = written(scanned, "license-scan")
    told = scanned.where("words IS NOT NULL").dropDuplicates(["file"])
    cued = F.filter("paragraphs", lambda p: p.rlike(CUE))

    def kind(k: int, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(k).alias("kind"), t.alias("passage")))

    # 0 lines, 1 paragraphs, 2 sentences of paragraphs, 3 the first paragraph
    spoken = told.select(
        "file", F.explode(F.concat(
            kind(0, F.col("lines")), kind(1, cued), kind(2, F.filter(F.flatten(F.transform(cued, sentences)), lambda s: s.rlike(CUE))),
            kind(3, F.filter(F.slice("paragraphs", 1, 1), lambda p: p.rlike(CUE))),
        )).alias("said"),
    )
    spoken = written(spoken.select("file", "said.kind", "said.passage", F.md5(F.col("said.passage").cast("binary")).alias("passage_key")), "license-passages")
    distinct = spoken.groupBy("passage_key").agg(F.any_value("passage").alias("passage"), F.count("*").alias("n"))
    known = written(matches(distinct, threshold, "passage_key"), "license-matches")
    by_passage = spoken.join(known, "passage_key").groupBy("file").agg(
        F.max(F.struct("similarity", "licence")).alias("best"),
        *[F.sum(F.when(F.col("kind") == k, word_count(F.col("passage"))).otherwise(0)).alias(f"words_{k}") for k in (0, 2)],
        F.max((F.col("kind") == 3) & (F.col("template") >= FIRST_TITLE)).alias("titled"),
    )
    keyed = told.select("file", "paragraphs", F.md5(F.array_join("paragraphs", "\n").cast("binary")).alias("text_key"))
    texts = keyed.groupBy("text_key").agg(F.any_value("paragraphs").alias("paragraphs"), F.count("*").alias("n"))
    whole = written(keyed.select("file", "text_key").join(whole_matches(texts, threshold), "text_key").select("file", F.struct("similarity", "licence").alias("whole")), "license-texts")
    noticed = told.select("file", "path", "folder", "words").join(written(by_passage, "license-notices"), "file", "left").join(whole, "file", "left")
    noticed = noticed.where("best IS NOT NULL OR whole IS NOT NULL").withColumn("top", F.coalesce("whole", "best"))
    most = F.greatest("words_0", "words_2") >= FILE_SHARE * F.col("words")
    covers = F.col("whole").isNotNull() | F.col("path").rlike(LICENSE_NAME) | F.coalesce(F.col("titled") | most, F.lit(False))
    noticed = written(noticed.select("file", "folder", "top.licence", "top.similarity", covers.alias("covers")), "license-own")
    covering = noticed.where("covers").groupBy(F.col("folder").alias("cover")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("c"))
    folders = scanned.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("a"))
    reached = folders.join(covering, F.col("a.folder") == F.col("cover")).groupBy("folder").agg(F.max(F.struct("a.depth", "cover", F.col("c.licence").alias("licence"))).alias("up"))
    reached = written(reached.select(F.col("folder").alias("_folder"), F.col("up.cover").alias("cover"), F.col("up.licence").alias("from_above")), "license-folders")
    own = noticed.select(F.col("file").alias("_file"), "licence", "similarity")
    mine = scanned.select("doc_id", "path", "folder", "file").join(own, F.col("file") == F.col("_file"), "left")
    full = mine.join(reached, F.col("folder") == F.col("_folder"), "left")
    has = F.col("licence").isNotNull()
    return full.select(
        "doc_id", "path", F.coalesce("licence", "from_above").alias("licence"), "similarity",
        F.when(has, "own").when(F.col("from_above").isNotNull(), "directory").alias("origin"), F.when(~has, F.col("cover")).alias("inherited_from"),
    )
