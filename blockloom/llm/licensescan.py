"""License scans (operator 5): sparse TF-IDF cosine to templates, then inheritance by path.

Every text is searched whole: its sentences, lines, paragraphs and itself are passages.
Passages and templates are sparse TF-IDF vectors; how many documents hold a template word
is counted over all documents. A passage's license is the template with the highest cosine,
if it reaches the threshold. Of each template the heaviest words are anchors, as many as it
takes for the others' mass to stay below any threshold: a passage without an anchor can't
reach one, so only those with one are scored. Short templates differ in a name or a version
only; these must be there for the template to count. A file that as a
whole is close to a template, or that is named like a license file, speaks for its
directory; files without a license of their own inherit from the nearest directory above
them that has one.

Scale: two maps over the texts. The counts gathered for IDF have one row for each word of
the templates. Inheritance works on distinct directories: each is exploded to its
ancestors (as many as it is deep) and meets the license directories in an equi-join; files
join their directory's answer, one row for each directory, so a directory with a third of
all files is a split join, not a group."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, only

# Customary notices of each license, long and short.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Released under the Apache License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This file is MIT licensed."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "Licensed under GPL v2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "Licensed under GPL v3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
)
THRESHOLD = 0.7
FILE_THRESHOLD = 0.5  # for a whole text to speak for its directory
NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
SHORT = 14  # words up to which a template needs its names and versions
TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
SENTENCE = re.compile(r"(?<=[.;!?])\s+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


VOCABULARY = frozenset(t for _, text in TEMPLATES for t in tokens(text))


def document_counts(files: DataFrame) -> tuple[int, dict[str, int]]:
    """How many documents there are, and how many hold each template word: one row a word
    and task before the sum, one row a word after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen[""] += 1
                if t:
                    seen.update(VOCABULARY.intersection(tokens(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = files.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def _required() -> list[frozenset[str]]:
    """For each template the words that a passage must have: of a short one those of its
    license alone and those that begin with a digit."""
    of: dict[str, set[str]] = {}
    for name, text in TEMPLATES:
        for w in tokens(text):
            of.setdefault(w, set()).add(name)
    short = [len(tokens(text)) <= SHORT for _, text in TEMPLATES]
    named = [frozenset(w for w in tokens(text) if len(of[w]) == 1 and w in NAME_WORDS or w[0].isdigit() and len(w) < 4) for _, text in TEMPLATES]
    return [words if few else frozenset() for words, few in zip(named, short)]


# Words that name a license.
NAME_WORDS = frozenset("apache mit gpl lgpl agpl lesser affero bsd isc mpl mozilla cc cc0 unlicense nc sa noncommercial 2 3 v2 v3".split())


class Scorer:
    def __init__(self, n: int, counts: dict[str, int]):
        self.idf = {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1 for w in VOCABULARY}
        self.other = math.log(1 + n) + 1  # of words that no template has
        self.templates = [(name, *self.vector(tokens(text)), must) for (name, text), must in zip(TEMPLATES, _required())]
        least, anchors = min(THRESHOLD, FILE_THRESHOLD) - 1e-6, set()
        for _, v, norm, _ in self.templates:
            rest = norm * norm
            for w in sorted(v, key=lambda w: (-self.idf[w], w)):
                if rest < (least * norm) ** 2:
                    break
                anchors.add(w)
                rest -= v[w] ** 2
        self.anchors = frozenset(anchors)

    def vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        v = {w: c * self.idf.get(w, self.other) for w, c in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    def best(self, words: list[str]) -> tuple[float, str]:
        if self.anchors.isdisjoint(words):
            return 0.0, ""
        v, norm = self.vector(words)
        top = (0.0, "")
        for name, t, t_norm, must in self.templates:
            if must and not must <= v.keys():
                continue
            dot = sum(x * v[w] for w, x in t.items() if w in v)
            if dot and (s := dot / (norm * t_norm)) > top[0] + 1e-12:
                top = (s, name)
        return top

    def scan(self, text: str | None) -> tuple[str | None, float, float, str | None]:
        """(license, its score, the whole text's score and license); scores under both
        thresholds may be stated as 0"""
        if not text:
            return None, 0.0, 0.0, None
        whole_words = tokens(text)
        if self.anchors.isdisjoint(whole_words):
            return None, 0.0, 0.0, None
        whole = self.best(whole_words)
        top = whole
        lines = text.split("\n")
        done = -1
        for i, line in enumerate(lines):
            words = tokens(line)
            if self.anchors.isdisjoint(words):
                continue
            passages = [words, *map(tokens, SENTENCE.split(line))]
            if i > done:  # the paragraph around it, once
                a = b = i
                while a > 0 and lines[a - 1].strip():
                    a -= 1
                while b + 1 < len(lines) and lines[b + 1].strip():
                    b += 1
                done = b
                if b > a:
                    passages.append(tokens("\n".join(lines[a : b + 1])))
            for p in passages:
                if (s := self.best(p))[0] > top[0] + 1e-12:
                    top = s
        ok = top[0] >= THRESHOLD
        return (top[1] if ok else None), top[0], whole[0], (whole[1] or None)


def _folder(path: Column) -> Column:
    """What stands before the last slash; the root is the empty string."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def _above(folder: Column) -> Column:
    """Depth and name of a directory and of all above it, the root included."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("dir")),
    )


def scan_licenses(files: DataFrame) -> DataFrame:
    """doc_id, path, own_license, score, is_license_file, license and inherited_from for
    every row of ``files`` (doc_id, path, text).

    Null texts have no license of their own; a null path lies in the root; of several
    license files in one directory the closest to its template speaks, ties to the smaller
    name; a file's own license always wins; inherited_from is null unless it was
    inherited; repeated rows come back as often as they are there. An empty table gives an
    empty table."""
    thin = only(files, doc_id="doc_id", path="path", text="text").select(
        F.col("doc_id").cast("long"), F.coalesce("path", F.lit("")).alias("path"), "text"
    )
    n, counts = document_counts(thin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(n, counts)
        for b in batches:
            cols = list(zip(*(scorer.scan(t) for t in b.column("text").to_pylist()))) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("path"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "path", "own_license", "score", "whole", "whole_license"],
            )

    found = thin.mapInArrow(run, "doc_id long, path string, own_license string, score double, whole double, whole_license string")
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(NAMES) & F.col("own_license").isNotNull()
    speaks = named | (F.col("whole") >= FILE_THRESHOLD)
    found = materialise(found.withColumn("is_license_file", speaks).withColumn("dir", _normal(_folder(F.col("path")))), "licenses")

    law = (
        found.filter("is_license_file")
        .withColumn("name", F.coalesce("own_license", "whole_license"))
        .groupBy(F.col("dir").alias("of"))
        .agg(F.min(F.struct((-F.col("whole")).alias("s"), "name")).alias("x"))
        .select("of", F.col("x.name").alias("law"))
    )
    above = found.select("dir").distinct().select("dir", F.explode(_above(F.col("dir"))).alias("a")).select("dir", "a.depth", F.col("a.dir").alias("of"))
    nearest = above.join(law, "of").groupBy("dir").agg(F.max(F.struct("depth", "of", "law")).alias("x"))
    out = found.join(nearest.select("dir", "x.of", "x.law"), "dir", "left")
    inherits = F.col("own_license").isNull() & F.col("law").isNotNull()
    return out.select(
        "doc_id",
        "path",
        "own_license",
        F.round("score", 6).alias("score"),
        "is_license_file",
        F.coalesce("own_license", "law").alias("license"),
        F.when(inherits, F.col("of")).alias("inherited_from"),
    )


def _normal(folder: Column) -> Column:
    return F.array_join(F.filter(F.split(folder, "/"), lambda x: x != ""), "/")


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/hundreds of ids/id.txt."""
    none = F.lit("(none)")
    path = F.concat_ws(
        "/",
        F.coalesce("source", none),
        F.coalesce("lang", none),
        F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), none),
        F.concat(F.coalesce(F.col("doc_id").cast("string"), none), F.lit(".txt")),
    )
    return docs.select("doc_id", path.alias("path"), "text")
