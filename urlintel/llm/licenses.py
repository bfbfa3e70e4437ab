"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

What a file says of its licence is looked for in its passages: sentences and paragraphs with a telling word, long ones as
overlapping windows of WINDOW words; and in the file as a whole, however long. Passages are bags of words, and equal ones,
of which a corpus has very many, are one row with a count. Document frequencies of all words are counted over all passages
and joined to the bags, which makes them sparse TF-IDF vectors; the template of highest cosine, at least THRESHOLD, names
the passage's licence, and the best passage its file's. Templates are usual header wordings and the full texts in
``license_texts``. A file whose whole text reaches the threshold is a licence file and speaks for its directory. Files
without a licence take that of the nearest ancestor directory that has one, found by joining every directory's ancestors
with the directories that licence files speak for.

Defined results: null or empty texts state nothing and may inherit; ties go to the higher score, then to the licence
first in order; a path without a slash lies in the root directory ""; null paths inherit nothing; rows are known by what
is in them, so shared or missing ids keep them apart and repeated rows give repeated results; texts of any length are read
whole; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices, row_key
from .stash import stash

THRESHOLD = 0.6
WINDOW = 64  # words of a window of a long passage; windows overlap by half
SALT = 16  # tasks that the files of one directory are dealt to
WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]")
SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n")
PARAGRAPH = re.compile(r"\n[\s#*/;-]*\n")
TELLING = re.compile("licen|copyright|spdx|warrant|redistribut|public domain|permission is hereby")

# Usual wordings of common licences.
HEADERS = {
    "AGPL-3.0": ["SPDX-License-Identifier: AGPL-3.0", "licensed under the GNU Affero General Public License version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "Apache-2.0": ["SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license", "Released under the 3-clause BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["SPDX-License-Identifier: CC-BY-4.0", "Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["SPDX-License-Identifier: CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"],
    "GPL-2.0": ["SPDX-License-Identifier: GPL-2.0", "This work is licensed under the GNU General Public License, version 2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": ["SPDX-License-Identifier: GPL-3.0", "This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "ISC": ["SPDX-License-Identifier: ISC", "Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["SPDX-License-Identifier: MIT", "Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "MPL-2.0": ["SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}


@lru_cache(maxsize=1)
def templates() -> list[tuple[str, Counter]]:
    """(licence, bag of words) of every header wording and full text, in order."""
    texts = [(name, t) for name, wordings in HEADERS.items() for t in wordings]
    for f in resources.files(__package__).joinpath("license_texts").iterdir():
        if f.name.endswith(".txt"):
            texts.append((f.name[: -len(".txt")], f.read_text(encoding="utf-8")))
    return [(name, bag(t.lower())) for name, t in sorted(texts)]


def bag(low: str) -> Counter:
    return Counter(WORD.findall(low))


def passages(low: str) -> list[Counter]:
    """The bags of a lower-cased text's sentences and paragraphs with a telling word."""
    out = []
    for paragraph in PARAGRAPH.split(low):
        if TELLING.search(paragraph):
            for part in {paragraph, *SENTENCE.split(paragraph)}:
                if TELLING.search(part):
                    words = WORD.findall(part)
                    last = max(0, -(-2 * (len(words) - WINDOW) // WINDOW))
                    for k in range(last + 1):
                        window = words[k * WINDOW // 2 : k * WINDOW // 2 + WINDOW]
                        if not last or TELLING.search(" ".join(window)):
                            out.append(Counter(window))
    return out


def name_of(words: list[str], counts: list[int], whole: bool) -> tuple[int, int]:
    """128 bits that tell a bag."""
    digest = hashlib.blake2b("\n".join(f"{w} {c}" for w, c in zip(words, counts, strict=True)).encode() + bytes([whole]), digest_size=16).digest()
    return tuple(np.frombuffer(digest, "<i8").tolist())


BAGS = "array<struct<p1:long,p2:long,whole:boolean,words:array<string>,counts:array<int>>>"


def read(files: DataFrame) -> DataFrame:
    """k1, k2, doc_id, path and the bags of each file: of its passages, and of the whole."""
    kind = pa.list_(pa.struct([("p1", pa.int64()), ("p2", pa.int64()), ("whole", pa.bool_()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))]))

    def make():
        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(4).to_pylist():
                low = (text or "").lower()
                found = {}
                if TELLING.search(low):
                    for b, whole in [*((b, False) for b in passages(low)), (bag(low), True)]:
                        words = sorted(b)
                        counts = [b[w] for w in words]
                        p1, p2 = name_of(words, counts, whole)
                        found[p1, p2] = {"p1": p1, "p2": p2, "whole": whole, "words": words, "counts": counts}
                rows.append(list(found.values()))
            return pa.record_batch([*batch.columns[:4], pa.array(rows, kind)], ["k1", "k2", "doc_id", "path", "bags"])

        return do

    return map_slices(files.select(*row_key("doc_id", "path", "text"), "doc_id", "path", "text"), make, f"k1 long, k2 long, doc_id long, path string, bags {BAGS}")


class Templates:
    """Unit TF-IDF vectors of the templates."""

    def __init__(self, idf: dict[str, float]):
        self.names, self.postings = [], {}
        for k, (name, words) in enumerate(templates()):
            raw = {w: (1 + math.log(c)) * idf[w] for w, c in words.items()}
            length = math.sqrt(sum(x * x for x in raw.values())) or 1.0
            self.names.append(name)
            for w, x in raw.items():
                self.postings.setdefault(w, []).append((k, x / length))

    def best(self, weights: dict[str, float]) -> tuple[float, str]:
        """The highest cosine (rounded) of a passage's weights, and its licence; ties go to the first in order."""
        scores: dict[int, float] = {}
        for w, x in weights.items():
            for k, y in self.postings.get(w, ()):
                scores[k] = scores.get(k, 0.0) + x * y
        length = math.sqrt(sum(x * x for x in weights.values()))
        if not scores:
            return 0.0, ""
        least, name = min((-round(s / length, 6), self.names[k]) for k, s in scores.items())
        return -least, name


def scored(bags: DataFrame, threshold: float) -> DataFrame:
    """p1, p2, license, score: the bags (p1, p2, n, words, counts) that reach the threshold; n says how often a bag occurs."""
    total = bags.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
    words = bags.select("p1", "p2", "n", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("p1", "p2", "n", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    df = stash(words.groupBy("word").agg(F.sum("n").alias("df")))
    idf = lambda c: F.log((1 + F.lit(float(total))) / (1 + c)) + 1
    vocabulary = sorted({w for _, b in templates() for w in b})
    asked = df.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string").join(df, "word", "left")
    known = {r["word"]: r["idf"] for r in asked.select("word", idf(F.coalesce("df", F.lit(0))).alias("idf")).collect()}  # as many rows as the templates have words
    sent = df.sparkSession.sparkContext.broadcast(known)
    vectors = words.join(df, "word").groupBy("p1", "p2").agg(F.collect_list(F.struct("word", ((1 + F.log("c")) * idf(F.col("df"))).alias("x"))).alias("v"))

    def make():
        against = Templates(sent.value)

        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            top = [against.best({e["word"]: e["x"] for e in sorted(v, key=lambda e: e["word"])}) for v in batch.column(2).to_pylist()]
            keep = pa.array([s >= threshold for s, _ in top], pa.bool_())
            return pa.record_batch([*batch.columns[:2], pa.array([n for _, n in top], pa.string()), pa.array([s for s, _ in top], pa.float64())], ["p1", "p2", "license", "score"]).filter(keep)

        return do

    return map_slices(vectors, make, "p1 long, p2 long, license string, score double")


def statements(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` has doc_id, path, text. Gives k1, k2, doc_id, path, license and score of the best passage (null below
    the threshold), and whether the whole file is a licence text."""
    rows = stash(read(files))
    each = rows.select("k1", "k2", F.explode("bags").alias("b")).select("k1", "k2", "b.*")
    bags = stash(each.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.first("words").alias("words"), F.first("counts").alias("counts")))
    told = stash(scored(bags, threshold))
    place = F.struct((-F.col("score")).alias("s"), "license")
    best = each.select("k1", "k2", "p1", "p2", "whole").join(told, ["p1", "p2"]).groupBy("k1", "k2").agg(F.min(place).alias("best"), F.max("whole").alias("is_license_file"))
    joined = rows.select("k1", "k2", "doc_id", "path").join(best, ["k1", "k2"], "left")
    return joined.select("k1", "k2", "doc_id", "path", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"), F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"))


def inherited(stated: DataFrame) -> DataFrame:
    """Fill in the licence of the nearest ancestor directory: license, score, origin (own, inherited or null), from_dir."""
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    stated = stash(stated.withColumn("dir", directory))
    speaks = stated.filter("is_license_file and path is not null").groupBy(F.col("dir").alias("ancestor")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")).select("ancestor", F.col("best.license").alias("from_license"), (-F.col("best.s")).alias("from_score"))
    dirs = stated.filter("license is null and path is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    chain = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("depth", "ancestor"))
    nearest = chain.join(speaks, "ancestor").groupBy("dir").agg(F.max_by(F.struct("from_license", "from_score", F.col("ancestor").alias("from_dir")), "depth").alias("near"))
    # A directory may hold very many files: they are dealt by directory and salt.
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("salt", F.col("salt").cast("long"))
    joined = stated.withColumn("salt", F.pmod("k1", F.lit(SALT))).join(salted, ["dir", "salt"], "left")
    may = F.col("license").isNull() & F.col("path").isNotNull()
    return joined.select(
        "doc_id", "path", F.when(may, F.col("near.from_license")).otherwise(F.col("license")).alias("license"), F.when(may, F.col("near.from_score")).otherwise(F.col("score")).alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(may & F.col("near").isNotNull(), "inherited").alias("origin"), F.when(may, F.col("near.from_dir")).alias("from_dir"),
    )


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a file: doc_id, path, license, score, origin, from_dir."""
    files = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return inherited(statements(files, threshold))
