import math
import os
import random
from collections import Counter

from urlintel.llm import licenses

FULL = os.path.join(os.path.dirname(licenses.__file__), "license_texts")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."


def full(name):
    with open(f"{FULL}/{name}.txt") as f:
        return f.read()


def test_scan(spark):
    rows = [
        (1, "a/LICENSE", MIT), (2, "a/b/c/x.py", "code only"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "code and more of it " * 20), (4, "z/q.py", "nothing"),
        (5, "a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (6, "a/w.py", None), (7, None, "x"), (8, "top", ""),
        (9, "d/e.txt", "Words before it.\nLicensed under CC BY-NC 4.0.\nand after"), (10, "a/v.py", "The licence of that driver was lost and he left the town without it."), (6, "a/w.py", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").selectExpr("*", "'q' as license", "1 as score", "2 as k1", "'d' as dir", "3 as bags")
    got = {x["doc_id"]: (x["license"], x["origin"], x["from_dir"]) for x in licenses.scan(df).collect()}
    assert licenses.scan(df).count() == len(rows)
    assert got == {
        1: ("MIT", "own", None), 2: ("GPL-3.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", None), 4: (None, None, None), 5: ("GPL-3.0", "own", None), 6: ("MIT", "inherited", "a"),
        7: (None, None, None), 8: (None, None, None), 9: ("CC-BY-NC-4.0", "own", None), 10: ("MIT", "inherited", "a"),
    }
    assert licenses.scan(df.limit(0)).count() == 0


def test_full_texts_speak_for_their_directories(spark):
    """Texts of thousands of words, also in one line, and a sentence inside a long line."""
    names = [n[:-4] for n in sorted(os.listdir(FULL)) if n.endswith(".txt")]
    rows = [(k, f"{n}/LICENSE", full(n).replace("\n", " ") if k % 2 else full(n)) for k, n in enumerate(names)] + [(100 + k, f"{n}/src/deep/x.c", "int main") for k, n in enumerate(names)]
    words = random.Random(1).choices("tree house river stone wind cloud paper table light green".split(), k=300)
    rows.append((200, "long/line", " ".join(words[:150]) + ". Released under the MIT License. " + " ".join(words[150:])))
    rows.append((201, "very/long", " ".join(words * 1000) + "\n\n// SPDX-License-Identifier: ISC\n" + " ".join(words * 1000)))
    got = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, n in enumerate(names):
        assert (got[k]["license"], got[k]["origin"]) == (n, "own"), n
        assert (got[100 + k]["license"], got[100 + k]["from_dir"]) == (n, n), n
    assert got[200]["license"] == "MIT" and got[201]["license"] == "ISC"


def test_shared_and_missing_ids(spark):
    rows = [(1, "a/x", "Licensed under CC BY 4.0"), (1, "b/x", "SPDX-License-Identifier: MIT"), (None, "c/x", "SPDX-License-Identifier: ISC"), (None, "c/y", "code"), (None, None, None), (None, None, None)]
    got = sorted((str(x["path"]), str(x["license"])) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == [("None", "None"), ("None", "None"), ("a/x", "CC-BY-4.0"), ("b/x", "MIT"), ("c/x", "ISC"), ("c/y", "ISC")]


def test_against_brute_force(spark):
    """TF-IDF, cosine and ancestors calculated from the definition, over the given documents."""
    docs = [(r["doc_id"], f"{r['source']}/{r['lang']}/{r['doc_id']}", r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(1000, "hand/LICENSE", full("MPL-2.0")), (1001, "hand/er/s.c", "x"), (1002, "hand/er/t.c", "Copyright 2020. All rights reserved by the copyright holder.")]
    bags = {}
    for i, _, text in docs:
        low = (text or "").lower()
        if licenses.TELLING.search(low):
            bags[i] = {(tuple(sorted(b.items())), w) for b, w in [*((b, False) for b in licenses.passages(low)), (licenses.bag(low), True)]}
    every = [dict(b) for own in bags.values() for b, _ in own]
    df = Counter(w for b in every for w in b)
    weight = lambda b: {w: (1 + math.log(c)) * (math.log((1 + len(every)) / (1 + df[w])) + 1) for w, c in b.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(n, weight(b)) for n, b in licenses.templates()]

    def best(b):
        v = weight(b)
        return min((-round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 6), n) for n, t in known)

    own, speaks = {}, {}
    for i, path, _ in docs:
        tops = [(*best(dict(b)), w) for b, w in bags.get(i, ())]
        tops = [t for t in tops if -t[0] >= licenses.THRESHOLD]
        if tops:
            own[i] = min(tops)[:2]
            if any(w for *_, w in tops):
                d = path.rpartition("/")[0]
                speaks[d] = min(speaks.get(d, (0, "~")), own[i])
    want = set()
    for i, path, _ in docs:
        if i in own:
            want.add((i, own[i][1], -own[i][0], "own", None))
            continue
        d = path.rpartition("/")[0]
        while d and d not in speaks:
            d = d.rpartition("/")[0]
        want.add((i, speaks[d][1], -speaks[d][0], "inherited", d) if d in speaks else (i, None, None, None, None))
    got = {(x["doc_id"], x["license"], x["score"], x["origin"], x["from_dir"]) for x in licenses.scan(spark.createDataFrame(docs, "doc_id long, path string, text string")).collect()}
    close = lambda rows: {(a, b, None if c is None else round(c, 4), d, e) for a, b, c, d, e in rows}
    assert close(got) == close(want) and len(own) > 3
