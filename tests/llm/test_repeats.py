import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from urlintel.llm import repeats


def brute(docs, length=200):
    seen = Counter(raw[i : i + length] for _, raw in docs for i in range(len(raw) - length + 1))
    out = set()
    for doc, raw in docs:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.add((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(r.randint(30, 90)) for _ in range(6)]
    texts = [None, "", "short", "x" * 900, "ab" * 400, prose(400)]
    for _ in range(40):
        parts = [prose(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            cut = r.randint(0, len(s) // 2)
            parts += [s[cut : cut + r.randint(150, 400)], prose(r.randint(0, 40))]
        texts.append("".join(parts))
    texts += [texts[10], texts[10], texts[12][:-1], texts[14][3:]]
    near = texts[20].split(" ")
    for i in range(0, len(near), 30):
        near[i] = "zz"
    texts.append(" ".join(near))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    got = {tuple(r) for r in repeats.remove_repeats(df).collect()}
    assert got == brute([(i, (t or "").encode()) for i, t in rows])


def test_sorted_suffixes_against_python():
    r = random.Random(5)
    for _ in range(50):
        texts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(20, 60))) for _ in range(4)]
        joined = b"".join(t + b"\0" * 20 for t in texts)
        base = np.cumsum([0] + [len(t) + 20 for t in texts])
        where = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 10)]
        starts, room = np.array([base[k] + i for k, i in where]), np.array([len(texts[k]) - i for k, i in where])
        order, prefix = repeats.sorted_suffixes(starts, room, np.frombuffer(joined, np.uint8), 20)
        suffix = [texts[where[j][0]][where[j][1] :][:20] for j in order]
        assert all(x.ljust(20, b"\0") <= y.ljust(20, b"\0") for x, y in zip(suffix, suffix[1:]))
        for x, y, n in zip(suffix, suffix[1:], prefix[1:]):
            assert n == len(os.path.commonprefix([x, y]))


def test_missing_ids_clashing_columns_and_a_long_text(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    long = " ".join(word() for _ in range(150_000))
    rows = [(None, "n" * 300), (None, "m" * 199), (1, long), (1, long[5000:5400]), (2, "o" * 260), (2, "p" * 250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k1", "'x' as core", "2 as n_removed", "3 as at")
    got = sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"]) for x in repeats.remove_repeats(df).collect())
    assert got == [("1", 400, 400, 1), ("1", len(long), 400, 1), ("2", 250, 250, 1), ("2", 260, 260, 1), ("None", 199, 0, 0), ("None", 300, 300, 1)]


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(empty).count() == 0
    twice = spark.createDataFrame([(1, "q" * 150 + "r" * 100, 5), (1, "q" * 150 + "r" * 100, 5), (1, "s" * 10, 6), (None, None, 7)], "doc_id long, text string, n_bytes int")
    got = sorted(map(tuple, repeats.remove_repeats(twice).select("n_bytes", "n_removed", "n_spans").collect()))
    assert got == [(0, 0, 0), (10, 0, 0), (250, 250, 1), (250, 250, 1)]
