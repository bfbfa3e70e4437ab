import random
import re
from collections import Counter

import numpy as np
import pytest

from urlintel.llm import collocations


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, least, first):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    many = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = lambda s, t: any(t[i : i + len(s)] == s for i in range(len(t) - len(s) + 1))
    out = {}
    for (lang, w), a in many.items():
        if any(lang == other and len(v) > len(w) and 100 * b >= 100 * a and inside(w, v) for (other, v), b in many.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:first]))


def random_docs(r, n):
    words = ["A", "b", "cé", "B", "dd", " x", "e\x1f", "の", "long" * 200]
    gaps = [" ", " ", " ", "\t ", ".", ", ", "\n", "\x0b", "?"]
    return [(r.choice(["en", "de", None, "und", ""]), "".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("buckets", [collocations.BUCKETS, 64])
def test_against_brute_force(spark, buckets):
    """The summary only saves work: one of 64 places, which passes nearly everything, gives the same rows."""
    docs = random_docs(random.Random(3), 150) + [(None, None), ("en", ""), ("en", " . "), ("fr", "one word")] + [("en", "the same row of words, here")] * 12
    df = spark.createDataFrame([(*d, 7, "q") for d in docs], "lang string, text string, f long, w1 string").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, 4, 50, buckets).collect()))
    assert got == brute(docs, 4, 50) and len(got) > 60


def test_runs_and_blocks_of_any_size(spark, monkeypatch):
    """Windows that cross runs of words; a long text without a break, and one word of three blocks."""
    monkeypatch.setattr(collocations, "RUN", 5)
    docs = [("en", "a b c d e f g h i j " * 40), ("en", "a b " + "x" * 3_000_000 + " a b"), ("en", "a b c")]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(df, 3, 100, 1 << 12).collect())) == brute(docs, 3, 100)


def test_exact_beyond_64_bits(spark):
    """Products of large counts, and a floor that doubles would miss."""
    a, n = 10**12 + 7, 10**15 + 1
    rows = [("en", 0, "", n), ("en", 1, "p", a), ("en", 1, "q", 10**14 + 3), ("en", 2, "p q", a - 7)]
    found = spark.createDataFrame(rows, "lang string, k int, phrase string, f long")
    assert [tuple(x) for x in collocations.scored(found).collect()] == [("en", "p q", a - 7, a, 10**14 + 3, n, 1000 * (a - 7) * n // (a * (10**14 + 3)))]


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_windows_grow_with_phrases_not_with_partitions(spark, monkeypatch):
    """Five times the rows, in five times the partitions, send each window once a task, of which there is one a core."""
    rows, real = [], collocations.windows

    def windows(*args):
        out = real(*args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(collocations, "windows", windows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        docs = [("en", f"a{i} b{i} c{i}. d{i}") for i in range(10)]
        for copies in (40, 200):
            df = spark.createDataFrame(docs * copies, "lang string, text string").repartition(copies // 5)
            found = collocations.frequencies(df, 5, 20, 1 << 16).collect()
            assert {x.f for x in found if x.k} == {copies} and len(found) == 1 + 10 * (4 + 2 + 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(n <= 40 * spark.sparkContext.defaultParallelism for n in rows), rows


@pytest.mark.parametrize("held, piece", [(1 << 20, 1 << 24), (50, 1 << 16), (1, 1)])
def test_held_windows(monkeypatch, held, piece):
    """All windows with their counts, whatever a task holds before it sends them and however much leaves at once."""
    monkeypatch.setattr(collocations, "RUN", 7)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "PIECE", piece)
    docs, kept, got, expected = random_docs(random.Random(5), 80), collocations.Held(5), Counter(), Counter()

    def take():
        for batch in kept.give():
            for row in batch.to_pylist():
                got[(row["lang"], *(row[f"w{j}"] for j in range(1, 6)))] += row["c"]

    for lang, text in docs:
        runs = collocations.Runs([lang], [text.encode()], 5)
        for at, end, prefixes in runs:
            size = runs.left[at:end] + 1
            key, first, n = np.unique(np.choose(size - 1, prefixes) + size.astype(np.uint64), return_index=True, return_counts=True)
            kept.add(runs, first + at, size[first], key, n)
            if kept.full():
                take()
        for part in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", part)
            expected.update(("und" if lang is None else lang, *(w[i : i + 5] + [""] * 5)[:5]) for i in range(len(w)))
    take()
    assert got == expected and not len(kept.key)
