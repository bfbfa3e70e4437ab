import hashlib
import random
import re

import pytest

from urlintel.llm import decontaminate

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ws(t):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = ws(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = ws(t), set(), set()
        for n in range(1, 11):
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    found |= windows[tuple(w[a : a + n])]
                    hit |= set(range(a, a + n))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_against_brute_force(spark, bits):
    """The filter only thins what is joined: one of 64 bits, which passes everything, gives the same rows."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abé0") for _ in range(r.randint(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(n))) for i, n in enumerate([0, 1, 3, 4, 6, 9, 10, 11, 25, 40, 60])] + [(90, None), (91, "--")]
    items.append((10, items[8][1] + " extra"))
    docs = [(0, None), (1, ""), (2, "!!!"), (3, items[8][1].upper().replace(" ", " -- ")), (None, items[8][1]), (None, "nothing of it"), (None, None), (3, items[9][1]), (3, items[9][1])]
    for i in range(40):
        parts = prose(r.randint(0, 80))
        for _ in range(r.randint(0, 3)):
            w = r.choice(items[2:11])[1].split()
            a = r.randint(0, max(0, len(w) - 10))
            parts += w[a : a + r.randint(5, 30)] + prose(r.randint(0, 9))
        docs.append((i, " ".join(parts)))
    docs.append((700, " ".join(prose(200_000)) + " " + items[8][1]))
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as n_hit", "3 as k1", "4 as windows")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as size")
    got = sorted((tuple(x) for x in decontaminate.contamination(d, b, filter_bits=bits).collect()), key=str)
    want = brute(docs, items)
    assert got == want
    kept = decontaminate.clean(d, b, filter_bits=bits)
    assert kept.columns == d.columns
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(x[0]) for x in want if not x[-1])


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(e, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.contamination(one, b).first()["n_hit"] == 0
