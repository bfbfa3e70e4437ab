import random
import re

import pytest

from urlintel.llm import shingle_join


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, len(s), find(d)) for d, s in sets.items()}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 5)))
    prose = lambda n: [word() for _ in range(n)]
    rows, common = [None, "", " \n", "One two", "one TWO", "one two three", "É é", "a b c d e"], prose(60)
    for _ in range(25):
        base = prose(r.randint(5, 150))
        if r.random() < 0.5:
            base += common[: r.randint(20, 60)]
        for _ in range(r.randint(1, 7)):
            copy = list(base)
            for _ in range(int(len(copy) * r.choice([0, 0.005, 0.02, 0.03, 0.05]))):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if r.random() < 0.2 else "  ".join(copy))
    order = list(range(len(rows)))
    r.shuffle(order)
    return list(zip(order, rows))


@pytest.mark.parametrize("seed", [3, 4])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = {tuple(x)[:3] for x in shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) - 20


def test_chain_links_through_members_other_than_the_least(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(12):  # each differs from the one before in one more word, so the ends are not alike
        rows.append((12 - step, " ".join(f"x{i}" if i < 9 * step else w for i, w in enumerate(base))))
    got = {tuple(x)[:3] for x in shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_shared_and_missing_ids(spark):
    """The same rows in two orders: those that share an id keep their sets and are one document; those without one are linked with nothing."""
    w = [f"w{i}" for i in range(100)]
    near = lambda k: " ".join(w[:k] + ["new"] + w[k + 1 :])
    other = [f"v{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (2, near(0)), (2, " ".join(other)), (3, " ".join(["z", *other[1:]])), (4, near(99)), (4, near(99)), (5, "alone here"), (None, " ".join(w)), (None, None), (6, " ".join(f"u{i}" for i in range(50))), (6, " ".join(f"t{i}" for i in range(50)))]
    got = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").selectExpr("*", "'x' as node", "1 as n", "2 as component_id").repartition(3, "text")
        got.append(sorted((tuple(x)[:3] for x in shingle_join.near_duplicates(df).collect()), key=str))
    assert got[0] == got[1]
    assert len(got[0]) == len(rows) and {(d, c) for d, _, c in got[0]} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (None, None), (6, 6)}
    assert sorted(n for d, n, _ in got[0] if d is None) == [0, 96]


def test_very_long_text(spark):
    r = random.Random(8)
    long = [f"{r.randrange(10**6)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-400])), (3, " ".join(long[:60_000]))]
    got = {x["doc_id"]: x["component_id"] for x in shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_empty(spark):
    assert shingle_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string, n int")).count() == 0
