import random
import re

import pytest

from urlintel.llm import mixing


def wanted(docs, weights=(5, 2, 1)):
    """source -> (size, target), by the words of the contract: what is above goes to the others, round by round."""
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    got, rest, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while rest > 1e-9 and free:
        w = sum(weight[s] for s in free)
        for s in free:
            got[s] += rest * weight[s] / w
        rest = 0.0
        for s in sorted(free, key=str):
            if got[s] >= 2 * sizes[s]:
                rest += got[s] - 2 * sizes[s]
                got[s] = 2.0 * sizes[s]
                free.discard(s)
    return {s: (sizes[s], got[s]) for s in order}


def check(rows, docs):
    want = wanted(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d[0]), size(d[1])) for d in docs)
    taken, most = {}, {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        key = (r["source_size"], round(r["target"], 3))
        taken[key] = taken.get(key, 0) + r["taken"]
        most[key] = max(most.get(key, 0), r["size"])
    by = {}
    for s, t in want.values():
        by[s, round(t, 3)] = by.get((s, round(t, 3)), 0) + t
    assert set(taken) == set(by)
    for key, t in by.items():
        assert abs(taken[key] - t) <= most[key] / 2 * (t / max(key[1], 1e-9)) + 1


def prose(r, n):
    return "".join(r.choice("ab é") + r.choice([" ", "\n", "\x0b ", "  "]) for _ in range(n))


def docs_of(r, n):
    return [(r.choice([i, i, None, 5]), prose(r, r.choice([0, 1, 3, 10, 40])), r.choice(["a", "b", "c", "ä", "z", "Z", None, "", "b", "b"])) for i in range(n)]


@pytest.mark.parametrize("bits", [10, 2])
def test_targets_and_sizes(spark, monkeypatch, bits):
    """With small groups the tree has several levels."""
    monkeypatch.setattr(mixing, "GROUP_BITS", bits)
    r = random.Random(4)
    docs = docs_of(r, 400) + [(900, "same words here", "b")] * 50 + [(901, None, "b"), (902, prose(r, 2000), "c"), (903, "x", "only")]
    df = spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id long, text string, source string, mass int, none boolean")
    rows = mixing.mix_sources(df.repartition(3)).collect()
    check(rows, docs)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_expectation_of_a_meeting():
    """Over many pairs a document keeps its expectation, and no mass is lost."""
    n, got = 4000, 0
    for i in range(n):
        a, b = [i, 100, 30], [-i - 1, 50, 20]
        one, other = mixing.meet(a, b)
        assert a[-1] + b[-1] == 50 and one[-1] in (0, one[-2]) and 0 <= other[-1] <= other[-2]
        got += a[-1]
    assert abs(got / n - 30) < 1


def test_equal_rows_are_one(spark):
    """Half of a thousand copies are taken, and one row of many chunks comes back whole."""
    docs = [(1, "a b", "s")] * 9000 + [(2, "c", "t")] * 3
    rows = mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    check(rows, docs)


def test_nothing(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], kind)).collect() == []
    assert [tuple(x) for x in mixing.mix_sources(spark.createDataFrame([(1, None, None)], kind)).collect()] == [(1, 0, 0, 0.0, 0)]
