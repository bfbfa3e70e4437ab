import math
import random

from urlintel.llm import topk


def brute(rows, queries, k=5):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, v in [(i, [math.floor(256 * x) for x in v]) for i, v in queries if i is not None and ok(v)]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.25, 0.125, r.random()]) for _ in range(8)]) for i in range(300)]
    rows += [(1000, None), (1050, [float("nan")] * 8), (1100, [None] + [0.5] * 7), (1150, [float("inf")] * 8), (1200, [1.0, 2.0]), (1250, [3.0, 1.0]), (None, [0.0] * 8), (1300, []), (1350, [])]
    rows += [(1400, [1e6, -1e6, 3.0]), (1450, [1e5 + 0.125, 1e6, -7.0]), (1500, [1e6, 1e6 + 0.00390625, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "3 as score")
    queries = [x for x in rows if x[0] is not None and x[0] % 50 == 0]
    got = topk.top_k(df.repartition(3), df.filter("vec_id % 50 = 0"), tile=64, block=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, queries)
    assert got.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:bigint>"


def test_few_and_none(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(e, e).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, topk.top_k(two, two.filter("vec_id = 0")).collect())) == [(0, 1, 7, 256 * 512)]
