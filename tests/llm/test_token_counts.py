import random

from urlintel.llm import token_counts


def test_against_brute_force(spark):
    r = random.Random(6)
    n = [0, 0, 1, 5, 1023, 1024, 1025, 70_000] + [r.randint(0, 5000) for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "doc_id long, n_tokens long")
    table = token_counts.by_limit(token_counts.histogram(df, (512, 200_000)))
    got = {x["context_limit"]: x for x in table.collect()}
    assert set(got) == {*n, 512, 200_000}
    for limit, x in got.items():
        fit = [v for v in n if v <= limit]
        assert (x["n_docs"], x["docs_fit"], x["tokens_fit"]) == (n.count(limit), len(fit), sum(fit))
        assert (x["tokens_total"], x["tokens_truncated"]) == (sum(n), sum(min(v, limit) for v in n))
    assert token_counts.quantile_length(table, 0.5).first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, n_tokens long")
    rows = token_counts.by_limit(token_counts.histogram(e, (8,))).collect()
    assert [tuple(x) for x in rows] == [(8, 0, 0, None, 0, 0, 0)]


def test_encoded_lengths(spark):
    """From texts: null, empty and very long ones, repeated rows, and columns of the same names."""
    import tiktoken

    from urlintel.llm import bpe

    library = tiktoken.Encoding("own", pat_str=bpe.defaults()[1], mergeable_ranks=bpe.load(*bpe.defaults()).transducer.ranks, special_tokens={})
    texts = [None, "", "Hello there, wörld", "Hello there, wörld", "x y " * 60_000, "\U0001f600" * 50]
    df = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "7 as n_tokens", "'q' as ids", "1 as range")
    n = [len(library.encode_ordinary(t or "")) for t in texts]
    got = {x["context_limit"]: x for x in token_counts.by_limit(token_counts.histogram(token_counts.lengths(df, *bpe.defaults()), (10,))).collect()}
    assert set(got) == {*n, 10} and got[0]["n_docs"] == 2 and got[max(n)]["tokens_total"] == sum(n)
    assert got[10]["tokens_truncated"] == sum(min(x, 10) for x in n)
