import math
import random

import numpy as np

from urlintel.llm import langid

WORDS = {"en": "the of and to in is that for was with".split(), "de": "der die und den von zu das mit nicht über".split(), "fr": "le la et des les est pour été dans que".split()}


def prose(r, lang, n=60):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", r.choice(WORDS[lang])]) for _ in range(n))


def test_held_out_accuracy_and_rejects(spark):
    r = random.Random(4)
    rows = [(i, l, prose(r, l), f"h{i % 9}") for i in range(600) for l in [r.choice(list(WORDS))]]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string")
    languages, table = langid.fit(df.filter("doc_id < 200"))
    assert languages == ["de", "en", "fr"]
    odd = spark.createDataFrame([(1000, None, "12 34 ## 56", "h1"), (1001, None, None, None), (1002, None, "", "h2"), (1003, "de", "Der " + "über die " * 5000, "h0"), (1003, "de", "Der " + "über die " * 5000, "h0")], df.schema)
    got = langid.identify(langid.document_rows(df.union(odd).filter("doc_id >= 200")), languages, table).collect()
    right = sum(g["lang"] == rows[g["doc_id"]][1] and g["accepted"] for g in got if g["doc_id"] < 600)
    assert right >= 395 and len(got) == 405
    by = {g["doc_id"]: g for g in got}
    assert not any(by[i]["accepted"] for i in (1000, 1001, 1002)) and by[1003]["accepted"] and by[1003]["lang"] == "de"
    assert langid.identify(langid.document_rows(df.limit(0)), languages, table).count() == 0


def test_evidence_is_fused(spark):
    """With no evidence in the text, declaration, suffix and host decide, in that order of strength."""
    table = np.zeros((langid.CELLS, 3), np.float32)
    blank = [(i, "xx", None, None, None) for i in range(3)]
    rows = [(0, "xx", None, "de", "fr"), (1, "xx", None, "de", None), (2, "xx", None, "com", None), (3, "xx", None, None, "klingon")] + [(i + 10, *b[1:]) for i, b in enumerate(blank)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string, declared string")
    got = {g["doc_id"]: g["lang"] for g in langid.identify(df, ["de", "en", "fr"], table).collect()}
    assert got[0] == "fr" and got[1] == "de"


def test_host_prior(spark):
    r = random.Random(5)
    rows = [(i, prose(r, "fr"), "a") for i in range(60)] + [(i, prose(r, "en"), "b") for i in range(60, 200)] + [(900, "ab", "a"), (901, "ab", "b")]
    labelled = spark.createDataFrame([(l, prose(r, l)) for l in ("en", "fr") for _ in range(20)], "lang string, text string")
    languages, table = langid.fit(labelled)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {g["doc_id"]: g for g in langid.identify(langid.document_rows(df), languages, table * np.float32(1)).collect()}
    assert got[5]["lang"] == "fr" and got[100]["lang"] == "en"
    p = {i: g["posterior"] if g["lang"] == "fr" else 1 - g["posterior"] for i, g in got.items()}
    assert p[900] > p[901]


def posterior_by_hand(like, votes, me, overall, told, n):
    """One row: ``votes`` has (suffix counts, host counts) without the row's own vote, or None."""
    prior = list(overall)
    for counts in votes:
        counts = counts or [0] * n
        prior = [(c + langid.STRENGTH * p) / (sum(counts) + langid.STRENGTH) for c, p in zip(counts, prior)]
    score = [x + math.log(p) for x, p in zip(like, prior)]
    for place, right in told:
        if place is not None:
            score = [x + math.log(right if k == place else (1 - right) / (n - 1)) for k, x in enumerate(score)]
    top = max(score)
    odds = [math.exp(x - top) for x in score]
    return [x / sum(odds) for x in odds]


def test_posterior_by_hand(spark):
    """Every kind of evidence, and names of columns that the operator uses itself."""
    r = random.Random(11)
    languages = ["de", "en", "fr"]
    rows = [(i, prose(r, r.choice(languages), r.randint(1, 6)), r.choice(["a.de", "b.com", "c.fr", None]), r.choice([*languages, "xx", None])) for i in range(80)]
    labelled = spark.createDataFrame([(l, prose(r, l)) for l in languages for _ in range(20)], "lang string, text string")
    names, table = langid.fit(labelled)
    df = spark.createDataFrame([(i, t, h, h.rpartition(".")[2] if h else None, d) for i, t, h, d in rows], "doc_id long, text string, host string, suffix string, declared string")
    df = df.selectExpr("*", "'q' as like", "1 as guess", "2 as own", "'w' as s", "3.5 as h", "4 as voted", "true as sure", "6 as p")
    got = {g["doc_id"]: g for g in langid.identify(df, names, table).collect()}
    assert all((g["like"], g["guess"], g["own"], g["s"], g["p"]) == ("q", 1, 2, "w", 6) for g in got.values())
    like, vote = {}, {}
    for i, t, _, _ in rows:
        cells = langid.trigrams(t.encode())
        sums = [float(table[cells, k].astype(float).sum()) * min(len(cells), langid.TEMPER) / len(cells) for k in range(3)]
        like[i], vote[i] = sums, sums.index(max(sums))
    overall = [(sum(v == k for v in vote.values()) + 1) / (len(rows) + 3) for k in range(3)]
    for i, _, host, declared in rows:
        ask = lambda f: [sum(vote[j] == k for j, _, h, _ in rows if h and j != i and f(h)) for k in range(3)] if host else None
        suffix = host.rpartition(".")[2] if host else None
        told = [(languages.index(declared) if declared in languages else None, langid.DECLARED), (languages.index(suffix) if suffix in ("de", "fr") else None, langid.COUNTRY)]
        p = posterior_by_hand(like[i], [ask(lambda h: h.endswith(f".{suffix}")), ask(lambda h: h == host)], vote[i], overall, told, 3)
        assert got[i]["lang"] == languages[p.index(max(p))] and abs(got[i]["posterior"] - max(p)) < 1e-4


def test_pages(spark):
    r = random.Random(12)
    page = lambda lang, declared: f'<html lang="{declared}"><body><nav>x</nav><article><p>{prose(r, lang)}</p></article></body></html>'
    rows = [(1, "https://a.example.de/x", page("de", "de-DE")), (2, None, page("fr", "fr")), (3, "https://b.example.com/", None), (4, "nonsense", ""), (5, "https://c.example.com", "<html LANG=en><p>12 34")]
    labelled = spark.createDataFrame([(l, prose(r, l)) for l in WORDS for _ in range(20)], "lang string, text string")
    got = {g["page_id"]: g for g in langid.identify(langid.page_rows(spark.createDataFrame(rows, "page_id long, url string, html string")), *langid.fit(labelled)).collect()}
    assert got[1]["lang"] == "de" and got[1]["accepted"] and got[2]["lang"] == "fr" and got[2]["accepted"]
    assert not any(got[i]["accepted"] for i in (3, 4, 5)) and got[5]["lang"] == "en"


def test_accuracy_on_given_rows_not_fitted_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = docs.filter("doc_id % 4 = 0")
    texts = {r["text"] for r in fitted.select("text").collect()}
    got = {g["doc_id"]: g for g in langid.identify(langid.document_rows(docs), *langid.fit(fitted)).collect()}
    asked = [r for r in docs.collect() if r["text"] and r["text"] not in texts and r["lang"] and got[r["doc_id"]]["accepted"]]
    right = sum(got[r["doc_id"]]["lang"] == r["lang"] for r in asked)
    assert len(asked) > 300 and right >= 0.9 * len(asked)
