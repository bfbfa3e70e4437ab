from itertools import product

import pyspark
import pytest
from pyspark.sql import functions as F

from urlintel.functions import psl, urls
from urlintel.operators import runs

# Every combination of these parts, each with what it means; the suffix of a name is known, as it is put together here.
HOSTS = [(("", "tidepool", "net"), None), (("k7", "tidepool", "net"), None), (("n4.k7", "tidepool", "net"), None), (("", "tidepool", "co.uk"), None), (("k7.under_score", "tidepool", "co.uk"), None), (("m2", "tidepool", "xn--p1ai"), None), (None, "198.51.100.203"), (None, "2001:db8:5::9")]
FRONTS = [("", ""), ("ftp://", ""), ("https://", "ann:p%40w@"), ("//", "")]
STEPS = [(), ("one",), ("one", "two+%C3%A9", "three")]
FILES = [None, "tool.exe", ".hidden", "a.tar.gz", "ends."]
QUERIES = [None, "z=9&y=/q.zip"]
ENDS = ["", "/", "#part"]


def meaning(host, address, steps, file, query):
    """host, sub-domains, domain, path, file, ip, and the key that it is listed under, from the parts alone."""
    name = address or ".".join(x for x in (host[0], *host[1:]) if x)
    domain = None if address else f"{host[1]}.{host[2]}"
    segments = [x.replace("%C3%A9", "\u00e9") for x in steps] + ([file] if file else [])
    path = "/" + "/".join(segments) if segments else None
    is_file = file is not None and not file.endswith(".")
    if address:
        key = ("ip", address)
    elif is_file:
        key = ("full_url", f"{name}{path}?{query}") if query else ("file", file)
    elif path:
        key = ("host_path", name + path)
    else:
        key = ("host", name) if host[0] else ("domain", name)
    return name, host[0].split(".") if host and host[0] else None, domain, path, file if is_file else None, address, key


def written(front, host, address, steps, file, query, end):
    name = (f"[{address}]:81" if ":" in address else address) if address else ".".join(x for x in host if x)
    path = "".join("/" + x for x in steps) + (f"/{file}" if file else "") + ("/" if end == "/" else "")
    return front[0] + front[1] + name + path + (f"?{query}" if query else "") + (end if end == "#part" else "")


def test_decomposition(spark):
    cases = {}
    for front, (host, address), steps, file, query, end in product(FRONTS, HOSTS, STEPS, FILES, QUERIES, ENDS):
        if not (address and ":" in address and front[0] == ""):  # a bare [v6] needs no scheme either, but is no usual form
            cases[written(front, host, address, steps, file, query, end)] = meaning(host, address, steps, file, query)
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    for r in urls.decompose_urls(df, "url").withColumn("t", urls.entry_target()).collect():
        got = (r["host"], r["sub_domains"], r["domain"], r["path"], r["file"], r["ip"], tuple(r["t"]))
        assert got == cases[r["url"]], r["url"]
        assert r["login"] == ("ann:p@w" if "ann" in r["url"] else None)
    assert len(cases) > 2000


ODD = {
    # clean paths, hosts that are suffixes, and white space around
    "https://o.tidepool.co.uk/p//./q/../r/": ("tidepool.co.uk", "/p/r"), "https://o.tidepool.net/../x": ("tidepool.net", "/x"), "pear-tree.github.io": ("github.io", None), "z.pear-tree.github.io": ("pear-tree.github.io", None),
    "office/x": ("office", "/x"), "\u3000 https://o.tidepool.net/y \r\n": ("tidepool.net", "/y"), "https://o.tidepool.net/~z?a@b": ("tidepool.net", "/~z"),
}


def test_odd_forms(spark):
    df = spark.createDataFrame([(u,) for u in ODD], "url string")
    assert {r["url"]: (r["domain"], r["path"]) for r in urls.decompose_urls(df, "url").collect()} == ODD


def test_international_suffixes(spark):
    """Both forms of a suffix are known; private rules and names without a rule as well."""
    want = {"a.example.xn--55qx5d.cn": "example.xn--55qx5d.cn", "a.example.\u516c\u53f8.cn": "example.\u516c\u53f8.cn", "xn--55qx5d.cn": "xn--55qx5d.cn", "q.r.xn--p1ai": "r.xn--p1ai", "q.r.\u0440\u0444": "r.\u0440\u0444", "a.b.xn--nosuch": "b.xn--nosuch"}
    df = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r["host"]: r["domain"] for r in psl.with_registrable(df).collect()} == want
    assert psl.ascii_form("b\u00fccher.example") == "xn--bcher-kva.example"


def test_suffixes_need_no_jar(spark, monkeypatch, tmp_path):
    """The rules come with the package, wherever Spark is laid out."""
    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "elsewhere" / "__init__.py"))
    psl.rules.cache_clear()
    psl._tables.clear()
    hosts = {"a.b.com": "b.com", "a.b.co.uk": "b.co.uk", "a.x.kawasaki.jp": "a.x.kawasaki.jp", "z.city.kawasaki.jp": "city.kawasaki.jp", "A.B.CO.UK": "B.CO.UK", "q.github.io": "github.io", "p.q.github.io": "q.github.io", "co.uk": "co.uk", "www.ck": "www.ck", "x.y.nosuchsuffix": "y.nosuchsuffix", "one": "one"}
    df = spark.createDataFrame([(h,) for h in [*hosts, None]], "host string")
    got = {r["host"]: r["domain"] for r in psl.with_registrable(df).collect()}
    assert got == {**hosts, None: None}
    own = tmp_path / "list.txt"
    own.write_text("// note\nzz\nq.zz\n")
    assert psl.with_registrable(spark.createDataFrame([("a.b.q.zz",)], "host string"), path=str(own)).first()["domain"] == "b.q.zz"
    plan = psl.with_registrable(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan


@pytest.mark.parametrize("url", ["", "   ", " \t", None, "https://x.org/%zz", "https://x.org/a\tb"])
def test_invalid(spark, url):
    df = spark.createDataFrame([(url,)], "url string")
    r = urls.decompose_urls(df, "url").first()
    assert r["error"] == "invalid_url" and r["host"] is None
    assert df.select(urls.url_error(F.col("url"))).first()[0] == "invalid_url"


def test_check_keys_in_order(spark):
    df = urls.decompose_urls(spark.createDataFrame([("https://w3.lantern.info/news/2024/may/plan.pdf?v=2",)], "url string"), "url")
    keys = [tuple(k) for k in df.select(urls.check_keys()).first()[0]]
    h = "w3.lantern.info"
    assert keys == [("domain", "lantern.info"), ("host", h), *(("host_path", h + p) for p in ("/news", "/news/2024", "/news/2024/may", "/news/2024/may/plan.pdf")), ("file", "plan.pdf"), ("full_url", h + "/news/2024/may/plan.pdf?v=2")]


def test_levels_and_ttl(spark):
    got = spark.createDataFrame([(x,) for x in (0.97, 0.9, 0.85, 0.7, 0.65, 0.5, 0.4, 0.25, 0.2, 0.0)], "s double").select(urls.confidence_level(F.col("s"))).collect()
    assert [r[0] for r in got] == ["critical"] * 2 + ["high"] * 2 + ["medium"] * 2 + ["low"] * 2 + ["informational"] * 2
    cases = {"": 6, "3h": 3, "12h": 12, "30 * * * *": 1, "15 4 * * *": 24, "0 5 * * 2": 168, "5d": 24, "2w": 168, " 3h ": 3}
    df = spark.createDataFrame([(k, v * 3600) for k, v in cases.items()], "s string, want long")
    assert df.filter(runs.ttl_of_schedule(F.col("s")) != F.col("want")).collect() == []
