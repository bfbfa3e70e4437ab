from collections import Counter
from itertools import permutations, product

import pytest
from pyspark.sql import functions as F

from urlintel.operators import check, entries, index, lookup
from urlintel.sources import feeds

def build(spark, rows):
    lines = spark.createDataFrame([(u, s, "c") for u, s in rows], "line string, source string, category string")
    return feeds.make_entries(lines, F.lit("r"), F.lit(1))[0]


def covers(listed, asked):
    """The first key of ``asked`` that ``listed`` has, by a rule of its own: both are (sub-domain, path segments, file, query) of one domain."""
    sub, path, file, query = listed
    name = lambda s: f"{s}.{DOMAIN}" if s else DOMAIN
    if file and query:
        return ("full_url", f"{name(sub)}/{'/'.join((*path, file))}?{query}") if asked == listed else None
    if file:
        return ("file", file) if asked[2] == file else None
    if path:
        whole = (*asked[1], asked[2]) if asked[2] else asked[1]
        return ("host_path", f"{name(sub)}/{'/'.join(path)}") if asked[0] == sub and whole[: len(path)] == path else None
    if sub:
        return ("host", name(sub)) if asked[0] == sub else None
    return ("domain", DOMAIN)


DOMAIN = "brook-{}.org"
SHAPES = list(product(("", "west", "far.west"), ((), ("in",), ("in", "deep")), (None, "kit-{}.bin"), (None, "v=3")))


def test_every_pair_of_shapes(spark):
    """A URL of each shape listed, and URLs of all shapes checked against it; each listed one has a domain of its own."""
    url = lambda i, s: "https://" + (s[0] + "." if s[0] else "") + DOMAIN.format(i) + "".join("/" + x for x in s[1]) + ("/" + s[2].format(i) if s[2] else "") + ("?" + s[3] if s[3] else "")
    idx = index.key_index(build(spark, [(url(i, s), "oisd-big") for i, s in enumerate(SHAPES)]))
    pairs = [(i, listed, asked) for i, listed in enumerate(SHAPES) for asked in SHAPES]
    checks = spark.createDataFrame([(n, url(i, asked)) for n, (i, _, asked) in enumerate(pairs)], "url_id long, url string")
    hits = 0
    for r in check.bulk_check(checks, idx).collect():
        i, listed, asked = pairs[r["url_id"]]
        want = covers(listed, asked)
        assert [(m["type"], m["key"]) for m in r["matches"] or []] == ([(want[0], want[1].replace("{}", str(i)))] if want else []), (listed, asked)
        assert r["max_depth"] == (10 if want else 0)
        hits += want is not None
    assert 200 < hits < len(pairs) - 200


def test_order_of_hits_and_errors(spark):
    """The broadest key comes first, of sources the least; an address covers all its ports and paths; an empty URL is an error of its own."""
    idx = index.key_index(build(spark, [("https://reed.net/q/r", "b"), ("https://reed.net/q", "d"), ("https://reed.net/q", "c"), ("ftp://192.0.2.77:21/old", "a")]))
    asked = ["https://reed.net/q/r/s", "http://192.0.2.77/new", "http://192.0.2.78/old", "", None, "https://reed.net"]
    rows = check.bulk_check_all(spark.createDataFrame(list(enumerate(asked)), "url_id long, url string"), idx).orderBy("url_id").collect()
    assert [[(m["source"], m["key"]) for m in r["matches"] or []] for r in rows] == [[("c", "reed.net/q"), ("d", "reed.net/q"), ("b", "reed.net/q/r")], [("a", "192.0.2.77")], [], [], [], []]
    assert [r["error"] for r in rows] == [None, None, None, "invalid_url", "invalid_url", None]


SCORES = [
    ([("a", 0.92, "host")], 0.92, "critical"),
    ([("a", 0.8, "domain"), ("b", 0.6, "host_path"), ("b", 0.6, "file")], (0.8 * 0.3 + 0.6 * 1.0 + 0.6 * 0.7) / 2.0, "medium"),
    ([("x", None, "ip")], 0.5, "medium"),
    ([("a", 1.0, "domain"), ("b", 1.0, "host")], 0.4, "low"),
    ([("a", 0.0, "domain"), ("b", 0.0, "host_path")], 0.0, "informational"),
]


def test_scores(spark):
    rows = [(str(i), s, t, k) for i, (ms, _, _) in enumerate(SCORES) for s, t, k in ms]
    df = spark.createDataFrame(rows, "url string, source string, trust double, type string").withColumn("trust", F.coalesce("trust", F.lit(0.5)))
    got = {int(r["url"]): r for r in check.score_matches(df).collect()}
    for i, (_, score, level) in enumerate(SCORES):
        assert got[i]["confidence"] == pytest.approx(score) and got[i]["level"] == level


def test_upsert_is_idempotent_and_targets_are_single(spark):
    e = build(spark, [(f"https://h{i}.example.com/p{i}/f.exe?x={i % 3}", "s") for i in range(60)])
    once = entries.upsert_batch(e, e)
    assert sorted(map(str, once.collect())) == sorted(map(str, e.select(*once.columns).collect()))
    assert index.key_index(e).count() <= 60


def test_bloom(spark):
    keys = spark.range(20_000).select(F.lit("host").alias("type"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    bloom = index.build_bloom(keys).persist()
    assert bloom.select("bits").distinct().first()[0] == 191_702
    assert index.bloom_probe(keys, index.merge_bloom(bloom)).count() == 20_000
    absent = spark.range(20_000).select(F.lit("host").alias("type"), F.concat(F.lit("absent"), F.col("id").cast("string")).alias("key"))
    assert index.bloom_probe(absent, index.merge_bloom(bloom)).count() <= 400
    odd = keys.filter("source = 'b'")
    assert index.bloom_probe(odd, index.merge_bloom(bloom, without="a")).count() == 10_000
    by = {r["source"]: r["count"] for r in index.bloom_probe(odd, bloom).groupBy("source").count().collect()}
    assert by["b"] == 10_000 and by.get("a", 0) <= 100
    assert index.bloom_probe(keys, index.merge_bloom(bloom.limit(0))).count() == 0


def test_id_lookup_behind_a_gate(spark):
    from urlintel.operators import lookup

    e = build(spark, [("https://gull-bank.com", "s"), ("https://plover.net", "s"), ("https://plover.net", "t")])
    gate = index.merge_bloom(index.build_bloom(e.filter("source = 's'").select(F.lit("source_url").alias("type"), F.col("source_url").alias("key"), "source").filter("key like '%plover%'")))
    checks = spark.createDataFrame([(1, "https://gull-bank.com"), (2, "https://plover.net"), (3, None), (2, "https://plover.net")], "url_id long, url string")
    got = sorted((r["url_id"], len(r["ids"] or [])) for r in lookup.lookup_cached_ids(checks, entries.url_id_index(e), e, gate).collect())
    assert got == [(1, 0), (2, 2), (2, 2), (3, 0)]
    assert sorted(len(r["ids"] or []) for r in lookup.lookup_cached_ids(checks, entries.url_id_index(e), e).collect()) == [0, 1, 2, 2]


def test_unknown_feed(spark):
    df = spark.createDataFrame([("oisd-big",)], "source string")
    with pytest.raises(ValueError):
        feeds.select_feeds(df, ["nope"])


def test_ingest_files(spark, tmp_path):
    """A feed that isn't known, and one whose file breaks while it is read, leave the others alone."""
    (tmp_path / "a.txt").write_text("# c\n\nhttps://a.plover.net/x\n\t b.plover.net\u00a0\nhttp://\n")
    (tmp_path / "b.json").write_text('[{"url":"https://c.plover.net/","verified":true},{"url":"https://d.plover.net/","verified":false}]')
    (tmp_path / "c.json").write_text('[{"url":"https://c.plover.net/", ')
    known = {**feeds.FEEDS, "broken": feeds.Feed("broken", "c", feeds.read_json_array, feeds.verified_urls)}
    paths = {"urlhaus-online": str(tmp_path / "a.txt"), "phishtank-online-valid": str(tmp_path / "b.json"), "broken": str(tmp_path / "c.json"), "nope": "x"}
    got, errors = feeds.ingest_all_feeds(spark, paths, str(tmp_path / "out"), "r1", F.lit(5), known=known)
    assert sorted((r["source"], r["host"]) for r in got.collect()) == [("phishtank-online-valid", "c.plover.net"), ("urlhaus-online", "a.plover.net"), ("urlhaus-online", "b.plover.net")]
    assert sorted(errors) == ["broken", "nope"] and all(errors.values())
    feeds.write_entries(got, str(tmp_path / "e"))
    feeds.write_entries(got.filter("source = 'urlhaus-online'"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 3
    feeds.write_index(index.key_index(got), str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 3


def test_long_lines_are_rejects(spark):
    rows = [("https://plover.net/" + "x" * (1 << 20), "s", "c"), ("https://plover.net/ok", "s", "c")]
    good, bad = feeds.make_entries(spark.createDataFrame(rows, "line string, source string, category string"), F.lit("r"), F.lit(1))
    assert good.count() == 1 and [(r["reason"], r["line"] == rows[0][0]) for r in bad.collect()] == [("line_too_long", True)]


def test_options(spark):
    o = spark.createDataFrame([("oisd-big", False, 60, None), ("phishtank-online-valid", None, None, "k9")], "id string, enabled boolean, ttl_seconds long, api_key string")
    got = {r["id"]: r for r in feeds.with_options(feeds.sources(spark), o).collect()}
    assert len(got) == 6 and not got["oisd-big"]["enabled"] and got["oisd-big"]["ttl_seconds"] == 60
    assert got["phishtank-online-valid"]["enabled"] and "/k9/" in got["phishtank-online-valid"]["source_url"] and got["urlhaus-online"]["ttl_seconds"] == 7200


def test_a_hit_needs_few_exchanges_over_stored_tables(spark, tmp_path):
    e = build(spark, [(f"https://h{i}.plover.net/p{i}/f.exe?x={i % 3}", "s") for i in range(50)])
    e.write.parquet(str(tmp_path / "e"))
    index.key_index(e).write.parquet(str(tmp_path / "i"))
    e.select(F.col("source_url").alias("url")).write.parquet(str(tmp_path / "c"))
    stored, idx, checks = (spark.read.parquet(str(tmp_path / n)) for n in "eic")
    trust = spark.createDataFrame([("s", 0.7)], "source string, trust double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (check.bulk_hit(checks, idx, stored, trust), check.bulk_check(checks, idx), check.bulk_check_all(checks, idx)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= 9 and plan.count("FileScan parquet") <= 4
        assert check.bulk_hit(checks, idx, stored, trust).filter("blocked").count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stream_matches_by_public_suffix(spark, tmp_path):
    from urlintel.streaming import jobs

    idx = index.key_index(build(spark, [("https://gull.co.uk", "a"), ("https://gull.github.io", "a"), ("https://x.www.ck", "a"), ("https://b.plover.net/p", "a"), ("https://tern.com", "b")]))
    hosts = ["https://sub.gull.co.uk/x", "https://other.co.uk", "https://gull.github.io/p", "https://a.b.kawasaki.jp", "https://x.www.ck", "https://www.ck", "http://1.2.3.4/", "https://SUB.GULL.CO.UK", "https://tern.com", "https://tern.com/a\x01b", "", None, "https://co.uk", "https://b.plover.net/p/q"]
    checks = spark.createDataFrame(list(enumerate(hosts)), "url_id long, url string")
    checks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(checks.schema).parquet(str(tmp_path / "in"))
    jobs.stream_matches(stream, idx).writeStream.format("memory").queryName("suffixes").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["url_id"], r["ord"], r["type"], r["key"], r["source"]) for r in spark.table("suffixes").collect()}
    want = {(r["url_id"], m["ord"], m["type"], m["key"], m["source"]) for r in check.bulk_check_all(checks, idx).collect() for m in r["matches"] or []}
    assert got == want and (0, 0, "domain", "gull.co.uk", "a") in got and not {10, 9, 1} & {g[0] for g in got}


def test_upserts_hold_their_key(spark, tmp_path):
    """Three lines, two of them equal, into an empty table are two rows, whatever brings them in."""
    e = build(spark, [("https://reed.net", "s"), ("https://reed.net", "s"), ("https://moss.net", "s")])
    none = e.limit(0)
    for change in (entries.upsert_batch, entries.upsert_if_newer, entries.insert_ignore):
        assert sorted(r["source_url"] for r in change(none, e).collect()) == ["https://moss.net", "https://reed.net"]
    feeds.write_entries(e, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2
    two = spark.createDataFrame([("1", "u", "s", 5, 5, None, 0, "old"), ("2", "u", "s", 6, 5, None, 1, "new")], "id string, source_url string, source string, created_at long, updated_at long, deleted_at long, seq int, category string")
    target = two.drop("seq").limit(0)
    assert [(r["id"], r["category"]) for r in entries.upsert_batch(target, two).collect()] == [("1", "new")]
    assert [(r["id"], r["category"]) for r in entries.upsert_batch(target, two, order=-F.col("seq")).collect()] == [("2", "old")]
    assert [(r["id"], r["category"]) for r in entries.insert_ignore(target, two).collect()] == [("1", "old")]


def test_stored_upserts_write_only_their_buckets(spark, tmp_path):
    """Files of other buckets keep their names; the rows are those of an upsert of the whole table."""
    path = str(tmp_path / "t")
    files = lambda: {str(f.relative_to(path)) for f in (tmp_path / "t").rglob("*.parquet")}
    first = build(spark, [(f"https://h{i}.reed.net", s) for i in range(60) for s in "ab"])
    entries.upsert_stored(spark, path, first, 8)
    before = files()
    later = build(spark, [("https://h3.reed.net", "a"), ("https://h3.reed.net", "a"), ("https://new.reed.net", "a")]).withColumns({"run_id": F.lit("r2"), "created_at": F.lit(9).cast("long"), "updated_at": F.lit(9).cast("long")})
    entries.upsert_stored(spark, path, later, 8)
    kept = {f.rsplit("/", 1)[0] for f in before & files()}
    assert len({f.rsplit("/", 1)[0] for f in files() - before}) <= 2 and len(kept) >= 14
    got = spark.read.parquet(path).select(*first.columns)
    want = entries.upsert_batch(first, later).select(*first.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 121


def exchanges_over_bucketed_scans(plan):
    """For each bucketed scan, the exchanges between it and the first join above it."""
    out = []

    def walk(node, since):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            return walk(node.inputPlan(), since)
        since = 0 if "Join" in name else since + ("Exchange" in name)
        if "Bucketed: true" in node.simpleString(1000) and "Scan" in name:
            out.append(since)
        for i in range(node.children().size()):
            walk(node.children().apply(i), since)

    walk(plan, 0)
    return out


def test_an_index_by_key_is_not_shuffled(spark, tmp_path):
    """Fewer or more shuffle partitions than buckets: one shuffle by key for the probes, of which half share a domain, none above the stored tables; the answer of the plain join."""
    listed = [(f"https://h{i}.plover.net/p{i}", s) for i in range(40) for s in "ab"] + [("https://tern.com", "a")]
    e = build(spark, listed)
    idx = index.key_index(e)
    stored, confirmed = feeds.write_keys(e.filter("source_url <> 'https://h3.plover.net/p3'"), idx, str(tmp_path / "k'e y"), 4)
    urls = [u for u, _ in listed] + [f"https://w{i}.tern.com/x" for i in range(90)] + ["", None, "https://miss.org", "https://miss.org"]
    spark.createDataFrame(list(enumerate(urls)), "url_id long, url string").write.parquet(str(tmp_path / "c"))
    checks = spark.read.parquet(str(tmp_path / "c"))
    trust = spark.createDataFrame([("a", 0.7)], "source string, trust double")
    plain, rows = check.bulk_check_all(checks, idx).collect(), lambda found: sorted(map(str, found))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for parts in (2, 4, 32):
            for k, v in {**settings, "spark.sql.shuffle.partitions": str(parts)}.items():
                spark.conf.set(k, v)
            df = check.bulk_check_all(checks, stored, find=check.matches_by_key)
            assert rows(df.collect()) == rows(plain)
            found = check.matches_by_key(check.probe_keys(checks), stored, confirmed)
            assert exchanges_over_bucketed_scans(found._jdf.queryExecution().executedPlan()) == [0, 0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    hits = check.bulk_hit_by_key(checks, stored, confirmed, trust)
    assert rows(hits.collect()) == rows(check.bulk_hit(checks, idx, e.filter("source_url <> 'https://h3.plover.net/p3'"), trust).collect())
    assert hits.filter("blocked").count() == 2 * 39 + 1 + 90
    again = index.open_by_key(spark, str(tmp_path / "k'e y") + "/index", 4)
    assert rows(again.collect()) == rows(idx.select(*again.columns).collect())
    with pytest.raises(Exception):
        index.open_by_key(spark, str(tmp_path / "k'e y") + "/index", 8)


def test_one_pass_for_entries_rejects_and_counts(spark, tmp_path):
    """One scan and one shuffle of the lines; the counts of the log are those of the tables, whatever a line is; an empty feed counts nothing."""
    bad, long = "two words", "https://moss.net/" + "x" * (1 << 20)
    lines = ["https://moss.net/a", "https://moss.net/a", "https://reed.net", bad, bad, bad, "http://", long, long]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "in"))
    shaped = lambda path: feeds.flat_lines(feeds.read_lines(spark, path)).select("line", F.lit("s").alias("source"), F.lit("c").alias("category"))
    got = feeds.write_lines(shaped(str(tmp_path / "in")), str(tmp_path / "out"), F.lit("r"), F.lit(1))
    assert got == {"lines": 9, "parsed": 3, "entries": 2, "rejected": 6, "rejects": 3, "longest": len(long), "reasons": {"invalid_url": 4, "line_too_long": 2}}
    entries_, rejects = feeds.read_written(spark, str(tmp_path / "out"))
    assert entries_.count() == got["entries"] and {(r["line"], r["reason"], r["times"]) for r in rejects.collect()} == {(bad, "invalid_url", 3), ("http://", "invalid_url", 1), (long, "line_too_long", 2)}
    assert set(entries_.columns) == set(feeds.make_entries(shaped(str(tmp_path / "in")), F.lit("r"), F.lit(1))[0].columns)
    plan = feeds.parsed_once(shaped(str(tmp_path / "in")), F.lit("r"), F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    (tmp_path / "none.txt").write_text("# nothing\n")
    assert feeds.write_lines(shaped(str(tmp_path / "none.txt")), str(tmp_path / "empty"), F.lit("r"), F.lit(1))["lines"] == 0
    assert [df.count() for df in feeds.read_written(spark, str(tmp_path / "empty"))] == [0, 0]


def test_runs_are_logged_failed_ones_too(spark, tmp_path):
    from urlintel.operators import runs

    (tmp_path / "a.txt").write_text("https://reed.net\nhttp://\n")
    paths = {"urlhaus-online": str(tmp_path / "a.txt"), "oisd-big": str(tmp_path / "not-there")}
    for run in ("r1", "r2"):
        _, errors = feeds.ingest_all_feeds(spark, paths, str(tmp_path / run), run, F.lit(1), run_log=str(tmp_path / "log"))
        assert list(errors) == ["oisd-big"]
    log = runs.read_log(spark, str(tmp_path / "log"))
    assert sorted((r["source"], r["status"], r["entries"], bool(r["error"])) for r in log.collect()) == [("oisd-big", "failed", None, True)] * 2 + [("urlhaus-online", "completed", 1, False)] * 2
    by = {r["source"]: r.asDict() for r in runs.logged_metrics(log).collect()}
    assert by["urlhaus-online"] | {"last_seconds": 0} == {"source": "urlhaus-online", "syncs": 2, "successes": 2, "failures": 0, "last_seconds": 0, "saved": 2, "processed": 2, "parse_errors": 2}
    assert by["oisd-big"]["failures"] == 2 and by["oisd-big"]["saved"] == 0 and by["oisd-big"]["processed"] is None


def test_links_asked_twice_are_answered_twice(spark):
    """Two entries of a host, and one of them asked twice: rows, counts and totals are those of the plain join."""
    e = build(spark, [("https://a.reed.net/x", "s"), ("https://a.reed.net/y", "s")]).withColumn("norm_url", F.col("source_url"))
    links = spark.createDataFrame([("https://a.reed.net/x",), ("https://a.reed.net/x",), ("https://a.reed.net/y",)], "link string")
    got = Counter((r["link"][-1], r["match_type"]) for r in lookup.query_mixed(links, e).collect())
    want = {("x", "EXACT_URL"): 2, ("x", "HOST"): 4, ("x", "DOMAIN"): 4, ("x", "PATH"): 2, ("y", "EXACT_URL"): 1, ("y", "HOST"): 2, ("y", "DOMAIN"): 2, ("y", "PATH"): 1}
    assert got == want
    assert {(r["link"][-1], r["match_type"]): r["n"] for r in lookup.mixed_values(links, e)[0].collect()} == want
    assert {r["link"][-1]: r["count"] for r in lookup.top_hit(links, e).collect()} == {"x": 12, "y": 6}


def test_pairs_of_a_popular_host_are_spread_over_tasks(spark):
    """120 links, one of them asked 40 times more, and 100 entries of one host, one without an id, beside a few others: the rows of the plain join, and no task makes a third of them."""
    e = build(spark, [(f"https://a.reed.net/x{i}", "s") for i in range(100)] + [("https://b.test.org/y", "s")]).withColumn("norm_url", F.col("source_url"))
    e = e.withColumn("id", F.when(F.col("path") != "/x7", F.col("id")))
    links = spark.createDataFrame([(f"https://a.reed.net/x{min(i, 119)}",) for i in range(160)] + [("https://b.test.org/y",), ("https://c.none.com/z",), ("http://",), (None,)], "link string")
    found = lookup.query_mixed(links, e, block=16)
    path = {r["path"]: r["id"] for r in e.select("path", "id").collect()}
    want = Counter()
    for i in range(160):
        link = f"https://a.reed.net/x{min(i, 119)}"
        for j in range(100):
            want.update([(link, path[f"/x{j}"], "HOST", "a.reed.net"), (link, path[f"/x{j}"], "DOMAIN", "reed.net")])
        if i < 100:
            want.update([(link, path[f"/x{i}"], "EXACT_URL", link), (link, path[f"/x{i}"], "PATH", f"/x{i}")])
    want.update(("https://b.test.org/y", path["/y"], t, v) for t, v in (("EXACT_URL", "https://b.test.org/y"), ("HOST", "b.test.org"), ("DOMAIN", "test.org"), ("PATH", "/y")))
    assert Counter(tuple(r) for r in found.select("link", "id", "match_type", "matched_value").collect()) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        tasks = [r["count"] for r in lookup.query_mixed(links, e, block=16).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(tasks) == want.total() and max(tasks) * 3 < sum(tasks)
    none = lookup.query_mixed(links.limit(0), e).unionByName(lookup.query_mixed(links, e.limit(0)))
    assert none.count() == 0


def test_mean_trust_knows_no_order(spark):
    """0.65, 0.7 and 0.75 add up to a mean just below, at or above 0.7, by the order of their sum."""
    lists = [(i, list(p)) for i, p in enumerate(permutations(("a", "b", "c")))]
    trust = spark.createDataFrame([("a", 0.65), ("b", 0.7), ("c", 0.75)], "source string, trust double")
    got = check.score_sources(spark.createDataFrame(lists, "url int, sources array<string>").coalesce(1), trust, "url").collect()
    assert {(r["confidence"], r["level"]) for r in got} == {(0.7, "high")} and len(got) == 6
