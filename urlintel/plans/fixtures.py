"""Blocklist, checks, run log and landing metadata derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import index
from ..sources import feeds

NOW = 1_700_000_000_000_000_000
BARE = r"[?#].*$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, line, category."""
    host, bare, n = F.regexp_extract("url", "://([^/?#:]*)", 1), F.regexp_replace("url", BARE, ""), F.col("page_id")
    line = lambda source, value, when: F.when(when, F.struct(F.lit(source).alias("source"), value.alias("line")))
    every = F.lit(True)
    listed = F.array(
        line("oisd-big", host, F.length(host) % 7 == 0), line("oisd-nsfw", F.lit("example.org"), every), line("urlhaus-online", F.col("url"), n % 5 == 1), line("openphish-feed", bare, n % 10 == 2),
        line("phishtank-online-valid", F.concat(F.lit("https://"), host, F.lit("/en")), F.length(host) % 7 == 1), line("urlhaus-online", F.concat(bare, F.lit("?id=1")), F.col("url").like("%.html%") & (n % 2 == 0)),
        line("urlhaus-online", F.lit("http://203.0.113.40:8088/dump"), every),
    )
    out = table(spark, sf_dir, "pages").select(F.explode(F.array_compact(listed)).alias("l")).select("l.*")
    category = F.create_map(*[F.lit(x) for s in feeds.SOURCES if s[6] for x in (s[0], s[6])])
    return out.distinct().withColumn("category", category[F.col("source")])


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    odd = pages.agg(F.count("*")).select(F.explode(F.array(F.struct(F.lit(2_000_000).cast("long").alias("a"), F.lit("http://203.0.113.40/rest").alias("b")), F.struct(F.lit(2_000_001).cast("long").alias("a"), F.lit("clean.example.edu/x").alias("b")))).alias("s"))
    more = pages.filter("url like '%.html%'").select(F.col("page_id") + 1_000_000, F.concat(F.regexp_replace("url", BARE, ""), F.lit("?id=1")))
    return pages.union(more).union(odd.select("s.a", "s.b")).toDF("url_id", "url")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.make_entries(blocklist(spark, sf_dir), F.lit("r1"), F.lit(NOW))[0]


def key_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.key_index(entries(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of entries with ages, runs and deletions: a row a page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    e = urls.decompose_urls(pages, "url")
    return e.select(
        F.concat(F.lit("e"), F.col("page_id").cast("string")).alias("id"), F.when(F.col("page_id") % 4 == 0, "r1").otherwise("r2").alias("run_id"), F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string")).alias("source"),
        F.concat(F.lit("Cat-"), (F.col("page_id") % 4).cast("string")).alias("category"), F.col("url").alias("source_url"), "scheme", "host", "domain", "path", "raw_query", "file", "host_path", "full_url", "ip",
        F.when(F.col("page_id") % 6 == 0, F.lit(None)).otherwise((F.col("page_id") % 11) / 10).cast("double").alias("confidence"),
        F.col("page_id").alias("created_at"), F.col("page_id").alias("updated_at"), F.when(F.col("page_id") % 9 == 4, F.col("page_id") + 5).alias("deleted_at"), "page_id",
    )


SUFFIX_HOSTS = ("p{}.example.co.uk", "a.p{}.kawasaki.jp", "p{}.city.kawasaki.jp", "p{}.github.io", "a.p{}.github.io", "a.p{}.unlisted", "github.io", "a.p{}.\u516c\u53f8.cn", "a.p{}.xn--55qx5d.cn", "p{}.xn--j6w193g", "xn--55qx5d.cn")


def suffix_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url: hosts under suffixes of all kinds, a row a page."""
    host = F.element_at(F.array(*[F.format_string(h.replace("{}", "%s"), F.col("page_id").cast("string")) if "{}" in h else F.lit(h) for h in SUFFIX_HOSTS]), (F.col("page_id") % len(SUFFIX_HOSTS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://"), host, F.lit("/x")).alias("url"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log: an event is a run."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("completed")
    start = F.col("ts").cast("timestamp_ntz")
    return e.select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("provider"), status.alias("status"), start.alias("start_time"),
        F.when(status != "running", start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 90 + 1).cast("int"))).alias("end_time"), F.round("value").cast("long").alias("entry_count"),
    )


# The same as SQL, to be put before a query as common tables.
LINES = """h AS (SELECT DISTINCT regexp_extract(url,'://([^/?#:]*)',1) AS host FROM pages),
lines AS (SELECT DISTINCT source, line FROM (SELECT 'oisd-big' AS source, host AS line FROM h WHERE length(host) % 7 = 0
UNION ALL SELECT 'oisd-nsfw', 'example.org'
UNION ALL SELECT 'urlhaus-online', url FROM pages WHERE page_id % 5 = 1
UNION ALL SELECT 'openphish-feed', regexp_replace(url,'[?#].*$','') FROM pages WHERE page_id % 10 = 2
UNION ALL SELECT 'phishtank-online-valid', concat('https://', host, '/en') FROM h WHERE length(host) % 7 = 1
UNION ALL SELECT 'urlhaus-online', concat(regexp_replace(url,'[?#].*$',''),'?id=1') FROM pages WHERE url LIKE '%.html%' AND page_id % 2 = 0
UNION ALL SELECT 'urlhaus-online', 'http://203.0.113.40:8088/dump'))"""
CHECKS = """checks AS (SELECT page_id AS url_id, url FROM pages
UNION ALL SELECT page_id + 1000000, concat(regexp_replace(url,'[?#].*$',''),'?id=1') FROM pages WHERE url LIKE '%.html%'
UNION ALL SELECT 2000000, 'http://203.0.113.40/rest'
UNION ALL SELECT 2000001, 'clean.example.edu/x')"""
_RE = urls.URL.replace("'", "''")
_V4 = urls.IPV4.replace("(?:", "(")


def parts(source: str, url: str) -> str:
    """A sub-query that adds the parts of ``url`` to ``source``. The last two labels are the domain, as under com, net and org."""
    return f"""(SELECT *, host || path AS host_path, CASE WHEN path IS NOT NULL THEN host || path || coalesce('?' || raw_query, '') END AS full_url,
CASE WHEN ip IS NOT NULL THEN NULL WHEN len(labels) <= 2 THEN host ELSE labels[-2] || '.' || labels[-1] END AS domain,
CASE WHEN ip IS NULL AND len(labels) > 2 THEN labels[1:len(labels)-2] END AS sub_domains FROM (
SELECT *, string_split(host, '.') AS labels, CASE WHEN regexp_matches(host, '{_V4}') THEN host END AS ip, CASE WHEN len(segs) > 0 THEN '/' || array_to_string(segs, '/') END AS path,
CASE WHEN len(segs) > 0 AND regexp_matches(segs[-1], '\\.[^.]+$') THEN segs[-1] END AS file FROM (
SELECT *, nullif(regexp_extract(prep, '{_RE}', 1), '') AS scheme, nullif(regexp_extract(prep, '{_RE}', 3), '') AS host, list_filter(string_split(regexp_extract(prep, '{_RE}', 5), '/'), lambda x: x <> '' AND x <> '.') AS segs,
nullif(regexp_extract(prep, '{_RE}', 6), '') AS raw_query FROM (
SELECT *, CASE WHEN contains(trim({url}), '://') OR starts_with(trim({url}), '//') THEN trim({url}) ELSE '//' || trim({url}) END AS prep FROM {source}))))"""


# The rules that decide on these hosts, and the domain by them.
SUFFIX_DOMAINS = f"""u AS (SELECT page_id, replace([{', '.join(repr(h) for h in SUFFIX_HOSTS)}][page_id % {len(SUFFIX_HOSTS)} + 1], '{{}}', page_id::VARCHAR) AS host FROM pages),
rules(suffix, kind, private) AS (VALUES ('uk', 'plain', false), ('co.uk', 'plain', false), ('jp', 'plain', false), ('kawasaki.jp', 'wild', false), ('city.kawasaki.jp', 'except', false), ('io', 'plain', false), ('github.io', 'plain', true), ('cn', 'plain', false), ('\u516c\u53f8.cn', 'plain', false), ('xn--55qx5d.cn', 'plain', false), ('xn--j6w193g', 'plain', false)),
hit AS (SELECT page_id, string_split(host, '.') AS labels, kind = 'except' AS e, private, len(string_split(suffix, '.')) + CASE kind WHEN 'wild' THEN 1 WHEN 'except' THEN -1 ELSE 0 END AS k FROM u LEFT JOIN rules ON host = suffix OR ends_with(host, '.' || suffix)),
best AS (SELECT *, coalesce(k, 1) AS size FROM hit QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY e DESC NULLS LAST, k DESC NULLS LAST) = 1),
suffixed AS (SELECT page_id, labels, CASE WHEN len(labels) <= size OR len(labels) = size + 1 AND coalesce(private, false) THEN labels[-2:] ELSE labels[-(size + 1):] END AS tail FROM best)"""
TARGET = """CASE WHEN ip IS NOT NULL THEN {'type': 'ip', 'key': ip} WHEN file IS NOT NULL AND raw_query IS NOT NULL THEN {'type': 'full_url', 'key': full_url} WHEN file IS NOT NULL THEN {'type': 'file', 'key': file}
WHEN path IS NOT NULL THEN {'type': 'host_path', 'key': host_path} WHEN host = domain THEN {'type': 'domain', 'key': host} WHEN host IS NOT NULL THEN {'type': 'host', 'key': host} END"""
CATEGORY = "CASE source WHEN 'oisd-big' THEN 'blocklist' WHEN 'oisd-nsfw' THEN 'nsfw' WHEN 'urlhaus-online' THEN 'malware' WHEN 'openphish-feed' THEN 'phishing' WHEN 'phishtank-online-valid' THEN 'phishing' END"
ENTRIES = f"{LINES}, entries AS (SELECT sha256(source || chr(1) || line) AS id, {CATEGORY} AS category, line AS source_url, * FROM {parts('lines', 'line')})"
INDEX = f"{ENTRIES}, idx AS (SELECT DISTINCT k.type AS type, k.key AS key, source FROM (SELECT {TARGET} AS k, source FROM entries))"
PROBES = """list_filter([{'type': 'domain', 'key': domain}, {'type': 'host', 'key': host}, {'type': 'ip', 'key': ip}]
|| list_transform(range(1, len(segs) + 1), lambda i: {'type': 'host_path', 'key': host || '/' || array_to_string(segs[1:i], '/')})
|| [{'type': 'file', 'key': file}, {'type': 'full_url', 'key': full_url}], lambda k: k.key IS NOT NULL)"""
KEYS = f"{CHECKS}, cparts AS (SELECT * FROM {parts('checks', 'url')}), keys AS (SELECT url_id, url, unnest(range(0, len(p))) AS ord, unnest(p).type AS type, unnest(p).key AS key FROM (SELECT *, {PROBES} AS p FROM cparts))"
MATCHES = f"{INDEX}, {KEYS}, matches AS (SELECT k.*, i.source FROM keys k JOIN idx i ON k.type = i.type AND k.key = i.key)"
FIRST = f"{MATCHES}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_id ORDER BY ord, source) AS rn FROM matches) WHERE rn = 1)"
TRUST = "trust(source, trust) AS (VALUES ('oisd-big', 0.65::DOUBLE), ('oisd-nsfw', 0.65), ('urlhaus-online', 0.9), ('openphish-feed', 0.75), ('phishtank-online-valid', 0.7), ('spamhaus-drop', 0.95))"
WEIGHT = "CASE type WHEN 'domain' THEN 0.3::DOUBLE WHEN 'host' THEN 0.5 WHEN 'host_path' THEN 1.0 WHEN 'path' THEN 0.6 WHEN 'query' THEN 0.4 WHEN 'file' THEN 0.7 WHEN 'full_url' THEN 1.5 WHEN 'login' THEN 0.8 WHEN 'ip' THEN 0.8 ELSE 0.5 END"


def level(score: str) -> str:
    return f"CASE WHEN {score} >= 0.9 THEN 'critical' WHEN {score} >= 0.7 THEN 'high' WHEN {score} >= 0.5 THEN 'medium' WHEN {score} >= 0.25 THEN 'low' ELSE 'informational' END"


STORED = f"""stored AS (SELECT 'e' || page_id AS id, CASE WHEN page_id % 4 = 0 THEN 'r1' ELSE 'r2' END AS run_id, 's' || (page_id % 3) AS source, 'Cat-' || (page_id % 4) AS category, url AS source_url,
scheme, host, domain, path, raw_query, file, host_path, full_url, ip, CASE WHEN page_id % 6 = 0 THEN NULL ELSE (page_id % 11)::DOUBLE / 10 END AS confidence, page_id AS created_at, page_id AS updated_at,
CASE WHEN page_id % 9 = 4 THEN page_id + 5 END AS deleted_at, page_id FROM {parts('pages', 'url')})"""
RUNS = """runs AS (SELECT event_id AS run_id, 'p' || (user_id % 5) AS provider, status, ts AS start_time, CASE WHEN status <> 'running' THEN ts + to_seconds(event_id % 90 + 1) END AS end_time, CAST(round(value) AS BIGINT) AS entry_count
FROM (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status FROM events))"""
