"""Feeds of listed URLs: registry, readers, entries, landing files, dimensions and sinks."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import filters, runs
from ..operators.entries import active, one_a_key, typed_keys
from ..operators.index import write_by_key
from ..operators.runs import ttl_of_schedule

LONGEST_LINE = 1 << 20
REASONS = ("invalid_url", "line_too_long")  # of ``parse_lines``

# The seeded providers and sources.
PROVIDERS = [("oisd", "OISD", 0.65), ("abuse-ch", "abuse.ch", 0.9), ("openphish", "OpenPhish", 0.75), ("phishtank", "PhishTank", 0.7), ("spamhaus", "Spamhaus", 0.95), ("alienvault", "AlienVault", 0.8)]
SOURCES = [
    ("oisd-big", "oisd", "https://big.oisd.nl/domainswild2", "text", 0.65, 86400, "blocklist", "0 6 * * *"),
    ("oisd-nsfw", "oisd", "https://nsfw.oisd.nl/domainswild2", "text", 0.65, 86400, "nsfw", "22 6 * * *"),
    ("urlhaus-online", "abuse-ch", "https://urlhaus.abuse.ch/downloads/text_online/", "text", 0.9, 7200, "malware", "15 */2 * * *"),
    ("openphish-feed", "openphish", "https://openphish.com/feed.txt", "text", 0.75, 14400, "phishing", "30 */4 * * *"),
    ("phishtank-online-valid", "phishtank", "http://data.phishtank.com/data/{api_key}/online-valid.json", "json", None, 14400, "phishing", "45 */6 * * *"),
    ("spamhaus-drop", "spamhaus", "https://www.spamhaus.org/drop/drop.txt", "text", None, 86400, None, None),
]
DEFAULT_TRUST = 0.5
HEAD, TAIL = 4096, 256
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")
ARRAY_START = re.compile(r'\ufeff?[ \t\r\n]*\[[ \t\r\n]*(\{[ \t\r\n]*"(?:[^"\\]|\\.)*"[ \t\r\n]*:)')
JSON_FEED = "url string, verified boolean, verification_time string"


@dataclass(frozen=True)
class Feed:
    """A feed is a reader of its landed files and a transform to a ``line`` column; both stay in Catalyst."""

    name: str
    category: str | None
    reader: Callable[[SparkSession, str], DataFrame]
    transform: Callable[[DataFrame], DataFrame]


FEEDS: dict[str, Feed] = {}


def register_feed(name: str, category: str | None, reader: Callable[[SparkSession, str], DataFrame], transform: Callable[[DataFrame], DataFrame]) -> Feed:
    FEEDS[name] = Feed(name, category, reader, transform)
    return FEEDS[name]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_json_whole(spark: SparkSession, path: str) -> DataFrame:
    """Array files that are read by a task each, as compressed ones must be."""
    return spark.read.schema(JSON_FEED).json(path, multiLine=True, mode="FAILFAST")


def _ends(spark: SparkSession, path: str) -> list[tuple[str, bytes, bytes]]:
    """Each file with its first and last bytes; array feeds are few files, and no more of them is read here."""
    out = []
    for name in spark.read.text(path).inputFiles():
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        stream, size = fs.open(where), fs.getFileStatus(where).getLen()
        try:
            head = bytes(stream.readNBytes(HEAD))
            stream.seek(max(0, size - TAIL))
            out.append((where.toString(), head, bytes(stream.readNBytes(TAIL))))
        finally:
            stream.close()
    return out


def json_pieces(spark: SparkSession, path: str) -> DataFrame | None:
    """piece: the records of array files, each as an array of its own; None where a file can't be cut and is to be read whole.

    The record separator is how the first record opens, with its first name (``{"phish_id":``). Within a text its quotes
    would be escaped, so it is found at the start of an object only, and every task can begin at the next one. A record
    that opens otherwise stays with the one before it, in one piece. A file that doesn't open and close as an array is an error.
    """
    by_opening: dict[str, list[str]] = {}
    for name, head, tail in _ends(spark, path):
        if name.endswith(COMPRESSED):
            return None
        start = ARRAY_START.match(head.decode("utf-8", "replace"))
        if not head.lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"[") or not tail.rstrip(b" \t\r\n").endswith(b"]"):
            raise ValueError(f"not a whole JSON array: {name}")
        if not start:
            return None
        by_opening.setdefault(start[1], []).append(name)
    pieces = []
    for opening, names in by_opening.items():
        text = spark.read.option("lineSep", opening).text(names).select(F.regexp_replace("value", r"[ \t\r\n]+$", "").alias("value"))
        rest = text.filter(~F.col("value").rlike(r"^\x{FEFF}?[ \t\r\n]*\[$")).select(F.regexp_replace("value", r"[,\]]$", "").alias("value"))
        pieces.append(rest.select(F.concat(F.lit("[" + opening), "value", F.lit("]")).alias("piece")))
    return reduce(DataFrame.unionByName, pieces) if pieces else None


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """The records of array files, cut so that one file goes to many tasks. A file that isn't JSON is an error of its feed."""
    pieces = json_pieces(spark, path)
    if pieces is None:
        return read_json_whole(spark, path)
    return pieces.select(F.inline(F.from_json("piece", f"array<struct<{_struct(JSON_FEED)}>>", {"mode": "FAILFAST"})))


def split_json_array(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of array files, and as rejects (line, reason) the pieces that aren't JSON; files of which the ends are wrong stay errors."""
    pieces = json_pieces(spark, path)
    if pieces is None:
        return read_json_whole(spark, path), spark.createDataFrame([], "line string, reason string")
    valid = F.try_parse_json("piece").isNotNull()
    records = pieces.filter(valid).select(F.inline(F.from_json("piece", f"array<struct<{_struct(JSON_FEED)}>>")))
    return records, pieces.filter(~valid).select(F.col("piece").alias("line"), F.lit("invalid_json").alias("reason"))


def _struct(ddl: str) -> str:
    """``a string, b long`` as the fields of a struct."""
    return ", ".join(":".join(f.split()) for f in ddl.split(","))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JSON_FEED).json(path, mode="FAILFAST")


def flat_lines(lines: DataFrame) -> DataFrame:
    """Trim; drop blank lines and comments."""
    line = urls.trimmed(F.col("line"))
    return lines.withColumn("line", line).filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def verified_urls(records: DataFrame) -> DataFrame:
    return records.filter("verified").select(urls.trimmed(F.col("url")).alias("line"), *[c for c in records.columns if c not in ("url", "line")])


for _id, _, _, _kind, _, _, _category, _ in SOURCES:
    if _id != "spamhaus-drop":
        register_feed(_id, _category, read_json_array if _kind == "json" else read_lines, verified_urls if _kind == "json" else flat_lines)


def select_feeds(df: DataFrame, names: list[str], known: list[str] | None = None) -> DataFrame:
    unknown = set(names) - set(known or FEEDS)
    if unknown:
        raise ValueError(f"unknown feeds: {', '.join(sorted(unknown))}")
    return df.filter(F.col("source").isin(names))


def remove_feeds(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(~F.col("source").isin(names))


def ingest_all_feeds(spark: SparkSession, paths: dict[str, str], out: str, run_id: str, now: Column, names: list[str] | None = None, known: dict[str, Feed] | None = None, run_log: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The entries of every landed feed (of those registered, or ``known``), one a key, and the error of each feed that couldn't be planned or read.

    Every feed is a write of its own under ``out``, side by side with the others, so that a file that breaks while it is
    read ends its feed only. With ``run_log`` a row a feed, failed ones too, is added there, with the counts of its write.
    """
    asked, errors = names or list(paths), {}

    def ingest(name: str) -> tuple[DataFrame | None, dict]:
        began, said = time.time(), {}
        try:
            feed = (FEEDS if known is None else known)[name]
            lines = feed.transform(feed.reader(spark, paths[name])).select("line", F.lit(name).alias("source"), F.lit(feed.category).alias("category"))
            said = write_lines(lines, f"{out}/{name}", F.lit(run_id), now)
            made = read_written(spark, f"{out}/{name}")[0]
        except Exception as e:  # one feed's failure leaves the others; the caller gets its reason
            errors[name], made = (str(e).splitlines() or [type(e).__name__])[0], None
        return made, {"source": name, "run_id": run_id, "status": "failed" if name in errors else "completed", "start_time": began, "end_time": time.time(), "error": errors.get(name), **said}

    with ThreadPoolExecutor(max(1, len(asked))) as pool:  # a thread a feed only waits for its write
        done = list(pool.map(ingest, asked))
    made = [df for df, _ in done if df is not None]
    if run_log:
        runs.log_runs(spark, [row for _, row in done], run_log)
    none = spark.createDataFrame([], "line string, source string, category string")
    return (reduce(DataFrame.unionByName, made) if made else make_entries(none, F.lit(run_id), now)[0]), errors


def parsed_once(lines: DataFrame, run_id: Column, now: Column) -> DataFrame:
    """Entries and rejects of a batch of lines, parsed once and one row a (source, line): the columns of an entry, reason, times (lines that were alike), kind.

    What becomes of a line follows from its text, so alike lines are entries or rejects together.
    """
    one = one_a_key(parse_lines(lines, run_id, now), times="times")
    return one.withColumn("kind", F.when(F.col("reason").isNull(), "entries").otherwise("rejects"))


def write_lines(lines: DataFrame, path: str, run_id: Column, now: Column) -> dict:
    """Write the entries and the rejects of a batch, and count them, in one pass: lines, parsed, entries, rejected, rejects, longest, and lines by reason.

    ``lines`` are read and parsed once. The counts are observed behind the last shuffle, in the tasks that write: a task
    that is run again there counts once, which isn't so before a shuffle.
    """
    seen, good = Observation(), F.col("reason").isNull()
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("times"))), F.lit(0)).cast("long")
    counted = parsed_once(lines, run_id, now).observe(
        seen, total(F.lit(True)).alias("lines"), total(good).alias("parsed"), F.count_if(good).alias("entries"), total(~good).alias("rejected"), F.count_if(~good).alias("rejects"),
        F.coalesce(F.max(F.length("source_url")), F.lit(0)).cast("long").alias("longest"), *[total(F.col("reason") == r).alias(r) for r in REASONS],
    )
    counted.write.mode("overwrite").partitionBy("kind").parquet(path)
    got = seen.get
    return {k: v for k, v in got.items() if k not in REASONS} | {"reasons": {r: got[r] for r in REASONS if got[r]}}


def read_written(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The entries, and the rejects (source, line, reason, times), that ``write_lines`` left; each reads its own files only."""
    every = spark.read.schema(WRITTEN).parquet(path)
    entries = every.filter("kind = 'entries'").drop("kind", "reason", "times")
    return entries, every.filter("kind = 'rejects'").select("source", F.col("source_url").alias("line"), "reason", "times")


def parse_lines(lines: DataFrame, run_id: Column, now: Column) -> DataFrame:
    """Every line decomposed once: the columns of an entry, and ``reason``, null where the line makes one."""
    long = F.length("line") > LONGEST_LINE
    parts = urls.decompose_urls(lines.withColumn("long", long).withColumn("short", F.when(~long, F.col("line"))), "short")
    return parts.select(
        F.sha2(F.concat_ws("\u0001", "source", "line"), 256).alias("id"), run_id.alias("run_id"), "source", "category", F.col("line").alias("source_url"), urls.normalize_url(F.col("short")).alias("norm_url"),
        "scheme", "domain", "host", "sub_domains", "path", "raw_query", "file", "host_path", "full_url", "login", "ip",
        F.lit(None).cast("double").alias("confidence"), now.cast("long").alias("created_at"), now.cast("long").alias("updated_at"), F.lit(None).cast("long").alias("deleted_at"),
        F.when(F.col("long"), "line_too_long").otherwise(F.col("error")).alias("reason"),
    )


# The columns that ``write_lines`` writes.
WRITTEN = (
    "source_url string, source string, id string, created_at long, run_id string, category string, norm_url string, scheme string, domain string, host string, sub_domains array<string>, path string, raw_query string, file string, "
    "host_path string, full_url string, login string, ip string, confidence double, updated_at long, deleted_at long, reason string, times long, kind string"
)


def make_entries(lines: DataFrame, run_id: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """``lines`` has line, source, category. Gives the entries, and the rejects with a reason.

    A caller that writes both should use ``write_lines``, which parses them once.
    """
    parsed = parse_lines(lines, run_id, now)
    return parsed.filter("reason is null").drop("reason"), parsed.filter("reason is not null").select("source", F.col("source_url").alias("line"), "reason")


def write_landed(lines: DataFrame, landing: str, provider: str, run_id: str, created_at: Column) -> None:
    """Land one response: its lines, and then its metadata, so that a response without metadata is one that never arrived whole."""
    lines.select("line").write.mode("overwrite").text(f"{landing}/data/provider={provider}/run_id={run_id}")
    meta = lines.sparkSession.range(1).select(F.lit(provider).alias("provider"), F.lit(run_id).alias("run_id"), created_at.cast("timestamp_ntz").alias("created_at"))
    meta.coalesce(1).write.mode("overwrite").json(f"{landing}/meta/{provider}/{run_id}")


def read_landing(spark: SparkSession, landing: str) -> DataFrame:
    """provider, run_id, created_at, path: the metadata of all landed responses."""
    meta = spark.read.schema("provider string, run_id string, created_at timestamp_ntz").option("recursiveFileLookup", True).json(f"{landing}/meta")
    return meta.withColumn("path", F.concat(F.lit(f"{landing}/data/provider="), "provider", F.lit("/run_id="), "run_id"))


def read_landed(spark: SparkSession, landing: str, now: Column, ttl_seconds: Column) -> DataFrame:
    """provider, run_id, age_seconds, line: the lines of each provider's newest response, where it is fresh; other runs' files are pruned."""
    fresh = landing_fresh(read_landing(spark, landing), now, ttl_seconds).filter("fresh").select("provider", "run_id", "age_seconds")
    data = spark.read.schema("line string, provider string, run_id string").text(f"{landing}/data").select("line", "provider", "run_id")
    return data.join(fresh, ["provider", "run_id"]).select("provider", "run_id", "age_seconds", "line")


def landing_fresh(landing: DataFrame, now: Column, ttl_seconds: Column) -> DataFrame:
    """Each provider's newest landed response, with its age in seconds and whether it may be used as it is."""
    newest = landing.groupBy("provider").agg(F.max_by(F.struct("run_id", "created_at", "path"), "created_at").alias("x")).select("provider", "x.*")
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    return newest.withColumn("age_seconds", age).withColumn("fresh", F.col("age_seconds") <= ttl_seconds)


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "id string, name string, trust_score double")


def sources(spark: SparkSession) -> DataFrame:
    """The seeded sources, all enabled, with the response lifetime that their schedule gives."""
    seeded = spark.createDataFrame(SOURCES, "id string, provider_id string, source_url string, type string, trust_score double, update_interval long, category string, schedule string")
    return seeded.withColumns({"name": F.col("id"), "enabled": F.lit(True), "ttl_seconds": ttl_of_schedule(F.col("schedule"))})


def with_options(sources: DataFrame, options: DataFrame) -> DataFrame:
    """Sources under the options set for them: id, and enabled, source_url, schedule, category, api_key, ttl_seconds, each null where it isn't set.

    The key goes into the address; without a lifetime of its own a source has that of its schedule.
    """
    kept = [c for c in options.columns if c != "id"]
    joined = sources.join(options.select("id", *[F.col(c).alias(f"_{c}") for c in kept]), "id", "left")
    own = lambda c: F.coalesce(f"_{c}", c) if c in kept else F.col(c)
    schedule = own("schedule")
    out = joined.withColumns({"enabled": own("enabled"), "source_url": own("source_url"), "schedule": schedule, "category": own("category"), "ttl_seconds": F.coalesce("_ttl_seconds", ttl_of_schedule(schedule)) if "ttl_seconds" in kept else ttl_of_schedule(schedule)})
    if "api_key" in kept:
        out = out.withColumn("source_url", urls.resolve_source_url(F.col("source_url"), F.col("_api_key")))
    return out.select(*sources.columns)


def seed_dimensions(existing: DataFrame, seed: DataFrame) -> DataFrame:
    """Seeds replace rows of the same id."""
    return existing.join(seed.select("id"), "id", "left_anti").unionByName(seed)


def source_provider(spark: SparkSession) -> DataFrame:
    p = providers(spark).select(F.col("id").alias("provider_id"), F.col("name").alias("provider"), F.col("trust_score").alias("provider_trust"))
    return sources(spark).join(F.broadcast(p), "provider_id")  # a handful of seeded rows


def load_trust(spark: SparkSession) -> DataFrame:
    """source, trust: the source's own, else its provider's, else the default."""
    return source_provider(spark).select(F.col("id").alias("source"), F.coalesce("trust_score", "provider_trust", F.lit(DEFAULT_TRUST)).alias("trust"))


def source_hosts(sources: DataFrame, url_col: str = "source_url", extra: str = "raw.githubusercontent.com") -> DataFrame:
    """host: the distinct hosts of the sources' addresses, and one more that feeds redirect to."""
    hosts = sources.select(urls.url_host(F.col(url_col)).alias("host"))
    return hosts.union(sources.sparkSession.createDataFrame([(extra,)], "host string")).filter("host is not null").distinct()


def write_entries(entries: DataFrame, path: str) -> None:
    """Only the sources present in ``entries`` are overwritten. Repeats are one row."""
    one_a_key(entries).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type").parquet(path)


def write_keys(entries: DataFrame, index: DataFrame, path: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Store an index, and the typed keys that confirm its matches, by key; for ``check.bulk_hit_by_key``."""
    return write_by_key(index, f"{path}/index", buckets), write_by_key(typed_keys(entries).distinct(), f"{path}/confirmed", buckets)


def write_url_filter(entries: DataFrame, path: str) -> int:
    """Add a batch's active source_urls to the stored filter that gates exact lookups."""
    return filters.add_layer(entries.sparkSession, path, active(entries), ["source_url"])


def write_key_filter(index: DataFrame, path: str) -> int:
    """Add the keys of (a batch of) the index to its stored filter."""
    return filters.add_layer(index.sparkSession, path, index, ["type", "key"])


def results_json(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(F.to_json(F.struct(*[F.col(c) for c in verdicts.columns])).alias("record"))
