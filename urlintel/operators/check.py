"""Bulk checks of URLs against the key index, confirmation and scores.

Equal URLs are checked once. Each is exploded to its probe keys; one equi-join finds the listed ones, whatever their
type. The size of the index decides how Spark joins; it is never sent by force. An index stored by key
(``index.write_by_key``) is read as it lies by ``matches_by_key``: it isn't shuffled, whatever is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.feeds import DEFAULT_TRUST
from . import filters
from .entries import exists_by_type

SALTS = 64  # shares of the URLs of one key


def probe_keys(checks: DataFrame, url_col: str = "url", **options) -> DataFrame:
    """url, ord, type, key: the keys of the distinct valid URLs, in the order in which they count."""
    parts = urls.decompose_urls(checks.select(F.col(url_col).alias("url")).distinct(), "url", **options)
    return parts.filter("error is null").select("url", F.posexplode(urls.check_keys()).alias("ord", "k")).select("url", "ord", "k.*")


def all_matches(keys: DataFrame, index: DataFrame) -> DataFrame:
    """url, ord, type, key, source: every listed key of every URL."""
    return keys.join(index, ["type", "key"]).select("url", "ord", "type", "key", "source")


def matches_by_key(keys: DataFrame, index: DataFrame, confirmed: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """``all_matches`` over an index stored by key, and only those that ``confirmed``, typed keys stored in as many buckets, has too.

    The keys of the URLs are shuffled once, by key and a share of its URLs, so that a popular domain is no single task. Each
    share asks once; these questions alone go to the buckets, and the answers come back to where the keys are.
    """
    shares = keys.withColumn("share", F.pmod(F.xxhash64("url"), F.lit(salts))).repartition("type", "key", "share")
    listed = shares.select("type", "key", "share").distinct().join(index.select("type", "key", "source"), ["type", "key"])
    if confirmed is not None:
        listed = listed.join(confirmed, ["type", "key"], "left_semi")
    return shares.join(listed, ["type", "key", "share"]).select("url", "ord", "type", "key", "source")


def in_order():
    """The matches of a URL in order; there are at most as many as it has keys times the sources."""
    return F.array_sort(F.collect_list(F.struct("ord", "source", "type", "key")))


def first_match(matches: DataFrame) -> DataFrame:
    """The match of lowest (ord, source) of each URL."""
    return matches.groupBy("url").agg(F.min(F.struct("ord", "source", "type", "key")).alias("m")).select("url", "m.*")


def _back(checks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row for each row checked. Only URLs with a match have a verdict; the error is told from the URL itself."""
    return checks.withColumn("error", urls.url_error(F.col("url"))).join(verdicts, "url", "left")


def _checked(checks: DataFrame, verdicts: DataFrame) -> DataFrame:
    depth = F.least(10 * F.coalesce(F.size("matches"), F.lit(0)), F.lit(100))
    return _back(checks, verdicts).select(*checks.columns, "error", F.col("matches").isNotNull().alias("likely"), depth.alias("max_depth"), "matches")


def bulk_check(checks: DataFrame, index: DataFrame, find=all_matches, **options) -> DataFrame:
    """All columns of ``checks``, error, likely, max_depth and matches (the first hit, or none). For an index stored by key ``find`` is ``matches_by_key``."""
    first = first_match(find(probe_keys(checks, **options), index))
    return _checked(checks, first.select("url", F.array(F.struct("source", "type", "key")).alias("matches")))


def bulk_check_all(checks: DataFrame, index: DataFrame, find=all_matches, **options) -> DataFrame:
    """As ``bulk_check`` with every match, in order."""
    found = find(probe_keys(checks, **options), index)
    return _checked(checks, found.groupBy("url").agg(in_order().alias("matches")))


def attach_trust(matches: DataFrame, trust: DataFrame) -> DataFrame:
    """``trust`` has a row a source: a small dimension."""
    return matches.join(trust, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(DEFAULT_TRUST)))


def score_matches(matches: DataFrame, listed: bool = False) -> DataFrame:
    """url, n_matches, confidence, check_max_depth, level, and with ``listed`` the matches: one match gives its trust; several, the trust-weighted mean of their depth weights."""
    total, weighted = F.sum("trust"), F.sum(F.col("trust") * urls.depth_weight(F.col("type")))
    score = F.when(F.count("*") == 1, F.max("trust")).when(total == 0, F.lit(0.0)).otherwise(weighted / total)
    every = [in_order().alias("matches")] if listed else []
    return matches.groupBy("url").agg(F.count("*").alias("n_matches"), score.alias("confidence"), F.max(F.floor(urls.depth_weight(F.col("type")) * 100 + F.lit(1e-9))).alias("check_max_depth"), *every).withColumn("level", urls.confidence_level(F.col("confidence")))


def score_sources(lists: DataFrame, trust: DataFrame, id_col: str) -> DataFrame:
    """Mean trust of a list of sources (columns id, sources); an empty one scores 0. Twelve digits count, so that the order in which a sum is made moves no mean over a bound."""
    each = attach_trust(lists.select(id_col, F.explode_outer("sources").alias("source")), trust)
    mean = F.round(F.avg(F.when(F.col("source").isNotNull(), F.col("trust"))), 12)
    return each.groupBy(id_col).agg(F.coalesce(mean, F.lit(0.0)).alias("confidence")).withColumn("level", urls.confidence_level(F.col("confidence")))


def bulk_hit(checks: DataFrame, index: DataFrame, entries: DataFrame, trust: DataFrame, match_mode: str = "first", **options) -> DataFrame:
    """Check, confirm against the active entries, score. Misses come back with blocked = false."""
    return _hits(checks, exists_by_type(all_matches(probe_keys(checks, **options), index), entries), trust, match_mode)


def bulk_hit_by_key(checks: DataFrame, index: DataFrame, confirmed: DataFrame, trust: DataFrame, match_mode: str = "first", **options) -> DataFrame:
    """``bulk_hit`` over tables stored by key, the index and the ``typed_keys`` of the entries: neither is shuffled, and no entry is read."""
    return _hits(checks, matches_by_key(probe_keys(checks, **options), index, confirmed), trust, match_mode)


def _hits(checks: DataFrame, found: DataFrame, trust: DataFrame, match_mode: str) -> DataFrame:
    if match_mode == "first":
        found = first_match(found)
    scored = score_matches(attach_trust(found, trust), listed=True)
    score = F.coalesce("confidence", F.lit(0.0))
    return _back(checks, scored).select(*checks.columns, "error", F.col("matches").isNotNull().alias("blocked"), score.alias("confidence"), urls.confidence_level(score).alias("level"), "matches")


def clean_urls(checks: DataFrame, index: DataFrame) -> DataFrame:
    return checks.join(all_matches(probe_keys(checks), index).select("url").distinct(), "url", "left_anti")


def covered_by(checks: DataFrame, index: DataFrame, kind: str) -> DataFrame:
    """url, key, source: the URLs that a listed domain (kind 'domain') or path ('host_path') above them covers."""
    return all_matches(probe_keys(checks).filter(F.col("type") == kind), index).select("url", "key", "source")


def prefilter_urls(checks: DataFrame, entries: DataFrame) -> DataFrame:
    """The URLs that are listed just so."""
    return checks.join(entries.filter("deleted_at is null").select(F.col("source_url").alias("url")).distinct(), "url", "left_semi")


def prefilter_urls_gated(checks: DataFrame, gate: list[filters.Filter]) -> DataFrame:
    """The URLs that may be listed just so, by a filter of source_urls alone: none that is listed is missing, few others are there."""
    may = filters.probe(checks.select(F.col("url").alias("source_url")), gate, ["source_url"])
    return checks.join(may.select(F.col("source_url").alias("url")), "url", "left_semi")


def lookup_report(verdicts: DataFrame) -> DataFrame:
    hit = F.count_if("blocked")
    return verdicts.agg(F.count("*").alias("checked"), hit.alias("listed"), (F.count("*") - hit).alias("not_listed"), F.round(100.0 * hit / F.count("*"), 6).alias("hit_percent"))
