"""The key index (one row an entry) and relational bloom filters over its keys."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from .entries import active

LEAST_N, RATE = 1000, 0.01


def key_index(entries: DataFrame) -> DataFrame:
    """Distinct (type, key, source) of the active entries, from stored columns only."""
    return active(entries).select(urls.entry_target().alias("k"), "source").filter("k is not null").select("k.type", "k.key", "source").distinct()


def index_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("type").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("keys"))


def rebuild_source(index: DataFrame, source: str, fresh: DataFrame) -> DataFrame:
    """Replace one source's keys only."""
    return index.filter(F.col("source") != source).unionByName(fresh.filter(F.col("source") == source))


def write_by_key(keys: DataFrame, path: str, buckets: int) -> DataFrame:
    """Store rows with type and key by bucket of these, a file a bucket, and give the table that ``open_by_key`` gives.

    A join by (type, key) then reads it as it lies. What was there is replaced; let readers end first, or take a new path.
    """
    spark, folder = keys.sparkSession, f"{path.rstrip('/')}/buckets-{buckets}"
    name = _by_key_table(spark, folder, keys.schema.simpleString()[7:-1].replace(":", " "), buckets)
    keys.repartition(buckets, "type", "key").sortWithinPartitions("type", "key").write.insertInto(name, overwrite=True)
    return spark.table(name)


def open_by_key(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """A table that ``write_by_key`` stored, in this session or another; ``buckets`` as it was made with."""
    folder = f"{path.rstrip('/')}/buckets-{buckets}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)  # an error where there is none
    return spark.table(_by_key_table(spark, folder, columns, buckets))


def _by_key_table(spark: SparkSession, folder: str, columns: str, buckets: int) -> str:
    """Only the catalog knows buckets, so each folder is a table there, under a name that its path gives."""
    name = "by_key_" + hashlib.sha256(folder.encode()).hexdigest()[:32]
    where = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (type, key) SORTED BY (type, key) INTO {buckets} BUCKETS LOCATION '{where}'")
    spark.catalog.refreshTable(name)
    return name


def shapes(index: DataFrame, rate: float = RATE) -> DataFrame:
    """type, bits, hashes: the shape of each type's filters, from the number of its keys; a row a key type."""
    n = F.greatest(F.count_distinct("key"), F.lit(LEAST_N)).cast("double")
    bits = F.ceil(n * F.lit(-math.log(rate) / math.log(2) ** 2))
    sized = index.groupBy("type").agg(n.alias("n"), bits.cast("long").alias("bits"))
    return sized.select("type", "bits", F.greatest(F.lit(1), F.round(F.col("bits") / F.col("n") * F.lit(math.log(2)))).cast("int").alias("hashes"))


def positions() -> Column:
    """Bit positions of ``key`` among ``bits``; both hashes are reduced before they are multiplied."""
    bits = F.col("bits")
    h1, h2 = F.pmod(F.xxhash64("key"), bits), F.pmod(F.xxhash64("key", F.lit(7)), bits)
    return F.transform(F.sequence(F.lit(0), F.col("hashes") - 1), lambda i: F.pmod(h1 + i * h2, bits))


def build_bloom(index: DataFrame, rate: float = RATE) -> DataFrame:
    """type, source, bits, hashes, word, mask: 64-bit words of a filter for each (type, source), built and merged by bit_or.

    All filters of a type have one shape, so that they can be merged.
    """
    at = index.join(F.broadcast(shapes(index, rate)), "type").select("type", "source", "bits", "hashes", F.explode(positions()).alias("p"))
    return at.groupBy("type", "source", "bits", "hashes", F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("mask"))


def merge_bloom(bloom: DataFrame, without: str | None = None) -> DataFrame:
    """The filter of each type over all sources, or all but one."""
    kept = bloom.filter(F.col("source") != without) if without else bloom
    return kept.groupBy("type", "bits", "hashes", "word").agg(F.bit_or("mask").alias("mask"))


def bloom_probe(probes: DataFrame, bloom: DataFrame) -> DataFrame:
    """The distinct (type, key) of ``probes`` that a filter may hold: of the merged one, or with source of each source's own."""
    by = ["type", "key", *[c for c in bloom.columns if c == "source"]]
    kinds = bloom.select("type", "bits", "hashes").distinct()  # a row a key type, of which there are nine
    at = probes.select("type", "key").distinct().join(F.broadcast(kinds), "type").withColumn("p", F.explode(F.array_distinct(positions())))
    at = at.withColumn("wanted", F.size(F.array_distinct(positions()))).withColumn("word", F.expr("p div 64"))
    hit = at.join(bloom.drop("bits", "hashes"), ["type", "word"]).filter(F.col("mask").bitwiseAND(F.expr("shiftleft(1L, cast(p % 64 as int))")) != 0)
    return hit.groupBy(*by).agg(F.count("*").alias("n"), F.max("wanted").alias("wanted")).filter("n = wanted").select(*by)
