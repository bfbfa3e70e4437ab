"""Structured Streaming: landed lines to entries and index, streams of URLs to verdicts.

Streams of any number of feeds write to one table of batches (``store``). Each micro-batch writes its own rows and reads
nothing of the table, so its cost doesn't grow with it. A stream is known by its checkpoint: a new one is a new stream,
whose batches count beside those of the old one. The key index is read from the same table, so that it can't differ.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..operators import check
from ..sources import feeds
from . import store

COMPACT_EVERY = 64  # batches between two compactions


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gives a query when it first uses a checkpoint."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def apply_lines(lines: DataFrame, stream: str, batch_id: int, table: str, run_id: Column, now: Column, compact_every: int = COMPACT_EVERY) -> bool:
    """Write one batch of lines (line, source, category) as entries with their keys; False where it counts already."""
    spark = lines.sparkSession
    batch, _ = feeds.make_entries(lines, run_id, now)
    new = store.upsert(spark, table, batch, stream, batch_id)
    if new and len(store.snapshot(spark, table)[1]) >= compact_every:
        store.compact(spark, table)
    return new


def stream_ingest(spark: SparkSession, landing: str, source: str, table: str, checkpoint: str, now: Column | None = None, trigger: dict | None = None, files_per_batch: int = 100) -> StreamingQuery:
    """Landed text files of one feed into the table of entries, which other streams may write to as well."""
    feed = feeds.FEEDS[source]
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(landing).withColumnRenamed("value", "line")
    lines = feeds.flat_lines(lines).select("line", F.lit(source).alias("source"), F.lit(feed.category).alias("category"))
    at = now if now is not None else F.unix_micros(F.current_timestamp()) * 1000

    def work(df: DataFrame, batch_id: int) -> None:
        apply_lines(df, stream_name(df.sparkSession, checkpoint), batch_id, table, F.lit(f"{source}-{batch_id}"), at)

    return lines.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def stream_bootstrap(stored: DataFrame, table: str) -> None:
    """Put stored entries into a table, and so their keys into its index, before streams start."""
    store.upsert(stored.sparkSession, table, stored, f"bootstrap-{uuid.uuid4().hex}", 0)


def stream_check(checks: DataFrame, table: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Verdicts for a stream of (url_id, url) against the index as it is at each batch; no state across batches."""

    def work(df: DataFrame, batch_id: int) -> None:
        current = store.read_index(df.sparkSession, table)
        if current is None:
            raise ValueError(f"there is no table at {table}: fill it with stream_bootstrap")
        check.bulk_check(df, current).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return checks.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def stream_matches(checks: DataFrame, current: DataFrame) -> DataFrame:
    """All matches as plain stream-static joins, for append sinks; the same keys as ``check.bulk_check_all`` probes."""
    parts = urls.decompose_urls(checks, "url").filter("error is null")
    keys = parts.select("url_id", "url", F.posexplode(urls.check_keys()).alias("ord", "k")).select("url_id", "url", "ord", "k.*")
    return keys.join(current, ["type", "key"])


def distinct_across_batches(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """A re-sent (source, source_url) within the delay goes, with bounded state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["source", "source_url"])
