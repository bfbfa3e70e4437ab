"""The entries table: predicates, counts and changes. A change computes the new state; the caller writes it."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

MAX_LIMIT, DEFAULT_LIMIT = 1000, 100
KEY = ("source_url", "source")
SKETCH = 14  # log2 of the registers of a sketch


def active(entries: DataFrame) -> DataFrame:
    return entries.filter("deleted_at is null")


def by_source(entries: DataFrame, source: str) -> DataFrame:
    return active(entries).filter(F.col("source") == source)


def by_category(entries: DataFrame, category: str) -> DataFrame:
    return active(entries).filter(F.col("category") == category)


def by_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Deleted entries too."""
    return entries.join(ids.select("id").distinct(), "id", "left_semi")


def by_id(entries: DataFrame, id_: str) -> DataFrame:
    """Deleted or not."""
    return entries.filter(F.col("id") == id_)


def by_full_url(entries: DataFrame, url: str) -> DataFrame:
    return entries.filter(F.col("source_url") == url).orderBy("source", "id").limit(1)


def search(entries: DataFrame, limit: int | None = None, offset: int = 0, include_deleted: bool = False, category: str | None = None, **equal: str) -> DataFrame:
    """Equality on domain, host, path, raw_query, ip or source; category by substring; newest first."""
    out = entries if include_deleted else active(entries)
    for column, value in equal.items():
        if value:
            out = out.filter(F.col(column) == value)
    if category:
        out = out.filter(F.lower("category").contains(category.lower()))
    size = DEFAULT_LIMIT if not limit or limit < 0 else min(limit, MAX_LIMIT)
    return out.orderBy(F.desc("created_at"), "id").offset(max(0, offset)).limit(size)


def search_scored(found: DataFrame) -> DataFrame:
    score = F.coalesce("confidence", F.lit(0.0))
    match = F.array(F.struct(F.lit("domain").alias("type"), F.col("source"), F.col("domain").alias("key")))
    return found.select(urls.build_url(F.col("scheme"), F.col("host"), F.col("path"), F.col("raw_query")).alias("url"), F.lit(True).alias("blocked"), score.alias("confidence"), urls.confidence_level(score).alias("level"), match.alias("matches"), "id")


def exists_by(probes: DataFrame, entries: DataFrame, column: str) -> DataFrame:
    """The probes (column ``key``) that any active entry has in ``column``."""
    return probes.join(active(entries).select(F.col(column).alias("key")), "key", "left_semi")


def typed_keys(entries: DataFrame) -> DataFrame:
    """(type, key) of every active entry, by which a match of that type is confirmed; not distinct, as a semi-join needs no more."""
    c = F.col
    pairs = F.array(*[urls.key(t, c(t)) for t in ("host", "domain", "ip", "file", "host_path", "full_url")])
    return active(entries).select(F.explode(F.filter(pairs, lambda k: k["key"].isNotNull())).alias("k")).select("k.*")


def exists_by_type(probes: DataFrame, entries: DataFrame) -> DataFrame:
    return probes.join(typed_keys(entries), ["type", "key"], "left_semi")


def count_urls(entries: DataFrame) -> DataFrame:
    return active(entries).agg(F.count_distinct("source_url").alias("urls"))


def count_urls_by_source(entries: DataFrame) -> DataFrame:
    return active(entries).groupBy("source").agg(F.count_distinct("source_url").alias("urls"))


def url_sketches(batch: DataFrame, *by: str) -> DataFrame:
    """by, sketch: an HLL sketch of the active source_urls of a batch; sketches of any batches unite, so a new batch reads only its own rows."""
    return active(batch).groupBy(*by).agg(F.hll_sketch_agg("source_url", F.lit(SKETCH)).alias("sketch"))


def add_sketches(batch: DataFrame, path: str, stream: str, number: int) -> None:
    """Store a batch's sketch of each source; the same batch again takes its own place."""
    url_sketches(batch, "source").write.mode("overwrite").parquet(f"{path}/stream={quote(stream, safe='')}/batch={number}")


def count_urls_approx(sketches: DataFrame, *by: str) -> DataFrame:
    """Distinct source_urls by united sketches, with a standard error of 0.8 %; what was deleted since counts until the sketches are made anew."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("urls"))


def url_id_index(entries: DataFrame) -> DataFrame:
    return active(entries).groupBy("source_url").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def dedup_batch(batch: DataFrame, times: str | None = None) -> DataFrame:
    """The last row of each key by (updated_at, seq) wins; the first one's id and created_at stay. Other ties go by content. ``times`` names a column for the rows that a key had."""
    rest = [c for c in batch.columns if c not in (*KEY, "id", "created_at", "seq")]
    at = F.struct("updated_at", "seq", F.xxhash64(*[c for c in batch.columns if c not in KEY]))
    return batch.groupBy(*KEY).agg(F.min_by("id", at).alias("id"), F.min_by("created_at", at).alias("created_at"), F.max_by(F.struct(*rest), at).alias("last"), F.count("*").alias("n")).select(*KEY, "id", "created_at", "last.*", *([F.col("n").alias(times)] if times else []))


def _merge(target: DataFrame, batch: DataFrame, wins: Column) -> DataFrame:
    columns = target.columns
    joined = target.alias("t").join(batch.alias("b"), list(KEY), "full_outer")
    new = F.col("b.id").isNotNull() & (F.col("t.id").isNull() | wins)
    out = []
    for c in columns:
        if c in KEY:
            out.append(F.col(c))
        elif c in ("id", "created_at"):
            out.append(F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}")).alias(c))
        elif c == "deleted_at":
            out.append(F.when(~F.coalesce(new, F.lit(False)), F.col("t.deleted_at")).alias(c))
        else:
            out.append(F.when(F.coalesce(new, F.lit(False)), F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
    return joined.select(*out)


def one_a_key(batch: DataFrame, order: Column | None = None, times: str | None = None) -> DataFrame:
    """The batch as one row a key; rows of one updated_at come in the ``order`` given, else in that of a column seq, if any."""
    if order is None:
        order = F.col("seq") if "seq" in batch.columns else F.lit(0)
    return dedup_batch(batch.withColumn("seq", order), times)


def upsert_batch(target: DataFrame, batch: DataFrame, order: Column | None = None) -> DataFrame:
    """Insert or overwrite by (source_url, source); the stored id and created_at stay, a deletion mark goes. Repeats in the batch are one row first."""
    return _merge(target, one_a_key(batch, order), F.lit(True))


def upsert_if_newer(target: DataFrame, batch: DataFrame, order: Column | None = None) -> DataFrame:
    return _merge(target, one_a_key(batch, order), F.col("b.updated_at") > F.col("t.updated_at"))


def insert_ignore(target: DataFrame, batch: DataFrame, order: Column | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """A stored row stays; of a key's rows in the batch the first comes in. With columns ``within`` it is the first for each of their values, for a table that may hold a key several times."""
    seq = order if order is not None else F.col("seq") if "seq" in batch.columns else F.lit(0)
    at = F.struct(F.col("updated_at"), seq.alias("seq"), F.xxhash64(*batch.columns).alias("h"))
    first = batch.groupBy(*KEY, *within).agg(F.min_by(F.struct(*target.columns), at).alias("r")).select("r.*")
    return target.unionByName(first.join(target.select(*KEY), list(KEY), "left_anti").select(*target.columns))


def upsert_stored(spark: SparkSession, path: str, batch: DataFrame, buckets: int, order: Column | None = None) -> None:
    """``upsert_batch`` into a table stored by (source, bucket of the source_url): only buckets that the batch hits are read and written again.

    Which these are is a list no longer than the table has partitions. ``buckets`` stays as the table was made with.
    """
    own = one_a_key(batch, order).withColumn("bucket", F.pmod(F.xxhash64("source_url"), F.lit(buckets)).cast("int"))
    hit = [(r["source"], r["bucket"]) for r in own.select("source", "bucket").distinct().collect()]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    columns = [c for c in own.columns if c != "bucket"]
    if fs.exists(where):
        stored = spark.read.schema(own.schema).parquet(path)
        touched: dict[str, list[int]] = {}
        for source, bucket in hit:
            touched.setdefault(source, []).append(bucket)
        some = F.lit(False)
        for source, numbers in touched.items():
            some = some | (F.col("source") == source) & F.col("bucket").isin(numbers)
        target = stored.filter(some).select(*columns)
    else:
        target = own.limit(0).select(*columns)
    out = upsert_batch(target, own.select(*columns)).withColumn("bucket", F.pmod(F.xxhash64("source_url"), F.lit(buckets)).cast("int"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "bucket").parquet(path)


def expire_stale(entries: DataFrame, source: str, run_id: str, now: int) -> DataFrame:
    stale = (F.col("source") == source) & ~F.col("run_id").eqNullSafe(F.lit(run_id)) & F.col("deleted_at").isNull()
    return entries.withColumn("deleted_at", F.when(stale, F.lit(now)).otherwise(F.col("deleted_at")))


def soft_delete_ids(entries: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    gone = ids.select("id", F.lit(True).alias("gone")).distinct()
    return entries.join(gone, "id", "left").withColumn("deleted_at", F.when(F.col("gone"), F.lit(now)).otherwise(F.col("deleted_at"))).drop("gone")


def clear_all(entries: DataFrame, now: int) -> DataFrame:
    """Entries deleted before get the new mark too."""
    return entries.withColumn("deleted_at", F.lit(now).cast("long"))
