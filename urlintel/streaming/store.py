"""A table of batches that any number of streams write to, with a log of what counts.

``data/<folder>`` holds the rows of one batch, ``log/`` an empty file for each commit, whose name says it all: sequence,
kind, stream, batch and folder. A batch is written to a folder of its own first and counts from the moment its commit is
there, so nobody sees half of one and no writer writes over another's rows. (stream, batch) counts once: a batch that is
run again finds its commit, or leaves a second one that is ignored. The sequence is taken when a batch commits: the next
free one. Writers that take the same are told apart by their names, so the order is total and nobody waits for a lock.

Kinds: ``rows`` (entries, upserted), ``gone`` (keys that are deleted, with the time), ``clear`` (all before it is deleted)
and ``base``. Rows and deletions of a key are merged when the table is read, by sequence. A deletion takes the place right
after the last commit that it looked at, so that an upsert that comes in meanwhile isn't lost.

``compact`` folds what counts into a base, which lists the batches in it by stream. It keeps the place of the first and
last row and of the last deletion of every key, so a commit that was late is still merged where it belongs. Files go only
when the next base is written; readers and writers that began before a base are thus left alone.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.entries import KEY, dedup_batch

LAST = "~"  # after every name of a stream
PLACES = ("first_at", "last_at", "gone_at", "gone_time")


class Commit(NamedTuple):
    seq: int
    kind: str
    stream: str
    batch: int
    folder: str
    info: int

    @property
    def place(self) -> str:
        """Where it stands in the order of all commits, as text; a deletion stands behind all rows of its sequence."""
        return f"{self.seq:015d}{LAST if self.kind in ('gone', 'clear') else ' '}{quote(self.stream, safe='')} {self.batch:015d}"

    @property
    def name(self) -> str:
        return "@".join((f"{self.seq:015d}", self.kind, quote(self.stream, safe=""), str(self.batch), self.folder, str(self.info)))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def log(spark: SparkSession, table: str) -> list[Commit]:
    """All commits in their order; of two of one batch the first."""
    fs, where = _files(spark, f"{table}/log")
    out: dict[tuple, Commit] = {}
    if fs.exists(where):
        for status in fs.listStatus(where):
            parts = status.getPath().getName().split("@")
            if len(parts) == 6:
                c = Commit(int(parts[0]), parts[1], unquote(parts[2]), int(parts[3]), parts[4], int(parts[5]))
                key = (c.kind == "base", c.stream, c.batch)
                out[key] = min(c, out.get(key, c), key=lambda x: (x.place, x.folder))
    return sorted(out.values(), key=lambda c: (c.place, c.folder))


def _folded(spark: SparkSession, table: str, base: Commit | None) -> tuple[dict[str, list[list[int]]], list]:
    """The batches in a base as ranges by stream, and the place and time of the last clearing."""
    if base is None:
        return {}, ["", 0]
    said = json.loads(spark.read.text(f"{table}/data/{base.folder}/folded", wholetext=True).first()[0])
    return said["folded"], said["clear"]


def snapshot(spark: SparkSession, table: str) -> tuple[Commit | None, list[Commit], dict, list]:
    """The base in which most is folded, the commits that aren't in it, what is in it, and the last clearing."""
    every = log(spark, table)
    base = max((c for c in every if c.kind == "base"), key=lambda c: (c.info, c.seq, c.folder), default=None)
    folded, clear = _folded(spark, table, base)
    inside = lambda c: any(a <= c.batch <= b for a, b in folded.get(c.stream, ()))
    live = [c for c in every if c.kind != "base" and not inside(c)]
    return base, live, folded, max([clear, *([c.place, c.info] for c in live if c.kind == "clear")])


def counted(spark: SparkSession, table: str, stream: str, batch: int) -> bool:
    _, live, folded, _ = snapshot(spark, table)
    return any((c.stream, c.batch) == (stream, batch) for c in live) or any(a <= batch <= b for a, b in folded.get(stream, ()))


def commit(spark: SparkSession, table: str, rows: DataFrame | None, kind: str, stream: str, batch: int, info: int = 0, after: int | None = None) -> bool:
    """Write a batch and let it count; False where it counts already. Nothing of the table is read but its log."""
    if counted(spark, table, stream, batch):
        return False
    folder = uuid.uuid4().hex
    fs, where = _files(spark, f"{table}/data/{folder}")
    if rows is not None:
        rows.write.parquet(f"{table}/data/{folder}/rows")
    if counted(spark, table, stream, batch):
        fs.delete(where, True)
        return False
    seq = max((c.seq for c in log(spark, table)), default=0) + 1 if after is None else after
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/log/{Commit(seq, kind, stream, batch, folder, info).name}"), False).close()
    return True


def with_keys(batch: DataFrame) -> DataFrame:
    """One row a key of the table, with the key that it is listed under."""
    return dedup_batch(batch.withColumn("seq", F.lit(0))).withColumn("target", urls.entry_target())


def upsert(spark: SparkSession, table: str, batch: DataFrame, stream: str, number: int) -> bool:
    return commit(spark, table, with_keys(batch), "rows", stream, number)


def _read(spark: SparkSession, table: str, commits: list[Commit]) -> DataFrame | None:
    if not commits:
        return None
    places = F.create_map(*[F.lit(x) for c in commits for x in (c.folder, c.place)])  # a batch or two for each commit since the base
    folder = F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/rows/", 1)
    return spark.read.option("mergeSchema", True).parquet(*[f"{table}/data/{c.folder}/rows" for c in commits]).withColumn("place", places[folder])


def merged(spark: SparkSession, table: str, columns: list[str] | None = None, snap=None) -> DataFrame | None:
    """One row a key: the first id and created_at, the rest of the last upsert, deleted_at, and the places these came from.

    With ``columns`` only these and what tells the living from the deleted are read. None while nothing is there.
    """
    base, live, _, clear = snap or snapshot(spark, table)
    rows, gone = _read(spark, table, [c for c in live if c.kind == "rows"]), _read(spark, table, [c for c in live if c.kind == "gone"])
    parts = []
    if base is not None:
        parts.append(spark.read.parquet(f"{table}/data/{base.folder}/rows"))
    if rows is not None:
        parts.append(rows.withColumns({"first_at": F.col("place"), "last_at": F.col("place"), "gone_at": F.lit(""), "gone_time": F.lit(None).cast("long")}).drop("place"))
    if not parts:
        return None
    wanted = columns or [c for c in parts[-1].columns if c not in (*KEY, *PLACES, "deleted_at")]
    fixed = [c for c in ("id", "created_at") if c in wanted]
    rest = [c for c in wanted if c not in fixed]
    if gone is not None:
        parts.append(gone.select(*KEY, F.lit(None).cast("string").alias("first_at"), F.lit(None).cast("string").alias("last_at"), F.col("place").alias("gone_at"), F.col("gone_time")))
    both = parts[0].select(*KEY, *PLACES, *[c for c in (*wanted, "deleted_at") if c in parts[0].columns])
    for p in parts[1:]:
        both = both.unionByName(p.select(*[c for c in p.columns if c in both.columns]), allowMissingColumns=True)
    last = F.max_by(F.struct(F.col("last_at"), F.struct(*rest, "deleted_at").alias("v")), F.coalesce("last_at", F.lit(""))).alias("last")
    one = both.groupBy(*KEY).agg(
        *[F.min_by(c, F.coalesce("first_at", F.lit(LAST))).alias(c) for c in fixed], F.min("first_at").alias("first_at"), last,
        F.max(F.struct(F.coalesce("gone_at", F.lit("")).alias("at"), "gone_time")).alias("gone"),
    ).filter("first_at is not null")
    said = F.greatest(F.struct(F.col("gone.at").alias("at"), F.col("gone.gone_time").alias("time")), F.struct(F.lit(clear[0]).alias("at"), F.lit(clear[1]).cast("long").alias("time")))
    out = one.withColumn("said", said).select(*KEY, *fixed, "last.v.*", "first_at", F.col("last.last_at").alias("last_at"), F.col("said.at").alias("gone_at"), F.col("said.time").alias("gone_time"))
    return out.withColumn("deleted_at", F.when(F.col("gone_at") > F.col("last_at"), F.col("gone_time")).otherwise(F.col("deleted_at")))


def read_entries(spark: SparkSession, table: str) -> DataFrame | None:
    """All entries, deleted ones too, as if the batches and deletions had been applied one after another."""
    rows = merged(spark, table)
    return None if rows is None else rows.drop(*PLACES, "target")


def read_index(spark: SparkSession, table: str) -> DataFrame | None:
    """type, key, source, entries: every key that a living entry is listed under, and how many. Only the columns that tell are read."""
    rows = merged(spark, table, ["target"])
    if rows is None:
        return None
    alive = rows.filter("deleted_at is null and target is not null").select("target.type", "target.key", "source")
    return alive.groupBy("type", "key", "source").agg(F.count("*").alias("entries"))


def read_url_ids(spark: SparkSession, table: str) -> DataFrame | None:
    """source_url, ids: the inverted index, from what the batches added and removed. A batch reads nothing of it."""
    rows = merged(spark, table, ["id"])
    return None if rows is None else rows.filter("deleted_at is null").groupBy("source_url").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _delete(spark: SparkSession, table: str, pick, now: int, stream: str, batch: int) -> bool:
    snap = snapshot(spark, table)
    rows = merged(spark, table, ["id", "run_id"], snap)
    if rows is None or counted(spark, table, stream, batch):
        return False
    seen = max([c.seq for c in snap[1]] + ([snap[0].seq] if snap[0] else []))
    return commit(spark, table, pick(rows).select(*KEY, F.lit(now).cast("long").alias("gone_time")), "gone", stream, batch, after=seen)


def expire_stale(spark: SparkSession, table: str, source: str, run_id: str, now: int, stream: str, batch: int) -> bool:
    """Delete the living entries of a source that its last run didn't bring. Their keys are written, the table isn't."""
    stale = (F.col("source") == source) & ~F.col("run_id").eqNullSafe(F.lit(run_id)) & F.col("deleted_at").isNull()
    return _delete(spark, table, lambda rows: rows.filter(stale), now, stream, batch)


def soft_delete_ids(spark: SparkSession, table: str, ids: DataFrame, now: int, stream: str, batch: int) -> bool:
    return _delete(spark, table, lambda rows: rows.join(ids.select("id").distinct(), "id", "left_semi"), now, stream, batch)


def clear_all(spark: SparkSession, table: str, now: int, stream: str, batch: int) -> bool:
    """Delete everything so far, entries deleted before too, by a commit without rows."""
    seen = max((c.seq for c in log(spark, table)), default=0)
    return commit(spark, table, None, "clear", stream, batch, info=now, after=seen)


def ranges(numbers: list[int], known: list[list[int]]) -> list[list[int]]:
    """Whole numbers and ranges as the fewest ranges."""
    out: list[list[int]] = []
    for a, b in sorted([*known, *([n, n] for n in numbers)]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def compact(spark: SparkSession, table: str) -> None:
    """Fold all that counts now into a base. What the base before it was made of goes now, not at once, so that its readers can end."""
    snap = snapshot(spark, table)
    base, live, folded, clear = snap
    rows = merged(spark, table, None, snap)
    if not live or rows is None:
        return
    streams = {*folded, *(c.stream for c in live)}
    now = {s: ranges([c.batch for c in live if c.stream == s], folded.get(s, [])) for s in streams}
    folder, many = uuid.uuid4().hex, sum(b - a + 1 for r in now.values() for a, b in r)
    gone = F.col("gone_at") > F.col("last_at")
    rows.withColumn("deleted_at", F.when(~gone, F.col("deleted_at"))).write.parquet(f"{table}/data/{folder}/rows")
    spark.createDataFrame([(json.dumps({"folded": now, "clear": clear}),)], "said string").coalesce(1).write.text(f"{table}/data/{folder}/folded")
    fs, _ = _files(spark, table)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.create(path(f"{table}/log/{Commit(live[-1].seq, 'base', folder, 0, folder, many).name}"), False).close()
    if base is not None:
        for c in log(spark, table):
            if c.folder != base.folder and (c.info < base.info if c.kind == "base" else any(a <= c.batch <= b for a, b in folded.get(c.stream, ()))):
                fs.delete(path(f"{table}/log/{c.name}"), False)
                fs.delete(path(f"{table}/data/{c.folder}"), True)
