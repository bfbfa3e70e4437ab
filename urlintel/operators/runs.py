"""The run log: recording, history, metrics, and the planning of refreshes. ``now`` is always passed in."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import trimmed

HOUR, DAY, WEEK, DEFAULT_TTL = 3600, 86_400, 604_800, 21_600
# The units of duration text, in nanoseconds.
UNITS = {"ns": 1, "us": 10**3, "\u00b5s": 10**3, "\u03bcs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
NUMBER = r"[0-9]+\.?[0-9]*|\.[0-9]+"


# A row of the log that an ingest leaves: what became of one feed's lines.
LOGGED = "source string, run_id string, status string, start_time timestamp, end_time timestamp, error string, lines long, parsed long, entries long, rejected long, rejects long, longest long, reasons map<string,long>"


def log_runs(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Add the rows of one ingest, one a feed, to the log; the columns are those of ``LOGGED``, times are in epoch seconds. Counts of failed feeds are null."""
    names = [c.split()[0] for c in LOGGED.split(", ")]
    at = lambda c, v: datetime.fromtimestamp(v, UTC) if c.endswith("_time") else v
    spark.createDataFrame([tuple(at(c, r.get(c)) for c in names) for r in rows], LOGGED).coalesce(1).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOGGED).parquet(path)


def logged_metrics(logged: DataFrame) -> DataFrame:
    """``feed_metrics`` from the log alone, by source, without reading entries or rejects: saved and parse_errors over all runs, processed by the last completed one."""
    last, done = F.struct("start_time", "run_id"), F.col("status") == "completed"
    return logged.groupBy("source").agg(
        F.count("*").alias("syncs"), F.count_if(done).alias("successes"), F.count_if(~done).alias("failures"), F.max_by(F.unix_timestamp("end_time") - F.unix_timestamp("start_time"), last).alias("last_seconds"),
        F.coalesce(F.sum("entries"), F.lit(0)).alias("saved"), F.max_by("lines", F.when(done, last)).alias("processed"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("parse_errors"),
    )


def record_run(events: DataFrame) -> DataFrame:
    """The latest state of each run from its append-only events (run_id, seq, status, at, error)."""
    at = F.struct("at", "seq")
    return events.groupBy("run_id").agg(F.min("at").alias("start_time"), F.max_by("status", at).alias("status"), F.max_by(F.when(F.col("status") != "running", F.col("at")), at).alias("end_time"), F.max_by("error", at).alias("error"))


def latest_running(runs: DataFrame, now: Column, deadline_seconds: int) -> DataFrame:
    last = runs.filter("status = 'running'").agg(F.max_by(F.struct("run_id", "start_time"), F.struct("start_time", "run_id")).alias("r")).select("r.*").filter("run_id is not null")
    return last.withColumn("alive", F.col("start_time") + F.expr(f"interval {deadline_seconds} seconds") > now)


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("start_time"), F.desc("run_id"))


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    """Those running, and the newest n others."""
    current = runs.filter("status = 'running'")
    return current.unionByName(list_runs(runs.filter("status <> 'running'")).limit(n))


def run_by_id(live: DataFrame, stored: DataFrame, ids: DataFrame) -> DataFrame:
    """One row a run asked for: the live record before the stored one."""
    columns = [c for c in stored.columns if c != "run_id"]
    both = live.withColumn("rank", F.lit(0)).unionByName(stored.withColumn("rank", F.lit(1)))
    return both.join(ids, "run_id", "left_semi").groupBy("run_id").agg(F.min_by(F.struct(*columns), "rank").alias("r")).select("run_id", "r.*")


def merge_run_history(live: DataFrame, stored: DataFrame) -> DataFrame:
    return live.join(stored.select("run_id"), "run_id", "left_anti").unionByName(stored)


def entries_per_run(runs: DataFrame) -> DataFrame:
    """provider, run_id: processed, seconds, rate."""
    seconds = F.max(F.unix_timestamp("end_time")) - F.min(F.unix_timestamp("start_time"))
    return runs.groupBy("provider", "run_id").agg(F.sum("entry_count").alias("processed"), seconds.alias("seconds")).withColumn("rate", F.when(F.col("seconds") > 0, F.col("processed") / F.col("seconds")).otherwise(0.0))


def feed_metrics(runs: DataFrame, rejects: DataFrame, entries: DataFrame) -> DataFrame:
    """Per provider: syncs, successes, failures, last duration, saved, processed (by the last run), parse errors, deleted. ``entries`` has provider and deleted_at."""
    last = F.struct("start_time", "run_id")
    by = runs.groupBy("provider").agg(
        F.count("*").alias("syncs"), F.count_if(F.col("status") == "completed").alias("successes"), F.count_if(F.col("status") == "failed").alias("failures"),
        F.max_by(F.unix_timestamp("end_time") - F.unix_timestamp("start_time"), last).alias("last_seconds"), F.sum("entry_count").alias("saved"), F.max_by("entry_count", last).alias("processed"),
    )
    errors = rejects.groupBy("provider").agg(F.count("*").alias("parse_errors"))
    deleted = entries.groupBy("provider").agg(F.count("deleted_at").alias("deleted"))
    return by.join(errors, "provider", "left").join(deleted, "provider", "left").fillna(0, ["parse_errors", "deleted"])


def ttl_of_schedule(schedule: Column) -> Column:
    """Seconds: duration text as it says (``1h30m``, ``1.5h``, ``90s``, cut to whole seconds); the cron forms that feeds use; else hour, day or week by name; else six hours."""
    s = trimmed(F.coalesce(schedule, F.lit("")))
    every = F.regexp_extract(s, r"^[0-9]+ \*/([0-9]+) \* \* \*$", 1)
    low = F.lower(s)
    steps = F.regexp_extract_all(s, F.lit(f"({NUMBER})({'|'.join(UNITS)})"), 1), F.regexp_extract_all(s, F.lit(f"({NUMBER})({'|'.join(UNITS)})"), 2)
    scale = F.create_map(*[F.lit(x) for unit, nanos in UNITS.items() for x in (unit, nanos)])
    nanos = F.aggregate(F.zip_with(*steps, lambda n, unit: n.try_cast("decimal(28,9)") * scale[unit]), F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + x).cast("decimal(38,9)"))
    whole = F.when(s.startswith("-"), -nanos).otherwise(nanos) / F.lit(10**9).cast("decimal(10,0)")
    out = F.when(s.rlike(rf"^[+-]?(?:(?:{NUMBER})(?:{'|'.join(UNITS)}))+$"), whole.cast("long")).when(s.rlike(r"^[+-]?0$"), F.lit(0))
    out = out.when(s.rlike(r"^[0-9]+ \* \* \* \*$"), F.lit(HOUR)).when(every != "", every.try_cast("long") * HOUR)
    out = out.when(s.rlike(r"^[0-9]+ [0-9]+ \* \* \*$"), F.lit(DAY)).when(s.rlike(r"^[0-9]+ [0-9]+ \* \* [0-9]$"), F.lit(WEEK))
    return out.when(low.contains("h"), F.lit(HOUR)).when(low.contains("d"), F.lit(DAY)).when(low.contains("w"), F.lit(WEEK)).otherwise(F.lit(DEFAULT_TTL)).cast("long")


def freshness(created: Column, now: Column, ttl_seconds: Column) -> tuple[Column, Column]:
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(created.cast("timestamp"))
    return age, age <= ttl_seconds


def plan_refresh(sources: DataFrame, counts: DataFrame, landing: DataFrame) -> DataFrame:
    """name, action, reason. ``counts`` has source, urls; ``landing`` has provider, fresh (its newest landed response)."""
    joined = sources.select(F.col("id").alias("name")).join(counts.select(F.col("source").alias("name"), "urls"), "name", "left").join(landing.select(F.col("provider").alias("name"), "fresh"), "name", "left")
    populated = F.coalesce(F.col("urls") > 0, F.lit(False))
    action = F.when(populated & F.coalesce("fresh", F.lit(False)), "skip").when(~populated & F.coalesce("fresh", F.lit(False)), "restore").otherwise("full_fetch")
    reason = F.when(action == "skip", "entries and fresh response present").when(action == "restore", "fresh response, no entries").when(F.col("fresh").isNull(), "no response landed").otherwise("landed response is stale")
    return joined.select("name", F.coalesce("urls", F.lit(0)).alias("entries"), action.alias("action"), reason.alias("reason"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """One line; a row a registered feed goes into it."""
    return plan.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "name", "action"))), ", ").alias("summary"))
