"""Arrow helpers that the operators share. Every task sees one batch at a time; nothing is kept across batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts that a Python worker holds at once are cut into slices of about this many bytes.
SLICE_BYTES = 8 << 20
#: What operators keep in a worker between their tasks, by owner: functions that let go of it and say whether there was any.
KEPT: dict[str, Callable[[], bool]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about SLICE_BYTES (one row at least)."""
    rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Return to the system what a task has freed: the worker stays for other tasks, beside busy ones."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries than glibc do so by themselves
        ctypes.CDLL(None).malloc_trim(0)


def take_over(owner: str = "") -> None:
    """At the start of a task: what other operators keep in this worker goes, as a worker serves the tasks of all."""
    if any([let_go() for name, let_go in KEPT.items() if name != owner]):
        gc.collect()
        give_back()


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list[pa.RecordBatch] | None]], schema: str | StructType, owner: str = "") -> DataFrame:
    """mapInArrow where ``make`` builds the per-task function, called on bounded slices of each batch. Tasks of an ``owner`` leave what it keeps in KEPT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(owner)
        do = make()
        for batch in batches:
            for part in slices(batch):
                out = do(part)
                if out is None:
                    continue
                yield from out if isinstance(out, list) else [out]
        del do
        give_back()

    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns, clashing ones too, are pruned from the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def row_key(*columns: str) -> list:
    """k1, k2: 128 bits that tell rows apart by what is in them, null and shared ids included. Rows equal in all of it share a key."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns[::-1]).alias("k2")]


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each row; null gives b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bounded_sample(rows: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """At most n rows of different texts, those whose texts have the least hashes. Only hashes are sorted; no text moves before it is chosen."""
    hashed = rows.withColumn("sample_hash", F.xxhash64(text_col))
    least = hashed.select("sample_hash").distinct().orderBy("sample_hash").limit(n).agg(F.max("sample_hash")).first()[0]  # one number
    return hashed.filter(F.col("sample_hash") <= F.lit(least).cast("long")).dropDuplicates(["sample_hash"]).drop("sample_hash")
