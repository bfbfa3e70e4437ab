"""Blocked Bloom filters as tables: all bits of a key lie in one block of 512 bits, so a probe is one row of one equi-join.

A block is a row of eight 64-bit words, in each of which a key sets one bit. Building takes one row a key and combines
before the shuffle (``bit_or``); duplicates change nothing. Blocks are chosen by hash over all columns of the key, so no
type or source makes a hot one.

Stored filters grow by layers: keys that come in later get a layer of their own, sized by their number, and no earlier
layer is read but for the probe that tells which keys are new. The errors allowed to the layers fall as 1 / n^2 and sum to
the rate asked for, however many there are; a layer costs a probe one more row, so rebuild from the keys where they are
many. Keys can't be taken out: after deletions a filter still holds what is gone, and never misses what isn't.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 0.01
WORDS, WIDTH = 8, 64
SPREAD = 1.06  # three standard errors of the approximate count that sizes a filter


class Filter(NamedTuple):
    """block, w0 to w7; blocks without a bit have no row."""

    rows: DataFrame
    blocks: int


def error(bits: float) -> float:
    """The share of false positives at so many bits a key: keys fall on blocks by Poisson's law."""
    mean = WORDS * WIDTH / bits
    chance, total = math.exp(-mean), 0.0
    for n in range(1, int(mean + 12 * math.sqrt(mean) + 12)):
        chance *= mean / n
        total += chance * (1 - (1 - 1 / WIDTH) ** n) ** WORDS
    return total


def bits_per_key(rate: float) -> float:
    return next(b / 2 for b in range(12, 1025) if error(b / 2) <= rate)


def _block(by: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(blocks))


def _masks(by: list[str]) -> list[Column]:
    """The bit of a key in each word: six bits of a second hash say where."""
    h = F.xxhash64(*by, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(WIDTH - 1)).cast("int")) for i in range(WORDS)]


def build(keys: DataFrame, by: list[str], rate: float = RATE) -> Filter:
    """A filter of the keys; one pass counts them approximately to size it, one sets the bits."""
    n = keys.agg(F.approx_count_distinct(F.xxhash64(*by), 0.02)).first()[0]
    blocks = max(1, math.ceil(n * SPREAD * bits_per_key(rate) / (WORDS * WIDTH)))
    at = keys.select(_block(by, blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(by))])
    return Filter(at.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks)


def probe(probes: DataFrame, layers: list[Filter], by: list[str]) -> DataFrame:
    """The distinct keys of ``probes`` that any layer may hold: all that one holds, and few others."""
    asked = probes.select(*by).dropna().distinct()
    if not layers:
        return asked.limit(0)
    where = [F.struct(F.lit(i).alias("layer"), _block(by, x.blocks).alias("block")) for i, x in enumerate(layers)]
    at = asked.select(*by, F.explode(F.array(*where)).alias("at")).select(*by, "at.*")
    held = reduce(DataFrame.unionByName, [x.rows.withColumn("layer", F.lit(i)) for i, x in enumerate(layers)])
    every = reduce(and_, [F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(by))])
    found = at.join(held, ["layer", "block"]).filter(every).select(*by)
    return found.distinct() if len(layers) > 1 else found


def read_layers(spark: SparkSession, path: str) -> list[Filter]:
    """The whole layers of a stored filter; their names give number and blocks."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(where))
    whole = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    schema = ", ".join(["block long", *[f"w{i} long" for i in range(WORDS)]])
    return [Filter(spark.read.schema(schema).parquet(f"{path}/{n}"), int(n.split("-")[1])) for n in whole]


def add_layer(spark: SparkSession, path: str, keys: DataFrame, by: list[str], rate: float = RATE) -> int:
    """Add the keys that no layer holds yet; gives their number. A batch added again changes nothing; keys with a null are none.

    A key that a layer holds by mistake needs no bits of its own: it is never missed.
    """
    layers, asked = read_layers(spark, path), keys.select(*by).dropna().distinct()
    new = asked if not layers else asked.join(probe(asked, layers, by), by, "left_anti")
    new = new.persist()
    try:
        n = new.count()
        if n:
            made = build(new, by, rate * 6 / math.pi**2 / (len(layers) + 1) ** 2)
            made.rows.write.parquet(f"{path}/{len(layers):06d}-{made.blocks}-{uuid.uuid4().hex}")
        return n
    finally:
        new.unpersist()
