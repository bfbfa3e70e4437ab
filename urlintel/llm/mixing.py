"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target, a number of words; a document's expected copies are its source's target over its source's
size. The whole copies are given; the rest is a probability, held as a mass of words between none and the document's
size, in units of 1 / UNIT word. Two documents meet and mass goes from one to the other, in a direction drawn so that both
keep their expectation, until one of them is in or out; the other goes on to the next. The mass of a source thus stays as
it is, to the last document, which alone is rounded. So a source misses its target by half of one document at most,
but for a unit a document.

The meetings form a tree: a source's documents are dealt by hash to groups of about GROUP, the one left of each to groups
of groups, and so on. Draws are hashes of the two documents, so that a rerun agrees however its tasks are cut.

Defined results: null or wordless texts have size 0 and take nothing; a null source comes last; rows equal in doc_id,
source and text are rounded as one row a number of times, so their number is no hot spot; rows that share a doc_id or have
none are documents of their own; with no words at all every target is 0; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stash import stash

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
UNIT_BITS = 20
GROUP_BITS = 10
CHUNK = 4096  # equal rows that are given back at once


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, none, size, h, n: the documents by what is in them, and how many rows are just so. No text moves."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")).cast("long")
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("none"), size.alias("size"), F.xxhash64(F.col(id_col), source, text).alias("h"))
    return rows.groupBy("doc_id", "source", "none", "size", "h").agg(F.count("*").alias("n"))


def placed(sources: DataFrame) -> DataFrame:
    """Add place, a source's number in the order of code points, null last, from 0. Spark sorts by ranges; ranges are counted, then joined."""
    order = ["none", "source"]
    ranged = stash(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"range": F.spark_partition_id(), "i": F.monotonically_increasing_id() % F.lit(1 << 33)}))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranged.groupBy("range").agg(F.count("*").alias("c")).select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    return ranged.join(ranges, "range").withColumn("place", F.col("before") + F.col("i")).drop("range", "i", "before")


def water_level(sources: DataFrame, share: float, most: int) -> tuple[float, float]:
    """The words a unit of weight gets. Every round those that it takes to their most leave the rest to the others; a round is one sum over the sources."""
    level, full = -1.0, -1
    while True:
        held = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        s = sources.agg(F.sum("source_size").alias("size"), F.sum(F.when(held, F.col("source_size") * most)).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("weight"), F.count_if(held).alias("full")).first()
        if not s["size"] or not s["weight"] or s["full"] == full:
            return level
        level, full = (share * s["size"] - (s["held"] or 0)) / s["weight"], s["full"]


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, none, source_size, rows, target of every source. ``docs`` is as ``sized`` gives it."""
    by = docs.groupBy("source", "none").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("rows"))
    weighed = stash(placed(by).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))))
    level = water_level(weighed, share, most)
    return weighed.select("source", "none", "source_size", "rows", F.least(F.col("source_size") * F.lit(float(most)), F.greatest(F.lit(level), F.lit(0.0)) * F.col("weight")).alias("target"))


def draw(a: int, b: int, whole: int) -> int:
    """A number below ``whole`` that is told by the two documents that meet."""
    return int.from_bytes(hashlib.blake2b(a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True), digest_size=16).digest(), "little") * whole >> 128


def meet(a: list, b: list) -> tuple[list, list]:
    """Move mass between two documents [.., h, most, mass] until one has none or its most; that one, and the one that goes on."""
    (h, c, m), (h2, c2, m2) = a[-3:], b[-3:]
    up, down = min(c - m, m2), min(m, c2 - m2)  # what a can get, and give
    move = up if draw(h, h2, up + down) < down else -down  # so a's expectation stays: up with down / (up + down)
    a[-1], b[-1] = m + move, m2 - move
    return (a, b) if a[-1] in (0, c) else (b, a)


FIELDS = ("source", "none", "group", "doc_id", "size", "n", "base", "whole", "source_size", "target", "bits", "h", "most", "mass")


def met(rows: DataFrame) -> DataFrame:
    """One level of the tree: the rows of a source and group meet one after another. ``open`` tells the one that goes on, if any."""
    group = F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(h, 64 - bits)")).otherwise(F.lit(0).cast("long"))
    key = ["source", "none", "group"]
    dealt = rows.withColumn("group", group).repartition(*key).sortWithinPartitions(*key, "h", "doc_id", "most", "n").select(*FIELDS)
    kinds = dict(dealt.dtypes)

    def run(batches):
        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([*(pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*types, pa.bool_()], strict=True))], [*FIELDS, "open"])

        spare, now, types = None, None, []
        for batch in batches:
            types, out = batch.schema.types, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    if spare is not None:
                        out.append((*spare, True))
                    spare, now = list(row), row[:3]
                    continue
                if spare is None:
                    spare = list(row)
                    continue
                done, spare = meet(spare, list(row))
                out.append((*done, False))
                if spare[-1] in (0, spare[-2]):
                    out.append((*spare, False))
                    spare = None
            if out:
                yield table(out)
        if spare is not None:
            yield table([(*spare, True)])

    return dealt.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in FIELDS) + ", open boolean")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    narrow = stash(sized(docs, id_col, text_col, source_col))
    by = stash(targets(narrow, weights, share, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    bits = F.greatest(F.lit(0), F.ceil(F.log2("rows")).cast("int") - GROUP_BITS)
    rows = narrow.join(by.withColumns({"ratio": ratio, "bits": bits}), ["source", "none"])
    limit, mass = F.shiftleft("size", UNIT_BITS), F.floor((F.col("ratio") - F.floor("ratio")) * F.col("size") * (1 << UNIT_BITS)).cast("long")
    rows = rows.withColumns({"base": F.floor("ratio").cast("int"), "most": limit, "each": mass, "group": F.lit(0).cast("long")})
    together = F.col("each").cast("decimal(38,0)") * F.col("n")  # of equal rows: some are in, one is open
    rows = rows.withColumns({"whole": F.when(F.col("most") > 0, F.call_function("div", together, F.col("most").cast("decimal(19,0)"))).otherwise(F.lit(0)).cast("long"), "mass": F.when(F.col("most") > 0, together % F.col("most").cast("decimal(19,0)")).otherwise(F.lit(0)).cast("long")})
    rows = rows.select(*FIELDS)
    fresh, done = rows.filter("mass > 0"), [rows.filter("mass = 0")]
    levels = 1 + -(-(by.agg(F.max(bits)).first()[0] or 0) // GROUP_BITS)
    for _ in range(levels):
        written = stash(met(fresh))
        done.append(written.filter("not open").select(*FIELDS))
        fresh = written.filter("open").select(*FIELDS).withColumn("bits", F.greatest(F.lit(0), F.col("bits") - GROUP_BITS))
    done.append(fresh.withColumn("mass", F.when(2 * F.col("mass") >= F.col("most"), F.col("most")).otherwise(F.lit(0))))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    up = F.col("whole") + (F.col("mass") > 0).cast("long")  # so many of the equal rows get a copy more
    runs = every.withColumn("up", up).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    single = runs.withColumn("i", F.explode(F.sequence("from", F.least(F.col("n"), F.col("from") + CHUNK) - 1)))
    return single.select("doc_id", "size", "source_size", "target", ((F.col("base") + (F.col("i") < F.col("up")).cast("long")) * F.col("size")).alias("taken"))
