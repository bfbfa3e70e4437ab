"""Benchmark decontamination by winnowing.

Of every run of ``window - gram + 1`` consecutive word k-grams the least hash is a fingerprint, so a span of ``window``
words that a document shares with a benchmark item always holds a shared fingerprint. Documents are read once: a
document's fingerprints that the items may have are extended to the windows around them, and these windows are joined
with the items' on both their hash and their fingerprint, 128 bits in all. Items shorter than a window are windows of
their own length, with fingerprints to match.

What an item may have is told by a Bloom filter of a fixed size, whatever the number of items, which only thins what is
joined. Nothing else goes through the driver; texts are never shuffled.

Defined results: null or wordless texts have no words; an item without words has no window; equal windows of several
items hit all of them; empty tables give no hits; further columns are ignored; rows that share a doc_id, or have none,
stay separate documents; rows that share an item_id are one item, as are those without one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices, row_key, utf8
from .hashing import ALNUM, U, grams, mix, sliding_min, words
from .stash import stash

WINDOW, GRAM = 10, 5
FILTER_BITS = 1 << 26  # of the filter over the items' fingerprints: 8 MB


def fingerprints(g: np.ndarray, width: int) -> np.ndarray:
    """Places of the winnowed k-grams: of every ``width`` consecutive ones the least by its upper 32 bits, leftmost."""
    if len(g) < width:
        return np.zeros(0, np.int64)
    if width == 1:
        return np.arange(len(g))
    low = U(0xFFFFFFFF)
    return np.unique((sliding_min((g & ~low) | np.arange(len(g), dtype=U), width) & low).astype(np.int64))


def item_windows(benchmark: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """size, whole (the window's hash), print (the fingerprint that every copy of it holds), item_id."""

    def make():
        def do(batch: pa.RecordBatch):
            rows = []
            for item, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                h = words(raw, ALNUM)
                if not len(h):
                    continue
                size = min(window, len(h))
                whole, g = grams(h, size), grams(h, min(size, gram))
                for at in range(len(whole)):
                    own = g[at : at + size - min(size, gram) + 1]
                    rows.append((size, whole[at], own[np.argmin(own >> U(32))], item))
            if not rows:
                return None
            size, whole, prints, item = zip(*rows, strict=True)
            return pa.record_batch([pa.array(size, pa.int32()), pa.array(np.array(whole, U).view(np.int64)), pa.array(np.array(prints, U).view(np.int64)), pa.array(item, pa.string())], ["size", "whole", "print", "item_id"])

        return do

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(items, make, "size int, whole long, print long, item_id string").distinct()


def places(prints: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Three bits of the filter for each fingerprint of windows of ``size`` words."""
    h = mix(prints ^ U(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.stack([(h >> U(k)) % U(bits) for k in (0, 18, 36)]).astype(np.int64)


def print_filter(items: DataFrame, size_in_bits: int) -> np.ndarray:
    """The packed filter over (size, print); so many bits at most come to the driver."""

    def run(batches):
        seen = np.zeros(size_in_bits, bool)
        for batch in batches:
            size, prints = (batch.column(k).to_numpy() for k in range(2))
            for n in np.unique(size).tolist():
                seen[places(prints[size == n].view(np.uint64), n, size_in_bits).ravel()] = True
        bits = np.packbits(seen).view("<i8")
        filled = np.flatnonzero(bits)
        yield pa.record_batch([pa.array(filled, pa.int64()), pa.array(bits[filled], pa.int64())], ["word", "bits"])

    rows = items.select("size", "print").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(size_in_bits // 64, "<i8")
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits.view(np.uint8)


def near(h: np.ndarray, shapes: list[int], known: np.ndarray, gram: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """size, starts, hashes and fingerprints of a document's windows around the fingerprints that the filter passes."""
    out = []
    for size in shapes:
        if len(h) < size:
            continue
        k = min(size, gram)
        g = grams(h, k)
        width = size - k + 1
        at = fingerprints(g, width)
        bits = places(g[at], size, 8 * len(known))
        at = at[((known[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).all(axis=0)]
        if not len(at):
            continue
        starts = np.unique((at[:, None] - np.arange(width)).ravel())  # extend each hit to the windows around it
        starts = starts[(starts >= 0) & (starts <= len(h) - size)]
        first = np.argmin(g[starts[:, None] + np.arange(width)] >> U(32), axis=1)
        out.append((size, starts, grams(h, size)[starts], g[starts + first]))
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """``contamination``, and the row's key (k1, k2)."""
    items = stash(item_windows(benchmark, window, gram, item_col, item_text_col))
    shapes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``window`` values
    sent = docs.sparkSession.sparkContext.broadcast(print_filter(items, filter_bits))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(*row_key("doc_id", "text"), "doc_id", "text")

    def make():
        known = sent.value

        def do(batch: pa.RecordBatch):
            n_words, lists = [], []
            for raw in utf8(batch.column(3)):
                h = words(raw, ALNUM)
                n_words.append(len(h))
                lists.append(near(h, shapes, known, gram))
            each = np.array([sum(len(s) for _, s, _, _ in found) for found in lists])
            ends = pa.array(np.append(0, np.cumsum(each)), pa.int32())
            flat = [part for found in lists for part in found]
            column = lambda k, t: np.concatenate([p[k] for p in flat]).astype(t) if flat else np.zeros(0, t)
            size = np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in flat]) if flat else np.zeros(0, np.int32)
            windows = pa.StructArray.from_arrays([pa.array(size), pa.array(column(1, np.int32)), pa.array(column(2, U).view(np.int64)), pa.array(column(3, U).view(np.int64))], ["size", "start", "whole", "print"])
            return pa.record_batch([*batch.columns[:3], pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(ends, windows)], ["k1", "k2", "doc_id", "n_words", "windows"])

        return do

    read = stash(map_slices(keyed, make, "k1 long, k2 long, doc_id long, n_words long, windows array<struct<size:int,start:int,whole:long,print:long>>"))
    asked = read.filter(F.size("windows") > 0).select("k1", "k2", F.explode("windows").alias("w")).select("k1", "k2", "w.*").distinct()
    hit = asked.join(items, ["size", "whole", "print"])
    # A document's windows and items are no more than it has words, and than there are items.
    found = stash(hit.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")))
    end = lambda s: s["start"] + s["size"]
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), end(s) - F.greatest(a["upto"], s["start"]))).alias("n"), F.greatest(a["upto"], end(s)).alias("upto")))
    counted = found.select("k1", "k2", covered["n"].cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    joined = read.select("k1", "k2", "doc_id", "n_words").join(counted, ["k1", "k2"], "left")
    none = F.sha2(F.lit(""), 256)
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "k1", "k2")


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return report(docs, benchmark, **how).drop("k1", "k2")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without a hit word, with all their columns. Only the keys of the others are joined with the texts."""
    bad = stash(report(docs, benchmark, id_col=id_col, text_col=text_col, **how).filter("contaminated").select("k1", "k2").distinct())
    k1, k2 = row_key("_doc", "_text")
    keyed = docs.withColumns({"_doc": F.col(id_col).cast("long"), "_text": F.col(text_col).cast("string")}).withColumns({"k1": k1, "k2": k2})
    return keyed.join(bad, ["k1", "k2"], "left_anti").select(*docs.columns)
