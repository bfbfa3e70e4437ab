"""Removal of long repeated byte strings, by merging the shards' sampled suffix arrays and transforms.

A window of 200 bytes belongs to an anchor: the least 16-gram that starts at or up to 144 bytes after its start, so equal
windows have equal anchors at equal places, and the suffixes at anchors stand for all. Each shard (a portion of a task's
texts) sorts its anchors' suffixes once, by the bytes of their text. Of the sorted suffixes it keeps the common prefixes of
neighbours and, as in a Burrows-Wheeler transform, what stands before each: here the text back to the first window of the
anchor, under a name. Runs of neighbours with a common prefix of at least CORE bytes, which all windows of an anchor hold, are the
shard's intervals, and one row each.

The shards' intervals are merged by refining their interleave, in steps of many symbols: intervals of equal prefix form a
block of the whole corpus; a block of one suffix is done. Where all members of a block agree on the rest of what their
windows cover, before and behind, their windows are repeated intervals, and so they are where some do; one suffix for each
different surrounding goes on, to blocks of runs of 16 windows and then of single windows. No suffix is sorted again, as
deeper blocks are told by names of their bytes: merging counts names. The counts combine before each shuffle, so a
passage in a third of the corpus is no hot spot.

Defined results: null or short text loses nothing; copies of a long enough document lose everything, the first one too;
repeats inside one document count; an empty table gives an empty table; further columns are ignored; rows that
share a doc_id, or have none, are separate texts. A text needs about 40 bytes of memory a byte while its task reads it.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices, texts, utf8
from .hashing import Substrings, U, sliding_min
from .stash import drop, stash

LENGTH, GRAM, REACH = 200, 16, 144
SHARD = 1 << 16  # suffixes sorted together at most
MEMBER = "k1:long,k2:int,at:int,low:short,high:short,known:boolean,hull:long"
INTERVALS = f"core long, members array<struct<{MEMBER}>>"


def anchors(text: Substrings, length: int, gram: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor with windows: its place, and how far before it (least, most) the windows start that belong to it."""
    windows = text.n - length + 1
    place = np.arange(windows + reach - 1)
    low = U(0xFFFFFFFF)  # ties of the upper 32 bits go to the leftmost, so equal text gives equal anchors
    least = (sliding_min((text.of(place, place + gram) & ~low) | place.astype(U), reach)[:windows] & low).astype(np.int64)
    first = np.flatnonzero(np.diff(least, prepend=-1))
    last = np.append(first[1:], windows) - 1
    at = least[first]
    return at, at - last, at - first


def names(text: Substrings, at: np.ndarray, low: np.ndarray, high: np.ndarray, core_low: np.ndarray, core_high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """core: what all windows that start core_low to core_high before an anchor have in common, wherever it stands;
    hull: all that the windows low to high cover, from what stands before the anchor and what follows it."""
    core = text.of(at - core_low, at - core_high + length)
    core = core * U(0x9FB21C651E98DF25) + core_low.astype(U)
    before, behind = text.of(at - high, at), text.of(at, at - low + length)
    hull = (before * U(0x2545F4914F6CDD1D) + high.astype(U)) ^ (behind * U(0xD1342543DE82EF95) + low.astype(U))
    return core, hull


def sorted_suffixes(starts: np.ndarray, room: np.ndarray, texts_: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's suffix array (which suffix comes at each place, by ``length`` bytes) and the common prefix of each with the
    one before it. ``starts`` are places in the shard's joined texts, ``room`` the bytes left in the suffix's own text."""
    heads = np.lib.stride_tricks.sliding_window_view(texts_, length)[starts]
    order = np.argsort(heads.view(f"S{length}").ravel(), kind="stable")
    heads, room = heads[order], np.minimum(room[order], length)
    differs = heads[1:] != heads[:-1]
    prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    return order, np.append(0, np.minimum(prefix, np.minimum(room[1:], room[:-1])))


def as_intervals(first: np.ndarray, core: np.ndarray, members: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each run of members that starts where ``first`` is true."""
    heads = np.flatnonzero(first)
    types = (np.int64, np.int32, np.int32, np.int16, np.int16, bool, np.int64)
    fields = [pa.array(m.view(np.int64) if m.dtype == np.uint64 else m.astype(t)) for m, t in zip(members, types, strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(first)), pa.int32()), pa.StructArray.from_arrays(fields, ["k1", "k2", "at", "low", "high", "known", "hull"]))
    return pa.record_batch([pa.array(core[heads].view(np.int64)), lists], ["core", "members"])


def intervals(docs: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """The intervals of the shards at the depth that all windows of an anchor hold: the bytes from the anchor on."""
    depth = length - reach + 1

    def make():
        def do(batch: pa.RecordBatch):
            parts, joined, base = [], [], 0
            for k1, k2, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                if len(raw) < length:
                    continue
                text = Substrings(raw)
                at, low, high = anchors(text, length, gram, reach)
                zero = np.zeros_like(at)
                core, hull = names(text, at, low, high, zero, zero + reach - 1, length)
                parts.append((np.full(len(at), k1, np.int64), np.full(len(at), k2, np.int32), at, low, high, np.zeros(len(at), bool), hull, core, at + base, len(raw) - at))
                joined += [raw, b"\0" * length]
                base += len(raw) + length
            if not parts:
                return None
            flat = [np.concatenate(x) for x in zip(*parts, strict=True)]
            texts_ = np.frombuffer(b"".join(joined), np.uint8)
            out = []
            for i in range(0, len(flat[0]), SHARD):
                shard = [x[i : i + SHARD] for x in flat]
                order, prefix = sorted_suffixes(shard[8], shard[9], texts_, length)
                out.append(as_intervals(prefix < depth, shard[7][order], [x[order] for x in shard[:7]]))
            return out

        return do

    return map_slices(docs, make, INTERVALS)


def finer(docs: DataFrame, open_rows: DataFrame, step: int, length: int) -> DataFrame:
    """The windows of the open rows again, in runs of ``step``, on a grid counted from the anchor; those of a task that share a core are one row."""
    todo = open_rows.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "low", "high", "known")).alias("todo"))

    def make():
        def do(batch: pa.RecordBatch):
            out = []
            for k1, k2, raw, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3), strict=True):
                items = part.values
                at, low, high = (np.asarray(items.field(k)).astype(np.int64) for k in range(3))
                known = items.field(3).to_numpy(zero_copy_only=False)
                text = Substrings(raw)
                cells = high // step - low // step + 1
                row = np.repeat(np.arange(len(at)), cells)
                cell = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells) + (low // step)[row]
                at, least, most = at[row], cell * step, cell * step + step - 1
                low, high = np.maximum(low[row], least), np.minimum(high[row], most)
                core, hull = names(text, at, low, high, least, most, length)
                out.append((np.full(len(at), k1, np.int64), np.full(len(at), k2, np.int32), at, low, high, known[row], hull, core))
            flat = [np.concatenate(x) for x in zip(*out, strict=True)]
            order = np.argsort(flat[7], kind="stable")
            core = flat[7][order]
            return as_intervals(np.append(True, core[1:] != core[:-1]), core, [x[order] for x in flat[:7]])

        return do

    return map_slices(docs.join(todo, ["k1", "k2"]).select("k1", "k2", "text", "todo"), make, INTERVALS)


WHERE = ("k1", "k2", "at", "low", "high")


def merged(level: DataFrame) -> DataFrame:
    """The members of blocks of more than one suffix; ``settled`` where all of a block agree on the hull, and core and hull where they don't."""
    blocks = level.groupBy("core").agg(F.sum(F.size("members")).alias("n"), F.min(F.array_min("members.hull")).alias("a"), F.max(F.array_max("members.hull")).alias("b")).filter("n > 1")
    blocks = stash(blocks.select("core", (F.col("a") == F.col("b")).alias("settled")))  # so that both sides of the join are dealt anew and Spark can split a core that very many rows share
    members = level.join(blocks, "core").select("core", "settled", F.explode("members").alias("m")).select("core", "settled", "m.*")
    rows = stash(members.select(*WHERE, "known", "settled", *[F.when(~F.col("settled"), F.col(c)).alias(c) for c in ("core", "hull")]))
    drop(blocks)
    return rows


def by_hull(rows: DataFrame) -> DataFrame:
    """One row for each different hull of an open block: its core and hull, the member that goes on, and whether its windows are known to be repeated."""
    one = rows.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(F.struct(*WHERE, "known")).alias("m"))
    return stash(one.select("core", "hull", *[F.col(f"m.{c}").alias(c) for c in WHERE], ((F.col("n") > 1) | F.col("m.known")).alias("known"), (F.col("n") > 1).alias("again")))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, reach: int = REACH, steps: tuple[int, ...] = (16, 1)) -> DataFrame:
    """k1, k2, at, low, high: the windows that start ``low`` to ``high`` bytes before ``at`` are found elsewhere too.

    ``docs`` has text and the row's key, k1 and k2. reach + gram may not exceed length, so that a window alone decides on its anchor.
    """
    if reach + gram > length:
        raise ValueError("reach + gram must not exceed length")
    level, found, used = intervals(docs, length, gram, reach), [], []
    for step in (*steps, None):
        level = stash(level)
        block_rows = merged(level)
        drop(level)
        used.append(block_rows)
        found.append(block_rows.filter("settled and not known").select(*WHERE))
        if step:
            open_rows = block_rows.filter("not settled")
            hulls = by_hull(open_rows)
            used.append(hulls)
            again = hulls.filter("again").select("core", "hull")
            found.append(open_rows.filter("not known").join(again, ["core", "hull"]).select(*WHERE))
            level = finer(docs, hulls, step, length)
    out = stash(reduce(DataFrame.unionByName, found))
    for table in used:
        drop(table)
    return out


def without(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """What is left when the spans go, the bytes removed, and the number of maximal runs."""
    change = np.zeros(len(raw) + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, **how) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep`` also the bytes kept."""
    docs = texts(docs, id_col, text_col).select(F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"), "doc_id", "text")  # 96 bits
    windows = repeated_windows(docs.select("k1", "k2", "text"), length, **how)
    spans = windows.groupBy("k1", "k2").agg(F.collect_set(F.struct((F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end"))).alias("spans"))

    def make():
        sha = hashlib.sha256

        def do(batch: pa.RecordBatch):
            out = []
            for raw, part in zip(utf8(batch.column(1)), batch.column(2), strict=True):
                left, removed, runs = raw, 0, 0
                if part.is_valid:
                    start, end = (np.asarray(part.values.field(k)).astype(np.int64) for k in range(2))
                    left, removed, runs = without(raw, start, end)
                out.append((len(raw), removed, runs, sha(left).hexdigest(), left))
            columns = list(zip(*out, strict=True))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            fields = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep:
                arrays.append(pa.array(columns[4], pa.binary()))
                fields.append("kept")
            return pa.record_batch(arrays, fields)

        return do

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    return map_slices(docs.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans"), make, schema)
