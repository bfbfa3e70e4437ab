"""Phrase collocation mining by top-order marginalisation.

Only the longest windows are counted: each word with the up to four that follow it in its piece, as columns w1 to w5,
padded with empty words. One Spark ROLLUP over (lang, w1 .. w5) then sums successively shorter prefixes, which gives the
frequency of every phrase of one to five words, and each language's number of words, without counting any order by itself.

A window is padded not only at the end of its piece but from where its prefix can no longer be frequent. That is told by
a summary of fixed size, in which each prefix of every window adds to the count of one of ``buckets`` places for its
length: a place below the threshold holds no frequent phrase. The summary saves work only; where it is full, windows
are simply longer. Its bits (a threshold reached or not), BUCKETS / 8 bytes a length, are all that goes through the driver.

Words are told apart by 64-bit hashes inside a task, while windows are counted there; from then on they are strings. A
task counts all of its rows before it sends a window, and tasks are as few as keep all cores busy, so that the windows
sent are at most tasks times phrases that pass the summary, or past a bound on memory one a word.

Defined results: null or empty texts have no words; a null language is ``und``; repeated rows each count; an empty table
gives an empty table; ties in score go by frequency and then by the phrase in UTF-8 byte order; further columns are
ignored; texts of any length and words of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import give_back, slices, take_over, utf8
from .hashing import LOWER, U, mix, word_spans
from .stash import stash

LONGEST, LEAST, FIRST = 5, 100, 2000
BUCKETS, BLOCK = 1 << 23, 1 << 15  # places of the summary for each length, and those that travel as one row
RUN = 1 << 20  # words that are counted at once
HELD, HELD_BYTES = 1 << 19, 64 << 20  # windows that a task holds before it sends them, and bytes of their words
PIECE = 16 << 20  # bytes of windows that leave a task at once
JOINED = 32  # partitions of the table that one task reads at most
STEP = 60_000  # windows between two looks at counts of 16 bits
SALTS = 64  # parts of a language that are ranked apart before they are ranked together
WORD = np.ones(256, bool)
WORD[list(b" \t.,;:!?\n\x0b\x0c\r")] = False
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True


class Runs:
    """The words of a slice of texts in runs of bounded size: hashes of all prefixes of each word's window."""

    def __init__(self, langs: list[str | None], texts: list[bytes], longest: int):
        self.longest = longest
        self.langs = ["und" if x is None else x for x in langs]
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts])  # one past the break that follows each text
        self.start, self.stop, self.hash = word_spans(self.data, WORD)
        breaks = np.flatnonzero(BREAK[self.data])
        piece = np.searchsorted(breaks, self.start)
        self.left = np.zeros(len(piece), np.int8)  # words of the window that start at each word, less one
        for j in range(1, min(longest, len(piece))):
            self.left[: len(piece) - j] += piece[j:] == piece[: len(piece) - j]
        codes = {x: U(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(self.langs)}
        self.names = sorted(codes)
        place = {x: i for i, x in enumerate(self.names)}
        text = np.searchsorted(self.ends, self.start, side="right")
        self.lang = np.array([place[x] for x in self.langs], np.int32)[text] if len(texts) else np.zeros(0, np.int32)
        self.seed = np.array([codes[x] for x in self.names], U)

    def __iter__(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """first word, one past the last, and for each length the hash of the window's prefix of so many words."""
        for at in range(0, len(self.start), RUN):
            end = min(at + RUN, len(self.start))
            h, out = mix(self.seed[self.lang[at:end]]), []
            for j in range(self.longest):
                own = np.zeros(end - at, U)
                n = max(0, min(end + j, len(self.start)) - (at + j))
                own[:n] = self.hash[at + j : at + j + n]
                h = mix(h * U(0x9E3779B97F4A7C15) + own)
                out.append(h)
            yield at, end, out


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> U(20)).astype(np.int64) & (buckets - 1)


def packed(counts: np.ndarray) -> bytes:
    """Counts of a block of places, 255 at most: all of them, or where few are filled their places and counts."""
    some = np.flatnonzero(counts)
    if 3 * len(some) < len(counts):
        return b"s" + some.astype("<u2").tobytes() + np.minimum(counts[some], 255).astype(np.uint8).tobytes()
    return b"d" + np.minimum(counts, 255).astype(np.uint8).tobytes()


def add_packed(to: np.ndarray, raw: bytes) -> None:
    if raw[:1] == b"d":
        to += np.frombuffer(raw, np.uint8, offset=1)
    else:
        n = (len(raw) - 1) // 3
        to[np.frombuffer(raw, "<u2", n, 1)] += np.frombuffer(raw, np.uint8, n, 1 + 2 * n)


def summary(docs: DataFrame, longest: int, least: int, buckets: int) -> np.ndarray:
    """For each length the packed bits of the places that reach the threshold.

    A task counts its own rows and sends its counts by blocks; another adds up the counts of a block as they come.
    """
    block = min(BLOCK, buckets)

    def count(batches):
        seen = np.zeros((longest, buckets), np.uint16)
        for batch in batches:
            for part in slices(batch):
                runs = Runs(part.column(0).to_pylist(), utf8(part.column(1)), longest)
                for at, end, prefixes in runs:
                    for j, h in enumerate(prefixes):
                        b = bucket(h[runs.left[at:end] >= j], buckets)
                        for own in np.array_split(b, len(b) // STEP + 1):
                            np.add.at(seen[j], own, 1)
                            seen[j][own] = np.minimum(seen[j][own], 255)
        ids, rows = [], []
        for i, counts in enumerate(seen.reshape(-1, block)):
            if counts.any():
                ids.append(i)
                rows.append(packed(counts))
            if len(rows) == 64:
                yield pa.record_batch([pa.array(ids, pa.int32()), pa.array(rows, pa.binary())], ["block", "counts"])
                ids, rows = [], []
        yield pa.record_batch([pa.array(ids, pa.int32()), pa.array(rows, pa.binary())], ["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = sums.setdefault(i, np.zeros(block, np.uint16))
                add_packed(to, raw)
                np.minimum(to, 255, out=to)
        bits = [np.packbits(s >= min(least, 255)).tobytes() for s in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["block", "bits"])

    rows = docs.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, bits binary").collect()
    out = np.zeros((longest * buckets // block, block // 8), np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(longest, buckets // 8)


class Held:
    """The padded windows that a task has met, each once with its count. Texts are kept of their words only.

    What is held is bounded: when ``full``, it is given out and counting starts afresh.
    """

    def __init__(self, longest: int):
        self.longest = longest
        self.langs: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.key, self.n = np.zeros(0, U), np.zeros(0, np.int64)
        self.lang, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.words = np.zeros((0, self.longest), np.int32)  # one more than the place in texts, 0 where padded
        self.known, self.place, self.texts = np.zeros(0, U), np.zeros(0, np.int32), []  # hashes of words in order, and where each is in texts

    def full(self) -> bool:
        return len(self.key) >= HELD or int(self.bytes.sum()) >= HELD_BYTES

    def add(self, runs: Runs, first: np.ndarray, size: np.ndarray, key: np.ndarray, n: np.ndarray) -> None:
        """Windows by first word and length; keys are in order and different."""
        hit, at = among(self.key, key)
        self.n[at[hit]] += n[hit]
        first, size, key, n = first[~hit], size[~hit], key[~hit], n[~hit]
        inside = [np.flatnonzero(size > j) for j in range(self.longest)]
        low, high = (int(first.min()), int(first.max()) + self.longest) if len(first) else (0, 0)
        used = np.zeros(high - low, bool)
        for j, own in enumerate(inside):
            used[first[own] + j - low] = True
        met = np.flatnonzero(used) + low
        hashes, one, back = np.unique(runs.hash[met], return_index=True, return_inverse=True)
        fresh = ~among(self.known, hashes)[0]
        spans = met[one[fresh]]
        known = np.concatenate([self.known, hashes[fresh]])
        place = np.concatenate([self.place, np.arange(len(self.texts), len(self.texts) + len(spans), dtype=np.int32)])
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], place[order]
        self.texts += [LOWER[runs.data[s:e]].tobytes() for s, e in zip(runs.start[spans].tolist(), runs.stop[spans].tolist(), strict=True)]
        word = np.zeros(high - low, np.int32)
        word[met - low] = self.place[among(self.known, hashes)[1]][back] + 1
        words, length = np.zeros((len(key), self.longest), np.int32), np.zeros(len(key), np.int64)
        for j, own in enumerate(inside):
            words[own, j] = word[first[own] + j - low]
            length[own] += runs.stop[first[own] + j] - runs.start[first[own] + j]
        codes = np.array([self.langs.setdefault(x, len(self.langs)) for x in runs.names], np.int32)
        order = np.argsort(np.concatenate([self.key, key]), kind="stable")
        both = lambda old, own: np.concatenate([old, own])[order]
        self.lang, self.bytes = both(self.lang, codes[runs.lang[first]]), both(self.bytes, length)
        self.key, self.n, self.words = both(self.key, key), both(self.n, n), both(self.words, words)

    def give(self) -> Iterator[pa.RecordBatch]:
        """All windows, in batches of bounded size."""
        names = ["lang", *(f"w{j + 1}" for j in range(self.longest)), "c"]
        part = np.cumsum(self.bytes + PIECE // 65_536) // PIECE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        texts, langs = pa.array([b"", *self.texts], pa.binary()).view(pa.string()), pa.array(list(self.langs), pa.string())
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                columns = [texts.take(pa.array(self.words[a:b, j])) for j in range(self.longest)]
                yield pa.record_batch([langs.take(pa.array(self.lang[a:b])), *columns, pa.array(self.n[a:b])], names)
        self.clear()


def among(have: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes asked for are among those at hand, which are in order, and where."""
    if not len(have):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
    return have[at] == asked, at


def windows(docs: DataFrame, longest: int, least: int, buckets: int) -> DataFrame:
    """lang, w1 .. w<longest>, c: the padded longest windows, counted within a task."""
    sent = docs.sparkSession.sparkContext.broadcast(summary(docs, longest, least, buckets))
    names = [f"w{j + 1}" for j in range(longest)]

    def count(batches):
        take_over()
        known, held = sent.value, Held(longest)
        for batch in batches:
            for part in slices(batch):
                runs = Runs(part.column(0).to_pylist(), utf8(part.column(1)), longest)
                for at, end, prefixes in runs:
                    size, top = np.zeros(end - at, np.int8), mix(runs.seed[runs.lang[at:end]])  # a window without words counts for its language
                    passed = np.ones(end - at, bool)
                    for j, h in enumerate(prefixes):
                        b = bucket(h, len(known[j]) * 8)
                        passed = passed & (runs.left[at:end] >= j) & ((known[j][b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).astype(bool)
                        size[passed] = j + 1
                        top = np.where(passed, h, top)
                    key, first, n = np.unique(mix(top + size.astype(U)), return_index=True, return_counts=True)
                    held.add(runs, first + at, size[first], key, n)
                    if held.full():
                        yield from held.give()
        yield from held.give()
        del held
        give_back()

    return docs.mapInArrow(count, ", ".join(["lang string", *(f"{w} string" for w in names), "c long"]))


def together(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows in as many partitions as there are cores (or ``tasks``), but no more than JOINED of the table's to one.

    Each task sends what it has counted once, however many rows it read, so that more tasks than can run at a time only
    make more partial counts of the same phrases.
    """
    if tasks is None:
        tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // JOINED))
    return rows.coalesce(tasks)


def frequencies(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, buckets: int = BUCKETS, lang_col: str = "lang", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """lang, k, phrase, f: every phrase of 1 to ``longest`` words that comes ``least`` times in a language; for k = 0 the language's words."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    names = [f"w{j + 1}" for j in range(longest)]
    rolled = windows(together(rows, tasks), longest, least, buckets).rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    k = F.lit(longest) - F.bit_count("g")  # the columns that the ROLLUP left out are bits
    padded = F.element_at(F.array(F.lit("-"), *names), (k + 1).cast("int")) == ""
    real = rolled.filter((k >= 0) & ~padded)  # of grouping columns alone, so that padded prefixes go before they are summed
    kept = real.filter((k == 0) | (F.col("f") >= least))
    return kept.select("lang", k.cast("int").alias("k"), F.concat_ws(" ", *names).alias("phrase"), "f")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no longer one takes the place of. ``found`` is written.

    Each phrase meets the parts of its cuts once. A part one word shorter than the phrase and no more frequent is
    dropped; longer phrases need no look, as those between are at least as frequent.
    """
    exact = lambda *c: F.col(c[0]).cast("decimal(19,0)") if len(c) == 1 else exact(c[0]) * exact(c[1])
    many = found.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    piece = lambda cut, side: F.struct(cut.alias("cut"), F.lit(side).alias("side"), F.array_join(F.slice("w", F.lit(1), cut) if side == "l" else F.slice("w", cut + 1, F.col("k") - cut), " ").alias("part"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda cut: F.array(piece(cut, "l"), piece(cut, "r"))))
    parts = many.select("lang", "k", "phrase", "a", F.explode(cuts).alias("p")).select("lang", "k", "phrase", "a", "p.*")
    met = parts.join(found.filter("k > 0").select("lang", F.col("phrase").alias("part"), F.col("k").alias("part_k"), "f"), ["lang", "part"])
    own = F.struct(F.col("phrase"), F.lit(False).alias("gone"), "a", "cut", "side", "f")
    loses = (F.col("part_k") == F.col("k") - 1) & (F.col("part_k") > 1) & (F.col("a") >= F.col("f"))
    none = F.lit(None)
    other = F.when(loses, F.struct(F.col("part").alias("phrase"), F.lit(True).alias("gone"), none.cast("long").alias("a"), none.cast("int").alias("cut"), none.cast("string").alias("side"), none.cast("long").alias("f")))
    said = met.select("lang", F.explode(F.array_compact(F.array(own, other))).alias("s")).select("lang", "s.*")
    longest = LONGEST - 1
    of = lambda side, cut: F.max(F.when((F.col("side") == side) & (F.col("cut") == cut), F.col("f"))).alias(f"{side}{cut}")
    whole = said.groupBy("lang", "phrase").agg(F.max("gone").alias("gone"), F.max("a").alias("a"), *[of(s, c) for c in range(1, longest + 1) for s in "lr"]).filter("not gone")
    with_n = whole.join(found.filter("k = 0").select("lang", F.col("f").alias("n")), "lang")
    top = F.lit(1000).cast("decimal(4,0)") * exact("a", "n")
    score = lambda c: F.when(F.col(f"l{c}").isNotNull(), F.struct(F.call_function("div", top, exact(f"l{c}", f"r{c}")).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")))
    best = F.array_min(F.array_compact(F.array(*[score(c) for c in range(1, longest + 1)])))
    return with_n.select("lang", "phrase", "a", "n", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, buckets: int = BUCKETS, lang_col: str = "lang", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of every language.

    A language is ranked in parts first, so that what meets in one task for it is no more than SALTS times ``first`` rows.
    """
    found = stash(frequencies(docs, LONGEST, least, buckets, lang_col, text_col, tasks))
    every = scored(found)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    near = every.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
