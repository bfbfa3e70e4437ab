"""N-gram Jaccard join: which documents share at least ``threshold`` percent of their word shingles.

Documents with equal shingle sets form a class, of which one member goes on. Shingles are put in one order for the
whole corpus, rare ones first: a bounded summary of the most frequent shingles comes last, the rest by hash. Two sets
that reach the threshold must then share a shingle within their prefixes. The prefixes are joined on the shingle in two
steps that together reach every link without listing all pairs of a group: first each member with the least member of
its shingle's bucket; then, for buckets whose members are not yet connected, the pairs between different components.
Length, positional, count and suffix filters thin the candidates, and each pair left is verified once on the whole sets.

Defined results: null or wordless texts are linked with nothing and are their own component; texts of fewer words than
a shingle count as one; equal sets are linked; an empty table gives an empty table; further columns are ignored; rows
that share a doc_id keep their own sets and are linked with each other, whatever the order of the rows; rows without a
doc_id are counted, linked with nothing and have no component.

A class is known by the least doc_id of its members; where rows that share a doc_id would give two classes one name,
these have a name of their own (below zero), made from the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import give_back, map_slices, slices, take_over, texts, utf8
from .components import components
from .hashing import VISIBLE, U, grams, mix, words
from .stash import drop, stash

WORDS, THRESHOLD = 5, 80
FREQUENT = 1 << 18  # size of the summary that orders frequent shingles last; it bounds what is sent to every task
LOCAL, COUNTED = 3, 6_000_000  # a shingle enters the summary where so many documents among so many shingles have it
CELLS = 256  # of the suffix filter
FILTER_BITS = 1 << 23  # of the filter that picks the documents to verify
PACK = 512  # members of a list that are counted together


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    hashes = words(raw, VISIBLE)
    if 0 < len(hashes) < k:
        return grams(hashes, len(hashes))
    return np.unique(grams(hashes, k))


def name_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set."""
    return (int(np.add.reduce(mix(s)).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + U(77))).view(np.int64))) if len(s) else (0, 0)


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most documents have, sorted by hash, and their counts: at most FREQUENT."""

    def run(batches):
        take_over()
        sets, size = [], 0
        for batch in batches:
            for part in slices(batch):
                for raw in utf8(part.column(1)):
                    sets.append(shingle_set(raw, k))
                    size += len(sets[-1])
                if size >= COUNTED:
                    yield often(sets)
                    sets, size = [], 0
        if sets:
            yield often(sets)
        sets = None
        give_back()

    def often(sets):
        every = np.concatenate(sets)
        sets.clear()  # and sorted in place, so that the shingles stand here once
        every.sort()
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(every)))
        got, n = every[first[n >= LOCAL]], n[n >= LOCAL]
        return pa.record_batch([pa.array(got.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    top = docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT)
    found = top.toPandas()
    h, n = found["h"].to_numpy(np.int64).view(U), found["n"].to_numpy(np.int64)
    by = np.argsort(h)
    return h[by], n[by]


def rare_first(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    rank = np.zeros(len(shingles), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))]


def needed(n: np.ndarray | int, threshold: int):
    """The least overlap with any set, for a set of n that reaches the threshold."""
    return -(-n * threshold // 100)


def profiles(docs: DataFrame, k: int, threshold: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, n, the set's 128-bit name and its prefix in rare-first order."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, counts))

    def make():
        order, count = sent.value

        def do(batch: pa.RecordBatch):
            n, left, right, prefix = [], [], [], []
            for raw in utf8(batch.column(1)):
                s = shingle_set(raw, k)
                n.append(len(s))
                a, b = name_of(s)
                left.append(a)
                right.append(b)
                prefix.append(rare_first(s, order, count)[: len(s) - needed(len(s), threshold) + 1].view(np.int64) if len(s) else s.view(np.int64))
            ends = np.cumsum([0] + [len(p) for p in prefix]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))
            return pa.record_batch([batch.column(0), pa.array(n, pa.int32()), pa.array(left, pa.int64()), pa.array(right, pa.int64()), lists], ["doc_id", "n", "left", "right", "prefix"])

        return do

    return map_slices(docs, make, "doc_id long, n int, left long, right long, prefix array<long>")


def plausible(threshold: int):
    """Length and positional filters on (n, i) and (m, j): sizes, and places of a shared shingle in the two prefixes."""
    n, m, i, j = (F.col(c).cast("long") for c in ("n", "m", "i", "j"))
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    return (F.least(n, m) * 100 >= threshold * F.greatest(n, m)) & ((100 + threshold) * most >= threshold * (n + m))


def enough(threshold: int):
    """Count filter: c shingles shared in the prefixes, of which the one that ends first is compared whole."""
    n, m = F.col("n").cast("long"), F.col("m").cast("long")
    rest = F.greatest(F.ceil(n * threshold / 100), F.ceil(m * threshold / 100)) - 1
    return (100 + threshold) * (F.col("c") + rest) >= threshold * (n + m)


def places(ids: np.ndarray) -> np.ndarray:
    """Three bits of the filter for each id."""
    h = mix(ids.astype(np.int64).view(U))
    return np.stack([(h >> U(k)) % U(FILTER_BITS) for k in (0, 20, 40)]).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids: FILTER_BITS bits at most come to the driver, whatever the number of ids."""

    def run(batches):
        seen = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            seen[places(batch.column(0).to_numpy()).ravel()] = True
        bits = np.packbits(seen).view("<i8")
        words = np.flatnonzero(bits)
        yield pa.record_batch([pa.array(words, pa.int64()), pa.array(bits[words], pa.int64())], ["word", "bits"])

    rows = ids.select("doc_id").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, "<i8")
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return np.unpackbits(bits.view(np.uint8)).astype(bool)


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The shingle sets (sorted) of the classes in ``ids`` (node, doc_id, left, right, is_a, is_b), read from a member each.

    A Bloom filter passes over the other documents before their texts are read, and the join drops those that it let
    through, so that sets are shuffled and texts are not.
    """
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(id_filter(ids)))

    def make():
        known = np.unpackbits(sent.value).astype(bool)

        def do(batch: pa.RecordBatch):
            batch = batch.filter(pc.is_valid(batch.column(0)))
            batch = batch.filter(pa.array(known[places(batch.column(0).to_numpy())].all(axis=0), pa.bool_()))
            if not batch.num_rows:
                return None
            sets = [shingle_set(raw, k) for raw in utf8(batch.column(1))]
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            names = [name_of(s) for s in sets]
            left, right = (pa.array([x[k] for x in names], pa.int64()) for k in range(2))
            return pa.record_batch([batch.column(0), left, right, lists], ["doc_id", "left", "right", "shingles"])

        return do

    found = map_slices(docs, make, "doc_id long, left long, right long, shingles array<long>")
    return found.join(ids, ["doc_id", "left", "right"]).dropDuplicates(["doc_id", "left", "right"]).select("node", "is_a", "is_b", "shingles")


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Suffix filter, then the exact overlap: both arrays are sorted hashes."""
    need = -(-threshold * (len(x) + len(y)) // (100 + threshold))
    if min(len(x), len(y)) < need:
        return False
    if len(x) > 4 * CELLS // 3:
        cells = lambda s: np.bincount((s.view(U) >> U(56)).astype(np.int64), minlength=CELLS)
        if int(np.minimum(cells(x), cells(y)).sum()) < need:
            return False
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large.view(U), small.view(U))
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small)) >= need


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold on their whole sets. Each set is computed once; only those of b meet the other side's."""
    ids = pairs.select(F.col("a").alias("node"), F.lit(True).alias("is_a"), F.lit(False).alias("is_b")).union(pairs.select("b", F.lit(False), F.lit(True)))
    ids = ids.groupBy("node").agg(F.max("is_a").alias("is_a"), F.max("is_b").alias("is_b"))
    ids = stash(ids.join(classes.select("node", F.col("class_id").alias("doc_id"), "left", "right"), "node"))
    sets = stash(sets_of(docs, ids, k))
    drop(ids)
    x = sets.filter("is_a").select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.filter("is_b").select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    full = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")

    def make():
        def do(batch: pa.RecordBatch):
            keep = []
            x, y = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                keep.append(linked(x[i].values.to_numpy(), y[i].values.to_numpy(), threshold))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return do

    out = stash(map_slices(full, make, "a long, b long"))
    drop(sets)
    return out


def cross_pairs(tagged: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs of different components, by how many prefix shingles they share.

    ``tagged`` has h, doc_id, n, i, component for each prefix shingle found twice or more. Members of a smaller component
    (ties by id) ask those of larger ones, in all their buckets that hold several components, so that a pair's shared
    shingles are all counted on one side and the largest group asks nothing. The members asked come as lists of about
    PACK documents, cut alike in all buckets, and are counted together without a row a pair.
    """
    mixed = tagged.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("h")
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    rest = tagged.join(mixed, "h", "left_semi").join(sizes, "component", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    cuts = 1 + tagged.select("doc_id").distinct().count() // PACK
    large = F.struct("size", F.col("component").alias("own"), F.pmod(F.xxhash64("doc_id"), F.expr(f"size div {PACK} + 1")).alias("cut"))
    small = F.struct(F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("own"), F.pmod(F.xxhash64("component"), F.lit(cuts)).alias("cut"))
    lists = rest.groupBy("h", F.when(F.col("size") > PACK // 8, large).otherwise(small).alias("pack")).agg(F.collect_list(F.struct("doc_id", "n", "component", "size", F.col("i").alias("j"))).alias("list"))
    asked = rest.select("h", F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("component").alias("ac"), F.col("size").alias("az"), "i")
    an, i = F.col("an").cast("long"), F.col("i").cast("long")

    def fits(e):
        """Order of components, length filter and positional filter, for one member of a list."""
        m, j = e["n"].cast("long"), e["j"].cast("long")
        above = (e["size"] > F.col("az")) | ((e["size"] == F.col("az")) & (e["component"] > F.col("ac")))
        most = F.least(i, j) + 1 + F.least(an - i - 1, m - j - 1)
        return above & (F.least(an, m) * 100 >= threshold * F.greatest(an, m)) & ((100 + threshold) * most >= threshold * (an + m))

    larger = F.col("pack.own").isNull() & (F.col("az") <= PACK // 8) | (F.struct("pack.size", "pack.own") > F.struct("az", "ac"))
    met = asked.join(lists, "h").filter(larger).withColumn("list", F.filter("list", fits)).filter(F.size("list") > 0).groupBy("a", "an", "ac", "az", "pack").agg(F.flatten(F.collect_list("list")).alias("list")).select("a", "an", "ac", "az", "list")

    def make():
        def do(batch: pa.RecordBatch):
            a, an, ac, az = (batch.column(j).to_numpy() for j in range(4))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(4)).to_numpy())
            ids, n, component, size, _ = (x.to_numpy() for x in batch.column(4).flatten().flatten())
            by = np.lexsort((ids, row))
            row, ids = row[by], ids[by]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])))  # a run is one document asked by one other
            shared = np.diff(np.append(first, len(row)))
            row, ids, n, component, size = row[first], ids[first], n[by][first].astype(np.int64), component[by][first], size[by][first]
            an, ac, az = an[row].astype(np.int64), ac[row], az[row]
            most = shared + np.maximum(needed(n, threshold), needed(an, threshold)) - 1
            keep = ((size > az) | (size == az) & (component > ac)) & (np.minimum(n, an) * 100 >= threshold * np.maximum(n, an)) & ((100 + threshold) * most >= threshold * (n + an))
            a, b = a[row][keep], ids[keep]
            return pa.record_batch([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

        return do

    return map_slices(met, make, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = WORDS, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (least doc_id with the same set), component_id."""
    docs = texts(docs, id_col, text_col)
    base = stash(profiles(docs, k, threshold, *frequent_shingles(docs, k)))
    name = ["n", "left", "right"]
    classes = base.filter("n > 0 and doc_id is not null").groupBy(*name).agg(F.min("doc_id").alias("class_id"))
    shared_ids = classes.groupBy("class_id").agg(F.count("*").alias("many")).filter("many > 1").select("class_id", F.lit(True).alias("many"))
    own = F.when(F.col("many"), -1 - F.xxhash64(*name).bitwiseAND((1 << 62) - 1)).otherwise(F.col("class_id"))
    classes = stash(classes.join(shared_ids, "class_id", "left").select(*name, "class_id", own.alias("node")))
    lone = classes.select(F.col("class_id").alias("doc_id"), "node", *name)
    # A posting for each prefix shingle of each class's representative; doc_id is the class's name from here on.
    postings = base.join(lone, ["doc_id", *name]).dropDuplicates(["doc_id", *name]).select(F.col("node").alias("doc_id"), "n", F.posexplode("prefix").alias("i", "h"))
    postings = postings.select("doc_id", "n", "h", F.col("i").cast("int").alias("i"))
    met = postings.groupBy("h").agg(F.count("*").alias("members")).filter("members > 1").select("h")
    shared = stash(postings.join(met, "h", "left_semi"))
    # Each member with the pivot that it shares most shingles with.
    pivots = shared.groupBy("h").agg(F.min(F.struct(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"))).alias("p")).select("h", "p.*")
    star = shared.join(pivots, "h").filter(F.col("doc_id") != F.col("b")).filter(plausible(threshold)).groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("m").alias("m"))
    star = stash(star.filter(enough(threshold)).groupBy("a").agg(F.max(F.struct("c", -F.col("b"))).alias("best")).select("a", (-F.col("best.col2")).alias("b")))
    edges = verified(star, docs, classes, k, threshold)
    drop(star)
    groups = components(edges)
    # Pairs between components that meet in a bucket.
    tagged = shared.select("h", "doc_id", "n", "i").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    tagged = stash(tagged)
    drop(shared)
    cross = stash(cross_pairs(tagged, groups, threshold))
    drop(groups)
    more = verified(cross, docs, classes, k, threshold)
    drop(tagged)
    drop(cross)
    # Rows that share a doc_id tie their classes together.
    member = stash(base.select("doc_id", *name).join(classes, name, "left"))
    ties = member.filter("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    tied = member.join(ties, "doc_id").filter("node is not null and node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    drop(base)
    groups = components(edges.union(more).union(tied))
    drop(edges)
    drop(more)
    # A component is known by its least class_id; its names may lie below zero.
    least = classes.join(groups.withColumnRenamed("id", "node"), "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    reached = groups.join(least, "component").select(F.col("id").alias("node"), "component_id")
    joined = member.join(reached, "node", "left")
    told = lambda c: F.when(F.col("doc_id").isNotNull(), c)
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), told(F.coalesce("component_id", "class_id", "doc_id")).alias("component_id"), told(F.coalesce("class_id", "doc_id")).alias("class_id"))
