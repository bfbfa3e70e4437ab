"""Language identification by Bayesian evidence fusion.

The evidence of a text is the likelihood of its byte trigrams under each language, tempered as neighbouring trigrams
repeat each other. To it are added, as log odds, the language the markup declares, and a prior of the host. Host priors
come from grouped aggregation of the text-only decisions, smoothed towards the address suffix and that towards the whole
corpus, and leave the row's own decision out; the suffix evidence enters through that chain and, for country suffixes,
a fixed table. The trigram model is fitted on at most SAMPLE labelled rows, taken by a hash of their text; all other
statistics cover every row.

A row is accepted when letters make up enough of its visible bytes and one language has most of the posterior.

Defined results: null, empty or letterless text has the language its other evidence favours and isn't accepted; without
labelled rows nothing is told or accepted; unknown hosts, suffixes and declarations add nothing; ties go to the first
language in order; repeated rows each count; an empty table gives an empty table; a caller's own columns come back as
they were, whatever their names. The likelihood table has CELLS numbers a language, 256 KB, and goes to every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bounded_sample, map_slices, utf8
from .hashing import LOWER
from .html_text import main_text
from .stash import stash

SAMPLE, CELLS, ADDED = 2000, 1 << 16, 0.5
TEMPER = 150.0  # so many trigrams at most count as independent
STRENGTH = 20.0  # rows that the level above weighs in a smoothed prior
DECLARED = 0.85  # how often a declaration is right
COUNTRY = 0.6  # how often a country suffix tells the language
ENOUGH, LETTERS = 0.5, 0.2

# Country suffixes and their main language.
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True
VISIBLE = np.ones(256, bool)
VISIBLE[:33] = False


def trigrams(raw: bytes) -> np.ndarray:
    """A cell for every three neighbouring bytes, A-Z lower-cased and all white space alike."""
    a = LOWER[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.uint32)
    a[a < 33] = 32
    return ((a[:-2] * 0x9E3B + a[1:-1] * 0x1F35 + a[2:] * 0x0101) * np.uint32(0x85EB_CA6B) >> np.uint32(16)).astype(np.uint32)


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-likelihood table (CELLS x languages). ``labelled`` has text and lang."""
    some = bounded_sample(labelled.filter("text is not null and lang is not null").select("lang", "text"), sample).select("lang", "text")

    def make():
        def do(batch: pa.RecordBatch):
            sums: dict[str, np.ndarray] = {}
            for lang, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(raw), minlength=CELLS)
            out = []
            for lang, n in sums.items():
                cells = np.flatnonzero(n)
                out.append(pa.record_batch([pa.array([lang] * len(cells)), pa.array(cells, pa.int32()), pa.array(n[cells], pa.int64())], ["lang", "cell", "n"]))
            return out

        return do

    counts = map_slices(some, make, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((CELLS, len(languages)), ADDED)
    for k, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        table[own["cell"].to_numpy(), k] += own["n"].to_numpy()
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def likelihoods(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """own, host, suffix, declared, and in place of text: like (a tempered log-likelihood a language), guess (the place of
    the greatest, the first among equals), sure (letters make up enough) and voted (sure, and no other is as great)."""
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def make():
        known = sent.value
        width = known.shape[1]

        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            like, sure = np.zeros((batch.num_rows, width)), np.zeros(batch.num_rows, bool)
            for i, raw in enumerate(utf8(batch.column(4))):
                n = 0
                for at in range(0, len(raw), 1 << 20):  # block by block, so that a long text needs no long arrays
                    cells = trigrams(raw[at : at + (1 << 20)])
                    like[i] += [known[:, k][cells].sum(dtype=np.float64) for k in range(width)]
                    n += len(cells)
                a = np.frombuffer(raw, np.uint8)
                like[i] *= min(n, TEMPER) / n if n else 0.0
                sure[i] = LETTER[a].sum() >= LETTERS * max(1, VISIBLE[a].sum())
            guess = like.argmax(axis=1)
            voted = sure & ((like == like.max(axis=1, keepdims=True)).sum(axis=1) == 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(like.ravel(), pa.float64()))
            return pa.record_batch([*batch.columns[:4], lists, pa.array(guess, pa.int32()), pa.array(sure), pa.array(voted)], READ)

        return do

    kind = rows.select("own").dtypes[0][1]
    return map_slices(rows.select("own", "host", "suffix", "declared", "text"), make, f"own {kind}, host string, suffix string, declared string, like array<double>, guess int, sure boolean, voted boolean")


READ = ["own", "host", "suffix", "declared", "like", "guess", "sure", "voted"]


def fused(like: np.ndarray, guess: np.ndarray, voted: np.ndarray, host: np.ndarray, suffix: np.ndarray, in_host: np.ndarray, in_suffix: np.ndarray, overall: np.ndarray, told: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """The posterior of every row (rows x languages).

    ``host`` and ``suffix`` are votes in the row's host and suffix, its own among them where in_host and in_suffix; each
    level without that vote is smoothed towards the one above, the last towards ``overall``. ``told`` has pairs of a
    language's place a row, -1 for none, and how often that kind of evidence is right.
    """
    n, width = like.shape
    mine = np.zeros((n, width))
    mine[np.arange(n), guess] = voted
    prior = np.broadcast_to(overall, (n, width))
    for votes, inside in ((suffix, in_suffix), (host, in_host)):
        others = votes - mine * inside[:, None]
        prior = (others + STRENGTH * prior) / (others.sum(axis=1, keepdims=True) + STRENGTH)
    score = like + np.log(prior)
    for place, right in told:
        odds = np.full((n, width), np.log((1 - right) / max(1, width - 1)))
        odds[np.arange(n), np.maximum(place, 0)] = np.log(right)
        score = score + odds * (place >= 0)[:, None]
    odds = np.exp(score - score.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def identify(rows: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """``rows`` has text, host, suffix and declared (null where unknown) besides its own columns; these come back with
    lang, posterior and accepted in place of text."""
    n = len(languages)
    own = [c for c in rows.columns if c not in ("text", "host", "suffix", "declared")]
    if not n:  # nothing to learn from: nothing can be told
        return rows.select(*own, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"))
    read = stash(likelihoods(rows.select(F.struct(*own).alias("own"), "host", "suffix", "declared", "text"), table))
    votes = read.filter("voted")
    count = [F.count_if(F.col("guess") == k).alias(f"n{k}") for k in range(n)]
    whole = votes.agg(*count).first()  # one row
    overall = np.array([(whole[f"n{k}"] + 1.0) / (sum(whole) + n) for k in range(n)])
    by_suffix = votes.filter("suffix is not null").groupBy("suffix").agg(*count).select("suffix", F.array(*[f"n{k}" for k in range(n)]).alias("s"))
    by_host = votes.filter("host is not null").groupBy("host").agg(*count).select("host", F.array(*[f"n{k}" for k in range(n)]).alias("h"))
    joined = read.join(by_suffix, "suffix", "left").join(by_host, "host", "left").select(*READ, "s", "h")
    place_of = {lang: k for k, lang in enumerate(languages)}

    def make():
        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.num_rows
            column = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
            known = lambda k: np.asarray(batch.column(k).is_valid())
            zero = [0] * n
            counts = lambda k: np.array([x or zero for x in batch.column(k).to_pylist()], np.float64).reshape(rows, n)
            place = lambda values: np.array([place_of.get(x, -1) for x in values])
            country = place([SUFFIX_LANGUAGE.get(x) for x in batch.column(2).to_pylist()])
            p = fused(np.asarray(batch.column(4).flatten()).reshape(rows, n), column(5), column(7), counts(9), counts(8), known(1), known(2), overall, [(place(batch.column(3).to_pylist()), DECLARED), (country, COUNTRY)])
            best = p.max(axis=1)
            lang = [languages[k] for k in p.argmax(axis=1)]
            return pa.record_batch([batch.column(0), pa.array(lang), pa.array(np.round(best, 6)), pa.array(column(6) & (best >= ENOUGH))], ["own", "lang", "posterior", "accepted"])

        return do

    kind = read.select("own").dtypes[0][1]
    out = map_slices(joined, make, f"own {kind}, lang string, posterior double, accepted boolean")
    return out.select(*[F.col("own")[c].alias(c) for c in own], "lang", "posterior", "accepted")


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Documents have no markup or address; their source stands for the host. Their own columns are doc_id, or those to ``keep``."""
    none = F.lit(None).cast("string")
    own = [F.col(id_col).cast("long").alias("doc_id")] if keep is None else list(keep)
    return docs.select(*own, F.col(host_col).cast("string").alias("host"), none.alias("suffix"), none.alias("declared"), F.col(text_col).cast("string").alias("text"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages with their main text, declared language, host and suffix."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    blank = lambda c: F.when(c != "", c)
    declared = F.lower(F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), blank(host).alias("host"), blank(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"), blank(declared).alias("declared"), F.col("html").cast("string").alias("html"))

    def make():
        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = [main_text(x) for x in batch.column(4).to_pylist()]
            return pa.record_batch([*batch.columns[:4], pa.array(text, pa.string())], ["page_id", "host", "suffix", "declared", "text"])

        return do

    return map_slices(rows, make, "page_id long, host string, suffix string, declared string, text string")
