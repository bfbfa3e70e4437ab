"""Token counts by an exact length histogram.

Documents are counted by encoded length; sums over all longer lengths then answer, for every context limit, how many
documents fit, how many tokens there are in all and after truncation, and where each quantile lies. The sums run in two
steps, within ranges of RANGE lengths and over the ranges, so that no task sees more than a range or the ranges' totals.

Defined results: null and empty texts have length 0 and are counted; any length of text is encoded whole; an empty
table has only the rows of the limits asked for; repeated rows each count; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode
from .stash import stash

RANGE = 1024
LIMITS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 131072)


def lengths(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return encode(docs, path, pattern, id_col, text_col).select("doc_id", "n_tokens")


def histogram(counted: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """n_tokens, n_docs; a limit that no document has gets a row of 0 documents. Written once, as it is read twice: a row a length."""
    asked = counted.sparkSession.createDataFrame([(x, 0) for x in limits], "n_tokens long, n_docs long")
    return stash(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).union(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def by_limit(hist: DataFrame) -> DataFrame:
    """One row a context limit: the documents of just that length, those that fit, the quantile that this is, the
    tokens of those that fit, of all, and of all after truncation to the limit."""
    hist = hist.withColumn("range", F.expr(f"n_tokens div {RANGE}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    over = Window.orderBy(F.desc("range"))
    after = over.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = hist.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    ranges = ranges.select("range", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("d", "t")), *(F.sum(c).over(every).alias(f"{c}_all") for c in ("d", "t")))
    inside = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = hist.join(ranges, "range").withColumns({"longer": F.col("d_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)), "beyond": F.col("t_after") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
    fit, tokens_fit = F.col("d_all") - F.col("longer"), F.col("t_all") - F.col("beyond")
    return longer.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", fit.alias("docs_fit"), F.when(F.col("d_all") > 0, F.round(fit / F.col("d_all"), 9)).alias("quantile"),
        tokens_fit.alias("tokens_fit"), F.col("t_all").alias("tokens_total"), (tokens_fit + F.col("n_tokens") * F.col("longer")).alias("tokens_truncated"),
    )


def quantile_length(table: DataFrame, share: float) -> DataFrame:
    """The least length that so many of the documents don't exceed."""
    return table.filter(F.col("docs_fit") > 0).filter(F.col("quantile") >= share).agg(F.min("context_limit").alias("n_tokens"))
