"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

1. language_id: documents whose language can't be told (no letters to speak of, or no language with most of the
   posterior) go.
2. near_duplicates: of each component of near duplicates the document of least doc_id stays.
3. decontaminate: documents that hold a passage of a benchmark item go.
4. pii: personal data give way to the name of their kind; n_chars follows.
5. byte_bpe: token ids (little-endian unsigned 32-bit integers), their number and whether they decode to the text again
   join the columns.

Defined results: stages know a row by what is in it, so that rows that share a doc_id, or have none, are documents of
their own; rows equal in doc_id and text are one document, of which near_duplicates keeps one; a row without doc_id
comes after those that have one. Null and empty texts have no language and go with the first stage. Columns other than
those of ``documents`` are left out. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlintel.llm import bpe, decontaminate, langid, pii, shingle_join
from urlintel.llm.arrow import row_key, table
from urlintel.llm.stash import folder, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without(docs: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    """The rows whose key isn't among those that go: keys are written first, so that Spark knows how few they are."""
    return docs.join(stash(gone.select(*key).distinct()), list(key), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select(*COLUMNS).withColumns(dict(zip(("k1", "k2"), row_key("doc_id", "source", "text"), strict=True)))
    found = langid.identify(langid.document_rows(keyed, keep=("k1", "k2")), *langid.fit(docs))
    return without(keyed, found.filter("not accepted"), "k1", "k2").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are known by 128 bits. The join takes one number a row: its doc_id where no other row has that, else one below zero made from the row.

    By their doc_ids the copies of a text meet its first form, so that a group of copies is a star.
    """
    k1, k2 = row_key("doc_id", "text")
    keyed = docs.select(*COLUMNS).withColumns({"k1": k1, "k2": k2})
    below = lambda k: -1 - F.col(k).bitwiseAND(F.lit((1 << 63) - 1))
    rows = keyed.select("doc_id", "k1", "k2").distinct()
    shared = stash(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id >= 0").select("doc_id", F.lit(True).alias("shared")))
    known = rows.join(shared, "doc_id", "left")
    others = known.filter("shared or doc_id is null or doc_id < 0").select(below("k1").alias("k"), "k2")
    twice = stash(others.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k", F.lit(True).alias("twice")))
    own = F.col("shared").isNull() & (F.col("doc_id") >= 0)
    keyed = keyed.join(shared, "doc_id", "left").withColumn("k", F.when(own, F.col("doc_id")).otherwise(below("k1")))
    keyed = keyed.join(twice, "k", "left").withColumn("k", F.when(F.col("twice"), below("k2")).otherwise(F.col("k")))
    found = shingle_join.near_duplicates(keyed, id_col="k").select(F.col("doc_id").alias("k"), F.col("component_id").alias("component")).distinct()
    ids = keyed.select("k", "doc_id").distinct()
    ranked = stash(found.join(ids, "k").select("k", "component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k").alias("place")))
    first = ranked.groupBy("component").agg(F.min("place").alias("first"))
    gone = ranked.join(first, "component").filter(F.col("k") != F.col("first.k"))
    return without(keyed, gone, "k").dropDuplicates(["k1", "k2"]).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pii_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.cleaned(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.with_ids(docs.select(*COLUMNS), *bpe.defaults(), share=0.5)  # beside executors that the stages before have filled


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("pii", pii_removed), ("byte_bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, home = table(spark, sf_dir, "documents"), f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{home}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{home}/{name}")
    return docs
