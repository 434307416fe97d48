"""From raw documents to packed training batches, in five stages.

Each stage takes the session, the documents that its predecessor kept and the
folder of the tables; all but the last return the columns of documents.  Each
reads its input anew for every pass, so callers write a stage's result and
reread it (:func:`run` does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm.common import stash, table, unused
from helixmill.llm.ngram_join import NO_ID, near_duplicates
from helixmill.llm.packing import pack_documents
from helixmill.llm.quality import keep_good
from helixmill.llm.secret_scan import mask_secrets
from helixmill.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, rows as they are.

    A null text is scored as an empty one; without a label nothing is accepted.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the least id, null ids last (one row of repeated ones).

    Texts without words, nulls and empty ones among them, are one class.
    """
    # Ids may be null or given to several texts, so classes have a key of their own; of one id's texts, the least hash stands for the class.
    d, th = unused(docs, "d", "th")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias(d), F.col("th").alias(th))).alias("first")
    stays = near_duplicates(docs).groupBy("class_key").agg(first).select("first.*")
    keyed = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn(th, F.xxhash64(F.coalesce("text", F.lit(""))))
    # Repeated rows become one of each task before texts move; the join needs no further exchange of them.
    return keyed.dropDuplicates([d, th]).join(stays, [d, th]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that one with a smaller id holds; a null id is the largest.

    A row that loses nothing stays as it is, one that loses every word goes.
    Rows of one id, repeated ones among them, take nothing from each other.
    """
    return without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; every row stays, one without a secret as it is, nulls included."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches, a row for each row: doc_id, n_tokens, bucket, pad_to, batch and slot.

    A null text has no tokens; repeated rows take a slot each.
    """
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("secret scans", secrets),
    ("packing", packing),
]

#: Trees, MinHash and the randomness tests have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
