"""The corpus pipeline: quality, repeated lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir); docs has the columns of ``documents``. What a stage keeps
is written as Parquet and read again as the next one's input. The last returns packed pieces.

In all stages extra columns are dropped with the result, an empty table gives an empty result, texts may be of any
length, and a null id or text is defined below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from foldcast.llm.common import bounded, crc_mod, short_batches, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts; it learns from labels as op5 does.

    Rows without id or text are judged as empty texts; repeated rows and ties get one verdict. Without labels of
    both classes all documents stay.
    """
    short_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod("doc_id", 4) != 2)
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(bounded(labels.select("doc_id").distinct()), "doc_id", "left_semi")
    ranking = quality.learn(staged(quality.featurize(marked), "features"), labels)
    return quality.keep_good(docs, ranking).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document that loses all its text goes.

    Rows without id or text stay as they are. Of equal lines the one of the smallest (doc_id, line) stays; rows that
    repeat a doc_id are one document, so they keep the same lines.
    """
    done = line_dedup.clean(docs).where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    return done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at five-word shingles and 0.8.

    The smallest doc_id stays, with all its repeated rows. Rows without id or without words link with nothing and stay.
    """
    return jaccard_join.one_per_group(docs, 5, 80).select(*COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Rows without id or text match nothing and stay; of repeated ids all go if one has an item.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    A null text is empty and has its end token alone; repeated rows and null ids give pieces of their own; ties in length go by id and start.
    """
    return packing.pack(staged(packing.cut(docs), "pieces"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("decontamination", without_leaks),
    ("packing", packed),
]

#: SQL can't express the ranking, the components or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
