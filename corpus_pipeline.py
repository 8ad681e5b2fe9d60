"""A training-data pipeline: its stages, each an operator of mirepoix.llm applied to what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes to the shared folder and reads
again as the docs of the next. All but the last return the columns of docs. Each row is kept or dropped for itself:
null and repeated doc_ids don't share their fate. ORACLE_SQL is None: SQL expresses none of the stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirepoix.llm import packing, quality, simhash, toxicity
from mirepoix.llm.common import settled, table

ORACLE_SQL = None


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row in `kept__row`, written once, so that every later read has the same numbers."""
    return settled(docs.withColumn("kept__row", F.monotonically_increasing_id()), "numbered")


def _kept(numbered: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of numbered whose number is in rows, a column of numbers without repeats; the number is dropped."""
    return numbered.join(rows.toDF("kept__row"), "kept__row", "left_semi").drop("kept__row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, doesn't take for toxic."""
    return toxicity.sifted(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of enough and not too repetitive words whose perplexity is within their language's bands."""
    return quality.sifted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, that with the smallest doc_id, nulls last; of equal ids the first row.

    Near-duplicates share about 0.8 or more of their five-word shingles (see simhash.similar_documents).
    """
    numbered = _numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("kept__row").alias("row"))
    found = simhash.similar_documents(numbered.withColumn("kept__key", key), doc_id="kept__key")
    return _kept(numbered, found.where("doc_id.row = component_id.row").select("doc_id.row"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.packed_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("simhash near-dedup", drop_near_duplicates), ("best-fit packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
