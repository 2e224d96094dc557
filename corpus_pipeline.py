"""The corpus pipeline: quality rules, near-duplicates, mixing, sampled segmentations.

All stages: columns of documents stay as they are, also columns beside them, whatever their names; a row is a document, repeated rows and
ids included; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentograph.llm import mixing, pieces, quality_rules, simhash
from sentograph.llm.queries import tokenizer_path
from sentograph.llm.shared import new_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, all columns. A null or empty text has no words and goes; a document without id is judged as any other, and
    is no labelled one; rows of the same id are judged by their own texts."""
    return quality_rules.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, of equal ids that of the smallest fingerprint, then the first. Null and empty texts
    are one group, as all of fingerprint zero; documents without id stay only where their group has none with one."""
    return simhash.one_of_each(docs)


def keep_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order, documents as often as it takes them. Null and empty texts have no words and aren't taken; a null source is a source, last in
    order; each of repeated rows takes its own share; ties in time go by hash."""
    return mixing.mix(docs)


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of each row, their ids and scores. A null or empty text has the one of the leading space mark; a text with one
    segmentation has one row; a null id draws as the id "null"; repeated rows draw alike; a text of any length goes through in windows."""
    return pieces.sample(docs, tokenizer_path("piece_bpe_32k.model"), k=2)


STAGES = [("quality_rules", keep_good), ("simhash", keep_one), ("mixing", keep_mix), ("sentencepiece", sample_pieces)]

#: The list is learned and the segmentations are sampled, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
