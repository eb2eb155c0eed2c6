"""The corpus pipeline: five of the training-data operators in a row, each stage written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.mixing import take_copies
from sparkloom.llm.near_dedup import keep_one_of_each
from sparkloom.llm.quality import keep_good
from sparkloom.llm.queries import TOKENIZERS
from sparkloom.llm.scratch import Scratch
from sparkloom.llm.sentence_pieces import encode_pieces, load
from sparkloom.llm.toxicity import remove_toxic


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression calls toxic go."""
    return remove_toxic(docs, _labels(spark, sf_dir))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the isolation forest rejects go."""
    return keep_good(docs, _labels(spark, sf_dir))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8 or more) the document of the smallest id stays."""
    return keep_one_of_each(docs, percent=80, size=5)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it takes no time go."""
    return take_copies(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, exact of every copy."""
    return encode_pieces(docs, load(f"{TOKENIZERS}/piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity_stage), ("quality_rules", quality_stage), ("near_dedup", dedup_stage), ("mixing", mixing_stage), ("sentence_pieces", encoding_stage)]
#: The models' verdicts and the rounding can't be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
