"""The corpus pipeline: toxicity, language ID, near-dedup, mixing and packing, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corveil.llm import langid, mixing, packing, simhash, toxicity
from corveil.llm.common import cut, table
from corveil.llm.queries import TOKENIZER


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays uncertain, go."""
    return langid.keep_identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more), the document with the smallest id stays."""
    return simhash.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes words of it, in the order of training; those it takes nothing of go."""
    return mixing.training_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return packing.best_fit_pack(packing.pieces(docs, TOKENIZER))


STAGES = [("toxicity", toxic_out), ("language_id", language_known), ("simhash_near_dedup", one_of_each), ("mixing", mixed), ("best_fit_packing", packed)]

#: No SQL expresses the first stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are checkpointed in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
