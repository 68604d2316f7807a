"""A corpus from raw documents to packed sequences, in four stages.

Each stage takes all that its predecessor kept, written as Parquet in the shared folder and read again.

In every stage null texts count as empty ones: they are not toxic, copies of nothing, and packed as one piece of one token. So are
texts without words in the second stage. Rows without a doc_id are kept throughout; repeated rows are treated alike, and of near copies
those with the smallest doc_id stay. Texts of any length are taken whole. An empty table gives no rows. Other columns,
whatever their names, come along unchanged up to the last stage, but for n_chars, which is counted anew where a text was cut.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from candela.llm import jaccard, packing, substrings, toxicity
from candela.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not reject."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return jaccard.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 50 bytes that documents with smaller ids have."""
    return substrings.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("packing", pack)]

#: None: the classifier, exact byte strings and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage, from the documents and labels of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
