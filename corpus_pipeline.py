"""The corpus pipeline: stages over documents, each an operator of tidemark.llm, written and read again in between.

Columns beside doc_id and text go through all stages but the last, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, packing, personal_data, toxicity
from tidemark.llm.common import table, written
from tidemark.llm.jaccard_join import keep_one

#: Near duplicates: shingles of five words and a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, trained on the labelled ones among them, doesn't reject. A null or empty text has no toxic term and stays; repeated rows are judged each."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; of equal rows one. Null and empty texts all stay."""
    return keep_one(docs, SHINGLE, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark. Null and empty texts stay; without benchmark items all do."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind. Null and empty texts stay as they are."""
    return personal_data.redact(docs, personal_data.learn_patterns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens, with the crc32 of their ids and of their sequence's. A null or empty text is one id, the end."""
    return packing.with_sequence_digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal data", redact),
    ("packing", pack),
]

#: Learned models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
