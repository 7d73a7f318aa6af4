"""A corpus from raw documents: toxic ones go, near copies and repeated passages go, benchmark passages go, ids come out.

Each stage is one operator of sedimenta.llm over everything its predecessor kept. run() writes no files of its own;
the operators keep what they must reread under spark.checkpoint.dir. Null texts pass every stage and end as begin
and end ids; an empty table stays empty; columns besides those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import decontamination, pieces, simhash, substrings, toxicity
from sedimenta.llm.common import saved, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints one row stays, that of the smallest id; an id may stand on several rows."""
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that an earlier document has are cut from the text."""
    return substrings.cut_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in any occurrence of a benchmark window are cut from the text."""
    return decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, n_tokens and the decoded text."""
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", pieces_stage),
]

#: The stages use models, hashes and a tokenizer that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
