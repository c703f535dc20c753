"""A corpus pipeline over `documents`: quality rules, toxicity, near-duplicates, benchmark decontamination, packing.

Each stage works on all that the one before it kept and is written as Parquet before the next one reads it. All stages take empty
tables, nulls in any column, repeated rows and further columns of any name; each says below what it does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundlane.llm import decontam, neardup, packing, quality, toxicity
from groundlane.llm.base import dropped, saved, table
from groundlane.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose ledger bits pass the policy. Null and empty texts have too few words and go; repeated rows are judged each;
    a null doc_id changes nothing; an empty table stays empty."""
    return quality.filtered(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the severity cut, by a model of the labelled ones among them. Where labels allow no fit, and for null and
    empty texts, severity is 0 and the document stays; repeated rows are scored each."""
    return toxicity.filtered(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more on five-word shingles join: the one with the smallest doc_id.
    Texts without words and rows without doc_id stay; of equal rows one stays; rows that share a doc_id but not their text are
    documents of their own."""
    return neardup.filtered(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated: under a twentieth of their words stand in benchmark windows. Texts without words stay, and
    so does everything if the benchmark is empty; equal rows share their fate."""
    return decontam.filtered(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, as in the packing query. Null and empty texts hold the end id alone; a null source is a
    source; repeated rows are packed each; an empty table gives no piece."""
    return packing.packed(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokenizers and a trained model are no SQL; tests/llm holds the run against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "saved_at"):
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
