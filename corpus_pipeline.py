"""A corpus pipeline: five stages, each the whole job of one operator.

quality rules -> one document of each near-duplicate group -> repeated passages
removed -> personal data replaced -> packed sequences.  Every stage reads all
documents that the stage before it kept and returns the columns of documents;
the last returns the pieces.

Cases, in every stage: null and repeated ids are rows of their own; repeated rows
are judged alike (the near-duplicate stage keeps one of them); an empty table
gives an empty result of the same columns; further columns, whatever their
names, are passed on by all stages but the last.  Null and empty texts fail the
quality rules; the later stages, called on their own, keep them as they are
(packing makes them the end id alone).  Texts of any length are read whole.
``n_chars`` is counted anew where a text may have changed, if there is such a
column.  Ties go by the operators: the least id represents a near-duplicate
group, every occurrence of a passage goes, overlapping personal data is one
region named by its first span, documents of one turn are packed by source and
place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpanel import runtime
from quillpanel.llm import ngram_join, packing, pii_bootstrap, quality_rules, recompression, scratch

#: Words of a shingle and percent of similarity for near duplicates; words of a repeated passage.
SHINGLE, PERCENT, PASSAGE = 5, 80, 50


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null labels and a labels table without good rows leave the base rules."""
    return quality_rules.keep_good(docs, runtime.ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group; texts without words are in no group and stay."""
    runtime.ship(spark)
    return ngram_join.keep_one(docs, n=SHINGLE, percent=PERCENT)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occur elsewhere too; a text without one stays byte for byte."""
    runtime.ship(spark)
    return _sized(recompression.strip_repeats(docs, width=PASSAGE))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in angle brackets; a null text stays null."""
    return _sized(pii_bootstrap.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, sources mixed by the square roots of their sizes; a null source is a queue of its own."""
    runtime.ship(spark)
    return packing.pack(docs, length=2048, end_id=1)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", passages), ("PII", private), ("packing", packed)]

#: The stages compare whole texts, learn patterns and encode with a tokenizer file: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again."""
    docs = runtime.ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage-{k}")
    return docs
