"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor kept,
written as Parquet and read again, and returns a DataFrame: the columns of
documents, but the last, which returns the pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm import near_duplicates, packing, source_mix, substring_dedup, toxicity
from gatewright.llm.scratch import Scratch, tracked

def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold; rows without text are kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(spark, docs, labels).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with links of similarity 0.8 or more, the one with the least id; and all without shingles."""
    return near_duplicates.near_duplicates(spark, docs).where("keeper").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 13 words or more that a document with a smaller id has. A text that goes whole becomes empty."""
    out = substring_dedup.substring_dedup(spark, docs)
    # a text that loses nothing stays as it is, white space included
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_length(out.withColumn("text", text)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; where it takes one in part, words of the blocks taken. Rows whose text is null or has no words are taken never; repeated rows and rows without an id are taken one by one; an empty table gives none."""
    return _with_length(source_mix.taken_texts(source_mix.mix(spark, docs))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. A null text is empty and gives its end token; repeated rows and rows without an id are packed one by one; an empty table gives none."""
    return packing.packed_digests(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but the mix has an SQL form; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents. Each result is written before the next stage begins, and what only led to it is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        with tracked() as held:
            docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            at = Scratch(spark, "pipeline")
            docs = at.table(docs, "docs")
            for scratch in [*held, *([before] if before else [])]:
                scratch.drop_all()
            before = at
    return docs
