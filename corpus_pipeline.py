"""The corpus pipeline: toxicity, line dedup, near-dedup, source mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipworks.llm import line_dedup, minhash, mixing, pieces, toxicity
from clipworks.llm.frames import read
from clipworks.sources.tables import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learnt from the labelled ones outside the held-out fold."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of several lines removed; n_chars follows the text. Documents that lose every line go."""
    out = line_dedup.dedup_runs(docs)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else out[c] for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn towards the square root of their sizes, as many rows as before on average, in a global random order."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, beside its columns."""
    return pieces.encode_texts(docs)


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("sentencepiece", pieces_stage)]
#: The toxicity vote, MinHash and the Viterbi search are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
