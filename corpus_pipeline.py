"""The corpus pipeline: five stages from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Edge cases, in all stages: a null text counts as an empty one; null ids and sources stay; an empty table goes through as an
empty table; further columns, whatever their names, are dropped. Repeated rows: the quality stage keeps or rejects them alike
(equal texts get equal scores, and a score equal to the threshold is kept); the line stage counts a line once a doc_id and
keeps it in the largest one; the near-duplicate stage keeps the least doc_id of a group, and all rows that are equal in id
and text; the decontamination stage treats them alike; the mix takes each row by itself, ties in the order of ids. A text that
loses all its lines stays as an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontam, line_dedup, mixing, near_dup, quality
from sievework.llm.common import read, row_key, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.classify(docs, read(spark, sf_dir, "labels")).where(F.col("_predicted") == 1).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold go, except in the last of them; documents stay, with the text that is left."""
    done = line_dedup.drop_repeated_lines(docs)
    return done.select("doc_id", F.col("_kept").alias("text"), "lang", "source", F.length("_kept").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word similarity of 0.8 or more) stays, the one with the least doc_id."""
    return _kept(docs, near_dup.cluster(docs, percent=80).where("kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return _kept(docs, decontam.contamination(docs, read(spark, sf_dir, "benchmark")).where("not contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with the words taken of each; those of which nothing is taken go."""
    return mixing.taken_by_document(docs).where(F.col("taken") > 0)


def _kept(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs whose id and text hash are in stay."""
    ids = stored(stay.select(F.col("doc_id").alias("_i"), F.col("_th").alias("_t")), "kept")
    return row_key(docs.select(*COLUMNS), "doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left_semi").select(*COLUMNS)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mix", mix),
]

#: The classifier and the shingle sets have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and read again, so a lost executor costs one stage at most."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
