"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.session import shared_dir, stored  # noqa: F401  (the operators' way to both)

#: A word of the licence and benchmark operators, in text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of the size, shingle and line operators: no ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def sized(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept. Texts of one byte a character take the quick built-in, which is the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole(text: Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of text, A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(whole(text)), F.lit(WORD), F.lit(0))


def row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds _th, a hash of the text: with the id it names a row. Rows equal in both get equal results."""
    return df.withColumn("_th", F.xxhash64(whole(F.col(text_col))))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
