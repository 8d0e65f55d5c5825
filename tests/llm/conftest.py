"""Small tables with the cases that operators must stand."""

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
LINE = "this very line stands in many documents and is long enough"


def edge_texts() -> list[tuple]:
    rows = [
        (9001, None), (9002, ""), (9003, "   \n\t "), (9004, "one"), (9005, "one two three four"), (9006, "one two three four"),
        (9007, "ÉCOLE Straße KELVIN K cc-by CC BY licensed"), (9007, "ÉCOLE Straße KELVIN K cc-by CC BY licensed"),
        (None, "a text without an id, All Rights Reserved"), (9008, "x" * 5000), (9009, "word " * 30000),
        (9010, "Mail a@b.example.com_c@d.example.org at 10.0.0.1 or 300.1.1.1, card 4111 1111 1111 1111, call +1 (555) 555-0199."),
        (9011, "\U0001f600 4111-1111-1111-1111 +49 30 1234567 99.99.99.999 user@host +1 2 "),
        (9012, "General  public\nLICENSE; all rights reserved all rights reserved cc by"),
        (9015, "cc by " * 15000),
        (9013, "a\r\nb\n\n" + LINE), (9014, "password = \"abc123def456ghi\""),
    ]
    rows += [(9100 + i, f"{'  ' if i % 2 else ''}{LINE.upper() if i % 3 else LINE}\t\nown line {i}\n{LINE}") for i in range(7)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """sf0.001 documents and edge cases, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    edge = spark.createDataFrame(edge_texts(), schema).withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "src0")).withColumn("n_chars", F.length("text").cast("long"))
    clash = {c: F.lit(1) for c in ("_id", "_th", "_text", "size", "pos", "w", "term", "node", "n", "label", "_found", "_i", "_t", "_did", "host", "kind")}
    return base.unionByName(edge).withColumns(clash).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def empty_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
