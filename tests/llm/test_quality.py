"""The learner against plain Python, the sample of the fit, and the fold that is held out."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import quality as q


def plain_ftrl(data, times):
    z, n = defaultdict(float), defaultdict(float)

    def weight(p):
        return 0.0 if abs(z[p]) <= q.L1 else -(z[p] - math.copysign(q.L1, z[p])) / ((q.BETA + math.sqrt(n[p])) / q.ALPHA + q.L2)

    for _ in range(times):
        for x, y in data:
            w = {p: weight(p) for p in x}
            guess = 1 / (1 + math.exp(-sum(w[p] * v for p, v in x.items())))
            for p, v in x.items():
                g = (guess - y) * v
                sigma = (math.sqrt(n[p] + g * g) - math.sqrt(n[p])) / q.ALPHA
                z[p] += g - sigma * w[p]
                n[p] += g * g
    return {p: weight(p) for p in list(z)}


def test_ftrl_equals_plain_python():
    data = [(f"word{i % 7} word{i % 3} other text {i}.", int(i % 3 == 0)) for i in range(60)]
    features = []
    for text, y in data:
        places, values = q.featurize(text)
        features.append(({**dict(zip(places.tolist(), values.astype(np.float32).tolist(), strict=True)), q._SPACE: float(np.float32(q.BIAS))}, y))
    want = plain_ftrl(features, 3)
    got = q.ftrl(data, 3)
    assert set(np.flatnonzero(got)) == {p for p, w in want.items() if w}
    assert all(got[p] == pytest.approx(w, abs=1e-9) for p, w in want.items())


def test_passes_are_bounded():
    assert [q.passes(n) for n in (0, 1, 5000, 10_000, 20_000)] == [8, 8, 8, 4, 2]


def test_sample_is_one_row_an_id_and_bounded(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (None, 1, 0), (5, None, 0), (77_777, 1, 0)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(3, f"again {i}") for i in range(50)] + [(None, "no id"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["_text"], r["_y"]) for r in q.sample(texts, labels).collect()}
    held = {r["doc_id"] for r in labels.where(q.held_out("doc_id")).collect()}
    assert set(got) == set(range(40)) - held and q.sample(texts, labels).count() == len(got)
    assert all(got[i][1] == (0 if i == 3 else i % 2) for i in got)
    assert q.sample(texts, labels, most=5).count() == 5


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet") for name in ("documents", "labels"))
    done = q.classify(docs, labels).where(q.held_out("doc_id")).join(labels, "doc_id")
    right, good, kept = done.agg(F.avg((F.col("_predicted") == F.col("quality")).cast("int")), F.sum("quality"), F.sum(F.col("quality") * F.col("_predicted"))).first()
    assert right >= 0.93 and kept >= 0.97 * good


def test_existing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same text", 9), (1, "same text", 9), (2, None, 9), (None, "", 9)], "doc_id long, text string, _score int").withColumn("_predicted", F.lit("x"))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = q.classify(docs, labels)
    assert got.columns == ["doc_id", "text", "_score", "_predicted"] and {r["_score"] for r in got.collect()} == {0.5} and got.count() == 4
