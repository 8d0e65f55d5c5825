"""Importance resampling against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievework.llm import importance as imp

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, order):
    w = WORD.findall((text or "").translate(AZ))
    return w, [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def brute(docs, bench, order=1, buckets=10_000, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, runs(x, order)[1]))
    for x in bench:
        t.update(map(bucket, runs(x, order)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out, able = [], []
    for doc, x in docs:
        w, f = runs(x, order)
        weight = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None])
        if len(w) >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = i
    return Counter(map(tuple, out))


def found(df):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("order", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 60)])
def test_against_counting(spark, docs, monkeypatch, order, buckets, percent):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, [r["text"] for r in bench.collect()], order, buckets, percent)
    assert found(imp.resample(docs, bench, order=order, buckets=buckets, percent=percent)) == want


def test_tries_start_anew_without_a_change(spark, monkeypatch):
    trie, other = imp.Trie(2), imp.Trie(2)
    import numpy as np

    a, b = np.zeros(97, np.int64), np.zeros(97, np.int64)
    for text in (b"a b a b c", b"A-B c", "é ü é".encode(), b""):
        trie.add(imp.words(text))
        other.add(imp.words(text))
        other.drain(b)
        assert other.nodes == 0
    trie.drain(a)
    assert (a == b).all() and a.sum() == 9 + 5 + 5


def test_crc_is_continued_along_the_path():
    trie = imp.Trie(3)
    trie.add(imp.words("Über den Wolken".encode()))
    node = trie.root["Über".encode()]["den".encode()]["wolken".encode()] if "Über".encode() in trie.root else None
    assert node is not None and node.crc == zlib.crc32("Über den wolken".encode())


def test_empty_tables_and_targets(spark, docs, empty_docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert imp.resample(empty_docs, none).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(imp.resample(docs, none)) == brute(rows, [])


def test_ranks_are_consecutive_over_ties(spark):
    docs = spark.createDataFrame([(i % 3, "same words all over again " * 5) for i in range(60)], "doc_id long, text string")
    ranks = imp.resample(docs, docs, percent=50).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 31))
    assert [(-r["score"], r["doc_id"]) for r in ranks] == sorted((-r["score"], r["doc_id"]) for r in ranks)
    assert docs.where(F.length("text") > 0).count() == 60
