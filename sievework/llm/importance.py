"""Importance resampling towards a target distribution, with partition-local word tries.

Features are the runs of 1 to `order` consecutive words; a feature's bucket is the CRC32 of its UTF-8 bytes, words joined by
one blank, modulo `buckets`.

1. Each task walks its texts through a word trie. A node stands for a run of words; it holds how often the run was met
   and the CRC state of its bytes, from which its children's are continued, so no run is ever spelled out or hashed
   twice. At the end of the task, and whenever the trie has MAX_NODES nodes, its counts are added up by bucket and the
   trie starts anew: a task holds MAX_NODES nodes and `buckets` totals at most, and gives a row a bucket.
2. The totals of all tasks are merged, for the documents (s, of S features) and the target (t, of T). A bucket's gain is
   floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))). The gains are `buckets` numbers, whatever the corpus.
3. Texts are walked again through tries whose nodes hold their bucket's gain; the weight is the sum along the walk.
4. Each document gets Gumbel noise from a hash of its id, so that the highest scores are a draw without replacement, with
   chances by weight. Scores are numbered over ranges (see operators/order.py): no task ranks all documents.

Edge cases: null and empty texts have no features and weight 0; an empty target has T = 0; null ids are hashed as an empty
text and lose ties; repeated rows are documents of their own, which count and are drawn by themselves, with equal
scores; rows equal in score and id are numbered in any order; an empty table gives no rows; documents of fewer than
`least` words are scored but not drawn; further columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import stored, whole
from sievework.operators.order import numbered

ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, "2024"
#: Nodes at which a trie starts anew.
MAX_NODES = 200_000
#: Bytes of words after A-Z are lower-cased: digits, a-z and all beyond ASCII; others part words.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_KEPT).split()


class Node(dict):
    """A run of words: its children by next word, how often it was met, the CRC of its bytes, and its gain."""

    __slots__ = ("count", "crc", "gain", "trie")

    def __init__(self, trie: Trie, crc: int | None):
        self.trie, self.crc, self.count = trie, crc, 0
        self.gain = 0 if crc is None or trie.gains is None else trie.gains[crc % len(trie.gains)]

    def __missing__(self, word: bytes) -> Node:
        crc = zlib.crc32(word) if self.crc is None else zlib.crc32(word, zlib.crc32(b" ", self.crc))
        child = self[word] = Node(self.trie, crc)
        self.trie.nodes += 1
        return child


class Trie:
    """The runs of up to `order` words that a task has met since the trie was last emptied."""

    def __init__(self, order: int, gains: list[int] | None = None):
        self.order, self.gains = order, gains
        self.empty()

    def empty(self) -> None:
        self.nodes, self.root = 0, Node(self, None)

    def add(self, toks: list[bytes]) -> None:
        """Counts all runs."""
        root, more = self.root, self.order - 1
        for i, word in enumerate(toks, 1):
            node = root[word]
            node.count += 1
            for after in toks[i : i + more]:
                node = node[after]
                node.count += 1

    def weight(self, toks: list[bytes]) -> int:
        """The sum of gains over all runs."""
        root, more, total = self.root, self.order - 1, 0
        for i, word in enumerate(toks, 1):
            node = root[word]
            total += node.gain
            for after in toks[i : i + more]:
                node = node[after]
                total += node.gain
        return total

    def drain(self, totals: np.ndarray) -> None:
        """Adds the counts to the totals by bucket, and empties the trie."""
        stack = [self.root]
        while stack:
            for node in stack.pop().values():
                totals[node.crc % len(totals)] += node.count
                if node:
                    stack.append(node)
        self.empty()


def bucket_totals(docs: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features fall into each bucket that has any."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, totals = Trie(order), np.zeros(buckets, np.int64)
        for pdf in parts:
            for raw in pdf["raw"]:
                trie.add(words(raw))
                if trie.nodes >= MAX_NODES:
                    trie.drain(totals)
        trie.drain(totals)
        met = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": met, "n": totals[met]})

    raw = docs.select(whole(F.col(text_col)).cast("binary").alias("raw"))
    return raw.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket."""
    all_s, all_t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * all_s / ((source.get(b, 0) + 1.0) * all_t))) for b in range(buckets)]


def weighed(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def walk(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(order, shared.value)
        for texts in parts:
            out = np.zeros((len(texts), 3), np.int64)
            for i, raw in enumerate(texts):
                toks = words(raw)
                n = len(toks)
                out[i] = n, sum(max(0, n - k) for k in range(order)), trie.weight(toks)
                if trie.nodes >= MAX_NODES:
                    trie.empty()
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("doc_id"), walk(whole(F.col(text_col)).cast("binary")).alias("w")).select("doc_id", "w.*")


def noise(id_col: str, seed: str = SEED) -> Column:
    """Thousandths of standard Gumbel noise, by a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED
) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank (from 1 among the drawn; null for the others). target has the
    texts, in a column of the same name, whose distribution is aimed at."""
    source, aim = ({r["bucket"]: r["n"] for r in bucket_totals(x, text_col, order, buckets).collect()} for x in (docs, target))  # `buckets` rows at most
    scored = weighed(docs, gains(source, aim, buckets), id_col, text_col, order)
    scored = stored(scored.withColumn("score", F.col("weight") + noise("doc_id", seed)), "importance")
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    ranked = numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(scored.where(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank")))
