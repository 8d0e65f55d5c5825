"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are words and runs of marks. Features are hashed n-grams (n up to 2) of the tokens, and n-grams (n up to 3)
of the tokens' shapes (letters' case, digits, which mark), with a shape of its own for a token equal to the one
before, so that a repeated word is a bigram of its own. A document is its feature counts, damped and scaled to
length 1; its score is the sparse dot product with the weights.

Training takes at most MAX_TRAIN labelled documents, those with the least hash of their id, and of these the first
MAX_BYTES of text (documented bounds of the fit, not of the scoring). Follow-the-regularised-leader is sequential, so
the sample is sorted by id hash and streamed through one task; it is visited PASSES times, fewer times when
that makes more than VISITS updates. The weights have 2^BITS places, whatever the corpus, and are broadcast for scoring.

Edge cases: null and empty texts have no features and score the intercept; labels that are null, or without a
document, are not used; a doc_id labelled twice counts with its lower quality; of rows with the same doc_id one is
learnt from (that with the least hash of its text); repeated rows get equal scores; with no usable label the score is
0.5; an empty table gives no rows; columns _score and _predicted of the input are replaced, all others are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Bounds of the fit: labelled documents, bytes of their texts, passes over them, and updates beyond two passes.
MAX_TRAIN, MAX_BYTES, PASSES, VISITS = 20_000, 256 << 20, 8, 40_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
THRESHOLD = 0.7
#: The fold that is never learnt from.
HELD_OUT = 2
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_SPACE = 1 << BITS
#: The value of the intercept's feature.
BIAS = 0.3


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


class _Hashes(dict):
    """Token -> hash of the word, and below it that of its shape, 32 bits each; forgets all when it grows large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        low = token.lower()
        if token[0].isalnum() or token[0] == "_":
            shape = "d" if token.isdigit() else "U" if len(token) > 1 and token.isupper() else "T" if token[0].isupper() else "l" if token.isalpha() else "m"
        else:
            shape = token[:3]
        out = self[token] = zlib.crc32(low.encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape.encode("utf-8", "surrogatepass"), 77)
        return out


_hashes = _Hashes()
_AGAIN = zlib.crc32(b"again")


def featurize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    tokens = _TOKENS.findall(text)
    if not tokens:
        return np.empty(0, np.int64), np.empty(0)
    both = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    repeated = np.zeros(len(word), bool)
    repeated[1:] = word[1:] == word[:-1]
    shape = np.where(repeated, np.uint64(_AGAIN), shape)
    m = np.uint64(0x9E3779B97F4A7C15)
    shapes2 = shape[1:] * m + shape[:-1]
    grams = [word, word[1:] * m + word[:-1] + np.uint64(1), shape + np.uint64(2), shapes2 + np.uint64(3), shapes2[1:] * m + shape[:-2] + np.uint64(4)]
    mixed = np.concatenate(grams) * m
    places, counts = np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
    values = np.log1p(counts)
    return places, values / np.sqrt((values * values).sum())


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ftrl:
    """The learner's state: z and n of each place; the last place is the intercept, whose feature is BIAS."""

    def __init__(self):
        self.z, self.n = np.zeros(_SPACE + 1), np.zeros(_SPACE + 1)

    def weights(self, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[places]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[places])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w, n = self.weights(places), self.n[places]
        g = (_sigmoid(float(w @ values)) - label) * values
        self.z[places] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[places] = n + g * g


def passes(rows: int) -> int:
    return min(PASSES, max(2, VISITS // max(rows, 1)))


def ftrl(labelled: Iterable[tuple[str, int]], times: int | None = None) -> np.ndarray:
    """Weights after `times` passes over (text, label) in the given order (see `passes`); texts beyond MAX_BYTES are not used."""
    rows, held = [], 0
    for text, label in labelled:
        held += len(text.encode("utf-8", "surrogatepass"))
        if held > MAX_BYTES:
            break
        places, values = featurize(text)
        rows.append((np.append(places, _SPACE).astype(np.int32), np.append(values, BIAS).astype(np.float32), label))
    state = Ftrl()
    for _ in range(passes(len(rows)) if times is None else times):
        for row in rows:
            state.update(*row)
    return state.weights()


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, _h (hash of the id), _y, _text: a row for each of at most `most` labelled documents outside the held-out fold."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    picked = usable.groupBy("doc_id").agg(F.min("quality").alias("_y")).withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(most)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "_h", "_y").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAIN) -> np.ndarray:
    """Weights learnt from the sample in the order of its id hashes; the sample is bounded, so one task takes it."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = ftrl((text, int(y)) for pdf in parts for text, y in zip(pdf["_text"], pdf["_y"], strict=True))
        places = np.flatnonzero(w)
        yield pd.DataFrame({"place": places, "w": w[places]})

    ordered = sample(docs, labels, id_col, text_col, most).select("_h", "doc_id", "_text", "_y").repartition(1).sortWithinPartitions("_h", "doc_id")
    out = np.zeros(_SPACE + 1)
    got = ordered.mapInPandas(fit, "place long, w double").toPandas()  # at most 2^BITS + 1 rows
    out[got["place"].to_numpy(np.int64)] = got["w"].to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with _score, the chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in parts:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                places, values = featurize(text or "")
                out[i] = w[places] @ values + BIAS * w[_SPACE]
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return docs.withColumn("_score", scored(F.coalesce(F.col(text_col), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _score and _predicted (1 where the score reaches THRESHOLD)."""
    scored = score(docs, train(docs, labels, id_col, text_col), text_col)
    return scored.withColumn("_predicted", (F.col("_score") >= THRESHOLD).cast("int"))
