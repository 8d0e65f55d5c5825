"""Token counts without token ids.

A byte-level BPE tokenizer first cuts a text into pre-tokens by a pattern, and then each pre-token into pieces by itself.
So the pieces of a text are the sum over its pre-tokens:

1. The JVM cuts all texts and counts each distinct pre-token of the corpus. Strings of added tokens in a text are
   pre-tokens of their own, as the library takes them by default.
2. The library counts the pieces of each distinct pre-token once; the table is stored.
3. Texts are cut again and each pre-token meets its pieces. The commonest pre-tokens, at most MOST_PIECES and MOST_BYTES of
   them, are broadcast, and add up to one number a document before anything moves. Frequencies of the others by
   document are shuffled to their pieces, and their sums back to the document. None of these is hot: a hot
   pre-token is among the commonest.

The pattern's classes of letters and digits are those of the library, which may know a newer Unicode than the JVM does:
code points that the JVM has not assigned are classed as the library does (see `classes`).

Edge cases: null and empty texts have no tokens; each row is counted by itself, so repeated rows and null ids change
nothing; a pre-token of any length is encoded whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import stored, whole

LIMIT = 512
#: Bounds of the pre-tokens that are broadcast with their pieces.
MOST_PIECES, MOST_BYTES = 500_000, 16 << 20
#: The white space of the pattern, and the endings that it cuts off.
SPACE = r"\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
ENDINGS = r"'s|'t|'re|'ve|'m|'ll|'d"


def described(path: str) -> tuple[str, list[str]]:
    """The tokenizer's file as text, and the strings of its added tokens, longest first. An error for other kinds of tokenizers."""
    text = Path(path).read_text(encoding="utf-8")
    spec = json.loads(text)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
    if not plain or any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError(f"{path} is no byte-level tokenizer without normalizer whose pieces depend on pre-tokens alone")
    return text, sorted((x["content"] for x in added), key=lambda x: (-len(x), x))


@functools.cache
def classes() -> tuple[str, str]:
    """Ranges of the code points that the library has as letters and as digits, for character classes. Those that the oldest
    Unicode at hand had assigned are left out: the JVM has them as well."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    found: dict[str, list[int]] = {"a": [], "1": []}
    blocks = [range(i, i + 4096) for i in range(0x110000 - 4096, -1, -4096)]
    while blocks:
        block = blocks.pop()
        points = [c for c in block if unicodedata.ucd_3_2_0.category(chr(c)) == "Cn"]
        if len(cut("!" + "".join(map(chr, points)) + "!")) == 1:
            continue  # all of them are marks
        if len(block) > 32:
            blocks += [block[len(block) // 2 :], block[: len(block) // 2]]
            continue
        for mark, mine in found.items():
            # between two letters (or digits), a code point of the same class makes one pre-token of three
            mine += [points[at // 4] for _, (at, end) in cut("".join(f"{mark}{chr(c)}{mark}!" for c in points)) if end - at == 3 and at % 4 == 0]
    return _ranges(found["a"]), _ranges(found["1"])


def _ranges(points: list[int]) -> str:
    """Rising code points as ranges of a character class."""
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


def pattern() -> str:
    """The pattern of pre-tokens."""
    letters, digits = (rf"\p{{{k}}}[\p{{Cn}}&&[{x}]]" for k, x in zip("LN", classes(), strict=True))
    return rf"{ENDINGS}| ?[{letters}]+| ?[{digits}]+| ?[^{SPACE}{letters}{digits}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def pretokens(text: Column, added: list[str]) -> Column:
    """The pre-tokens of text, those of added tokens last."""
    cut = lambda c: F.regexp_extract_all(c, F.lit(pattern()), F.lit(0))
    if not added:
        return cut(text)
    strings = "|".join(rf"\Q{x}\E" for x in added)
    parts = F.concat(F.flatten(F.transform(F.split(text, strings, -1), cut)), F.regexp_extract_all(text, F.lit(strings), F.lit(0)))
    holds = F.lit(False)
    for x in added:
        holds = holds | F.contains(text, F.lit(x))
    return F.when(holds, parts).otherwise(cut(text))


def vocabulary(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """pre, n (occurrences in the corpus), pieces, of each distinct pre-token; stored."""
    spec, added = described(path)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(shared.value)
        for pdf in parts:
            encoded = tokenizer.encode_batch_fast(pdf["pre"].tolist(), add_special_tokens=False)
            yield pdf.assign(pieces=[len(e) for e in encoded])

    counts = docs.select(F.explode(pretokens(whole(F.col(text_col)), added)).alias("pre")).groupBy("pre").agg(F.count(F.lit(1)).alias("n"))
    return stored(counts.mapInPandas(encode, "pre string, n long, pieces long"), "pretokens")


def commonest(table: DataFrame) -> Column:
    """Which pre-tokens are broadcast: those of at least a frequency, the least at which all of them are within the bounds.
    The bounds are looked up in totals by powers of two of the frequency, 64 rows at most."""
    power = F.floor(F.log2("n")).cast("int")
    totals = table.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("pre")).alias("bytes")).orderBy(F.desc("power")).collect()
    least, rows, size = 64, 0, 0
    for t in totals:
        rows, size = rows + t["rows"], size + t["bytes"]
        if rows > MOST_PIECES or size > MOST_BYTES:
            break
        least = t["power"]
    return power >= least


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of docs: the id, n_bytes, n_tokens, over_limit. path: a byte-level tokenizer's JSON file, read on the driver."""
    table = vocabulary(docs, path, text_col)
    common = commonest(table)
    text = whole(F.col(text_col))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    key = ["_row", "_id", "n_bytes"]
    flat = rows.select(*key, F.explode_outer(pretokens(F.col("_text"), described(path)[1])).alias("pre"))
    met = flat.join(F.broadcast(table.where(common).select("pre", "pieces")), "pre", "left")
    known = F.col("pieces").isNotNull() | F.col("pre").isNull()
    per = met.groupBy(*key, F.when(~known, F.col("pre")).alias("pre")).agg(F.count(F.lit(1)).alias("times"), F.sum("pieces").alias("sum"))
    # the sums of common pre-tokens stay where they are dealt: a key of their own, which no pre-token has, spreads them
    spread = per.withColumn("_key", F.coalesce("pre", F.concat(F.lit("\0"), F.col("_row").cast("string"))))
    rare = table.where(~common).select(F.col("pre").alias("_pre"), F.col("pieces").alias("_pieces"))
    tokens = F.coalesce("sum", F.col("times") * F.col("_pieces"), F.lit(0))
    done = spread.join(rare, F.col("_key") == F.col("_pre"), "left").groupBy(*key).agg(F.sum(tokens).cast("long").alias("n_tokens"))
    return done.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
