"""Token counts against the library itself."""

import json
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from sievework.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a  b\t\tc \n\n d   ", "   lead", "it's we'll I'M they've 's'", "12 34abc5 ½²", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|><|endoftext|>c", "  <|endoftext|>", "<|endof text|>",
    " x  y　", "é é ß", "ᲉꟜ \U00010ec2 \U0001ccf0x ࢏", "\U0001f600‍\U0001f600 ﻿ \x00\x00 \x85", "--- !!! ...?!a", "\r\n\r\n", "x" * 4000, "ab " * 9000, " " * 3000,
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def check(df, rows, library):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect())
    assert got == Counter((d, len((t or "").encode()), n, n > 512) for d, t in rows for n in [library(t)])


def test_documents_and_odd_texts(spark, docs, library):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(20_000 + i, t) for i, t in enumerate(ODD)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'p' as pre", "2 as pieces", "3 as _row").repartition(5)
    check(tc.count_tokens(table, PATH), rows, library)


def test_few_pretokens_are_broadcast(spark, docs, library, monkeypatch):
    monkeypatch.setattr(tc, "MOST_PIECES", 5)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()] + [(1, "the the the"), (2, None), (None, "")]
    check(tc.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH), rows, library)
    table = tc.vocabulary(docs, PATH)
    assert 0 <= table.where(tc.commonest(table)).count() <= 5


def test_code_points_are_cut_as_the_library_does(spark):
    """Pieces of texts with code points between letters, digits, marks and blanks: all of the first, the edges of what the
    JVM may not know, and a sample of the others."""
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    edges = {int(x, 16) + d for k in tc.classes() for x in re.findall(r"\{(\w+)\}", k) for d in (-1, 0, 1)}
    points = sorted({*range(0x3100), *edges, *range(0x3100, 0x110000, 97)} - set(range(0xD800, 0xE000)))
    texts = [(i, "".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)} {chr(c)}{chr(c)}" for c in points[i : i + 256])) for i in range(0, len(points), 256)]
    df = spark.createDataFrame(texts, "i long, text string").repartition(8).select("i", tc.pretokens(F.col("text"), []).alias("p"))
    text_of = dict(texts)
    for r in df.collect():
        want = [text_of[r["i"]][a:b] for _, (a, b) in cut(text_of[r["i"]])]
        assert r["p"] == want, r["i"]


def test_empty_table_and_wrong_tokenizers(spark, empty_docs, tmp_path):
    assert tc.count_tokens(empty_docs, PATH).count() == 0
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        tc.described(str(tmp_path / "t.json"))
