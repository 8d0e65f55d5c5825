"""Text functions on hand-made edge cases."""

import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.functions import text


def one(spark, f, *values):
    """f over the values as one column."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["x"] for r in rows.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_collapse_knows_all_white_space(spark):
    assert one(spark, text.collapse, " a  b﻿", "\r\n", "a\tb", None) == ["a b", "", "a b", None]


def test_topics_are_the_first_two_tags_that_are_not_blank(spark):
    tags = [["\u00a0vía  libre ", " ", "zona-30", "c"], ["\t", "punto-ciego"], ["", "\ufeff"], [], None]
    df = spark.createDataFrame(list(enumerate(tags)), "i int, tags array<string>")
    got = df.select("i", text.topic_key(F.col("tags")).alias("k"), text.topic_title(F.col("tags")).alias("t")).orderBy("i").collect()
    assert [(r["k"], r["t"]) for r in got] == [("vía libre-zona-30", "Vía libre y Zona 30"), ("punto-ciego", "Punto Ciego"), ("", ""), ("", ""), (None, None)]


def test_fold_composed_and_decomposed(spark):
    assert one(spark, text.fold, "  Ñandú  É", "Éx", "ÅNGSTRÖM", "ß") == ["nandu e", "ex", "angstrom", "ß"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cc", "Cs"]), max_size=20), min_size=1, max_size=8))
def test_fold_equals_decomposition(spark, values):
    def plain(x):
        bare = "".join(c for c in unicodedata.normalize("NFD", x) if not 0x300 <= ord(c) <= 0x36F)
        return " ".join(bare.replace("İ", "i").lower().replace(" ", " ").split(" ")).strip()

    got = one(spark, text.fold, *values)
    assert [" ".join(g.split()) for g in got] == [" ".join(plain(v).split()) for v in values]


def test_tokens_keep_repeats_and_drop_short_ones(spark):
    assert one(spark, text.tokens, "La señal de PARE, la señal!", "a b", "...") == [["senal", "pare", "senal"], [], []]


def test_jaccard_at_the_threshold(spark):
    df = spark.createDataFrame([(list(map(str, range(41))), list(map(str, range(50)))), ([], []), (["a"], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.82, 0.0, 0.0]


MARKS = re.compile("Ã[^\n\r\u2028\u2029]|Â[^\n\r\u2028\u2029]|â€|ï¿½")


def plain_repair(x, lenient):
    """The repair in plain Python."""
    score = lambda s: len(MARKS.findall(s)) + (0 if lenient else 2 * s.count("\ufffd"))
    if not MARKS.search(x):
        return x
    for _ in range(2):
        again = bytes(c.encode("utf-16-be")[1] for c in x).decode("utf-8", "replace").removeprefix("\ufeff")
        if score(again) >= score(x):
            break
        x = again
    return x


@pytest.mark.parametrize("lenient", [False, True])
def test_repair(spark, lenient):
    rnd = random.Random(1)
    cases = ["SegÃºn", "Según", "SegÃºn el niÃ±o", "Ã©tÃ© – pâte", "château", "Ãrea", "Â¿QuÃ©?", "dice â€œholaâ€\x9d", "Ã\x83Âº doble", "Ã", "Ã\n", "ï»¿Ã©", "\U0001f600 Ã©", "", "Â Â", "ï¿½x"]
    cases += ["".join(rnd.choice("aÃÂâ€©ºï¿½\x80\x93\xbb\ufffd\u20ac z\xe2\xc3\xf0\x9f\u2013\U0001f600") for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    got = one(spark, lambda c: text.repair(c, lenient), *cases, None)
    assert got == [*(plain_repair(x, lenient) for x in cases), None]
    assert one(spark, lambda c: text.repair(c, lenient), "Ã©tÃ© – pâte", "château") == ["été \x13 p\ufffdte" if lenient else "Ã©tÃ© – pâte", "château"]


@pytest.mark.parametrize(("given_", "want"), [("7", "chapter-7"), (" 12 ", "chapter-12"), (" x ", "x"), (None, "")])
def test_chapter_id(spark, given_, want):
    assert one(spark, text.chapter_id, given_) == [want]


def test_slug_rewrite_and_titles(spark):
    assert one(spark, text.slug, "Ai:New q_1-Ñ") == ["ai-new-q-1--"]
    lead = ["seg[uú]n el manual,"]
    assert one(spark, lambda c: text.rewrite(c, lead), "Según el manual,  qué es", "según el manual, ¿qué?", "Qué es", "qué es") == ["Qué es", "¿qué?", None, "Qué es"]
    assert one(spark, text.title_from_slug, "luz-alta") == ["Luz Alta"]


def test_numbers(spark):
    got = one(spark, text.number, "12", " ", None, "x", "-1.5")
    assert got[:3] == [12.0, 0.0, 0.0] and got[3] != got[3] and got[4] == -1.5
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.49,)], "x double")
    assert [r[0] for r in df.select(text.round_half_up(F.col("x"))).collect()] == [3, -2, 0]


def test_json_is_salvaged(spark):
    assert one(spark, text.json_object, '{"a":1}', 'so: {"a":\n1} end', "no", "{bad", None) == ['{"a":1}', '{"a":\n1}', None, None, None]


def test_words_between_ascii_borders(spark):
    assert one(spark, lambda c: text.has_word(c, ["una", "un"]), "una sola", "ñuna", "ninguna", "un.") == [True, True, False, True]


def test_small_ones(spark):
    assert one(spark, text.first_underscore_to_space, "new_question_x", "x") == ["new question_x", "x"]
    df = spark.createDataFrame([([1, 2], 2, "9", 4), ([1], 2, "x", 0), ([], 1, None, 3)], "a array<int>, x int, w string, n int")
    assert [tuple(r) for r in df.select(text.toggle(F.col("a"), F.col("x")), text.clamp_size(F.col("w"), F.col("n"))).collect()] == [([1], 4), ([1, 2], 1), ([1], 1)]
    assert [r[0] for r in df.select(text.percent(F.col("x"), F.col("n"))).collect()] == [50.0, 0.0, pytest.approx(100 / 3)]


def test_rewritten_leads_agree_with_their_sql(spark, tmp_path):
    """Capitals of one character, and white space as the SQL's patterns know it."""
    import duckdb

    from sievework.plans import bindings

    texts = ["ßachzu  |", "In ß tek", "ŉ a", "ﬁn", "ᾳ x", "the\u00a0end", "the \u00a0 end\u2003x", "a \u2028", "b\u3000 ", "of\x0bx", "and\x0b  y", "the", "the ", "", None, "A b", "a\tb ", "¿the x", "of of  x", "ǆ"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = dict(con.execute(bindings.ORACLES["rewrite_leads"]).fetchall())
    assert {r["doc_id"]: r["rewritten"] for r in bindings.rewrite_leads(spark, str(tmp_path)).collect()} == want
