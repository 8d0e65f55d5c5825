"""Work is dealt out by rows, and what is made of a row is made once."""

import hashlib
import re

from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import reducer, rules, similarity
from sievework.plans import editorial, review, suggest
from sievework.session import spread, stored
from sievework.streaming import quiz as stream_quiz


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_dealt_out(spark):
    dealt = spread(spark.range(25_000).coalesce(1))
    assert dealt.rdd.getNumPartitions() == 3 and dealt.distinct().count() == 25_000
    assert spread(spark.range(0)).count() == 0
    for made in (editorial.raw_items, editorial.bank, editorial.suggestions, editorial.chunks):
        assert "Repartition" in optimized(made(spark, "/root/testdata/sf0.001"))


def test_texts_are_folded_once(spark):
    df = spark.range(2).selectExpr("id", "cast(id as string) as t")
    kept = similarity.tokenized(df, "id", "t").where("k1 is not null")
    assert optimized(kept).count("translate(") == 1 and kept.count() == 2


def test_issues_are_made_once(spark):
    df = spark.createDataFrame([(1, "published", "", "Marque una", "single", "a", [("no", True), ("NO", False)], None)], "id int, status string, source_reference string, instruction string, selection_mode string, prompt string, options array<struct<text:string,is_correct:boolean>>, match_kind string")
    flat = rules.exploded(rules.evaluate(df, rules.diagnostic_rules()), "id")
    assert "Filter" not in optimized(flat).split("Generate", 1)[1]
    assert [(r["ord"], r["code"]) for r in flat.orderBy("ord").collect()] == [(0, "source_reference"), (1, "weak_distractor"), (2, "weak_distractor"), (3, "weak_distractor")]
    assert "_folded" not in rules.evaluate(df, rules.diagnostic_rules()).columns


def test_white_space_of_all_kinds(spark):
    spaces = [chr(x) for x in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    texts = [f"{a}x{a}{b}ñ{b} {a}y{b}" for a in spaces for b in spaces] + ["", " ", "a~!b", "\x85a\u200b b"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for r in df.select("t", text.collapse(F.col("t")).alias("c"), review.cleaned(F.lit("q"), "prompt", F.col("t")).alias("w")).collect():
        want = re.sub(f"[{''.join(spaces)}]+", " ", r["t"]).strip(" ")
        assert r["c"] == r["w"]["text"] == want, ascii(r["t"])
        assert [x["action"] for x in r["w"]["changes"]] == ["whitespace_normalized"] * (want != r["t"])


def test_bank_of_edge_sizes(spark):
    words = [f"w{i:03d}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words[:41])), (2, "a b"), (3, None)], "id long, t string")
    bank = spark.createDataFrame([(1, " ".join(words[:51])), (2, " ".join(words[:50])), (3, " ".join(words[:33])), (4, "A  B"), (5, None)], "id long, t string")
    got = similarity.bank_match(similarity.tokenized(items, "id", "t"), similarity.tokenized(bank, "id", "t"))
    assert {r["id"]: (r["match_id"], r["kind"], round(r["similarity"], 9)) for r in got.collect()} == {1: (2, "near", 0.82), 2: (4, "exact", 1.0)}


def test_attempts_that_share_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_quiz, "BUCKETS", 2)
    quiz = spark.createDataFrame([(0, "q0", "single", ["a"], True), (1, "q1", "multiple", ["a", "b"], False)], "at int, question_id string, selection_mode string, correct array<string>, double_weight boolean")
    steps = ["toggle", "confirm", "next", "toggle", "toggle", "confirm", "confirm", "next", "toggle", "confirm"]
    rows = [((1 << 60) + a if a else None, i, steps[(i + a) % 10], "ab"[(i * 7 + a) % 2]) for a in range(20) for i in range(30)]
    log = spark.createDataFrame(rows, "attempt_id long, seq long, action string, option_id string")
    for at, part in enumerate((log.where("seq < 11"), log.where("seq >= 9"))):
        part.write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
        stream_quiz.run_to(stream_quiz.outcomes(stream, quiz, is_exam=True), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    want = reducer.outcomes(log, quiz, is_exam=True)
    read = lambda df: sorted((str(x[0]), *x[1:]) for x in map(tuple, df.select(*reducer.OUTCOME).collect()))
    assert read(spark.read.parquet(f"{tmp_path}/out")) == read(want)


def test_filters_on_what_is_made_stay_behind_the_dealing_out(spark):
    made = spread(spark.range(25_000).coalesce(1)).withColumn("made", F.md5(F.concat(F.lit("x"), "id")))
    found = made.where("made > 'f'")
    assert "Filter" not in optimized(found).split("Repartition", 1)[1]
    assert found.count() == sum(hashlib.md5(f"x{i}".encode()).hexdigest() > "f" for i in range(25_000))


def test_rewrites_are_made_once(spark):
    bank = editorial.questions(spark, "/root/testdata/sf0.001")
    assert optimized(suggest.rewrites(bank, "a", F.current_timestamp()).select("prompt")).count("en el enfoque") == 1


def test_questions_and_suggestions_are_stored_for_the_steps_that_read_them(spark, monkeypatch):
    names = []
    monkeypatch.setattr(suggest, "stored", lambda df, name: names.append(name) or stored(df, name))
    found, _ = editorial._generated(spark, "/root/testdata/sf0.001")
    assert "questions" in names and "md5(" not in optimized(found.where("suggestion_type <> 'new_question'")).split("s_suppkey")[0]
    suggest.verified(editorial.suggestions(spark, "/root/testdata/sf0.001"), editorial.questions(spark, "/root/testdata/sf0.001"))
    assert names.count("suggestions") == 1


def test_classes_of_letters_are_tables(spark):
    texts = ["", "ab", "abc", "ab abc0 a_b-xyz9ñ ab12", "A-Z ABC", "zz__zzz  000", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select("t", text.folded_tokens(F.col("t")).alias("w"), text.bare(F.col("t")).alias("b"), text.slug(F.col("t")).alias("s"), text.has_word(F.col("t"), ["ab", "abc"]).alias("h"))
    for r in got.collect():
        t = r["t"]
        assert r["w"] == (None if t is None else [x for x in re.split("[^a-z0-9]+", t) if len(x) >= 3])
        assert r["b"] == (None if t is None else re.sub("[^a-z0-9 ]", "", t).strip(" "))
        assert r["s"] == (None if t is None else re.sub("[^A-Za-z0-9-]", "-", t).lower())
        assert r["h"] == (None if t is None else bool(re.search("(?<![A-Za-z0-9_])(?:ab|abc)(?![A-Za-z0-9_])", t)))
    assert "a-z" not in optimized(got)
