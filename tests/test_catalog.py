"""Catalog, workflow, sampling, suggestions and writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievework.operators import catalog, coverage, quiz, workflow
from sievework.plans import suggest
from sievework.sources import tables

OPTIONS = "array<struct<id:string,label:string,text:string,is_correct:boolean,order:int>>"
QUESTION = f"id string, edition_id string, chapter_id string, prompt string, selection_mode string, instruction string, source_document_id string, source_page int, source_reference string, explanation string, public_explanation string, status string, is_official_exam_eligible boolean, double_weight boolean, reviewed_at timestamp, published_at timestamp, updated_by string, options {OPTIONS}"
NOW = "2030-01-01 00:00:00"
OLD = dt.datetime(2020, 1, 1)


def question(i, **more):
    base = {
        "id": f"q{i}", "edition_id": "e", "chapter_id": "chapter-1", "prompt": f"Pregunta número {i} sobre tema {i * 7}", "selection_mode": "single", "instruction": "Marque una", "source_document_id": "s",
        "source_page": 3, "source_reference": "r", "explanation": "x", "public_explanation": "x", "status": "published", "is_official_exam_eligible": True, "double_weight": False, "reviewed_at": OLD,
        "published_at": OLD, "updated_by": "a", "options": [(f"q{i}-opt-a", "A", "detenerse", True, 1), (f"q{i}-opt-b", "B", "continuar", False, 2)],
    }
    return tuple((base | more).values())


@pytest.fixture(scope="module")
def questions(spark):
    rows = [question(i, double_weight=i < 4) for i in range(12)] + [question(90, status="draft"), question(91, is_official_exam_eligible=False)]
    return spark.createDataFrame(rows, QUESTION).cache()


def test_exam_takes_the_quotas(questions):
    got = quiz.exam(questions, "seed", double=3, regular=8).collect()
    assert sum(r["double_weight"] for r in got) == 3 and len(got) == 11 and sorted(r["position"] for r in got) == list(range(1, 12))
    assert [r["id"] for r in got] == [r["id"] for r in quiz.exam(questions, "seed", 3, 8).collect()]
    with pytest.raises(ValueError, match="too few"):
        quiz.exam(questions, "seed", double=5, regular=8).count()
    assert quiz.practice(questions, ["chapter-1"], "s", 50).count() == 13 and quiz.practice(questions, ["chapter-2"], "s", 5).count() == 0


def test_grading_and_scores(spark, questions):
    answers = spark.createDataFrame([("t", 1, "q0", ["q0-opt-a"]), ("t", 2, "q5", ["q5-opt-b"]), ("t", 3, "q6", ["q6-opt-a"]), ("t", 4, "zz", [])], "attempt_id string, seq int, question_id string, selected array<string>")
    got = quiz.graded(answers, questions, is_exam=True).cache()
    assert [r["points_earned"] for r in got.orderBy("seq").collect()] == [2, 0, 1, 0]
    s = quiz.score(got, passing=3).first()
    assert (s["correct"], s["incorrect"], s["points"], s["pct"], s["tier"], s["passed"]) == (2, 2, 3, 50, "low", True)
    last = quiz.with_outcomes(questions, got).where("is_correct is not null")
    assert {r["id"] for r in last.collect()} == {"q0", "q5", "q6"}
    assert quiz.pilot_budget("mixed", 3) == (2, 1) and quiz.pilot_budget("mixed", 1) == (1, 0) and quiz.pilot_budget("new", 4) == (4, 0)


@pytest.mark.parametrize(
    ("action", "status", "dates", "want"),
    [
        ("save_draft", "published", (OLD, OLD), ("draft", OLD, None)),
        ("mark_reviewed", "draft", (None, OLD), ("reviewed", "now", None)),
        ("publish", "draft", (None, None), ("published", "now", "now")),
        ("publish", "published", (OLD, OLD), ("published", OLD, "now")),
        ("archive", "published", (OLD, OLD), ("archived", OLD, OLD)),
        ("save", "published", (None, None), ("published", "now", "now")),
        ("save", "draft", (None, None), ("draft", None, None)),
        ("seed", "reviewed", (None, OLD), ("reviewed", None, OLD)),
    ],
)
def test_transitions(spark, action, status, dates, want):
    df = spark.createDataFrame([(status, *dates, action)], "s string, r timestamp, p timestamp, a string")
    now = F.lit(NOW).cast("timestamp")
    got = df.select(*workflow.transition(F.col("s"), F.col("r"), F.col("p"), F.col("a"), now)).first()
    assert tuple(got) == tuple(dt.datetime(2030, 1, 1) if x == "now" else x for x in want)


def test_requests_write_events_or_are_refused(spark, questions):
    bad = question(50, status="draft", options=[], reviewed_at=None, published_at=None)
    asked = questions.union(spark.createDataFrame([bad], QUESTION))
    requests = spark.createDataFrame([("q90", "publish", "me"), ("q50", "publish", "me"), ("q1", "archive", "me")], "id string, action string, actor string")
    good, events, refused = workflow.applied(asked, requests, F.lit(NOW).cast("timestamp"))
    assert {(r["id"], r["status"], r["updated_by"]) for r in good.collect()} == {("q90", "published", "me"), ("q1", "archived", "me")}
    assert {r["id"] for r in events.collect()} == {"event-q90-publish-1893456000000", "event-q1-archive-1893456000000"}
    assert [(r["id"], [i["code"] for i in r["issues"]]) for r in refused.collect()] == [("q50", ["two_options_required", "answer_required", "single_answer_required"])]


def test_overlay_precedence(spark):
    editions = "id string, code string, is_active boolean, effective_from date"
    chapters, plain = "id string, edition_id string, title string, display_order int", "id string, title string, edition_id string, question_id string, prompt string"
    rules = spark.createDataFrame([("exam", None)], "code string, edition_id string")

    def make(who, ids):
        rows = lambda: spark.createDataFrame([(i, f"{who}-{i}", "e1", i, who) for i in ids], plain)
        e = spark.createDataFrame([(f"e{n}", None if who == "remote" and n == 2 else f"{who}{n}", who == "remote" and n == 2, None) for n in (1, 2)], editions)
        c = spark.createDataFrame([(i, "e1", f"{who}-{i}", ord(i)) for i in ids], chapters)
        return catalog.Catalog(e, c, rows(), rows(), rows(), rules)

    done = catalog.with_floor(make("remote", "bc"), make("seed", "ab"))
    titles = lambda df: {r["id"]: r["title"] for r in df.collect()}
    assert titles(done.chapters) == titles(done.sources) == {"a": "seed-a", "b": "seed-b", "c": "remote-c"}
    assert titles(done.questions) == titles(done.events) == {"a": "seed-a", "b": "remote-b", "c": "remote-c"}
    assert {(r["id"], r["code"], r["is_active"]) for r in done.editions.collect()} == {("e1", "remote1", False), ("e2", "seed2", True)}
    assert done.rules.first()["edition_id"] == "e2"
    assert catalog.scoped(done, "e9").questions.count() == 0


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 11)], "id int, v string, at int")
    new = spark.createDataFrame([(2, "B", 0), (3, "C", 0)], "id int, v string, at int")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(tables.upsert(old, new, ["id"])) == {(1, "a", 10), (2, "B", 0), (3, "C", 0)}
    by = [F.col("at"), F.col("v")]
    assert rows(tables.prepend(old, new, "id", "at", by)) == {(1, "a", 10), (2, "B", 11), (3, "C", 9)}
    assert rows(tables.newest_first(old, new.where("id = 2"), "id", "at", by)) == {(1, "a", 10), (2, "B", 9)}
    several = spark.createDataFrame([(7, "x", 1), (2, "y", 2), (8, "z", 3), (7, "w", 4), (2, "q", 5)], old.schema)
    assert rows(tables.prepend(old, several, "id", "at", by)) == {(8, "z", 8), (7, "w", 9), (1, "a", 10), (2, "q", 11)}
    assert rows(tables.append(old, several, "id", "at", by)) == {(1, "a", 10), (2, "q", 11), (7, "w", 12), (8, "z", 13)}
    assert rows(tables.newest_first(old, several, "id", "at", by)) == {(2, "q", 7), (7, "w", 8), (8, "z", 9), (1, "a", 10)}
    assert rows(tables.prepend(old.limit(0), several, "id", "at", by)) == {(7, "w", -1), (2, "q", -2), (8, "z", -3)}
    assert rows(tables.update_where(old, F.col("id") == 1, v=F.lit("z"))) == {(1, "z", 10), (2, "b", 11)}
    assert rows(tables.delete_where(old, F.col("id") == 1)) == {(2, "b", 11)}
    assert tables.seeded(old, new) is old and tables.seeded(old.limit(0), new) is new
    assert tables.single(old.where("id = 1")).count() == 1
    with pytest.raises(ValueError, match="several"):
        tables.single(old)
    path = tables.write_snapshot(old, str(tmp_path), "t")
    assert spark.read.parquet(path).count() == 2
    assert not tables.has_table(spark, str(tmp_path), "none") and tables.schema_version(spark, str(tmp_path)) == "seed"
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.StringType())])
    defaults = spark.createDataFrame([(0, "d")], kind)
    (tmp_path / "s.json").write_text('{"id": 5}')
    (tmp_path / "bad.json").write_text('{"id": ')
    read = lambda n: tuple(tables.read_snapshot(spark, str(tmp_path / n), kind, defaults).first())
    assert (read("s.json"), read("bad.json"), read("none.json")) == ((5, "d"), (0, "d"), (0, "d"))


def test_suggestions(spark, questions):
    odd = [question(30, prompt="Según el manual, qué indica la luz"), question(31, prompt="Otra cosa", options=[("x", "A", "no", False, 1), ("y", "B", "continuar", True, 2)])]
    qs = questions.limit(3).union(spark.createDataFrame(odd, QUESTION))
    candidate = "struct<prompt:string,selection_mode:string,instruction:string,options:array<string>,correct:array<int>,public_explanation:string,review_notes:string>"
    chunks = spark.createDataFrame(
        [("c1", "e", "chapter-1", "s", "ref", "g", "why", ("otra  COSA", "single", "i", ["a", "b"], [0], "x", "")), ("c2", "e", "chapter-1", "s", "ref", "g", "why", ("Nueva pregunta", "single", "Marque una", ["detenerse", "continuar"], [0], "x", "")), ("c3", "e", "chapter-1", "s", "ref", "g", "why", None)],
        f"id string, edition_id string, chapter_id string, source_document_id string, reference_label string, grounding_summary string, rationale string, candidate {candidate}",
    )
    chapters = spark.createDataFrame([("chapter-1", "e", "C1", "T", "d"), ("chapter-2", "e", "C2", "T2", "d2")], "id string, edition_id string, code string, title string, description string")
    now = F.lit(NOW).cast("timestamp")
    cat = catalog.Catalog(None, chapters, None, qs, None, None)
    made, run = suggest.generate(cat, chunks, "e", "me", now)
    got = {(r["suggestion_type"], r["dedupe_key"]) for r in made.collect()}
    assert {("new_question", "new-question:c2"), ("rewrite", "rewrite:q30"), ("coverage_gap", "coverage-gap:chapter-2"), ("flag", "flag:q31:weak-distractors")} <= got
    assert not any("c1" in k or "c3" in k for _, k in got)
    totals = run.first()
    assert totals["generatedCount"] == len(got) and totals["newQuestionCount"] == 1 and totals["rewriteCount"] == 1
    d = {r["id"]: r for r in suggest.drafts(made, "me").collect()}
    assert set(d) == {"q30", "ai-ai-new-question-c2"} and d["q30"]["prompt"] == "Qué indica la luz" and d["q30"]["options"][0]["id"] == "q30-opt-a"
    raw = spark.createDataFrame(
        [("c2", "new_question", 'Sure: {"prompt":" Nueva ","selectionMode":"single","instruction":"Marque una","options":["detenerse","continuar"],"correctOptionIndexes":[0]} ok'), ("c9", "new_question", "no json")], "key string, kind string, raw_output string"
    ).select("*", *[F.lit(v).alias(c) for c, v in {"edition_id": "e", "chapter_id": "chapter-1", "source_document_id": "s", "source_reference": "r", "grounding": "g", "rationale": "w"}.items()], F.lit(None).cast("string").alias("target_question_id"))
    records = suggest.pilot_records(raw, qs, "me", now).cache()
    status = {r["dedupe_key"]: r["verifier_status"] for r in records.collect()}
    assert status == {"pilot:new_question:c2": "passed", "pilot:new_question:c9": "failed"}
    assert coverage.pilot_summary(records).first().asDict() == {"attempted": 2, "passed": 1, "failed": 1, "new_questions": 2, "rewrites": 0}
