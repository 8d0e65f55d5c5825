"""Import review end to end, with the two rows known to be rejected."""

import json

from pyspark.sql import functions as F

from sievework.plans import review
from sievework.sources import tables


def question(ident, prompt, page, **more):
    base = {
        "externalId": ident, "prompt": prompt, "selectionMode": "single", "instruction": "Marque una", "options": [{"text": t} for t in ("detenerse", "continuar", "acelerar", "retroceder")],
        "correctOptionIndexes": [0], "publicExplanation": "Hay que detenerse", "sourcePageStart": page, "sourcePageEnd": page, "sourceReference": "Manual", "groundingExcerpt": "x", "reviewNotes": "", "tags": ["luz", " "],
    }
    return base | more


def make(tmp_path, spark):
    long = " ".join(f"palabra{i}" for i in range(12))
    four = [
        question("4-q001", "  Que   hace usted ante SeÃ±al alguna?", 40),
        question("4-q047", "Pregunta fuera de alcance", 109),
        question("4-q002", long, 41),
        question("4-q003", long + " otra", 41),
        question("", "Sin identificador propio", 42),
        question("4-q005", "¿Ya está en el banco?", 43),
    ]
    five = [question("5-q033", "Pregunta del anexo", 162)]
    for name, chapter, qs in (("a", "4", four), ("b", "chapter-5", five)):
        batch = {"batchId": f"batch-{name}", "editionId": "edition-2026", "chapterId": chapter, "sourceDocumentId": "manual" if name == "a" else "other", "questions": qs}
        (tmp_path / f"{name}.json").write_text(json.dumps(batch, ensure_ascii=False))
    bank = spark.createDataFrame([(1, "¿YA ESTA en el banco?")], "bank_id int, prompt string")
    return tables.read_batches(spark, str(tmp_path / "*.json")), bank


def test_review(spark, tmp_path):
    batches, bank = make(tmp_path, spark)
    batches = review.keyed(batches)
    items = review.reviewed(batches, bank).cache()
    got = {r["external_id"]: (r["status"], [e["code"] for e in r["errors"]]) for r in items.collect()}
    assert got == {
        "4-q001": ("accepted", []),
        "4-q047": ("rejected", ["chapter_scope_mismatch"]),
        "4-q002": ("rejected", ["near_duplicate_prompt_in_batch"]),
        "4-q003": ("rejected", ["near_duplicate_prompt_in_batch"]),
        "question-5": ("accepted", []),
        "4-q005": ("rejected", ["duplicate_prompt_existing_bank"]),
        "5-q033": ("rejected", ["chapter_scope_mismatch", "annex_scope_mismatch"]),
    }
    first = items.where("external_id = '4-q001'").first()
    assert first["prompt"] == "Que hace usted ante Señal alguna?" and [(c["field"], c["action"]) for c in first["changes"]] == [("prompt", "mojibake_recovered"), ("prompt", "whitespace_normalized")] and first["tags"] == ["luz"]

    of_batches = review.batch_issues(batches, "edition-2026", "manual")
    assert [r["code"] for r in of_batches.collect()] == ["invalid_source_document_id"]
    counts = {(r["questions"], r["accepted"], r["rejected"], r["warnings"], r["errors"]) for r in review.summary(items, of_batches).collect()}
    assert counts == {(6, 2, 4, 0, 4), (1, 0, 1, 0, 3)}
    listed = [(r["question_id"], r["code"]) for r in review.all_errors(items, of_batches).collect()]
    assert listed.index((None, "invalid_source_document_id")) < listed.index(("5-q033", "chapter_scope_mismatch")) < listed.index(("5-q033", "annex_scope_mismatch"))

    out = str(tmp_path / "out")
    review.write_artifacts(batches, items, of_batches, out, "2026-01-01")
    review.write_artifacts(batches, items, of_batches, out, "2026-01-02")  # a rerun
    assert spark.read.parquet(f"{out}/commits").count() == 4
    read = lambda kind, schema: review.read_artifacts(spark, out, kind, schema)
    assert read("accepted-candidates", "external_id string").count() == 2 and read("rejected-candidates", "external_id string").count() == 5
    assert {r["reviewed_at"] for r in read("review-log", "reviewed_at string").collect()} == {"2026-01-02"}
    assert read("review-summary", "value string").where("value like '# Import Review%'").count() == 2
    lines = review.report(batches, items, of_batches, "2026-01-01").orderBy("source_file", "position").collect()
    of = [[r["line"] for r in lines if r["source_file"].endswith(f)] for f in ("a.json", "b.json")]
    assert [r["position"] for r in lines] == [i for x in of for i in range(1, len(x) + 1)]
    assert of[1][:1] + of[1][7:] == [
        "# Import Review: batch-b", "- Total questions: 1", "- Accepted: 0", "- Rejected: 1", "- Warnings: 0", "- Errors: 3", "", "## Accepted items", "- None", "", "## Rejected items", "- `5-q033`",
        *(x for x in of[1] if x.startswith("  - ")), "", "## Normalization warnings", "- None", "", "## Next operator action", *review.NEXT_STEPS,
    ]
    assert "- `4-q001` prompt: mojibake_recovered" in of[0] and "- `batch` chapterId: chapter_id_normalized" in of[0]
    items.unpersist()


def test_batches_that_only_their_files_tell_apart(spark, tmp_path):
    """Two documents without an id, of one chapter and source document, are two batches."""
    for name in "ab":
        batch = {"batchId": "", "editionId": "edition-2026", "chapterId": "4", "sourceDocumentId": "manual", "questions": [question(f"q{i}", f"Pregunta número {name} {i} " + " ".join(f"{name}{i}palabra{j}" for j in range(6)), 40) for i in range(40)]}
        (tmp_path / f"{name}.json").write_text(json.dumps(batch))
    batches = review.keyed(tables.read_batches(spark, str(tmp_path / "*.json")))
    items = review.reviewed(batches, spark.createDataFrame([(1, "x")], "bank_id int, prompt string")).cache()
    assert items.count() == 80 and items.where("size(options) <> 4").count() == 0
    of_batches = review.batch_issues(batches, "edition-2026", "manual")
    assert [(r["questions"], r["errors"]) for r in review.summary(items, of_batches).collect()] == [(40, 1), (40, 1)]
    items.unpersist()


def test_lint_and_prompts(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("x = { prompt: 'It\\'s one', b: 1 }, { prompt: 'two' } SegÃºn")
    (tmp_path / "src/b.ts").write_text("SegÃºn")
    texts = tables.read_texts(spark, str(tmp_path), "*.ts")
    assert {r["prompt"] for r in tables.extract_prompts(texts).collect()} == {"It's one", "two"}
    found = tables.encoding_lint(texts, {"latin": "Ã.", "none": "ZZZ"}, allowed=["b.ts"]).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["pattern"], r["n"]) for r in found] == [("a.ts", "latin", 1)]
    assert tables.encoding_lint(texts, {"latin": "Ã."}).agg(F.sum("n")).first()[0] == 2


def test_artifacts_of_many_batches_are_few_files(spark, tmp_path):
    """Files go by tasks: sixty batches made 240 folders before."""
    for i in range(60):
        batch = {"batchId": f"b{i}", "editionId": "edition-2026", "chapterId": "4", "sourceDocumentId": "manual", "questions": [question(f"q{i}", " ".join(f"palabra{i}x{j}" for j in range(6)), 40)]}
        (tmp_path / f"{i:02d}.json").write_text(json.dumps(batch))
    batches = review.keyed(tables.read_batches(spark, str(tmp_path / "*.json")))
    items = review.reviewed(batches, spark.createDataFrame([(1, "x")], "bank_id int, prompt string"))
    out = str(tmp_path / "out")
    review.write_artifacts(batches, items, review.batch_issues(batches, "edition-2026", "manual"), out, "2026-01-01")
    assert len(list((tmp_path / "out").rglob("part-*.json"))) < 60
    lines = review.read_artifacts(spark, out, "review-summary", "position long, value string").collect()
    assert {(r["source_file"].rsplit("/", 1)[1], r["value"]) for r in lines if r["position"] == 1} == {(f"{i:02d}.json", f"# Import Review: b{i}") for i in range(60)}
