"""Suggestions: new questions from prepared chunks, rewrites, flags from diagnostics, coverage gaps; drafts from them;
and records of a pilot whose raw model outputs are a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import catalog, coverage, quiz, rules, similarity, workflow
from sievework.operators.order import numbered
from sievework.session import stored

#: Lead-ins that a rewrite drops, and the confidence of each kind of suggestion.
LEAD_INS = ["seg[uú]n el manual,", "en el enfoque de sistema seguro,"]
CONFIDENCE = {"new_question": 0.73, "rewrite": 0.58, "flag": 0.81, "coverage_gap": 0.92}
PILOT_CONFIDENCE = {"new_question": 0.45, "rewrite": 0.38}

SUGGESTION = (
    "id", "edition_id", "chapter_id", "source_document_id", "source_reference", "suggestion_type", "status", "prompt", "selection_mode", "instruction", "suggested_options",
    "suggested_correct_answers", "public_explanation", "review_notes", "grounding_excerpt", "rationale", "confidence", "dedupe_key", "target_question_id", "created_by", "created_at",
)


def _suggestions(df: DataFrame, kind: str, key: Column, actor: str, now: Column, **columns: Column) -> DataFrame:
    """Rows in the form of suggestions; what is not given is null or empty."""
    text_null = F.lit(None).cast("string")
    given = {
        "id": F.concat(F.lit("ai-"), text.slug(key)), "suggestion_type": F.lit(kind), "status": F.lit("pending"), "confidence": F.lit(CONFIDENCE[kind]).cast("decimal(4,3)"), "dedupe_key": key,
        "created_by": F.lit(actor), "created_at": now, "suggested_options": F.expr("cast(array() as array<string>)"), "suggested_correct_answers": F.expr("cast(array() as array<int>)"),
    }
    given |= columns
    return df.select(*[given.get(c, text_null).alias(c) for c in SUGGESTION])


def reference(df: DataFrame) -> Column:
    return F.coalesce("source_reference", F.concat(F.lit("Pág. "), F.col("source_page").cast("string")))


def answer_indexes(options: str) -> Column:
    """Places of the correct options."""
    marked = F.transform(options, lambda o, i: F.when(o["is_correct"], i))
    return F.array_compact(marked)


def new_questions(chunks: DataFrame, questions: DataFrame, actor: str, now: Column) -> DataFrame:
    """Candidates of prepared chunks whose prompt the bank lacks."""
    flat = chunks.where("candidate is not null").withColumn("prompt", F.col("candidate.prompt"))
    fresh = similarity.not_in_bank(flat, questions, "prompt", "prompt")
    c = lambda n: F.col(f"candidate.{n}")
    return _suggestions(
        fresh, "new_question", F.concat(F.lit("new-question:"), F.col("id")), actor, now,
        edition_id=F.col("edition_id"), chapter_id=F.col("chapter_id"), source_document_id=F.col("source_document_id"), source_reference=F.col("reference_label"), prompt=F.col("prompt"),
        selection_mode=c("selection_mode"), instruction=c("instruction"), suggested_options=c("options"), suggested_correct_answers=c("correct"), public_explanation=c("public_explanation"),
        review_notes=c("review_notes"), grounding_excerpt=F.col("grounding_summary"), rationale=F.col("rationale"),
    )


def _of_question(q: DataFrame) -> dict[str, Column]:
    return {
        "edition_id": F.col("edition_id"), "chapter_id": F.col("chapter_id"), "source_document_id": F.col("source_document_id"), "source_reference": reference(q), "selection_mode": F.col("selection_mode"),
        "instruction": F.col("instruction"), "suggested_options": F.transform("options", lambda o: o["text"]), "suggested_correct_answers": answer_indexes("options"),
        "public_explanation": F.col("public_explanation"), "target_question_id": F.col("id"),
    }


def rewrites(questions: DataFrame, actor: str, now: Column) -> DataFrame:
    """Questions whose prompt a rewrite changes."""
    # a generator of one row, as in tokenized: the filter does not pass it, and prompts are rewritten once
    changed = questions.select("*", F.explode(F.array(text.rewrite(F.col("prompt"), LEAD_INS))).alias("_new")).where("_new is not null and _new <> ''")
    grounding = F.coalesce("public_explanation", "explanation", reference(changed))
    own = _of_question(changed) | {"prompt": F.col("_new"), "grounding_excerpt": grounding, "review_notes": F.lit("Shorter stem."), "rationale": F.lit("The prompt has a lead-in that adds nothing.")}
    return _suggestions(changed, "rewrite", F.concat(F.lit("rewrite:"), F.col("id")), actor, now, **own)


def _position(df: DataFrame) -> Column:
    """The place of a row in its catalog; null where the table has none."""
    return (F.col("position") if "position" in df.columns else F.lit(None)).cast("long").alias("position")


def entities(questions: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Reviewable entities: questions, then suggestions with options, mode and instruction; `position` is the catalog order."""
    q = questions.select(F.lit("question").alias("entity_type"), "id", _position(questions), "prompt", "instruction", "selection_mode", "source_reference", "status", F.transform("options", lambda o: F.struct(o["text"].alias("text"), o["is_correct"].alias("is_correct"))).alias("options"))
    if suggestions is None:
        return q
    ok = suggestions.where((F.col("suggestion_type") != "coverage_gap") & (F.size("suggested_options") > 0) & F.col("selection_mode").isNotNull() & (F.coalesce("instruction", F.lit("")) != ""))
    answers = F.col("suggested_correct_answers")
    s = ok.select(F.lit("suggestion").alias("entity_type"), "id", _position(ok), "prompt", "instruction", "selection_mode", "source_reference", F.lit(None).cast("string").alias("status"), F.transform("suggested_options", lambda o, i: F.struct(o.alias("text"), F.array_contains(answers, i).alias("is_correct"))).alias("options"))
    return q.unionByName(s)


def diagnosed(ents: DataFrame, with_source: bool = True) -> DataFrame:
    """A row a diagnostic: entity, ord, category (code), severity, title (message), id. First matches go by peer order:
    questions before suggestions, then catalog order, then id. A peer of the same id is skipped, whatever its type."""
    keyed = stored(ents.withColumn("_key", F.struct("entity_type", "position", "id")), "entities")
    sets = similarity.tokenized(keyed.withColumnRenamed("id", "_own"), "_key", "prompt", "_own")
    match = similarity.first_match(sets, skip="_own").select(F.col("id").alias("_key"), F.col("kind").alias("match_kind"))
    matched = match.select(F.col("_key.entity_type").alias("_type"), F.col("_key.id").alias("_mid"), "match_kind")
    joined = keyed.join(matched, (F.col("entity_type") == F.col("_type")) & (F.col("id") == F.col("_mid")), "left")
    checked = rules.evaluate(joined.drop("_key", "_type", "_mid"), rules.diagnostic_rules(with_source))
    flat = rules.exploded(checked, "entity_type", "id", "source_reference")
    return flat.withColumn("diagnostic_id", rules.diagnostic_id(F.col("entity_type"), F.col("id"), F.col("code"), F.col("message"))).drop("source_reference")


def diagnostic_map(diagnostics: DataFrame) -> DataFrame:
    """All diagnostics of an entity in one row."""
    return diagnostics.groupBy("entity_type", "id").agg(F.array_sort(F.collect_list(F.struct("ord", "code", "severity", "message"))).alias("diagnostics"))


def flags(questions: DataFrame, diagnostics: DataFrame, actor: str, now: Column) -> DataFrame:
    """A flag for each diagnostic of a question."""
    d = diagnostics.where("entity_type = 'question'").select(F.col("id").alias("_q"), "message")
    joined = questions.join(d, questions["id"] == d["_q"])
    key = F.concat(F.lit("flag:"), F.col("id"), F.lit(":"), F.regexp_replace(F.lower("message"), f"{text.SPACE}+", "-"))
    own = _of_question(joined) | {"prompt": F.col("prompt"), "review_notes": F.col("message"), "grounding_excerpt": F.col("message"), "rationale": F.lit("A diagnostic asks for a look.")}
    return _suggestions(joined, "flag", key, actor, now, **own)


def gaps(chapters: DataFrame, questions: DataFrame, chunks: DataFrame, actor: str, now: Column) -> DataFrame:
    found = coverage.coverage_gaps(chapters, questions, chunks, "id", "chapter_id", "chapter_id", F.col("status") != "archived")
    return _suggestions(
        found, "coverage_gap", F.concat(F.lit("coverage-gap:"), F.col("id")), actor, now, edition_id=F.col("edition_id"), chapter_id=F.col("id"), source_reference=F.col("code"),
        prompt=F.concat(F.lit("Prepare more grounding for "), F.col("code"), F.lit(": "), F.col("title"), F.lit(".")), grounding_excerpt=F.col("description"), rationale=F.lit("Too little is prepared or live."),
    )


def generate(cat: catalog.Catalog, chunks: DataFrame, edition: str, actor: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(suggestions, the run's summary). The questions are stored: five steps read them."""
    questions = stored(cat.questions, "questions")
    mine = chunks.where(F.col("edition_id") == edition)
    diagnostics = diagnosed(entities(questions))
    parts = [new_questions(mine, questions, actor, now), rewrites(questions, actor, now), flags(questions, diagnostics, actor, now), gaps(cat.chapters, questions, chunks, actor, now)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, coverage.run_summary(out)


def drafts(suggestions: DataFrame, actor: str) -> DataFrame:
    """Draft questions of the suggestions that can become one."""
    ok = (
        F.col("suggestion_type").isin("new_question", "rewrite") & (F.coalesce("chapter_id", F.lit("")) != "") & (F.coalesce("source_document_id", F.lit("")) != "") & F.col("selection_mode").isNotNull()
        & (F.coalesce("instruction", F.lit("")) != "") & (F.size("suggested_options") >= 2) & (F.size("suggested_correct_answers") > 0)
    )
    qid = F.coalesce("target_question_id", text.slug(F.concat(F.lit("ai-"), F.col("id"))))
    # a column of its own: inside the options' function, the name id would mean the new id
    return suggestions.where(ok).withColumn("_qid", qid).select(
        F.col("_qid").alias("id"), "edition_id", "chapter_id", F.lit(1).alias("week"), "prompt", "selection_mode", "instruction", "source_document_id", F.lit(1).alias("source_page"), "source_reference",
        F.col("public_explanation").alias("explanation"), "public_explanation", F.lit("draft").alias("status"), F.lit(False).alias("is_official_exam_eligible"), F.lit(False).alias("double_weight"), "review_notes",
        F.lit(actor).alias("created_by"), F.lit(actor).alias("updated_by"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(None).cast("timestamp").alias("published_at"),
        catalog.built_options(F.col("_qid"), F.col("suggested_options"), F.col("suggested_correct_answers")).alias("options"),
    )


def created_draft(suggestions: DataFrame, ident: str, actor: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A suggestion becomes a draft: the written question, its event, and the suggestions with that one applied. Nothing is
    written, and nothing applied, where it can't become one."""
    draft = drafts(suggestions.where(F.col("id") == ident), actor)
    moved = workflow.transitioned(draft, F.lit("save_draft"), F.lit(actor), now)
    checked = workflow.checked(moved)
    written = checked.where(F.size("issues") == 0).drop("issues")
    done = written.select(F.col("id").alias("_question"))
    joined = suggestions.join(F.broadcast(done), F.col("id") == ident, "left")
    mine = F.col("_question").isNotNull()
    applied = joined.withColumns({"status": F.when(mine, "applied").otherwise(F.col("status")), "applied_question_id": F.when(mine, F.col("_question")).otherwise(F.col("applied_question_id")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))})
    return written, workflow.events(written, now), applied.drop("_question")


def clean_chunks(chunks: DataFrame, texts: list[str], options: str = "options") -> DataFrame:
    """Prepared chunks with repaired, collapsed texts and options; options without text go."""
    cleaned = lambda c: text.collapse(text.repair(c))
    kept = F.filter(F.transform(F.coalesce(options, F.expr("cast(array() as array<string>)")), cleaned), lambda o: o != "")
    return chunks.withColumns({c: cleaned(F.col(c)) for c in texts}).withColumn(options, kept)


def verified(suggestions: DataFrame, questions: DataFrame) -> DataFrame:
    """suggestions with their verifier issues (own checks, then diagnostics against the questions) and status."""
    suggestions = stored(suggestions, "suggestions")
    own = rules.evaluate(suggestions, rules.verifier_rules(), "_own")
    found = diagnosed(entities(questions, suggestions), with_source=False).where("entity_type = 'suggestion'")
    per = diagnostic_map(found).select(F.col("id").alias("_s"), F.transform("diagnostics", lambda d: F.struct(d["code"].alias("code"), d["severity"].alias("severity"), d["message"].alias("message"), F.lit(None).cast("string").alias("field"))).alias("_more"))
    both = own.join(per, own["id"] == per["_s"], "left").withColumn("verifier_issues", F.concat("_own", F.coalesce("_more", F.expr(f"cast(array() as {rules.ISSUE})"))))
    return both.withColumn("verifier_status", F.when(rules.any_of("verifier_issues", rules.CRITICAL), "failed").otherwise("passed")).drop("_own", "_more", "_s")


ANSWER = "prompt string, selectionMode string, instruction string, options array<string>, correctOptionIndexes array<int>, publicExplanation string, reviewNotes string, groundingExcerpt string, rationale string"


def pilot_records(raw: DataFrame, questions: DataFrame, actor: str, now: Column) -> DataFrame:
    """Verified records from raw outputs. raw: key, kind (new_question or rewrite), raw_output, and the fields that a bad
    output leaves standing: edition_id, chapter_id, source_document_id, source_reference, grounding, rationale, target_question_id."""
    parsed = raw.withColumn("a", F.from_json(text.json_object(F.col("raw_output")), ANSWER))
    trimmed = lambda c: F.trim(F.col(f"a.{c}"))
    strings = F.expr("cast(array() as array<string>)")
    s = parsed.select(
        F.concat(F.lit("pilot-"), text.slug(F.concat(F.col("kind"), F.lit("-"), F.col("key")))).alias("id"), "edition_id", "chapter_id", "source_document_id", "source_reference",
        F.col("kind").alias("suggestion_type"), F.lit("pending").alias("status"), F.coalesce(trimmed("prompt"), F.lit("")).alias("prompt"), F.col("a.selectionMode").alias("selection_mode"),
        trimmed("instruction").alias("instruction"), F.coalesce(F.transform("a.options", lambda o: F.trim(o)), strings).alias("suggested_options"),
        F.coalesce("a.correctOptionIndexes", F.expr("cast(array() as array<int>)")).alias("suggested_correct_answers"), trimmed("publicExplanation").alias("public_explanation"), trimmed("reviewNotes").alias("review_notes"),
        F.coalesce(F.nullif(trimmed("groundingExcerpt"), F.lit("")), "grounding").alias("grounding_excerpt"), F.coalesce(F.nullif(trimmed("rationale"), F.lit("")), "rationale").alias("rationale"),
        F.when(F.col("kind") == "rewrite", F.lit(PILOT_CONFIDENCE["rewrite"])).otherwise(F.lit(PILOT_CONFIDENCE["new_question"])).cast("decimal(4,3)").alias("confidence"),
        F.concat_ws(":", F.lit("pilot"), "kind", "key").alias("dedupe_key"), "target_question_id", F.lit(actor).alias("created_by"), now.alias("created_at"), "raw_output",
    )
    return verified(s, questions)


def pilot_items(chunks: DataFrame, questions: DataFrame, kind: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The chunks and questions that a pilot run of n items takes."""
    new, old = quiz.pilot_budget(kind, n)
    return chunks.where("candidate is not null").orderBy("id").limit(new), questions.where("status <> 'archived'").orderBy("id").limit(old)


def workspace(suggestions: DataFrame, runs: DataFrame, chunks: DataFrame, edition: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suggestions (last updated first) and runs (newest first), each with its place from 1, and prepared chunks, of an edition."""
    mine = F.col("edition_id") == edition
    newest = lambda df, c: numbered(df.where(mine), [F.col(c).desc_nulls_first(), F.col("id")], "place")
    return newest(suggestions, "updated_at"), newest(runs, "created_at"), chunks.where(mine)


def seeded_chunks(questions: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """First, middle and last page of each chapter's reviewed questions, as chunks, with some of the question's columns."""
    picked = quiz.first_middle_last(questions, "chapter_id", "source_page", "id")
    numbered = picked.withColumn("at", F.row_number().over(Window.partitionBy("chapter_id").orderBy("source_page")))
    return numbered.join(questions.select("id", "edition_id", "source_document_id", "source_reference", "tags", *keep), "id").select(
        F.concat_ws("-", F.lit("chunk"), "chapter_id", "at").alias("id"), "edition_id", "chapter_id", "source_document_id", "source_page", text.topic_key(F.col("tags")).alias("topic_key"), text.topic_title(F.col("tags")).alias("topic_title"), F.col("source_reference").alias("reference_label"), *keep
    )
