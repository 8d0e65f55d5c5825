"""Every rule with a case that breaks it and one that does not."""

import pytest
from pyspark.sql import functions as F

from sievework.operators import rules

NAN = float("nan")
GOOD = {
    "prompt": "¿Qué indica la luz roja?", "instruction": "Marque una respuesta", "selection_mode": "single", "page_start": 40.0, "page_end": 41.0, "source_reference": "Manual", "grounding_excerpt": "x",
    "public_explanation": "La luz roja indica detenerse", "options": ["detenerse", "seguir", "acelerar", "retroceder"], "correct": [0.0], "window_start": 37, "window_end": 67, "batch_kind": None, "bank_kind": None,
}
SCHEMA = "prompt string, instruction string, selection_mode string, page_start double, page_end double, source_reference string, grounding_excerpt string, public_explanation string, options array<string>, correct array<double>, window_start int, window_end int, batch_kind string, bank_kind string"
CASES = [
    ({}, []),
    ({"prompt": ""}, ["missing_prompt"]),
    ({"instruction": None}, ["missing_instruction"]),
    ({"selection_mode": "both"}, ["invalid_selection_mode"]),
    ({"page_end": NAN}, ["invalid_source_page"]),
    ({"page_start": 50.0}, ["invalid_source_page_range"]),
    ({"source_reference": ""}, ["missing_source_reference"]),
    ({"grounding_excerpt": ""}, ["missing_grounding_excerpt"]),
    ({"public_explanation": ""}, ["missing_public_explanation"]),
    ({"options": ["detenerse"]}, ["invalid_options", "non_standard_option_count"]),
    ({"options": ["detenerse", "", "b", "c"], "public_explanation": "detenerse"}, ["empty_option_text"]),
    ({"options": ["detenerse", "Séguir", "SEGUIR ", "c"]}, ["duplicate_option_text"]),
    ({"correct": [4.0], "public_explanation": "nada"}, ["invalid_correct_option_index"]),
    ({"correct": [0.5], "public_explanation": "nada"}, ["invalid_correct_option_index"]),
    ({"correct": [0.0, 0.0], "selection_mode": "multiple", "instruction": "Marque dos respuestas"}, ["duplicate_correct_option_index"]),
    ({"correct": [0.0, 1.0]}, ["invalid_single_answer_count"]),
    ({"correct": [0.0], "selection_mode": "multiple", "instruction": "Marque"}, ["invalid_multiple_answer_count"]),
    ({"page_start": 109.0, "page_end": 109.0}, ["chapter_scope_mismatch"]),
    ({"page_start": 162.0, "page_end": 162.0, "window_start": 68, "window_end": 76}, ["chapter_scope_mismatch", "annex_scope_mismatch"]),
    ({"page_start": 148.0, "page_end": 148.0, "window_start": 136, "window_end": 148}, []),
    ({"window_start": None, "window_end": None, "page_end": 162.0}, ["chapter_scope_not_configured"]),
    ({"batch_kind": "exact"}, ["duplicate_prompt_in_batch"]),
    ({"batch_kind": "near", "bank_kind": "near"}, ["near_duplicate_prompt_in_batch", "near_duplicate_prompt_existing_bank"]),
    ({"bank_kind": "exact"}, ["duplicate_prompt_existing_bank"]),
    ({"options": ["detenerse", "seguir", "acelerar"]}, ["non_standard_option_count"]),
    ({"instruction": "Marque las alternativas"}, ["instruction_mismatch"]),
    ({"instruction": "Marque una respuesta", "selection_mode": "multiple", "correct": [0.0, 1.0], "public_explanation": "detenerse"}, ["instruction_mismatch"]),
    ({"public_explanation": "hay que séguir"}, ["explanation_answer_conflict"]),
    ({"options": ["otra", "...", "b", "c"], "public_explanation": "nada"}, ["explanation_answer_conflict"]),
]


def codes(spark, schema, names, data, rule_list):
    df = spark.createDataFrame([(i, *[d[c] for c in names]) for i, d in enumerate(data)], f"i int, {schema}")
    return [[x["code"] for x in r["issues"]] for r in rules.evaluate(df, rule_list()).orderBy("i").collect()]


def test_import_rules(spark):
    got = codes(spark, SCHEMA, list(GOOD), [GOOD | c for c, _ in CASES], rules.import_rules)
    assert got == [want for _, want in CASES]


OPTION = "array<struct<text:string,is_correct:boolean>>"
ENTITY = {"prompt": "p", "instruction": "Marque una", "selection_mode": "single", "source_reference": "r", "status": "published", "options": [("detenerse", True), ("continuar", False)], "match_kind": None}
DIAGNOSED = [
    ({}, []),
    ({"source_reference": "  "}, [("source_reference", "critical")]),
    ({"options": [("continuar", False), ("detenerse", False)]}, [("answer_format", "critical")] * 2),
    ({"options": [("continuar", True), ("detenerse", False)], "selection_mode": "multiple", "instruction": ""}, [("answer_format", "critical")]),
    ({"instruction": "Marque dos"}, [("instruction_mismatch", "warning")]),
    ({"instruction": "Marque un", "selection_mode": "multiple", "options": [("detenerse", True), ("continuar", True)]}, [("instruction_mismatch", "warning")]),
    ({"options": [("detenerse", True), ("Continuar", False), ("continuár", False)]}, [("weak_distractor", "critical")]),
    ({"options": [("detenerse", True), ("avanzar", False)]}, [("weak_distractor", "warning")]),
    ({"options": [("detenerse", True), ("avanzara", False)]}, []),
    ({"options": [("continuar ya", True), ("Continuar  YA", False)]}, [("weak_distractor", "critical")] * 2),
    ({"match_kind": "exact"}, [("duplicate_prompt", "critical")]),
    ({"match_kind": "near"}, [("duplicate_prompt", "warning")]),
]


def test_diagnostics(spark):
    schema = f"prompt string, instruction string, selection_mode string, source_reference string, status string, options {OPTION}, match_kind string"
    df = spark.createDataFrame([(i, *(ENTITY | d).values()) for i, (d, _) in enumerate(DIAGNOSED)], f"i int, {schema}")
    got = [[(x["code"], x["severity"]) for x in r["issues"]] for r in rules.evaluate(df, rules.diagnostic_rules()).orderBy("i").collect()]
    assert got == [want for _, want in DIAGNOSED]


SAVED = {
    "edition_id": "e", "chapter_id": "c", "prompt": "p", "instruction": "i", "source_document_id": "s", "source_page": 3, "options": [("a", True), ("b", False)], "selection_mode": "single", "status": "draft",
    "reviewed_at": None, "published_at": None, "action": "publish",
}


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, []),
        ({"edition_id": " ", "chapter_id": None, "prompt": "", "instruction": "", "source_document_id": "", "source_page": 0}, ["edition_required", "chapter_required", "prompt_required", "instruction_required", "source_required", "page_required"]),
        ({"options": [(" ", False)]}, ["two_options_required", "option_text_required", "answer_required", "single_answer_required"]),
        ({"selection_mode": "multiple"}, ["multiple_answers_required"]),
        ({"status": "published"}, ["review_date_required", "publish_date_required"]),
        ({"status": "published", "action": "mark_reviewed"}, ["review_date_required"]),
        ({"status": "published", "action": "archive"}, []),
    ],
)
def test_save_rules(spark, change, want):
    row = SAVED | change
    schema = f"edition_id string, chapter_id string, prompt string, instruction string, source_document_id string, source_page int, options {OPTION}, selection_mode string, status string, reviewed_at timestamp, published_at timestamp, action string"
    df = rules.evaluate(spark.createDataFrame([tuple(row.values())], schema), rules.save_rules())
    got = df.select(rules.for_action("issues", F.col("action")).alias("x")).first()["x"]
    assert [x["code"] for x in got] == want
