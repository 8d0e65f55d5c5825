"""Declarative rules that emit issues.

A rule is a code, a severity, a condition and a message. All rules of a set become one array expression, so a table
is checked in one projection; the order of the rules is the order of the issues.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text

ERROR, WARNING, CRITICAL = "error", "warning", "critical"
ISSUE = "array<struct<code:string,severity:string,message:string,field:string>>"

#: Pages from which on the source is annex.
ANNEX_FROM = 149
#: Pages of the source that each chapter covers.
SCOPE_WINDOWS = [
    ("chapter-1", 6, 10), ("chapter-2", 11, 32), ("chapter-3", 33, 36), ("chapter-4", 37, 67), ("chapter-5", 68, 76),
    ("chapter-6", 77, 108), ("chapter-7", 109, 126), ("chapter-8", 127, 135), ("chapter-9", 136, 148),
]


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    condition: Column
    message: Column | str = ""
    field: str | None = None

    def issue(self) -> Column:
        message = self.message if isinstance(self.message, Column) else F.lit(self.message)
        return F.when(
            self.condition,
            F.struct(F.lit(self.code).alias("code"), F.lit(self.severity).alias("severity"), message.alias("message"), F.lit(self.field).cast("string").alias("field")),
        )


class Rules(list):
    """Rules with the columns that several of them read, in layers of which each may read the ones before. These are computed
    once a row, not once a rule."""

    def __init__(self, rules: list[Rule], *shared: dict[str, Column]):
        super().__init__(rules)
        self.shared = shared


def issues(rules: list[Rule]) -> Column:
    return F.array_compact(F.array(*[r.issue() for r in rules])).cast(ISSUE)


def evaluate(df: DataFrame, rules: list[Rule], out: str = "issues") -> DataFrame:
    """df with the array of issues of each row."""
    shared = getattr(rules, "shared", ())
    for layer in shared:
        df = df.withColumns(layer)
    return df.withColumn(out, issues(rules)).drop(*[name for layer in shared for name in layer])


def exploded(df: DataFrame, *keys: str, col: str = "issues") -> DataFrame:
    """A row an issue: keys, ord (order of emission), code, severity, message, field. The outer form and a filter after it: for
    the inner one a filter on the array is put before all that makes it, which then is made twice."""
    return df.select(*keys, F.posexplode_outer(col).alias("ord", "i")).where("ord is not null").select(*keys, "ord", "i.*")


def of_severity(col: str, severity: str) -> Column:
    return F.size(F.filter(col, lambda i: i["severity"] == severity)).cast("long")


def any_of(col: str, severity: str) -> Column:
    return F.exists(col, lambda i: i["severity"] == severity)


def blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def repeats(a: Column) -> Column:
    """Whether an array holds something twice."""
    return F.size(a) != F.size(F.array_distinct(a))


def _outside(value: Column, low: Column, high: Column) -> Column:
    return text.finite(value) & ((value < low) | (value > high))


def import_rules() -> list[Rule]:
    """Checks of a normalized question. Columns: prompt, instruction, selection_mode, page_start, page_end (double),
    source_reference, grounding_excerpt, public_explanation, options (array of texts), correct (array of double),
    window_start, window_end (null if the chapter has none), batch_kind and bank_kind (exact, near or null)."""
    n, start, end = F.size("options"), F.col("page_start"), F.col("page_end")
    pages = text.finite(start) & text.finite(end)
    configured = F.col("window_start").isNotNull()
    mode, correct = F.col("selection_mode"), F.col("correct")
    explained = text.fold_for_contains(F.coalesce("public_explanation", F.lit("")))
    chosen = lambda e: F.transform("_folded", lambda o, i: F.struct(F.contains(e, text.bare(o)).alias("named"), F.array_contains(correct, i.cast("double")).alias("good")))
    shared = [{"_instruction": text.fold(F.coalesce("instruction", F.lit(""))), "_folded": F.transform("options", text.fold)}, {"_chosen": text.let(explained, chosen), "_filled": F.filter("_folded", lambda x: x != "")}]
    instruction = F.col("_instruction")
    names = lambda good: F.exists("_chosen", lambda o: (o["good"] == good) & o["named"])
    rules = [
        Rule("missing_prompt", ERROR, blank("prompt"), "A prompt is required.", "prompt"),
        Rule("missing_instruction", ERROR, blank("instruction"), "An instruction is required.", "instruction"),
        Rule("invalid_selection_mode", ERROR, ~F.coalesce(mode.isin("single", "multiple"), F.lit(False)), "Selection is single or multiple.", "selectionMode"),
        Rule("invalid_source_page", ERROR, ~pages, "Pages must be numbers.", "sourcePageStart"),
        Rule("invalid_source_page_range", ERROR, pages & (start > end), "The first page comes after the last.", "sourcePageStart"),
        Rule("missing_source_reference", ERROR, blank("source_reference"), "A source reference is required.", "sourceReference"),
        Rule("missing_grounding_excerpt", ERROR, blank("grounding_excerpt"), "An excerpt of the source is required.", "groundingExcerpt"),
        Rule("missing_public_explanation", ERROR, blank("public_explanation"), "An explanation is required.", "publicExplanation"),
        Rule("invalid_options", ERROR, n < 2, "At least two options are required.", "options"),
        Rule("empty_option_text", ERROR, F.exists("options", lambda o: o == ""), "An option has no text.", "options"),
        Rule("duplicate_option_text", ERROR, repeats(F.col("_filled")), "Options repeat.", "options"),
        Rule("invalid_correct_option_index", ERROR, F.exists("correct", lambda x: ~text.whole_number(x) | (x < 0) | (x >= n)), "A correct index names no option.", "correctOptionIndexes"),
        Rule("duplicate_correct_option_index", ERROR, repeats(correct), "Correct indexes repeat.", "correctOptionIndexes"),
        Rule("invalid_single_answer_count", ERROR, (mode == "single") & (F.size(correct) != 1), "Single selection has one answer.", "correctOptionIndexes"),
        Rule("invalid_multiple_answer_count", ERROR, (mode == "multiple") & (F.size(correct) < 2), "Multiple selection has two answers or more.", "correctOptionIndexes"),
        Rule(
            "chapter_scope_mismatch",
            ERROR,
            configured & ((text.finite(start) & (start < F.col("window_start"))) | (text.finite(end) & (end > F.col("window_end")))),
            F.format_string("Pages %s to %s lie outside %d to %d.", start.cast("string"), end.cast("string"), F.col("window_start"), F.col("window_end")),
            "sourcePageStart",
        ),
        Rule("annex_scope_mismatch", ERROR, configured & ((text.finite(start) & (start >= ANNEX_FROM)) | (text.finite(end) & (end >= ANNEX_FROM))), "Pages lie in the annex.", "sourcePageStart"),
        Rule("chapter_scope_not_configured", WARNING, ~configured, "No pages are set for the chapter.", "chapterId"),
        Rule("duplicate_prompt_in_batch", ERROR, F.col("batch_kind") == "exact", "The batch holds the prompt twice.", "prompt"),
        Rule("near_duplicate_prompt_in_batch", ERROR, F.col("batch_kind") == "near", "The batch holds a very similar prompt.", "prompt"),
        Rule("duplicate_prompt_existing_bank", ERROR, F.col("bank_kind") == "exact", "The bank holds the prompt.", "prompt"),
        Rule("near_duplicate_prompt_existing_bank", ERROR, F.col("bank_kind") == "near", "The bank holds a very similar prompt.", "prompt"),
        Rule("non_standard_option_count", WARNING, n != 4, "Four options are usual.", "options"),
        Rule("instruction_mismatch", WARNING, (mode == "single") & (F.contains(instruction, F.lit("respuestas")) | F.contains(instruction, F.lit("alternativas"))), "The instruction asks for several answers.", "instruction"),
        Rule("instruction_mismatch", WARNING, (mode == "multiple") & F.contains(instruction, F.lit("una respuesta")), "The instruction asks for one answer.", "instruction"),
        Rule("explanation_answer_conflict", ERROR, ~blank("public_explanation") & names(False) & ~names(True), "The explanation names a wrong option and no right one.", "publicExplanation"),
    ]
    return Rules(rules, *shared)


def batch_rules(edition: str, source_document: str) -> list[Rule]:
    """Checks of a batch; they never reject its items. Columns: batch_id, edition_id, chapter_id, source_document_id, questions."""
    return [
        Rule("missing_batch_id", ERROR, blank("batch_id"), "A batch id is required."),
        Rule("invalid_edition_id", ERROR, ~F.col("edition_id").eqNullSafe(F.lit(edition)), f"The edition must be {edition}."),
        Rule("missing_chapter_id", ERROR, blank("chapter_id"), "A chapter is required."),
        Rule("invalid_source_document_id", ERROR, ~F.col("source_document_id").eqNullSafe(F.lit(source_document)), f"The source must be {source_document}."),
        Rule("invalid_questions_array", ERROR, F.col("questions").isNull(), "Questions must be a list."),
    ]


def diagnostic_rules(with_source: bool = True) -> list[Rule]:
    """Editorial diagnostics of a reviewable entity; the rule's code is the category. Columns: prompt, instruction,
    selection_mode, source_reference, status, options (array of struct text, is_correct), match_kind (or null)."""
    mode = F.col("selection_mode")
    instruction = F.col("_instruction")
    folded = F.transform("options", lambda o: F.struct(text.fold(o["text"]).alias("t"), o["is_correct"].alias("good")))
    of = lambda wanted: F.transform(F.filter("_folded", wanted), lambda o: o["t"])
    shared = [
        {"_instruction": text.fold(F.coalesce("instruction", F.lit(""))), "_folded": folded},
        {
            "_single": text.has_word(instruction, ["una", "un"]),
            "_multiple": text.has_word(instruction, ["dos", "tres"]) | F.contains(instruction, F.lit("respuestas")) | F.contains(instruction, F.lit("alternativas")),
            "_good": of(lambda o: o["good"]), "_bad": of(lambda o: ~o["good"]), "_filled": of(lambda o: o["t"] != ""),
        },
    ]
    n, single, multiple = F.size("_good"), F.col("_single"), F.col("_multiple")
    short = lambda o: (F.length(o) < 8) & (F.size(text.folded_tokens(o)) <= 1)
    source = [Rule("source_reference", CRITICAL, (F.col("status") == "published") & (text.collapse(F.coalesce("source_reference", F.lit(""))) == ""), "Published without a source")]
    rules = (source if with_source else []) + [
        Rule("answer_format", CRITICAL, n == 0, "No correct option"),
        Rule("answer_format", CRITICAL, (mode == "single") & (n != 1), "Single selection without exactly one answer"),
        Rule("answer_format", CRITICAL, (mode == "multiple") & (n < 2), "Multiple selection with fewer than two answers"),
        Rule("instruction_mismatch", WARNING, (mode == "single") & multiple & ~single, "Instruction asks for several answers"),
        Rule("instruction_mismatch", WARNING, (mode == "multiple") & single & ~multiple, "Instruction asks for one answer"),
        Rule("weak_distractor", CRITICAL, repeats(F.col("_filled")), "Repeated options"),
        Rule("weak_distractor", WARNING, F.exists("_bad", short), "Weak distractors"),
        Rule("weak_distractor", CRITICAL, F.arrays_overlap("_bad", "_good"), "Distractor equal to an answer"),
        Rule("duplicate_prompt", CRITICAL, F.col("match_kind") == "exact", "Duplicate prompt"),
        Rule("duplicate_prompt", WARNING, F.col("match_kind") == "near", "Very similar prompt"),
    ]
    return Rules(rules, *shared)


def diagnostic_id(entity_type: Column, entity_id: Column, category: Column, title: Column) -> Column:
    return F.concat_ws("-", entity_type, entity_id, category, F.regexp_replace(text.fold(title), " ", "-"))


def save_rules() -> list[Rule]:
    """Checks before a question is saved. Columns as of a question, with options (text, is_correct) and dates."""
    mode, n = F.col("selection_mode"), F.size(F.filter("options", lambda o: o["is_correct"]))
    empty = lambda c: text.collapse(F.coalesce(F.col(c), F.lit(""))) == ""
    published = F.col("status") == "published"
    return [
        Rule("edition_required", ERROR, empty("edition_id"), "An edition is required.", "edition_id"),
        Rule("chapter_required", ERROR, empty("chapter_id"), "A chapter is required.", "chapter_id"),
        Rule("prompt_required", ERROR, empty("prompt"), "A prompt is required.", "prompt"),
        Rule("instruction_required", ERROR, empty("instruction"), "An instruction is required.", "instruction"),
        Rule("source_required", ERROR, empty("source_document_id"), "A source is required.", "source_document_id"),
        Rule("page_required", ERROR, F.coalesce(F.col("source_page"), F.lit(0)) == 0, "A page is required.", "source_page"),
        Rule("two_options_required", ERROR, F.size("options") < 2, "Two options are required.", "options"),
        Rule("option_text_required", ERROR, F.exists("options", lambda o: text.collapse(o["text"]) == ""), "Options need text.", "options"),
        Rule("answer_required", ERROR, n == 0, "An answer is required.", "options"),
        Rule("single_answer_required", ERROR, (mode == "single") & (n != 1), "Single selection has one answer.", "options"),
        Rule("multiple_answers_required", ERROR, (mode == "multiple") & (n < 2), "Multiple selection has two answers or more.", "options"),
        Rule("review_date_required", ERROR, published & F.col("reviewed_at").isNull(), "Published needs a review date.", "reviewed_at"),
        Rule("publish_date_required", ERROR, published & F.col("published_at").isNull(), "Published needs a publish date.", "published_at"),
    ]


#: Codes that do not count for an action.
WAIVED = {
    "mark_reviewed": ["publish_date_required"],
    "archive": ["review_date_required", "publish_date_required"],
    "save": ["review_date_required", "publish_date_required"],
    "save_draft": ["review_date_required", "publish_date_required"],
}


def for_action(col: str, action: Column) -> Column:
    """The issues that count for an action."""
    waived = F.create_map(*[x for a, codes in WAIVED.items() for x in (F.lit(a), F.array(*map(F.lit, codes)))])
    mine = F.coalesce(waived[action], F.expr("cast(array() as array<string>)"))
    return F.filter(col, lambda i: ~F.array_contains(mine, i["code"]))


def verifier_rules() -> list[Rule]:
    """Checks of a suggestion before its diagnostics. Columns: prompt, grounding_excerpt, selection_mode, instruction,
    suggested_options, suggested_correct_answers, chapter_id, source_document_id, suggestion_type."""
    empty = lambda c: text.collapse(F.coalesce(F.col(c), F.lit(""))) == ""
    options, answers = F.col("suggested_options"), F.col("suggested_correct_answers")
    drafted = F.col("suggestion_type").isin("new_question", "rewrite") & ~empty("chapter_id") & ~empty("source_document_id") & F.col("selection_mode").isNotNull() & ~empty("instruction") & (F.size(options) >= 2) & (F.size(answers) > 0)
    return [
        Rule("prompt_missing", CRITICAL, empty("prompt"), "No prompt."),
        Rule("grounding_missing", CRITICAL, empty("grounding_excerpt"), "No grounding."),
        Rule("selection_mode_invalid", CRITICAL, ~F.coalesce(F.col("selection_mode").isin("single", "multiple"), F.lit(False)), "Selection is single or multiple."),
        Rule("instruction_missing", CRITICAL, empty("instruction"), "No instruction."),
        Rule("options_insufficient", CRITICAL, F.size(options) < 2, "Fewer than two options."),
        Rule("option_blank", CRITICAL, F.exists(options, lambda o: text.collapse(o) == ""), "An option is blank."),
        Rule("answer_out_of_range", CRITICAL, F.exists(answers, lambda a: (a < 0) | (a >= F.size(options))), "An answer names no option."),
        Rule("not_draftable", CRITICAL, ~F.coalesce(drafted, F.lit(False)), "It cannot become a draft."),
    ]
