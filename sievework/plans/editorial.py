"""Queries over the real rule sets, suggestions and workflow, on question banks made from the test tables.

The tables hold no questions, so items are made from `part` and suggestions from `customer`, by expressions that both Spark
and the SQL read. They are made so that every rule finds something somewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import catalog, coverage, rules, similarity, workflow
from sievework.plans import review, suggest
from sievework.plans.bindings import collapse_sql, fold_sql, query, t, tokens_sql
from sievework.session import shared_dir, spread, stored

EDITION, MANUAL, ACTOR = "e1", "manual", "editor"
NOW = "timestamp '2030-01-01 00:00:00'"


def words_of(g: str) -> str:
    """A prompt of ten words, made from a number."""
    return "concat('Cuestión', " + ", ".join(f"' ', substr(md5(concat('{c}', {g})), 1, 7)" for c in "abcdefghi") + ")"


K = "p_partkey"
#: Fields of an item as expressions over part, in words that both engines read.
ITEM = {
    "k": K,
    "batch": f"cast(floor({K} / 40) as bigint)",
    "ord": f"cast({K} % 40 as int)",
    "external_id": f"case when {K} % 29 = 0 then '' when {K} % 31 = 1 then concat('q-', {K} - 1) else concat('q-', {K}) end",
    "prompt": f"case when {K} % 41 = 0 then '' when {K} % 17 = 1 then upper({words_of(f'{K} - 1')}) when {K} % 23 = 1 then concat({words_of(f'{K} - 1')}, ' adicional') when {K} % 13 = 6 then concat('Según el manual,  ', {words_of(K)}) when {K} % 7 = 0 then concat('  ', {words_of(K)}, '  x') else {words_of(K)} end",
    "mode": f"case when {K} % 37 = 0 then 'triple' when {K} % 3 = 0 then 'multiple' else 'single' end",
    "instruction": f"case when {K} % 43 = 0 then '   ' when {K} % 3 = 0 then case when {K} % 5 = 0 then 'Marque una respuesta' else 'Marque dos respuestas' end when {K} % 7 = 0 then 'Marque las  alternativas' else 'Marque una' end",
    "o1": f"concat('detener ', substr(md5(concat('o', {K})), 1, 5))",
    "o2": f"case when {K} % 59 = 0 then ' ' else concat('seguir ', substr(md5(concat('s', {K})), 1, 5)) end",
    "o3": f"case when {K} % 61 = 0 then upper(concat('detener ', substr(md5(concat('o', {K})), 1, 5))) else concat('acelerar ', substr(md5(concat('r', {K})), 1, 5)) end",
    "o4": f"case when {K} % 9 = 0 then 'virar' else concat('virar ', substr(md5(concat('v', {K})), 1, 5)) end",
    "correct": f"case when {K} % 67 = 0 then '9' when {K} % 71 = 0 then '0|0' when {K} % 73 = 0 then 'x' when {K} % 3 = 0 then case when {K} % 11 = 0 then '1' else '0|1' end when {K} % 13 = 0 then '0|2' else '0' end",
    "page_start": f"case when {K} % 83 = 0 then 'abc' when {K} % 89 = 0 then '' else concat('', p_size * 3) end",
    "page_end": f"concat('', p_size * 3 + {K} % 5 - 1)",
    "reference": f"case when {K} % 97 = 0 then '' else concat('Manual p. ', p_size) end",
    "grounding": f"case when {K} % 101 = 0 then '' else 'Extracto' end",
}
OPTS = f"case when {K} % 47 = 0 then o1 when {K} % 53 = 0 then concat(o1, '|', o2, '|', o3, '|', o4, '|quinta') else concat(o1, '|', o2, '|', o3, '|', o4) end".replace(K, "k")
EXPLANATION = "case when k % 79 = 0 then '' when k % 19 = 0 then concat('Se debe ', o2) else concat('Se debe ', o1) end"
#: Fields of a batch as expressions over its number.
BATCH = {
    "batch_id": "case when batch % 9 = 0 then '' else concat('b-', batch) end",
    "edition": "case when batch % 7 = 3 then 'old' else 'e1' end",
    # batches without an id are all of one chapter and document, so that nothing but their file tells them apart
    "chapter": "case when batch % 9 = 0 then '5' when batch % 13 = 4 then '' else concat('', 1 + batch % 10) end",
    "document": "case when batch % 9 = 0 then 'manual' when batch % 11 = 3 then 'other' else 'manual' end",
    "broken": "batch % 17 = 16",
}


def listed(fields: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in fields.items())


RAW = f"raw as (select *, {OPTS} as opts, {EXPLANATION} as explanation from (select {listed(ITEM)}, p_size from part))"
#: The bank that imports are held against: copies in capitals, and longer versions, of some prompts.
BANK_PROMPT = f"case when {K} % 29 = 0 then upper({words_of(K)}) else concat({words_of(K)}, ' ampliada nueva') end"
BANK_WHERE = f"{K} % 29 = 0 or {K} % 31 = 0"
BANK = f"select {K} as bank_id, {BANK_PROMPT} as prompt from part where {BANK_WHERE}"


def raw_items(spark: SparkSession, sf: str) -> DataFrame:
    items = spread(t(spark, sf, "part").select(K, "p_size")).selectExpr(*[f"{e} as {n}" for n, e in ITEM.items()], "p_size")
    return items.selectExpr("*", f"{OPTS} as opts", f"{EXPLANATION} as explanation")


def batches(spark: SparkSession, sf: str) -> DataFrame:
    """Import batches of 40 items."""
    q = F.struct(
        F.col("external_id").alias("externalId"), "prompt", F.col("mode").alias("selectionMode"), "instruction", F.transform(F.split("opts", "[|]"), lambda o: F.struct(o.alias("text"))).alias("options"),
        F.split("correct", "[|]").alias("correctOptionIndexes"), F.col("explanation").alias("publicExplanation"), F.col("page_start").alias("sourcePageStart"), F.col("page_end").alias("sourcePageEnd"),
        F.col("reference").alias("sourceReference"), F.col("grounding").alias("groundingExcerpt"), F.lit("").alias("reviewNotes"), F.expr("cast(array() as array<string>)").alias("tags"),
    )
    per = raw_items(spark, sf).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ord", q.alias("q")))).alias("qs"))
    per = per.selectExpr("batch", "qs", *[f"{e} as {n}" for n, e in BATCH.items()])
    return per.select(
        F.col("batch_id").alias("batchId"), F.col("edition").alias("editionId"), F.col("chapter").alias("chapterId"), F.col("document").alias("sourceDocumentId"),
        F.when(~F.col("broken"), F.transform("qs", lambda x: x["q"])).alias("questions"), F.format_string("imports/%05d.json", "batch").alias("source_file"),
    )


def bank(spark: SparkSession, sf: str) -> DataFrame:
    part = spread(t(spark, sf, "part").where(BANK_WHERE).select(K))
    return part.selectExpr(f"{K} as bank_id", f"{BANK_PROMPT} as prompt")


def codes(issues: str | Column) -> Column:
    return F.array_join(F.transform(issues, lambda i: i["code"]), ",")


def bare_sql(x: str) -> str:
    """T05 in SQL."""
    return f"trim(regexp_replace({fold_sql(x)}, '[^a-z0-9 ]', '', 'g'))"


def number_sql(x: str) -> str:
    return f"case when trim({x}) = '' then 0.0 else coalesce(try_cast({x} as double), 'nan'::double) end"


def jaccard_sql(a: str, b: str) -> str:
    return f"case when len({a}) = 0 or len({b}) = 0 then 0 else len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end"


def codes_sql(conditions: list[tuple[str, str]]) -> str:
    return "concat_ws(',', " + ", ".join(f"case when {c} then '{code}' end" for code, c in conditions) + ")"


WINDOWS = ", ".join(f"('{c}', {a}, {b})" for c, a, b in rules.SCOPE_WINDOWS)
ERRORS = [
    ("missing_prompt", "prompt = ''"), ("missing_instruction", "instruction = ''"), ("invalid_selection_mode", "mode not in ('single', 'multiple')"), ("invalid_source_page", "not (isfinite(ps) and isfinite(pe))"),
    ("invalid_source_page_range", "isfinite(ps) and isfinite(pe) and ps > pe"), ("missing_source_reference", "reference = ''"), ("missing_grounding_excerpt", "grounding = ''"), ("missing_public_explanation", "explanation = ''"),
    ("invalid_options", "len(options) < 2"), ("empty_option_text", "list_contains(options, '')"), ("duplicate_option_text", "len(folded_options) <> len(list_distinct(folded_options))"),
    ("invalid_correct_option_index", "len(list_filter(right_, lambda x: not isfinite(x) or x <> floor(x) or x < 0 or x >= len(options))) > 0"), ("duplicate_correct_option_index", "len(right_) <> len(list_distinct(right_))"),
    ("invalid_single_answer_count", "mode = 'single' and len(right_) <> 1"), ("invalid_multiple_answer_count", "mode = 'multiple' and len(right_) < 2"),
    ("chapter_scope_mismatch", "ws is not null and ((isfinite(ps) and ps < ws) or (isfinite(pe) and pe > we))"), ("annex_scope_mismatch", "ws is not null and ((isfinite(ps) and ps >= 149) or (isfinite(pe) and pe >= 149))"),
    ("duplicate_prompt_in_batch", "batch_kind = 'exact'"), ("near_duplicate_prompt_in_batch", "batch_kind = 'near'"), ("duplicate_prompt_existing_bank", "bank_kind = 'exact'"), ("near_duplicate_prompt_existing_bank", "bank_kind = 'near'"),
    ("explanation_answer_conflict", "explanation <> '' and names_wrong and not names_right"),
]
WARNINGS = [
    ("chapter_scope_not_configured", "ws is null"), ("non_standard_option_count", "len(options) <> 4"),
    ("instruction_mismatch", "mode = 'single' and (contains(folded_instruction, 'respuestas') or contains(folded_instruction, 'alternativas'))"), ("instruction_mismatch", "mode = 'multiple' and contains(folded_instruction, 'una respuesta')"),
]
REVIEW = f"""
with {RAW},
b as (select *, {listed(BATCH)} from raw),
n as (
  select k, batch, batch_id, ord, coalesce(nullif(trim(external_id), ''), concat('question-', ord + 1)) as external_id, case when regexp_matches(trim(chapter), '^[0-9]+$') then concat('chapter-', trim(chapter)) else trim(chapter) end as chapter_id,
         {collapse_sql('prompt')} as prompt, {collapse_sql('mode')} as mode, {collapse_sql('instruction')} as instruction, {collapse_sql('explanation')} as explanation, {collapse_sql('reference')} as reference, {collapse_sql('grounding')} as grounding,
         list_transform(string_split(opts, '|'), lambda o: {collapse_sql('o')}) as options, list_transform(string_split(correct, '|'), lambda o: {number_sql('o')}) as right_, {number_sql('page_start')} as ps, {number_sql('page_end')} as pe
  from b where not broken),
f as (select *, {fold_sql('prompt')} as folded, list_distinct({tokens_sql('prompt')}) as toks, {fold_sql('instruction')} as folded_instruction, list_filter(list_transform(options, lambda o: {fold_sql('o')}), lambda o: o <> '') as folded_options, {bare_sql('explanation')} as bare,
      list_transform(options, lambda o, i: {{'bare': {bare_sql('o')}, 'good': list_contains(right_, (i - 1)::double)}}) as chosen from n),
peers as (
  select a.k, c.ord as peer, case when a.folded = c.folded then 'exact' else 'near' end as kind from f a join f c on a.batch = c.batch and a.external_id <> c.external_id and a.folded <> '' and c.folded <> ''
  where a.folded = c.folded or {jaccard_sql('a.toks', 'c.toks')} >= 0.82),
first as (select k, arg_min(kind, peer) as batch_kind from peers group by k),
bank as (select {fold_sql('prompt')} as folded, list_distinct({tokens_sql('prompt')}) as toks from ({BANK})),
banked as (select k, min(case when f.folded = bank.folded then 'exact' else 'near' end) as bank_kind from f join bank on f.folded <> '' and bank.folded <> '' and (f.folded = bank.folded or {jaccard_sql('f.toks', 'bank.toks')} >= 0.82) group by k),
w as (select * from (values {WINDOWS}) v(chapter_id, ws, we)),
j as (select f.*, batch_kind, bank_kind, ws, we, len(list_filter(chosen, lambda o: not o.good and contains(bare, o.bare))) > 0 as names_wrong, len(list_filter(chosen, lambda o: o.good and contains(bare, o.bare))) > 0 as names_right
      from f left join first using (k) left join banked using (k) left join w using (chapter_id)),
r as (select batch, batch_id, ord, external_id, chapter_id, {codes_sql(ERRORS)} as errors, {codes_sql(WARNINGS)} as warnings from j),
s as (select *, case when errors = '' then 'accepted' else 'rejected' end as status, case when errors = '' then 0 else len(string_split(errors, ',')) end as n_errors, case when warnings = '' then 0 else len(string_split(warnings, ',')) end as n_warnings from r),
own as (
  select batch, batch_id, code, (row_number() over (partition by batch order by p) - 1)::int as ord from (
    select batch, {listed(BATCH)} from (select distinct batch from raw)) x,
    lateral (values (0, 'missing_batch_id', batch_id = ''), (1, 'invalid_edition_id', edition <> 'e1'), (2, 'missing_chapter_id', chapter = ''), (3, 'invalid_source_document_id', document <> 'manual'), (4, 'invalid_questions_array', broken)) v(p, code, hit)
  where hit)
"""


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    return review.reviewed(batches(spark, sf), bank(spark, sf))


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keyed batches, their reviewed items (stored), and their own issues."""
    given = review.keyed(batches(spark, sf))
    return given, stored(review.reviewed(given, bank(spark, sf)), "reviewed"), review.batch_issues(given, EDITION, MANUAL)


@query(f"{REVIEW} select batch_id, ord, external_id, chapter_id, status, errors, warnings from s")
def import_review(spark, sf):
    """All import rules on every item, with the codes in the order of emission."""
    return _reviewed(spark, sf).select("batch_id", "ord", "external_id", "chapter_id", "status", codes("errors").alias("errors"), codes("warnings").alias("warnings"))


@query(f"{REVIEW} select batch_id, ord, code from own")
def batch_issues(spark, sf):
    return review.batch_issues(batches(spark, sf), EDITION, MANUAL).select("batch_id", "ord", "code")


@query(f"""{REVIEW}, per as (select batch, batch_id, count(*) as questions, count(*) filter (where status = 'accepted') as accepted, count(*) filter (where status = 'rejected') as rejected, sum(n_warnings) as warnings, sum(n_errors) as errors from s group by all),
o as (select batch, batch_id, count(*) as n from own group by all)
select coalesce(per.batch_id, o.batch_id) as batch_id, coalesce(questions, 0)::bigint as questions, coalesce(accepted, 0)::bigint as accepted, coalesce(rejected, 0)::bigint as rejected, coalesce(warnings, 0)::bigint as warnings, (coalesce(errors, 0) + coalesce(n, 0))::bigint as errors
from per full outer join o on per.batch = o.batch""")
def import_summary(spark, sf):
    return review.summary(*_both(spark, sf)[1:]).drop("batch_key")


@query(f"""{REVIEW} select cast(null as varchar) as question_id, -1 as item, ord, code from own
union all select external_id, ord, (i - 1)::int, e from (select external_id, ord, unnest(string_split(errors, ',')) as e, generate_subscripts(string_split(errors, ','), 1) as i from s where status = 'rejected')""")
def import_errors(spark, sf):
    """Errors of the batches, then of the rejected items."""
    return review.all_errors(*_both(spark, sf)[1:]).select("question_id", "item", "ord", "code")


#: The reports in SQL, but for the messages of issues, which are ours: lines with their place.
_LINES = f"""{REVIEW}, chg as (
  select batch, ord, external_id, field, i, action from (
    select b.batch, b.ord, n.external_id, field, i, raw from b join n using (k), lateral (values (0, 'prompt', b.prompt), (1, 'selectionMode', b.mode), (2, 'instruction', b.instruction), (3, 'publicExplanation', b.explanation), (4, 'sourceReference', b.reference), (5, 'groundingExcerpt', b.grounding)) v(i, field, raw)
    union all select b.batch, b.ord, n.external_id, 'options', 100 + i, raw from b join n using (k), lateral (select unnest(string_split(b.opts, '|')) as raw, generate_subscripts(string_split(b.opts, '|'), 1) as i) o) x,
    lateral (select 'whitespace_normalized' as action) y where {collapse_sql('raw')} <> raw),
head as (select batch, any_value({BATCH['batch_id']}) as batch_id, any_value({BATCH['chapter']}) as chapter, any_value({BATCH['document']}) as document, any_value({BATCH['broken']}) as broken, count(*) as n_all from raw group by batch),
c as (
  select head.*, printf('imports/%05d.json', head.batch) as source_file, case when broken then 0 else n_all end as questions, coalesce(accepted, 0) as accepted, coalesce(rejected, 0) as rejected, coalesce(warnings, 0) as warnings, coalesce(errors, 0) + coalesce(o.n, 0) as errors,
         coalesce(g.n, 0) + case when regexp_matches(chapter, '^[0-9]+$') then 1 else 0 end as changes
  from head left join (select batch, count(*) filter (where status = 'accepted') as accepted, count(*) filter (where status = 'rejected') as rejected, sum(n_warnings) as warnings, sum(n_errors) as errors from s group by batch) per using (batch)
  left join (select batch, count(*) as n from own group by batch) o using (batch) left join (select batch, count(*) as n from chg group by batch) g using (batch)),
lines as (
  select batch, part, p as place, sub, line from c, lateral (values
    (0, 0, 0, concat('# Import Review: ', case when batch_id = '' then source_file else batch_id end)), (0, 1, 0, ''), (0, 2, 0, '## Batch overview'), (0, 3, 0, concat('- Source file: `', source_file, '`')), (0, 4, 0, '- Reviewed at: `2030-01-01`'),
    (0, 5, 0, concat('- Chapter: `', case when regexp_matches(chapter, '^[0-9]+$') then concat('chapter-', chapter) else chapter end, '`')), (0, 6, 0, concat('- Source document: `', document, '`')), (0, 7, 0, concat('- Total questions: ', questions)),
    (0, 8, 0, concat('- Accepted: ', accepted)), (0, 9, 0, concat('- Rejected: ', rejected)), (0, 10, 0, concat('- Warnings: ', warnings)), (0, 11, 0, concat('- Errors: ', errors)), (0, 12, 0, ''), (0, 13, 0, '## Accepted items'), (0, 14, 0, case when accepted = 0 then '- None' end),
    (2, 0, 0, ''), (2, 1, 0, '## Rejected items'), (2, 2, 0, case when rejected = 0 then '- None' end), (4, 0, 0, ''), (4, 1, 0, '## Normalization warnings'), (4, 2, 0, case when changes = 0 then '- None' end), (5, -1, 0, case when regexp_matches(chapter, '^[0-9]+$') then '- `batch` chapterId: chapter_id_normalized' end),
    (6, 0, 0, ''), (6, 1, 0, '## Next operator action'), (6, 2, 0, case when rejected > 0 then '{review.NEXT_STEPS[0]}' end), (6, 3, 0, case when rejected > 0 then '{review.NEXT_STEPS[1]}' end), (6, 4, 0, case when rejected = 0 then '{review.ALL_PASSED}' end)) v(part, p, sub, line) where line is not null
  union all select batch, case when status = 'accepted' then 1 else 3 end, ord, 0, concat('- `', external_id, '`', case when status = 'accepted' and n_warnings > 0 then concat(' (', n_warnings, ' warnings)') else '' end) from s
  union all select batch, 3, ord, i, concat('  - ', e) from (select batch, ord, unnest(string_split(errors, ',')) as e, generate_subscripts(string_split(errors, ','), 1) as i from s where status = 'rejected')
  union all select batch, 5, ord, i, concat('- `', external_id, '` ', field, ': ', action) from chg)
"""


def _without_messages(line: str) -> Column:
    return F.regexp_replace(line, "^(  - [a-z_]+): .*$", "$1")


@query(f"{_LINES} select printf('imports/%05d.json', batch) as source_file, row_number() over (partition by batch order by part, place, sub) as position, line from lines")
def import_report(spark, sf):
    """The reports of all batches, line by line in order; the issues' messages are cut off."""
    lines = review.report(*_both(spark, sf), "2030-01-01")
    return lines.select("source_file", "position", _without_messages("line").alias("line"))


@query(f"""{_LINES} select 'accepted' as kind, printf('imports/%05d.json', batch) as source_file, external_id as value, count(*)::bigint as n from s where status = 'accepted' group by all
union all select 'rejected', printf('imports/%05d.json', batch), concat(external_id, ' ', errors), count(*)::bigint from s where status = 'rejected' group by all
union all select 'log', printf('imports/%05d.json', batch), concat(questions, ' ', accepted, ' ', rejected, ' ', errors), 1 from c
union all select 'summary', printf('imports/%05d.json', batch), line, count(*)::bigint from lines group by all""")
def import_artifacts(spark, sf):
    """The four artifacts of each batch, written twice with a failure in between, and read back."""
    given, items, own = _both(spark, sf)
    folder = shared_dir(spark, "import-reviews")
    run = review.write_artifacts(given, items, own, folder, "2029-12-31")
    # a run that stopped before its commit: its files are there, and count for nothing
    items.where("status = 'accepted'").limit(5).withColumn("source_file", F.lit("imports/00001.json")).select("source_file", "external_id").write.json(f"{folder}/accepted-candidates/run={run}x")
    review.write_artifacts(given, items, own, folder, "2030-01-01")
    read = lambda kind, schema: review.read_artifacts(spark, folder, kind, schema)
    issues = "array<struct<code:string>>"
    accepted = read("accepted-candidates", "external_id string").select(F.lit("accepted").alias("kind"), "source_file", F.col("external_id").alias("value"))
    rejected = read("rejected-candidates", f"external_id string, errors {issues}").select(F.lit("rejected").alias("kind"), "source_file", F.concat_ws(" ", "external_id", codes("errors")).alias("value"))
    log = read("review-log", "question_count long, accepted long, rejected long, errors long").select(F.lit("log").alias("kind"), "source_file", F.concat_ws(" ", "question_count", F.coalesce("accepted", F.lit(0)), F.coalesce("rejected", F.lit(0)), F.coalesce("errors", F.lit(0))).alias("value"))
    summary = read("review-summary", "value string").select(F.lit("summary").alias("kind"), "source_file", _without_messages("value").alias("value"))
    return accepted.unionByName(rejected).unionByName(log).unionByName(summary).groupBy("kind", "source_file", "value").agg(F.count(F.lit(1)).alias("n"))


# --- questions, suggestions, diagnostics ---

C = "c_custkey"
SUGGESTED = {
    "c": C,
    "id": f"case when {C} % 50 = 7 then concat('q-', {C}) else concat('s-', {C}) end",
    "position": f"100000 - {C}",
    "prompt": f"case when {C} % 13 = 0 then '' when {C} % 5 = 0 then {words_of(C)} when {C} % 5 = 1 then concat({words_of(C)}, ' adicional') else concat('Idea ', md5(concat('x', {C})), ' ', substr(md5(concat('y', {C})), 1, 9)) end",
    "kind": f"case {C} % 4 when 0 then 'new_question' when 1 then 'rewrite' when 2 then 'flag' else 'coverage_gap' end",
    "mode": f"case when {C} % 19 = 0 then null when {C} % 17 = 0 then 'triple' when {C} % 3 = 0 then 'multiple' else 'single' end",
    "instruction": f"case when {C} % 23 = 0 then '' when {C} % 29 = 0 then 'Marque dos' else 'Marque una' end",
    "opts": f"case when {C} % 31 = 0 then 'solo' when {C} % 37 = 0 then 'alfa uno||beta dos' when {C} % 41 = 0 then 'alfa uno|ALFA  uno|beta dos' else concat('alfa ', {C}, ' uno|beta ', {C}, ' dos|gama ', {C}, ' tres') end",
    "answers": f"case when {C} % 43 = 0 then '7' when {C} % 47 = 0 then '-1' when {C} % 3 = 0 then '0|1' else '0' end",
    "grounding": f"case when {C} % 53 = 0 then ' ' else 'Extracto' end",
    "chapter": f"case when {C} % 59 = 0 then '' else concat('chapter-', 1 + {C} % 9) end",
    "document": f"case when {C} % 61 = 0 then null else 'manual' end",
}
STATUS = "case k % 4 when 0 then 'published' when 1 then 'reviewed' when 2 then 'draft' else 'archived' end"
CHAPTER = "case when k % 103 = 0 then '' else concat('chapter-', 1 + k % 8) end"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """A bank of questions, one from each part."""
    right = F.split("correct", "[|]")
    raw = raw_items(spark, sf).selectExpr("*", f"{STATUS} as status", f"{CHAPTER} as chapter_id")
    options = F.transform(F.split("opts", "[|]"), lambda o, i: F.struct(F.chr(F.lit(65) + i).alias("label"), o.alias("text"), F.array_contains(right, i.cast("string")).alias("is_correct")))
    return raw.select(
        F.concat(F.lit("q-"), "k").alias("id"), "k", F.expr("100000 - k").alias("position"), "prompt", "instruction", F.col("mode").alias("selection_mode"), F.col("reference").alias("source_reference"), "status", "chapter_id",
        F.lit(EDITION).alias("edition_id"), F.lit(MANUAL).alias("source_document_id"), F.col("p_size").alias("source_page"), F.col("explanation").alias("public_explanation"), F.lit(None).cast("string").alias("explanation"),
        options.alias("options"), "p_size",
    )


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions, one from each customer."""
    s = spread(t(spark, sf, "customer").select(C)).selectExpr(*[f"{e} as {n}" for n, e in SUGGESTED.items()])
    return s.select(
        "c", "id", "position", F.col("kind").alias("suggestion_type"), "prompt", F.col("mode").alias("selection_mode"), "instruction", F.split("opts", "[|]").alias("suggested_options"),
        F.transform(F.split("answers", "[|]"), lambda a: a.cast("int")).alias("suggested_correct_answers"), F.col("grounding").alias("grounding_excerpt"), F.col("chapter").alias("chapter_id"), F.col("document").alias("source_document_id"),
        F.lit(EDITION).alias("edition_id"), F.lit("ref").alias("source_reference"), F.lit("why").alias("public_explanation"), F.lit(None).cast("string").alias("target_question_id"), F.lit("").alias("review_notes"),
    )


#: The diagnostics in SQL: code, severity, message, condition.
DIAGNOSTICS = [
    ("source_reference", "critical", "Published without a source", f"status = 'published' and {collapse_sql('reference')} = ''"),
    ("answer_format", "critical", "No correct option", "n_good = 0"),
    ("answer_format", "critical", "Single selection without exactly one answer", "mode = 'single' and n_good <> 1"),
    ("answer_format", "critical", "Multiple selection with fewer than two answers", "mode = 'multiple' and n_good < 2"),
    ("instruction_mismatch", "warning", "Instruction asks for several answers", "mode = 'single' and says_many and not says_one"),
    ("instruction_mismatch", "warning", "Instruction asks for one answer", "mode = 'multiple' and says_one and not says_many"),
    ("weak_distractor", "critical", "Repeated options", "len(full_options) <> len(list_distinct(full_options))"),
    ("weak_distractor", "warning", "Weak distractors", f"len(list_filter(bad, lambda o: len({tokens_sql('o')}) <= 1 and length({fold_sql('o')}) < 8)) > 0"),
    ("weak_distractor", "critical", "Distractor equal to an answer", f"list_has_any(list_transform(bad, lambda o: {fold_sql('o')}), list_transform(good, lambda o: {fold_sql('o')}))"),
    ("duplicate_prompt", "critical", "Duplicate prompt", "match_kind = 'exact'"),
    ("duplicate_prompt", "warning", "Very similar prompt", "match_kind = 'near'"),
]
BANK_AND_SUGGESTIONS = f"""
with {RAW},
q as (select concat('q-', k) as id, k, 100000 - k as position, prompt, instruction, mode, reference, {STATUS} as status, {CHAPTER} as chapter_id, string_split(opts, '|') as options, string_split(correct, '|') as right_, explanation, p_size from raw),
s as (select {listed(SUGGESTED)} from customer),
s2 as (select *, string_split(opts, '|') as options, string_split(answers, '|') as right_ from s)
"""
FIND = f"""
e as (
  select 0 as rank, 'question' as entity_type, id, position, prompt, instruction, mode, reference, status, options, right_ from q
  union all select 1, 'suggestion', id, position, prompt, instruction, mode, 'ref', null, options, right_ from s2 where kind <> 'coverage_gap' and len(options) > 0 and mode is not null and coalesce(instruction, '') <> ''),
e1 as (select *, row_number() over (order by rank, position, id) as peer, {fold_sql('prompt')} as folded, list_distinct({tokens_sql('prompt')}) as toks from e),
flat as (select peer, id, len(toks) as n, unnest(toks) as token from e1),
shared as (select a.peer as a, b.peer as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as common from flat a join flat b on a.token = b.token and a.id <> b.id and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 82 group by a.peer, b.peer),
pairs as (select a, b, 'near' as kind from shared where common::double / (n + m - common) >= 0.82 union all select x.peer, y.peer, 'exact' from e1 x join e1 y on x.folded = y.folded and x.folded <> '' and x.id <> y.id),
best as (select a as peer, kind as match_kind, row_number() over (partition by a order by b, kind) as nth from pairs),
g as (select e1.*, match_kind, {fold_sql('instruction')} as fi, list_filter(list_transform(options, lambda o: {fold_sql('o')}), lambda o: o <> '') as full_options,
      list_filter(options, lambda o, i: list_contains(right_, (i - 1)::varchar)) as good, list_filter(options, lambda o, i: not list_contains(right_, (i - 1)::varchar)) as bad
      from e1 left join best on best.peer = e1.peer and nth = 1),
h as (select *, len(good) as n_good, regexp_matches(fi, '(^|[^A-Za-z0-9_])(una|un)([^A-Za-z0-9_]|$)') as says_one,
      regexp_matches(fi, '(^|[^A-Za-z0-9_])(dos|tres)([^A-Za-z0-9_]|$)') or contains(fi, 'respuestas') or contains(fi, 'alternativas') as says_many from g),
d as (
  {' union all '.join(f"select peer, entity_type, id, {i} as p, '{code}' as code, '{severity}' as severity, '{message}' as message from h where {condition}" for i, (code, severity, message, condition) in enumerate(DIAGNOSTICS))}),
dd as (select *, (row_number() over (partition by peer order by p) - 1)::int as ord from d)
"""


@query(f"{BANK_AND_SUGGESTIONS}, {FIND} select entity_type, id, ord, code, severity, concat_ws('-', entity_type, id, code, regexp_replace(lower(message), ' ', '-', 'g')) as diagnostic_id from dd")
def diagnostics(spark, sf):
    """All diagnostics over the bank and its suggestions, with first matches by catalog order."""
    found = suggest.diagnosed(suggest.entities(questions(spark, sf), suggestions(spark, sf)))
    return found.select("entity_type", "id", "ord", "code", "severity", "diagnostic_id")


@query(f"{BANK_AND_SUGGESTIONS}, {FIND} select count(*)::bigint as total, (count(*) filter (where severity = 'critical'))::bigint as n_critical, (count(*) filter (where severity = 'warning'))::bigint as n_warning, "
       + ", ".join(f"(count(*) filter (where code = '{c}'))::bigint as n_{c}" for c in ("answer_format", "instruction_mismatch", "weak_distractor", "duplicate_prompt")) + " from dd")
def diagnostic_summary(spark, sf):
    found = suggest.diagnosed(suggest.entities(questions(spark, sf), suggestions(spark, sf)))
    return coverage.issue_summary(found, ["critical", "warning"], ["answer_format", "instruction_mismatch", "weak_distractor", "duplicate_prompt"])


VERIFIER = [
    ("prompt_missing", f"{collapse_sql('prompt')} = ''"), ("grounding_missing", f"{collapse_sql('grounding')} = ''"), ("selection_mode_invalid", "coalesce(mode not in ('single', 'multiple'), true)"), ("instruction_missing", f"coalesce({collapse_sql('instruction')}, '') = ''"),
    ("options_insufficient", "len(options) < 2"), ("option_blank", f"len(list_filter(options, lambda o: {collapse_sql('o')} = '')) > 0"), ("answer_out_of_range", "len(list_filter(right_, lambda a: a::int < 0 or a::int >= len(options))) > 0"),
    ("not_draftable", "not coalesce(kind in ('new_question', 'rewrite') and chapter <> '' and document is not null and mode is not null and instruction <> '' and len(options) >= 2, false)"),
]


@query(f"""{BANK_AND_SUGGESTIONS}, {FIND},
v as (select id, {codes_sql(VERIFIER)} as own from s2),
m as (select id, string_agg(code, ',' order by ord) as more, count(*) filter (where severity = 'critical') as n from dd where entity_type = 'suggestion' and code <> 'source_reference' group by id)
select v.id, concat_ws(',', nullif(own, ''), more) as codes, case when own <> '' or coalesce(n, 0) > 0 then 'failed' else 'passed' end as verifier_status from v left join m on v.id = m.id""")
def verifier_checks(spark, sf):
    """The verifier's own checks and the diagnostics of each suggestion."""
    done = suggest.verified(suggestions(spark, sf), questions(spark, sf))
    return done.select("id", codes("verifier_issues").alias("codes"), "verifier_status")


# --- saving and the workflow ---

DATED = {
    "action": f"case {K} % 6 " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(workflow.ACTIONS)) + " end",
    "edition_id": f"case when {K} % 19 = 5 then '' else 'e1' end",
    "source_document_id": f"case when {K} % 23 = 5 then ' ' else 'manual' end",
    "source_page": f"case when {K} % 29 = 5 then null when {K} % 31 = 5 then 0 else p_size end",
    "reviewed": f"{K} % 5 < 2",
    "published": f"{K} % 7 < 3",
}
SAVE = [
    ("edition_required", "edition_id = ''"), ("chapter_required", "chapter_id = ''"), ("prompt_required", f"{collapse_sql('prompt')} = ''"), ("instruction_required", f"{collapse_sql('instruction')} = ''"), ("source_required", "trim(source_document_id) = ''"),
    ("page_required", "coalesce(source_page, 0) = 0"), ("two_options_required", "len(options) < 2"), ("option_text_required", f"len(list_filter(options, lambda o: {collapse_sql('o')} = '')) > 0"), ("answer_required", "n_good = 0"),
    ("single_answer_required", "mode = 'single' and n_good <> 1"), ("multiple_answers_required", "mode = 'multiple' and n_good < 2"), ("review_date_required", "status = 'published' and reviewed_at is null"), ("publish_date_required", "status = 'published' and published_at is null"),
]
_WAIVES_BOTH = "action in ('archive', 'save', 'save_draft')"


def _for_action(code: str, condition: str) -> str:
    waived = {"review_date_required": _WAIVES_BOTH, "publish_date_required": f"({_WAIVES_BOTH} or action = 'mark_reviewed')"}
    return f"{condition} and not {waived[code]}" if code in waived else condition


SAVED = f"""
{BANK_AND_SUGGESTIONS},
w as (select p_partkey as k, {listed(DATED)} from part),
x0 as (select q.id, q.k, q.prompt, q.instruction, q.mode, q.status, q.chapter_id, q.options, len(list_filter(q.options, lambda o, i: list_contains(q.right_, (i - 1)::varchar))) as n_good, w.action, w.edition_id, w.source_document_id, w.source_page,
       case when reviewed then timestamp '2029-01-01 00:00:00' end as reviewed_at, case when published then timestamp '2029-06-01 00:00:00' end as published_at from q join w using (k)),
moved as (select * replace (
  case action when 'save_draft' then 'draft' when 'mark_reviewed' then 'reviewed' when 'publish' then 'published' when 'archive' then 'archived' else status end as status,
  case when action in ('mark_reviewed', 'publish') or (action = 'save' and status in ('reviewed', 'published')) then coalesce(reviewed_at, {NOW}) else reviewed_at end as reviewed_at,
  case when action in ('save_draft', 'mark_reviewed') then null when action = 'publish' then {NOW} when action = 'save' and status = 'published' then coalesce(published_at, {NOW}) else published_at end as published_at) from x0)
"""
FOR_ACTION = [(c, _for_action(c, x)) for c, x in SAVE]


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with dates and an action asked for each."""
    extra = t(spark, sf, "part").selectExpr(f"{K} as k", *[f"{e} as {n}" for n, e in DATED.items()])
    at = lambda flag, day: F.when(F.col(flag), F.lit(f"{day} 00:00:00").cast("timestamp_ntz"))
    q = questions(spark, sf).drop("edition_id", "source_document_id", "source_page", "position").join(extra, "k")
    return q.withColumns({"reviewed_at": at("reviewed", "2029-01-01"), "published_at": at("published", "2029-06-01")}).drop("reviewed", "published")


@query(f"{SAVED} select id, action, {codes_sql(SAVE)} as codes, {codes_sql(FOR_ACTION)} as counted from x0")
def save_checks(spark, sf):
    """The checks before saving, all of them and those that count for the action."""
    done = rules.evaluate(dated(spark, sf), rules.save_rules())
    return done.select("id", "action", codes("issues").alias("codes"), codes(rules.for_action("issues", F.col("action"))).alias("counted"))


def _applied(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = dated(spark, sf)
    return workflow.applied(q.drop("action"), q.select("id", "action", F.lit(ACTOR).alias("actor")), F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))


@query(f"{SAVED} select id, action, status, reviewed_at, published_at from moved where {codes_sql(FOR_ACTION)} = ''")
def workflow_written(spark, sf):
    """Requests that succeed: transitions first, checks after."""
    return _applied(spark, sf)[0].select("id", "action", "status", "reviewed_at", "published_at")


@query(f"{SAVED} select id, action, {codes_sql(FOR_ACTION)} as codes from moved where {codes_sql(FOR_ACTION)} <> ''")
def workflow_refused(spark, sf):
    return _applied(spark, sf)[2].select("id", "action", codes("issues").alias("codes"))


@query(f"{SAVED} select concat('event-', id, '-', action, '-', epoch_ms({NOW})) as event_id, id as question_id, action, '{ACTOR}' as actor_email from moved where {codes_sql(FOR_ACTION)} = ''")
def workflow_events(spark, sf):
    """The log's entries for what was written."""
    return _applied(spark, sf)[1].select(F.col("id").alias("event_id"), "question_id", "action", "actor_email")


# --- suggestions ---

S = "s_suppkey"
CHUNK = {
    "s": S,
    "id": f"concat('chunk-', {S})",
    "chapter": f"concat('chapter-', 1 + {S} % 12)",
    "edition": f"case when {S} % 11 = 0 then 'e0' else 'e1' end",
    "prompt": f"case when {S} % 5 = 0 then null when {S} % 3 = 0 then lower({words_of(S)}) else concat('Nueva ', md5(concat('n', {S}))) end",
}
GAP_PROMPT = "concat('Prepare more grounding for ', code, ': ', title, '.')"
CHAPTERS = {"id": "concat('chapter-', n_nationkey + 1)", "code": "concat('C', n_nationkey + 1)", "title": "n_name"}
#: White space, any number of it, in SQL.
ANY_WS = collapse_sql("x").split("'")[1].removesuffix("+") + "*"
REWRITTEN = collapse_sql(f"regexp_replace(regexp_replace(prompt, '^seg[uú]n el manual,{ANY_WS}', '', 'i'), '^en el enfoque de sistema seguro,{ANY_WS}', '', 'i')")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared chunks, one from each supplier, most with a candidate."""
    c = spread(t(spark, sf, "supplier").select(S)).selectExpr(*[f"{e} as {n}" for n, e in CHUNK.items()])
    candidate = F.struct(
        "prompt", F.lit("single").alias("selection_mode"), F.lit("Marque una").alias("instruction"), F.array(F.lit("si"), F.lit("no")).alias("options"), F.array(F.lit(0)).alias("correct"),
        F.lit("porque").alias("public_explanation"), F.lit("").alias("review_notes"),
    )
    return c.select(
        "id", F.col("edition").alias("edition_id"), F.col("chapter").alias("chapter_id"), F.lit(MANUAL).alias("source_document_id"), F.lit("ref").alias("reference_label"), F.lit("g").alias("grounding_summary"),
        F.lit("r").alias("rationale"), F.when(F.col("prompt").isNotNull(), candidate).alias("candidate"),
    )


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "nation").selectExpr(*[f"{e} as {n}" for n, e in CHAPTERS.items()], "'e1' as edition_id", "'d' as description", "n_nationkey as display_order")


def _generated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = questions(spark, sf)
    nothing = q.limit(0)
    return suggest.generate(catalog.Catalog(nothing, chapters(spark, sf), nothing, q, nothing, nothing), chunks(spark, sf), EDITION, ACTOR, F.lit("2030-01-01 00:00:00").cast("timestamp"))


FIND_IN_BANK = FIND.replace("union all select 1, 'suggestion', id, position, prompt, instruction, mode, 'ref', null, options, right_ from s2 where kind <> 'coverage_gap' and len(options) > 0 and mode is not null and coalesce(instruction, '') <> ''", "")
GENERATED = f"""
{BANK_AND_SUGGESTIONS}, {FIND_IN_BANK},
chunk as (select {listed(CHUNK)} from supplier),
chap as (select {listed(CHAPTERS)} from nation),
rw as (select id, upper({REWRITTEN}[1]) || {REWRITTEN}[2:] as new, prompt from q),
out_ as (
  select 'new_question' as kind, concat('new-question:', id) as dedupe_key, prompt, null as target from chunk where prompt is not null and edition = 'e1'
    and not exists (select 1 from q where lower({collapse_sql('q.prompt')}) = lower({collapse_sql('chunk.prompt')}))
  union all select 'rewrite', concat('rewrite:', id), new, id from rw where new <> prompt and new <> ''
  union all select 'flag', concat('flag:', dd.id, ':', regexp_replace(lower(message), ' +', '-', 'g')), q.prompt, q.id from dd join q on q.id = dd.id
  union all select 'coverage_gap', concat('coverage-gap:', id), {GAP_PROMPT}, null from chap where not exists (select 1 from q where chapter_id = chap.id and status <> 'archived') or not exists (select 1 from chunk where chapter = chap.id))
"""


@query(f"""{GENERATED} select concat('ai-', lower(regexp_replace(dedupe_key, '[^A-Za-z0-9-]', '-', 'g'))) as id, kind as suggestion_type, dedupe_key, md5(prompt) as prompt, target as target_question_id, 'pending' as status,
case kind when 'new_question' then 0.73 when 'rewrite' then 0.58 when 'flag' then 0.81 else 0.92 end::double as confidence from out_""")
def suggestions_generated(spark, sf):
    """New questions, rewrites, flags and coverage gaps of one run."""
    return _generated(spark, sf)[0].select("id", "suggestion_type", "dedupe_key", F.md5("prompt").alias("prompt"), "target_question_id", "status", F.col("confidence").cast("double").alias("confidence"))


@query(f"""{GENERATED} select count(*)::bigint as "generatedCount", (count(*) filter (where kind = 'new_question'))::bigint as "newQuestionCount", (count(*) filter (where kind = 'rewrite'))::bigint as "rewriteCount",
(count(*) filter (where kind = 'flag'))::bigint as "flagCount", (count(*) filter (where kind = 'coverage_gap'))::bigint as "coverageGapCount" from out_""")
def run_summary(spark, sf):
    return _generated(spark, sf)[1]


DRAFT_OK = "kind in ('new_question', 'rewrite') and chapter <> '' and coalesce(document, '') <> '' and mode is not null and instruction <> '' and len(options) >= 2"


@query(f"""{BANK_AND_SUGGESTIONS} select concat('ai-', id) as id, chapter as chapter_id, 'draft' as status, 1 as week, 1 as source_page, len(options)::bigint as n_options,
len(list_filter(options, lambda o, i: list_contains(right_, (i - 1)::varchar)))::bigint as n_right, concat('ai-', id, '-opt-a') as first_option from s2 where {DRAFT_OK}""")
def drafts(spark, sf):
    """Draft questions of the suggestions that can become one."""
    done = suggest.drafts(suggestions(spark, sf), ACTOR)
    size = F.size("options").cast("long").alias("n_options")
    return done.select("id", "chapter_id", "status", "week", "source_page", size, F.size(F.filter("options", lambda o: o["is_correct"])).cast("long").alias("n_right"), F.get("options", F.lit(0))["id"].alias("first_option"))


RAW_OUTPUT = (
    f"""concat('{{"prompt":" ', case when {S} % 6 = 0 then {words_of(S)} else concat('Piloto ', md5(concat('p', {S}))) end, '","selectionMode":"single","instruction":"Marque una","options":["alfa uno ', {S}, '","beta dos","gama tres"],"correctOptionIndexes":[', {S} % 4, '],"groundingExcerpt":"","rationale":"r"}}')"""
)
PILOT = {
    "key": f"concat('', {S})",
    "kind": f"case when {S} % 2 = 0 then 'new_question' else 'rewrite' end",
    "raw_output": f"case when {S} % 7 = 3 then 'no object here' when {S} % 5 = 0 then concat('Answer: ', {RAW_OUTPUT}, ' done.') else {RAW_OUTPUT} end",
}
PILOT_SQL = f"""
{BANK_AND_SUGGESTIONS.replace("s2 as", "s3 as")},
s2 as (select concat('pilot-', case when {S} % 2 = 0 then 'new-question' else 'rewrite' end, '-', {S}) as id, null as position, case when {S} % 7 = 3 then '' when {S} % 6 = 0 then {words_of(S)} else concat('Piloto ', md5(concat('p', {S}))) end as prompt,
       case when {S} % 2 = 0 then 'new_question' else 'rewrite' end as kind, case when {S} % 7 <> 3 then 'single' end as mode, case when {S} % 7 <> 3 then 'Marque una' end as instruction,
       case when {S} % 7 = 3 then [] else [concat('alfa uno ', {S}), 'beta dos', 'gama tres'] end as options, case when {S} % 7 = 3 then [] else [concat('', {S} % 4)] end as right_, 'g' as grounding, 'chapter-1' as chapter, 'manual' as document from supplier),
{FIND},
v as (select id, kind, prompt, {codes_sql([*VERIFIER[:-1], ("not_draftable", "mode is null")])} as own from s2),
m as (select id, string_agg(code, ',' order by ord) as more, count(*) filter (where severity = 'critical') as n from dd where entity_type = 'suggestion' group by id),
p as (select v.*, concat_ws(',', nullif(own, ''), more) as codes, case when own <> '' or coalesce(n, 0) > 0 then 'failed' else 'passed' end as verifier_status from v left join m on v.id = m.id)
"""


def _pilot(spark: SparkSession, sf: str) -> DataFrame:
    raw = spread(t(spark, sf, "supplier").select(S)).selectExpr(*[f"{e} as {n}" for n, e in PILOT.items()], "'e1' as edition_id", "'chapter-1' as chapter_id", "'manual' as source_document_id", "'ref' as source_reference", "'g' as grounding", "'r' as rationale", "cast(null as string) as target_question_id")
    return suggest.pilot_records(raw, questions(spark, sf), ACTOR, F.lit("2030-01-01 00:00:00").cast("timestamp"))


@query(f"{PILOT_SQL} select id, kind as suggestion_type, md5(prompt) as prompt, codes, verifier_status, case kind when 'rewrite' then 0.38 else 0.45 end::double as confidence from p")
def pilot_records(spark, sf):
    """Records from raw model outputs, parsed or salvaged, with the verifier's issues."""
    done = _pilot(spark, sf)
    return done.select("id", "suggestion_type", F.md5("prompt").alias("prompt"), codes("verifier_issues").alias("codes"), "verifier_status", F.col("confidence").cast("double").alias("confidence"))


@query(f"""{PILOT_SQL} select count(*)::bigint as attempted, (count(*) filter (where verifier_status = 'passed'))::bigint as passed, (count(*) filter (where verifier_status = 'failed'))::bigint as failed,
(count(*) filter (where kind = 'new_question'))::bigint as new_questions, (count(*) filter (where kind = 'rewrite'))::bigint as rewrites from p""")
def pilot_summary(spark, sf):
    return coverage.pilot_summary(_pilot(spark, sf))


# --- accepted items, catalogs, small edits ---


@query(f"""{REVIEW} select concat('import-', s.external_id) as id, s.chapter_id, case when regexp_matches(s.chapter_id, '^chapter-[0-9]+$') then greatest(1, replace(s.chapter_id, 'chapter-', '')::int) else 1 end as week, md5(prompt) as prompt, case when isfinite(ps) then ps else 1 end::double as source_page,
case when reference = '' then concat('Pág. ', case when isfinite(ps) then ps::bigint else 1 end) else reference end as source_reference, 'published' as status, len(options)::bigint as n_options, len(list_filter(chosen, lambda o: o.good))::bigint as n_right
from s join f on s.batch = f.batch and s.ord = f.ord where status = 'accepted'""")
def accepted_questions(spark, sf):
    """Accepted items as questions of the bank."""
    done = review.to_questions(_reviewed(spark, sf), EDITION, MANUAL, ACTOR, F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return done.select("id", "chapter_id", "week", F.md5("prompt").alias("prompt"), "source_page", "source_reference", "status", F.size("options").cast("long").alias("n_options"), F.size(F.filter("options", lambda o: o["is_correct"])).cast("long").alias("n_right"))


def _made_catalog(spark: SparkSession, sf: str, table: str, key: str, limits: tuple[str, str], tag: str) -> catalog.Catalog:
    """A catalog with question and event ids of a table; tag says where a row comes from."""
    rows = t(spark, sf, table).selectExpr(f"concat('q-', {key}) as id", f"'{tag}' as prompt")
    events = t(spark, sf, table).selectExpr(f"concat('e-', {key}) as id", f"'{tag}' as action")
    small, name = limits
    few = t(spark, sf, small).selectExpr(f"concat('x-', {name}) as id", f"{name} as display_order", f"concat('{tag} ', {name}) as title")
    editions = few.selectExpr("id", f"case when display_order % 2 = 0 then '{tag}' end as code", "display_order = 3 as is_active", "date '2026-01-01' as effective_from")
    return catalog.Catalog(editions, few, few.drop("display_order"), rows, events, spark.sql(f"select 'r' as id, cast(null as string) as edition_id, '{tag}' as name"))


@query("""with q as (select 'question' as part, coalesce(r.id, s.id) as id, case when r.id is not null then 'remote' else 'seed' end as value from (select concat('q-', p_partkey) as id from part) r full outer join (select concat('q-', c_custkey) as id from customer) s on r.id = s.id),
e as (select 'event' as part, coalesce(r.id, s.id) as id, case when r.id is not null then 'remote' else 'seed' end as value from (select concat('e-', p_partkey) as id from part) r full outer join (select concat('e-', c_custkey) as id from customer) s on r.id = s.id),
c as (select coalesce(r.n, s.n) as n, r.n is not null as remote, s.n is not null as seeded from (select n_nationkey as n from nation) r full outer join (select r_regionkey as n from region) s on r.n = s.n)
select * from q union all select * from e
union all select 'chapter', concat('x-', n), concat(case when seeded then 'seed ' else 'remote ' end, n) from c union all select 'source', concat('x-', n), concat(case when seeded then 'seed ' else 'remote ' end, n) from c
union all select 'edition', concat('x-', n), concat(coalesce(case when n % 2 = 0 then case when remote then 'remote' else 'seed' end end, 'none'), case when n = 3 then ' active' else '' end) from c
union all select 'rule', 'r', 'seed x-3'""")
def overlay_precedence(spark, sf):
    """A remote catalog over its seed: who wins in each table."""
    both = catalog.with_floor(_made_catalog(spark, sf, "part", "p_partkey", ("nation", "n_nationkey"), "remote"), _made_catalog(spark, sf, "customer", "c_custkey", ("region", "r_regionkey"), "seed"))
    part = lambda df, name, value: df.select(F.lit(name).alias("part"), "id", value.alias("value"))
    active = F.when(F.col("is_active"), F.lit(" active")).otherwise("")
    out = part(both.questions, "question", F.col("prompt")).unionByName(part(both.events, "event", F.col("action"))).unionByName(part(both.chapters, "chapter", F.col("title"))).unionByName(part(both.sources, "source", F.col("title")))
    return out.unionByName(part(both.editions, "edition", F.concat(F.coalesce("code", F.lit("none")), active))).unionByName(part(both.rules, "rule", F.concat_ws(" ", "name", "edition_id")))


@query(f"""{BANK_AND_SUGGESTIONS}
select id, concat_ws(' · ', {', '.join(f"case when list_contains(right_, '{i}') and len(options) > {i} then concat('{chr(65 + i)}. ', options[{i + 1}]) end" for i in range(5))}) as answer,
case when mode = 'single' then 1 else len(list_distinct(list_append(list_filter(right_, lambda x: try_cast(x as int) between 0 and len(options) - 1), '0'))) end::bigint as n_after from q""")
def answer_texts(spark, sf):
    """The correct answers as text, and how many there are after the first option is marked."""
    q = questions(spark, sf)
    return q.select("id", text.answer_text(F.col("options")).alias("answer"), F.size(F.filter(text.mark_option(F.col("options"), F.lit("A"), F.lit(True), F.col("selection_mode")), lambda o: o["is_correct"])).cast("long").alias("n_after"))


@query(f"""{BANK_AND_SUGGESTIONS} select 'suggestion' as part, id, row_number() over (order by position desc, id) as nth from s
union all select 'run', concat('run-', s_suppkey), row_number() over (order by s_acctbal desc, concat('run-', s_suppkey)) from supplier union all select 'chunk', id, null from (select {listed(CHUNK)} from supplier) where edition = 'e1'""")
def workspace(spark, sf):
    """What an editor's workspace shows: suggestions and runs, newest first, with their places, and the edition's chunks."""
    made = suggestions(spark, sf).withColumn("updated_at", F.col("position"))
    runs = t(spark, sf, "supplier").selectExpr("concat('run-', s_suppkey) as id", "'e1' as edition_id", "s_acctbal as created_at")
    s, r, c = suggest.workspace(made, runs, chunks(spark, sf), EDITION)
    out = s.select(F.lit("suggestion").alias("part"), "id", F.col("place").alias("nth")).unionByName(r.select(F.lit("run").alias("part"), "id", F.col("place").alias("nth")))
    return out.unionByName(c.select(F.lit("chunk").alias("part"), "id", F.lit(None).cast("long").alias("nth")))


@query(f"""with {RAW}, i as (select k as id, {fold_sql('prompt')} as folded, list_distinct({tokens_sql('prompt')}) as toks from raw), b as (select bank_id, {fold_sql('prompt')} as folded, list_distinct({tokens_sql('prompt')}) as toks from ({BANK})),
m as (select id, bank_id as match_id, case when i.folded = b.folded then 'exact' else 'near' end as kind, case when i.folded = b.folded then 1.0 else {jaccard_sql('i.toks', 'b.toks')} end as similarity
      from i join b on i.folded <> '' and b.folded <> '' and (i.folded = b.folded or {jaccard_sql('i.toks', 'b.toks')} >= 0.82)),
best as (select *, row_number() over (partition by id order by kind, match_id) as nth from m)
select id, match_id, kind, round(similarity, 9) as similarity from best where nth = 1""")
def bank_match_prompts(spark, sf):
    """Items against the bank: an equal prompt, else the first near one."""
    items = similarity.tokenized(raw_items(spark, sf), "k", "prompt")
    return similarity.bank_match(items, similarity.tokenized(bank(spark, sf), "bank_id", "prompt")).withColumn("similarity", F.round("similarity", 9))


@query(f"with {RAW} select k from raw where not exists (select 1 from ({BANK}) b where lower({collapse_sql('b.prompt')}) = lower({collapse_sql('raw.prompt')}))")
def prompts_not_in_bank(spark, sf):
    return similarity.not_in_bank(raw_items(spark, sf), bank(spark, sf), "prompt", "prompt").select("k")
