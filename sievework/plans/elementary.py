"""Queries over reads, writes, edits and small functions that the larger plans are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import catalog, coverage, quiz, workflow
from sievework.plans import suggest
from sievework.plans.bindings import collapse_sql, query, t
from sievework.plans.editorial import ACTOR, BANK_AND_SUGGESTIONS, CHUNK, DRAFT_OK, EDITION, chunks, questions, suggestions
from sievework.session import shared_dir
from sievework.sources import tables

NOW = "2030-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


# --- reads ---


@query("select o_orderkey, o_totalprice from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
def scan_by_key(spark, sf):
    return tables.scan(spark, sf, "orders", {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"}, ["o_orderkey", "o_totalprice"])


@query("select n_nationkey, n_name from nation where n_nationkey = 7")
def single_row(spark, sf):
    """A point look-up that must find exactly one row."""
    return tables.single(tables.scan(spark, sf, "nation", {"n_nationkey": 7}, ["n_nationkey", "n_name"]))


@query("select true as has_nation, false as has_editions, 'seed' as version, exists (select 1 from orders where o_totalprice > 100000) as any_large, exists (select 1 from orders where o_totalprice < 0) as any_negative")
def existence_probes(spark, sf):
    orders = t(spark, sf, "orders")
    probe = lambda condition, name: orders.where(condition).limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
    has = {f"has_{n}": F.lit(tables.has_table(spark, sf, n)) for n in ("nation", "editions")}
    both = probe("o_totalprice > 100000", "any_large").join(F.broadcast(probe("o_totalprice < 0", "any_negative")), how="cross")  # a row each
    return both.withColumns(has | {"version": F.lit(tables.schema_version(spark, sf))}).select("has_nation", "has_editions", "version", "any_large", "any_negative")


@query(" union all ".join(f"select '{n}' as name, count(*)::bigint as n from {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")))
def exact_counts(spark, sf):
    """Row counts without rows: Parquet footers answer them."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    parts = [t(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"{BANK_AND_SUGGESTIONS} select id, prompt from q where status = 'published'")
def published_view(spark, sf):
    return tables.published(questions(spark, sf)).select("id", "prompt")


@query("""select concat('q-', p_partkey) as id, case when p_partkey % 3 = 0 then 'seen' else 'inner' end as public_explanation, (case when p_partkey % 4 = 0 then 0 else 2 end)::bigint as n_options,
case when p_partkey % 4 = 0 then '' else 'second,first' end as texts, 0::bigint as n_media, 'v1' as version from part""")
def catalog_read(spark, sf):
    """A catalog of version v1, written and read with its children nested and its explanations completed."""
    part = t(spark, sf, "part")
    root = shared_dir(spark, "catalog")
    rows = part.selectExpr("concat('q-', p_partkey) as id", "'e1' as edition_id", "p_name as prompt", "'inner' as explanation", "case when p_partkey % 3 = 0 then 'seen' end as public_explanation", "'published' as status")
    options = part.where("p_partkey % 4 <> 0").selectExpr("p_partkey as k", "explode(array(1, 2)) as display_order")
    options = options.selectExpr("concat('o-', k, '-', display_order) as id", "concat('q-', k) as question_id", "display_order", "'A' as label", "case display_order when 2 then 'first' else 'second' end as text", "display_order = 1 as is_correct")
    media = part.limit(0).selectExpr("'' as id", "'' as question_id", "1 as display_order", "'image' as type", "'' as url", "'' as alt_text")
    few = t(spark, sf, "region").selectExpr("concat('x-', r_regionkey) as id", "r_regionkey as display_order", "r_name as title")
    editions = few.selectExpr("id", "id as code", "display_order = 0 as is_active", "date '2026-01-01' as effective_from")
    events = part.selectExpr("concat('e-', p_partkey) as id", "'seed' as action")
    rule_set = spark.sql("select 'r' as id, cast(null as string) as edition_id, 35 as size")
    names = {"editions": editions, "chapters": few, "source_documents": few, "questions": rows, "question_options": options, "question_media": media, "editorial_events": events, "exam_rule_sets": rule_set}
    for name, df in names.items():
        df.write.parquet(f"{root}/{name}.parquet")
    seed = catalog.Catalog(editions.limit(0), few.limit(0), few.limit(0), catalog.questions_of(rows.limit(0), options.limit(0), media), events.limit(0), rule_set)
    found, version = catalog.read_catalog(spark, root, seed, strict=True)
    joined = F.array_join(F.transform("options", lambda o: o["text"]), ",").alias("texts")
    return found.questions.select("id", "public_explanation", F.size("options").cast("long").alias("n_options"), joined, F.size("media").cast("long").alias("n_media"), F.lit(version).alias("version"))


# --- writes as new states ---


@query("select o_orderkey, case when o_orderstatus = 'F' then 'archived' else o_orderstatus end as o_orderstatus, case when o_orderstatus = 'F' then 0.0 else o_totalprice end as o_totalprice from orders")
def updated_rows(spark, sf):
    done = tables.update_where(t(spark, sf, "orders"), F.col("o_orderstatus") == "F", o_orderstatus=F.lit("archived"), o_totalprice=F.lit(0.0))
    return done.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select o_orderkey from orders where not coalesce(o_totalprice > 100000, false)")
def deleted_rows(spark, sf):
    return tables.delete_where(t(spark, sf, "orders"), F.col("o_totalprice") > 100000).select("o_orderkey")


@query("""select 'empty' as kind, n_nationkey as k from nation union all select 'kept', r_regionkey from region union all select 'replaced', n_nationkey from nation""")
def bulk_seed(spark, sf):
    """A seed goes into an empty table, not into a filled one unless it is to be replaced."""
    nations, regions = t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), t(spark, sf, "region").select(F.col("r_regionkey").alias("k"))
    cases = {"empty": tables.seeded(nations.limit(0), nations), "kept": tables.seeded(regions, nations), "replaced": tables.seeded(regions, nations, replace=True)}
    parts = [df.select(F.lit(kind).alias("kind"), "k") for kind, df in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: A list with places, and rows that arrive in an order of their own, some keys twice.
_ARRIVE = "select c_custkey % 500 as k, concat('new-', c_custkey) as v, (c_custkey * 7919) % 100003 as hour, c_custkey as nr from customer where c_custkey % 7 = 0"
_LISTS = f"""old as (select s_suppkey as k, s_suppkey + 10 as place, 'old' as v from supplier), came as (select *, row_number() over (order by hour, nr) as n from ({_ARRIVE})),
arrived as (select k, min(n) as first_n, max(n) as last_n, arg_max(v, n) as v from came group by k), fresh as (select arrived.*, row_number() over (order by first_n) as nth from arrived where k not in (select k from old))"""
_KNOWN = "select old.k, place, coalesce(arrived.v, old.v) as v from old left join arrived on old.k = arrived.k"


def _lists(spark, sf):
    old = t(spark, sf, "supplier").selectExpr("s_suppkey as k", "s_suppkey + 10 as place", "'old' as v")
    new = t(spark, sf, "customer").where("c_custkey % 7 = 0").selectExpr("c_custkey % 500 as k", "concat('new-', c_custkey) as v", "(c_custkey * 7919) % 100003 as hour", "c_custkey as nr")
    return old, new.withColumn("place", F.lit(None).cast("bigint")), [F.col("hour"), F.col("nr")]


@query(f"with {_LISTS} {_KNOWN} union all select k, (select min(place) from old) - nth, v from fresh")
def prepended_upsert(spark, sf):
    """Known keys keep their place, new ones come first, each before those that came earlier."""
    old, new, by = _lists(spark, sf)
    return tables.prepend(old, new, "k", "place", by)


@query(f"with {_LISTS}, rest as (select * from old where k not in (select k from arrived)), edge as (select coalesce(min(place), 0) as low from rest) select * from rest union all select k, low - row_number() over (order by last_n), v from arrived, edge")
def newest_first_upsert(spark, sf):
    old, new, by = _lists(spark, sf)
    return tables.newest_first(old, new, "k", "place", by)


@query(f"""with {_LISTS}, e as (select 'question' as part, * from ({_KNOWN} union all select k, (select max(place) from old) + nth, v from fresh) q),
rest as (select * from old where k not in (select k from arrived)), edge as (select coalesce(min(place), 0) as low from rest)
select * from e union all select 'event', * from rest union all select 'event', k, low - row_number() over (order by last_n), v from arrived, edge""")
def saved_questions(spark, sf):
    """Questions are replaced in place or appended, events come first."""
    old, new, by = _lists(spark, sf)
    questions, events = tables.saved_questions(old, old, new, new, by, "k")
    return questions.select(F.lit("question").alias("part"), "k", "place", "v").unionByName(events.select(F.lit("event").alias("part"), "k", "place", "v"))


@query("select c_custkey, 'e1' as edition_id, coalesce(case when c_acctbal > 0 then c_mktsegment end, 'none') as segment from customer")
def migrated_rows(spark, sf):
    """A column is added, and nulls of an old one are filled."""
    old = t(spark, sf, "customer").selectExpr("c_custkey", "case when c_acctbal > 0 then c_mktsegment end as segment")
    return tables.migrated(old, {"edition_id": F.lit("e1"), "segment": F.lit("x")}, {"segment": F.lit("none")})


# --- filters, samples, orders ---


@query("select concat('x-', n_nationkey) as id from nation order by n_regionkey = 2 desc, n_nationkey % 4 desc, concat('x-', n_nationkey) limit 1")
def active_edition(spark, sf):
    made = t(spark, sf, "nation").selectExpr("concat('x-', n_nationkey) as id", "n_regionkey = 2 as is_active", "n_nationkey % 4 as effective_from")
    return catalog.active_edition(made).select("id")


@query("select 'question' as part, o_orderkey as k from orders where o_orderpriority = '1-URGENT' union all select 'chapter', c_custkey from customer where c_mktsegment = '1-URGENT' union all select 'event', event_id from events where event_type = '1-URGENT' union all select 'edition', n_nationkey from nation union all select 'source', r_regionkey from region")
def edition_scope(spark, sf):
    """Questions, chapters and events of one edition; editions and sources as they are."""
    made = lambda table, key, edition: t(spark, sf, table).select(F.col(key).alias("k"), F.col(edition).alias("edition_id"))
    whole = catalog.Catalog(
        t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), made("customer", "c_custkey", "c_mktsegment"), t(spark, sf, "region").select(F.col("r_regionkey").alias("k")),
        made("orders", "o_orderkey", "o_orderpriority"), made("events", "event_id", "event_type"), spark.range(1),
    )
    found = catalog.scoped(whole, "1-URGENT")
    part = lambda name, df: df.select(F.lit(name).alias("part"), "k")
    return part("question", found.questions).unionByName(part("chapter", found.chapters)).unionByName(part("event", found.events)).unionByName(part("edition", found.editions)).unionByName(part("source", found.sources))


@query(f"{BANK_AND_SUGGESTIONS} select id from q where status = 'published' and chapter_id in ('chapter-1', 'chapter-5') order by md5(concat('seed', id)), id limit 10")
def practice_set(spark, sf):
    """Published questions of some chapters, shuffled; ten of them are the feature."""
    return quiz.practice(questions(spark, sf), ["chapter-1", "chapter-5"], "seed", 10).select("id")


@query(f"""{BANK_AND_SUGGESTIONS}, e as (select id, k % 5 = 0 as double_weight from q where status = 'published' and k % 3 <> 1),
r as (select *, row_number() over (partition by double_weight order by md5(concat('exam', id)), id) as n from e), p as (select * from r where n <= case when double_weight then 2 else 8 end)
select id, double_weight, row_number() over (order by md5(concat('exam/again', id)), id)::int as position from p""")
def exam(spark, sf):
    """Eligible published questions: two of double weight, eight others, reshuffled."""
    made = questions(spark, sf).withColumns({"is_official_exam_eligible": F.col("k") % 3 != 1, "double_weight": F.col("k") % 5 == 0})
    return quiz.exam(made, "exam", 2, 8).select("id", "double_weight", "position")


@query("""with o as (select user_id, arg_max(value > 50, event_id) as ok from events group by user_id), j as (select c_custkey as id, ok from customer join o on o.user_id = c_custkey)
select 'all' as which, count(*)::bigint as n from j union all select 'correct', count(*) filter (where ok) from j union all select 'incorrect', count(*) filter (where not ok) from j""")
def outcome_filters(spark, sf):
    asked = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    outcomes = t(spark, sf, "events").select(F.col("user_id").alias("question_id"), (F.col("value") > 50).alias("is_correct"), F.lit(1).alias("points_earned"), F.col("event_id").alias("seq"))
    parts = [quiz.outcome_filter(asked, outcomes, w).agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("which"), "n") for w in ("all", "correct", "incorrect")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select o_orderkey, case when o_totalprice > 150000 then 'passed' else 'failed' end as side from orders")
def passed_failed(spark, sf):
    passed, failed = coverage.split_by(t(spark, sf, "orders"), F.col("o_totalprice") > 150000)
    return passed.select("o_orderkey", F.lit("passed").alias("side")).unionByName(failed.select("o_orderkey", F.lit("failed").alias("side")))


@query(f"""{BANK_AND_SUGGESTIONS} select (count(*) filter (where status = 'published'))::bigint as published, least(10, count(*) filter (where status = 'published'))::bigint as default_size,
(count(*) filter (where status = 'published' and chapter_id in ('chapter-1', 'chapter-5')))::bigint as available from q""")
def practice_sizes(spark, sf):
    q = questions(spark, sf)
    return quiz.default_size(q, 48).join(F.broadcast(quiz.available(q, ["chapter-1", "chapter-5"])), how="cross")


@query(f"""with have as (select (select count(*) from supplier where {CHUNK['prompt']} is not null) as chunks, (select count(*) from part where p_partkey % 4 <> 3) as questions)
select kind, n, least(chunks, case kind when 'new' then n when 'rewrite' then 0 else greatest(1, (n + 1) // 2) end)::bigint as new, least(questions, case kind when 'new' then 0 when 'rewrite' then n else greatest(0, n - greatest(1, (n + 1) // 2)) end)::bigint as rewrites
from (values ('new'), ('rewrite'), ('mixed')) k(kind), range(1, 8) r(n), have""")
def pilot_budgets(spark, sf):
    """How many chunks and questions runs of several kinds and sizes take of those that there are."""
    rows = [(kind, n, *quiz.pilot_budget(kind, n)) for kind in ("new", "rewrite", "mixed") for n in range(1, 8)]
    budgets = spark.createDataFrame(rows, "kind string, n long, new long, rewrites long")
    have = chunks(spark, sf).agg(F.count_if(F.col("candidate").isNotNull()).alias("_c")).join(F.broadcast(questions(spark, sf).agg(F.count_if(F.col("status") != "archived").alias("_q"))), how="cross")  # a row each
    return budgets.join(F.broadcast(have), how="cross").select("kind", "n", F.least("_c", "new").alias("new"), F.least("_q", "rewrites").alias("rewrites"))


@query("select o_orderkey from orders where o_totalprice > 190000 order by case when o_custkey % 3 = 0 then o_orderdate end nulls last, concat('', o_orderkey) limit 20")
def publication_order(spark, sf):
    """The first of a catalog in the order of publication, unpublished ones last."""
    made = t(spark, sf, "orders").where("o_totalprice > 190000").selectExpr("o_orderkey", "concat('', o_orderkey) as id", "case when o_custkey % 3 = 0 then o_orderdate end as published_at")
    return catalog.ordered_questions(made).limit(20).select("o_orderkey")


# --- events, suggestions, drafts ---


@query(f"""select case when n is null then concat('event-', c_custkey, '-seed') else concat('', n) end as event_id, c_custkey as question_id, coalesce(a, 'seed') as action, case when n is null then '{ACTOR}' else 'someone' end as actor_email
from customer left join (select user_id, min(event_id) as n, arg_min(event_type, event_id) as a from (select *, min(ts) over (partition by user_id) as f from events) where ts = f group by user_id) on user_id = c_custkey""")
def first_events(spark, sf):
    """The first event of each question, or a made-up one."""
    made = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("question_id"), F.col("event_type").alias("action"), F.lit("someone").alias("actor_email"), F.col("ts").alias("created_at"), "event_id")
    first = made.groupBy("question_id").agg(F.min_by(F.struct("id", "action", "actor_email", "created_at"), F.struct("created_at", "event_id")).alias("e")).select("question_id", "e.*")
    done = catalog.first_events(t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), first, ACTOR, now())
    return done.select("event_id", "question_id", "action", "actor_email")


@query(f"{BANK_AND_SUGGESTIONS} select id, case when id = 's-8' then 'rejected' when id = 's-9' then 'applied' else 'pending' end as status, case when id = 's-8' then 'no' else 'old' end as review_notes, case when id = 's-9' then 'q-1' end as applied_question_id, id in ('s-8', 's-9') as touched from s")
def suggestion_status(spark, sf):
    """One suggestion is rejected with a note, another is applied to a question; notes stay where none is given."""
    made = suggestions(spark, sf).withColumns({"status": F.lit("pending"), "review_notes": F.lit("old"), "updated_at": F.lit(None).cast("timestamp_ntz"), "applied_question_id": F.lit(None).cast("string")})
    done = workflow.suggestion_applied(workflow.suggestion_status(made, "s-8", "rejected", now(), F.lit("no")), "s-9", "q-1", now())
    return done.select("id", "status", "review_notes", "applied_question_id", F.col("updated_at").isNotNull().alias("touched"))


@query(f"""{BANK_AND_SUGGESTIONS}, ok as (select * from s2 where {DRAFT_OK} and prompt <> '' and len(list_filter(options, lambda o: {collapse_sql('o')} = '')) = 0), one as (select min(id) as id from ok where mode = 'single' and right_ = ['0'])
select id, case when id = (select id from one) then 'applied' else 'pending' end as status, case when id = (select id from one) then concat('ai-', id) end as applied_question_id from s2""")
def created_draft(spark, sf):
    """The first suggestion that can become a draft does; it is applied, all others stay."""
    made = suggestions(spark, sf).withColumns({"status": F.lit("pending"), "updated_at": F.lit(None).cast("timestamp_ntz"), "applied_question_id": F.lit(None).cast("string")})
    blank = F.exists("suggested_options", lambda o: text.collapse(o) == "")
    fit = suggest.drafts(made.where((F.col("prompt") != "") & ~blank & (F.col("selection_mode") == "single") & (F.col("suggested_correct_answers") == F.array(F.lit(0)))), ACTOR)
    ident = fit.agg(F.min("id")).first()[0].removeprefix("ai-")
    return suggest.created_draft(made, ident, ACTOR, now())[2].select("id", "status", "applied_question_id")


# --- small functions ---


@query(f"""select p_partkey, case when regexp_matches(raw, '^[0-9]+$') then concat('chapter-', raw) else raw end as chapter_id, case when regexp_matches(raw, '^[0-9]+$') then greatest(1, raw::int) else 1 end as week,
case when p_partkey % 3 = 0 then 0.0 else coalesce(try_cast(raw as double), 'nan'::double) end as number from (select p_partkey, case when p_partkey % 5 = 0 then 'annex' else concat('', p_size) end as raw from part)""")
def chapters_and_numbers(spark, sf):
    raw = t(spark, sf, "part").selectExpr("p_partkey", "case when p_partkey % 5 = 0 then ' annex' else concat(' ', p_size, ' ') end as raw")
    chapter = text.chapter_id(F.col("raw"))
    return raw.select("p_partkey", chapter.alias("chapter_id"), catalog.week_of_chapter(chapter).alias("week"), text.number(F.when(F.col("p_partkey") % 3 != 0, F.col("raw"))).alias("number"))


@query(f"select p_partkey, regexp_matches(p_name, '(^|[^A-Za-z0-9_])(red|small)([^A-Za-z0-9_]|$)') as has_word, concat(p_brand, ' ', p_type) as spaced, {collapse_sql('p_name')} as prompt, case when p_partkey % 2 = 0 then p_type end as note from part")
def text_edits(spark, sf):
    """Words between borders, the first underscore as a space, and sanitized fields."""
    made = t(spark, sf, "part").select("p_partkey", text.has_word(F.col("p_name"), ["red", "small"]).alias("has_word"), text.first_underscore_to_space(F.concat_ws("_", "p_brand", "p_type")).alias("spaced"), F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "  ")).alias("prompt"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lit("  ")).alias("note"))
    return catalog.sanitized(made, ["prompt"], ["note"])


@query(f"select p_partkey, case when p_partkey % 2 = 0 then 'prompt' end as field, case when p_partkey % 2 = 0 then concat(p_name, '  ') end as before, case when p_partkey % 2 = 0 then p_name end as after from part")
def logged_changes(spark, sf):
    """A record for each text that normalizing changes."""
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("  "))).otherwise(F.col("p_name"))
    return t(spark, sf, "part").select("p_partkey", text.logged_change("prompt", raw, text.collapse(text.repair(raw))).alias("c")).select("p_partkey", "c.field", "c.before", "c.after")


@query("select concat('k-', p_partkey) as id, p_name as grounding, concat_ws('|', p_type, case when p_partkey % 2 = 0 then p_brand end) as options from part")
def clean_chunks(spark, sf):
    """Prepared chunks with clean texts and options."""
    made = t(spark, sf, "part").select(F.concat(F.lit("k-"), "p_partkey").alias("id"), F.concat("p_name", F.lit(" \n")).alias("grounding"), F.array(F.concat(F.lit(" "), "p_type"), F.lit("  "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit(""))).alias("options"))
    return suggest.clean_chunks(made, ["grounding"]).select("id", "grounding", F.array_join("options", "|").alias("options"))
