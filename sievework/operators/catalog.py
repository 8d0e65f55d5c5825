"""Catalog assembly: nesting of child tables, overlays with precedence, visibility, scoping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import intervals
from sievework.operators.order import numbered
from sievework.operators.skew import checked
from sievework.sources import tables


@dataclass(frozen=True)
class Catalog:
    """The tables of a catalog."""

    editions: DataFrame
    chapters: DataFrame
    sources: DataFrame
    questions: DataFrame
    events: DataFrame
    rules: DataFrame


def nested(parents: DataFrame, children: DataFrame, key: str, parent_key: str, order: str, fields: Sequence[str], out: str) -> DataFrame:
    """parents with the array of their children in order; children are gathered before the join."""
    struct = F.struct(F.col(order).alias("order"), *[F.col(f) for f in fields if f != "order"])
    per = children.groupBy(F.col(parent_key).alias("_k")).agg(F.array_sort(F.collect_list(struct)).alias(out))
    kind = dict(per.dtypes)[out]
    return parents.join(per, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(out, F.coalesce(out, F.expr(f"cast(array() as {kind})")))


def unnested(parents: DataFrame, key: str, array: str, parent_key: str) -> DataFrame:
    """The child rows of an array column."""
    return parents.select(F.col(key).alias(parent_key), F.posexplode(array).alias("at", "c")).select(parent_key, "at", "c.*")


def questions_of(rows: DataFrame, options: DataFrame, media: DataFrame, explain: bool = True) -> DataFrame:
    """Question entities. explain: a missing public explanation is the internal one."""
    out = nested(rows, options, "id", "question_id", "display_order", ["id", "label", "text", "is_correct"], "options")
    out = nested(out, media, "id", "question_id", "display_order", ["id", "type", "url", "alt_text"], "media")
    return out.withColumn("public_explanation", F.coalesce("public_explanation", "explanation")) if explain else out


def built_options(qid: Column, texts: Column, correct: Column) -> Column:
    """Options from texts: id <qid>-opt-a, label A, order from 1."""
    return F.transform(
        texts,
        lambda t, i: F.struct(
            F.concat(qid, F.lit("-opt-"), F.char(F.lit(97) + i)).alias("id"), F.char(F.lit(65) + i).alias("label"), t.alias("text"), F.array_contains(correct, i).alias("is_correct"), (i + 1).alias("order")
        ),
    )


def inferred_mode(correct: Column) -> Column:
    return F.when(F.size(correct) > 1, "multiple").otherwise("single")


def week_of_chapter(chapter: Column) -> Column:
    """chapter-7 is week 7; else week 1."""
    week = F.regexp_replace(chapter, "^chapter-", "").try_cast("int")
    return F.when(week > 0, week).otherwise(F.lit(1))


def sanitized(df: DataFrame, texts: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """White space collapsed in texts; optional ones become null where empty."""
    return df.withColumns({c: text.collapse(F.col(c)) for c in texts} | {c: text.none_if_blank(F.col(c)) for c in optional})


def overlay(base: DataFrame, over: DataFrame, key: str, fields: bool = False) -> DataFrame:
    """Full outer overlay by key: rows of over win whole, or field by field where they are not null."""
    a = base.select(F.col(key), F.struct(*base.columns).alias("_a"))
    b = over.select(F.col(key), F.struct(*base.columns).alias("_b"))
    both = a.join(b, key, "full_outer")
    pick = (lambda c: F.coalesce(F.col(f"_b.{c}"), F.col(f"_a.{c}"))) if fields else (lambda c: F.when(F.col("_b").isNotNull(), F.col(f"_b.{c}")).otherwise(F.col(f"_a.{c}")))
    return both.select(*[(F.col(key) if c == key else pick(c)).alias(c) for c in base.columns])


def with_window(rows: DataFrame, windows: DataFrame, key: str, *values: str, annex_from: int | None = None) -> DataFrame:
    """rows with the window (window_start, window_end) of their key, and what it says of the values: configured, mismatch (the
    first value lies before it or the last one after it) and annex (one of them is annex_from or more). windows: one a key."""
    joined = rows.join(checked(windows), key, "left")
    known = F.col("window_start").isNotNull()
    first, last = F.col(values[0]).cast("double"), F.col(values[-1]).cast("double")
    outside = (text.finite(first) & (first < F.col("window_start"))) | (text.finite(last) & (last > F.col("window_end")))
    late = F.lit(False) if annex_from is None else (text.finite(first) & (first >= annex_from)) | (text.finite(last) & (last >= annex_from))
    return joined.withColumns({"configured": known, "mismatch": F.coalesce(known & outside, F.lit(False)), "annex": F.coalesce(known & late, F.lit(False))})


def with_windows(rows: DataFrame, windows: DataFrame, row_id: str, key: str, first: str, last: str | None = None) -> DataFrame:
    """rows with what many, overlapping windows a key say: configured (the key has any), n_windows (how many hold the row from
    first to last) and first_window (the least window_id of these)."""
    counts = intervals.holding(rows, windows, row_id, key, first, last)
    known = checked(windows.select(key).distinct().withColumn("configured", F.lit(True)))
    return rows.join(counts, row_id, "left").join(known, key, "left").withColumns({"n_windows": F.coalesce("n_windows", F.lit(0)), "configured": F.coalesce("configured", F.lit(False))})


def first_live(questions: DataFrame, order: Sequence[Column], n: int = 3) -> DataFrame:
    """The first questions in catalog order that are not archived."""
    return questions.where(F.col("status") != "archived").orderBy(*order).limit(n)


def ordered_questions(questions: DataFrame) -> DataFrame:
    """Questions in the order of their publication, those unpublished last, then by id."""
    return questions.orderBy(F.col("published_at").asc_nulls_last(), "id")


def catalog_places(questions: DataFrame, column: str = "place") -> DataFrame:
    """Questions with their place (from 1) in the order of publication, unpublished ones last, then by id."""
    return numbered(questions, [F.col("published_at").asc_nulls_last(), F.col("id")], column)


def active_edition(editions: DataFrame) -> DataFrame:
    """The first active edition, else the one last in effect."""
    return editions.orderBy(F.desc("is_active"), F.col("effective_from").desc_nulls_last(), "id").limit(1)


def with_floor(remote: Catalog, seed: Catalog) -> Catalog:
    """A catalog over its seed: editions by field with the active one marked, chapters and sources from the seed first,
    questions and events from the remote first, the rule set from the seed with the active edition."""
    active = active_edition(remote.editions.unionByName(seed.editions.join(remote.editions.select("id"), "id", "left_anti"))).select(F.col("id").alias("_active"))
    editions = overlay(seed.editions, remote.editions, "id", fields=True).join(F.broadcast(active), how="left")
    return Catalog(
        editions=editions.withColumn("is_active", F.col("is_active") | F.col("id").eqNullSafe(F.col("_active"))).drop("_active"),
        chapters=overlay(remote.chapters, seed.chapters, "id").orderBy("display_order"),
        sources=overlay(remote.sources, seed.sources, "id").orderBy(F.collate("title", "UNICODE")),
        questions=overlay(seed.questions, remote.questions, "id"),
        events=overlay(seed.events, remote.events, "id"),
        rules=seed.rules.drop("edition_id").join(F.broadcast(active.withColumnRenamed("_active", "edition_id")), how="left").select(*seed.rules.columns),
    )


def scoped(catalog: Catalog, edition: str) -> Catalog:
    """Chapters, questions and events of one edition; its rule set; editions and sources as they are."""
    mine = lambda df: df.where(F.col("edition_id") == edition)
    return replace(catalog, chapters=mine(catalog.chapters), questions=mine(catalog.questions), events=mine(catalog.events), rules=catalog.rules.withColumn("edition_id", F.lit(edition)))


#: Columns that questions of version v1 have and older ones lack.
ADDED = {"edition_id": "string", "public_explanation": "string"}
FILES = {"editions": "editions", "chapters": "chapters", "sources": "source_documents", "events": "editorial_events", "rules": "exam_rule_sets"}


def read_layers(spark: SparkSession, layers: dict[str, str], seed: Catalog) -> tuple[Catalog, dict[str, str]]:
    """A catalog from several folders, in the order they are given (version v1, legacy, a local cache), and the layer that each
    table came from. Each table is read from the first folder that has it, whole (questions with their options and media),
    and gets the columns that its layer lacks (by the seed's, as nulls); tables that no folder has are the seed's. Only a missing table makes the next
    layer count: what can't be read otherwise is an error."""
    read = lambda layer, name, lacking: tables.migrated(tables.read_table(spark, layers[layer], name), {c: F.lit(None).cast(kind) for c, kind in lacking.items()}, {})
    first = lambda *names: next((x for x, root in layers.items() if all(tables.has_table(spark, root, n) for n in names)), "seed")
    came = {field: first(name) for field, name in FILES.items()} | {"questions": first("questions", "question_options", "question_media")}
    found = {field: read(layer, FILES[field], dict(getattr(seed, field).dtypes)) for field, layer in came.items() if layer != "seed" and field != "questions"}
    if came["questions"] != "seed":
        found["questions"] = questions_of(*[read(came["questions"], n, ADDED if n == "questions" else {}) for n in ("questions", "question_options", "question_media")])
    return replace(seed, **found), came


def read_catalog(spark: SparkSession, root: str, seed: Catalog, strict: bool = False, cache: str | None = None) -> tuple[Catalog, str]:
    """A catalog of files and the version it was read in. Only missing tables make it fall back (to legacy files, then to the
    local cache, then to the seed); with strict they are an error. A half-migrated folder, which has some tables of v1 only,
    is read as v1 where it can be, and its other tables come from the layers below."""
    version = tables.schema_version(spark, root)
    if strict and version != "v1":
        raise ValueError(f"{root} holds no catalog of version v1")
    if version == "seed":
        if cache is None or not any(tables.has_table(spark, cache, n) for n in (*FILES.values(), "questions")):
            return seed, version
        return read_layers(spark, {"cache": cache}, seed)[0], "cache"
    if strict:
        missing = [n for n in (*FILES.values(), "questions", "question_options", "question_media") if not tables.has_table(spark, root, n)]
        if missing:
            raise ValueError(f"{root} lacks {missing}")
    found, _ = read_layers(spark, {version: root} | ({"cache": cache} if cache else {}), seed)
    return (with_floor(found, seed) if version == "v1" else found), version


def visible(df: DataFrame, is_admin: bool, status: str = "status") -> DataFrame:
    return df if is_admin else df.where(F.col(status) == "published")


def visible_children(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, is_admin: bool, status: str = "status") -> DataFrame:
    """Children whose parent is visible."""
    return children if is_admin else children.join(visible(parents, False, status).select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def allowed(emails: DataFrame, allow_list: DataFrame) -> DataFrame:
    """The emails on the list, letter case aside."""
    known = allow_list.select(F.lower("email").alias("_e")).distinct()
    return emails.join(known, F.lower("email") == F.col("_e"), "left_semi")


def searched(df: DataFrame, needle: str, columns: Sequence[str], status: str | None = None, value: str | None = None) -> DataFrame:
    """Rows of a status (all if None) with the needle in one of the columns, letter case aside."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(needle.lower()))
    kept = df.where(hit) if needle else df
    return kept.where(F.col(status) == value) if status and value else kept


def first_events(questions: DataFrame, events: DataFrame, actor: str, now: Column) -> DataFrame:
    """An event for each question: its first one, else a made-up seed event."""
    per = events.groupBy("question_id").agg(F.min_by(F.struct("id", "action", "actor_email", "created_at"), F.struct("created_at", "id")).alias("e"))
    joined = questions.select("id").join(per, questions["id"] == per["question_id"], "left")
    return joined.select(
        F.coalesce("e.id", F.concat(F.lit("event-"), F.col("id"), F.lit("-seed"))).alias("event_id"),
        F.col("id").alias("question_id"),
        F.coalesce("e.action", F.lit("seed")).alias("action"),
        F.coalesce("e.actor_email", F.lit(actor)).alias("actor_email"),
        F.coalesce("e.created_at", now).alias("created_at"),
    )
