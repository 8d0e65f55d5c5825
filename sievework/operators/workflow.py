"""The editorial workflow: transitions as expressions, and an append-only event log. The clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators import rules

ACTIONS = ("save_draft", "mark_reviewed", "publish", "archive", "save", "seed")


def transition(status: Column, reviewed: Column, published: Column, action: Column, now: Column) -> tuple[Column, Column, Column]:
    """Status, review date and publish date after an action."""
    new = F.when(action == "save_draft", "draft").when(action == "mark_reviewed", "reviewed").when(action == "publish", "published").when(action == "archive", "archived").otherwise(status)
    review_due = action.isin("mark_reviewed", "publish") | ((action == "save") & status.isin("reviewed", "published"))
    at_review = F.when(review_due, F.coalesce(reviewed, now)).otherwise(reviewed)
    at_publish = F.when(action.isin("save_draft", "mark_reviewed"), F.lit(None)).when(action == "publish", now).when((action == "save") & (status == "published"), F.coalesce(published, now)).otherwise(published)
    return new, at_review, at_publish


def transitioned(questions: DataFrame, action: Column, actor: Column, now: Column) -> DataFrame:
    """questions after their action; dates are set before the checks, so that publishing can succeed."""
    status, reviewed, published = transition(F.col("status"), F.col("reviewed_at"), F.col("published_at"), action, now)
    return questions.select(*[c for c in questions.columns if c not in ("status", "reviewed_at", "published_at", "updated_by", "action")], status.alias("status"), reviewed.alias("reviewed_at"), published.alias("published_at"), actor.alias("updated_by"), action.alias("action"))


def checked(questions: DataFrame) -> DataFrame:
    """questions (with action) and the issues that count for it."""
    return rules.evaluate(questions, rules.save_rules()).withColumn("issues", rules.for_action("issues", F.col("action")))


def events(questions: DataFrame, now: Column) -> DataFrame:
    """An event for each written question."""
    ms = F.unix_millis(now.cast("timestamp")).cast("string")
    return questions.select(
        F.concat_ws("-", F.lit("event"), "id", "action", ms).alias("id"), "edition_id", F.col("id").alias("question_id"), F.col("updated_by").alias("actor_email"), "action", F.lit(None).cast("string").alias("notes"), now.alias("created_at")
    )


def applied(questions: DataFrame, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(written questions, their events, refused ones with issues) for requests (id, action, actor)."""
    asked = questions.join(requests, "id")
    done = checked(transitioned(asked, F.col("action"), F.col("actor"), now)).drop("actor")
    good = done.where(F.size("issues") == 0)
    return good.drop("issues"), events(good, now), done.where(F.size("issues") > 0)


def suggestion_status(suggestions: DataFrame, ident: str, status: str, now: Column, note: Column | None = None) -> DataFrame:
    """One suggestion's new status; its note stays where none is given."""
    mine = F.col("id") == ident
    kept = F.coalesce(note if note is not None else F.lit(None), F.col("review_notes"))
    return suggestions.withColumns({"status": F.when(mine, F.lit(status)).otherwise(F.col("status")), "review_notes": F.when(mine, kept).otherwise(F.col("review_notes")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))})


def suggestion_applied(suggestions: DataFrame, ident: str, question_id: str, now: Column) -> DataFrame:
    mine = F.col("id") == ident
    done = suggestion_status(suggestions, ident, "applied", now)
    return done.withColumn("applied_question_id", F.when(mine, F.lit(question_id)).otherwise(F.col("applied_question_id")))
