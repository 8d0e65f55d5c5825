"""Row-level visibility from policy rows.

A policy allows the rows of a table that satisfy its predicate to everyone (`public`) or to those on the allow list (`admin`).
A child's policy can follow its parent: the child is visible if its parent is. A table without a policy shows nothing. Who
asks is an email; the allow list is looked up in the plan, letter case aside, so a scan is one plan with one filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """A row of the policy table. parent: the table whose visibility counts, by child key and parent key."""

    table: str
    role: str
    predicate: str = "true"
    parent: tuple[str, str, str] | None = None


#: Who sees what.
POLICIES = [
    *[Policy(t, "public") for t in ("editions", "chapters", "source_documents", "exam_rule_sets")],
    Policy("questions", "public", "status = 'published'"),
    Policy("question_options", "public", parent=("questions", "question_id", "id")),
    Policy("question_media", "public", parent=("questions", "question_id", "id")),
    *[Policy(t, "admin") for t in ("editions", "chapters", "source_documents", "exam_rule_sets", "questions", "question_options", "question_media", "admin_allowlist", "editorial_events", "ai_runs", "ai_suggestions")],
    Policy("quiz_attempts", "public", "false"),
    Policy("attempt_answers", "public", "false"),
]


def _admin(df: DataFrame, allow_list: DataFrame, email: str | None) -> DataFrame:
    """df with _admin: whether the email is on the list."""
    listed = allow_list.agg(F.coalesce(F.bool_or(F.lower("email") == F.lit((email or "").lower())), F.lit(False)).alias("_admin"))
    return df.join(F.broadcast(listed), how="cross")  # one row


def scan(tables: dict[str, DataFrame], table: str, allow_list: DataFrame, email: str | None, policies: list[Policy] = POLICIES) -> DataFrame:
    """The rows of a table that the email may see."""
    mine = [p for p in policies if p.table == table]
    own: Column = F.lit(False)
    for p in mine:
        if p.parent is None:
            own = own | (F.expr(p.predicate) if p.role == "public" else F.col("_admin") & F.expr(p.predicate))
    rows = _admin(tables[table], allow_list, email)
    followed = [p for p in mine if p.parent is not None]
    if not followed:
        return rows.where(own).drop("_admin")
    parent, child_key, parent_key = followed[0].parent
    seen = scan(tables, parent, allow_list, email, policies).select(F.col(parent_key).alias("_p"), F.lit(True).alias("_seen")).distinct()
    both = rows.join(seen, F.col(child_key) == F.col("_p"), "left")
    return both.where(own | F.coalesce("_seen", F.lit(False))).drop("_admin", "_p", "_seen")
