"""Coverage and status summaries; each is one pass with conditional counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text


def counts(**conditions: Column) -> list[Column]:
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def group_coverage(groups: DataFrame, items: DataFrame, key: str, group_key: str, order: str, **conditions: Column) -> DataFrame:
    """A row for each group, also those without items: total and conditional counts. Items are counted before the join."""
    per = items.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("total"), *counts(**conditions))
    joined = groups.join(per, F.col(group_key) == F.col("_k"), "left").drop("_k")
    return joined.fillna(0, ["total", *conditions]).orderBy(order)


def source_coverage(sources: DataFrame, items: DataFrame, key: str, source_key: str, title: str, missing: Column) -> DataFrame:
    """total and missing_reference for each source, most items first."""
    return group_coverage(sources, items, key, source_key, title, missing_reference=missing).orderBy(F.desc("total"), title)


def coverage_gaps(groups: DataFrame, items: DataFrame, prepared: DataFrame, group_key: str, item_key: str, prepared_key: str, live: Column) -> DataFrame:
    """The groups without live items, or that nothing is prepared for."""
    used = items.where(live).select(F.col(item_key).alias("_k")).distinct().withColumn("_used", F.lit(True))
    ready = prepared.select(F.col(prepared_key).alias("_p")).distinct().withColumn("_ready", F.lit(True))
    joined = groups.join(used, F.col(group_key) == F.col("_k"), "left").join(ready, F.col(group_key) == F.col("_p"), "left")
    return joined.where(F.col("_used").isNull() | F.col("_ready").isNull()).drop("_k", "_p", "_used", "_ready")


def status_summary(items: DataFrame, status: str, values: list[str], **conditions: Column) -> DataFrame:
    """total, a count for each status, and further conditional counts, in one row."""
    return items.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values], *counts(**conditions))


def issue_summary(issues: DataFrame, severities: list[str], categories: list[str]) -> DataFrame:
    """total, by severity and by category, of exploded issues."""
    by = [*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in severities], *[F.count_if(F.col("code") == c).alias(f"n_{c}") for c in categories]]
    return issues.agg(F.count(F.lit(1)).alias("total"), *by)


def review_tasks(issues: DataFrame, key: str, first: str = "critical", limit: int | None = None) -> DataFrame:
    """Issues, those of the first severity before the others, then by key and order."""
    ordered = issues.orderBy(F.when(F.col("severity") == first, 0).otherwise(1), key, "ord")
    return ordered if limit is None else ordered.limit(limit)


def category_breakdown(outcomes: DataFrame, category: str, correct: Column, label: str = "General") -> DataFrame:
    """total, correct, percent by category; a blank category has a label of its own."""
    named = F.coalesce(F.nullif(F.trim(F.col(category)), F.lit("")), F.lit(label))
    per = outcomes.groupBy(named.alias("category")).agg(F.count(F.lit(1)).alias("total"), F.count_if(correct).alias("correct"))
    return per.withColumn("pct", text.round_half_up(text.percent(F.col("correct"), F.col("total"))))


def run_summary(suggestions: DataFrame) -> DataFrame:
    kinds = {"new_question": "newQuestionCount", "rewrite": "rewriteCount", "flag": "flagCount", "coverage_gap": "coverageGapCount"}
    return suggestions.agg(F.count(F.lit(1)).alias("generatedCount"), *[F.count_if(F.col("suggestion_type") == k).alias(n) for k, n in kinds.items()])


def pilot_summary(records: DataFrame) -> DataFrame:
    passed = F.col("verifier_status") == "passed"
    return records.agg(
        F.count(F.lit(1)).alias("attempted"), *counts(passed=passed, failed=~passed, new_questions=F.col("suggestion_type") == "new_question", rewrites=F.col("suggestion_type") == "rewrite")
    )


def split_by(records: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Records for which the condition holds, and all others."""
    holds = F.coalesce(condition, F.lit(False))
    return records.where(holds), records.where(~holds)
