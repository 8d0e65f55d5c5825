"""Sampling of exams, grading, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text


def seeded_order(seed: str, key: str) -> Column:
    """A shuffle that reruns repeat: the order of a hash of seed and key."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    """size rows in shuffled order; all, if there are fewer."""
    return df.orderBy(seeded_order(seed, key), key).limit(size)


def stratified(df: DataFrame, stratum: str, key: str, seed: str, quotas: dict) -> DataFrame:
    """The quota of each stratum by shuffled order, with position 1..n in a reshuffle of all. Ranks are cut to the quota
    before the one sort over the (quota-sized) sample."""
    order = Window.partitionBy(stratum).orderBy(seeded_order(seed, key), key)
    picked = None
    for value, quota in quotas.items():
        # a literal bound on the rank lets each task keep no more than the quota before anything is moved
        mine = df.where(F.col(stratum) == F.lit(value)).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= quota).drop("_rank")
        picked = mine if picked is None else picked.unionByName(mine)
    return picked.withColumn("position", F.row_number().over(Window.orderBy(seeded_order(f"{seed}/again", key), key)))


def quota_of_each(df: DataFrame, stratum: str, key: str, seed: str, quota: int) -> DataFrame:
    order = Window.partitionBy(stratum).orderBy(seeded_order(seed, key), key)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota)


def short_strata(df: DataFrame, stratum: str, quotas: dict) -> DataFrame:
    """stratum, wanted, found of the strata that cannot fill their quota; an exam must not be made if there are any."""
    wanted = df.sparkSession.createDataFrame(list(quotas.items()), f"{stratum} {dict(df.dtypes)[stratum]}, wanted long")
    found = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("found"))
    return wanted.join(found, stratum, "left").fillna(0, ["found"]).where("found < wanted")


def exam(questions: DataFrame, seed: str, double: int = 3, regular: int = 32) -> DataFrame:
    """An exam of eligible published questions: double-weight and regular ones, reshuffled; an error if there are too few."""
    eligible = questions.where((F.col("status") == "published") & F.col("is_official_exam_eligible"))
    quotas = {True: double, False: regular}
    short = short_strata(eligible, "double_weight", quotas).collect()  # two rows at most
    if short:
        raise ValueError(f"too few questions: {[r.asDict() for r in short]}")
    return stratified(eligible, "double_weight", "id", seed, quotas)


def practice(questions: DataFrame, chapters: list[str], seed: str, size: int) -> DataFrame:
    return shuffled(questions.where((F.col("status") == "published") & F.col("chapter_id").isin(chapters)), "id", seed, size)


def graded(answers: DataFrame, questions: DataFrame, is_exam: bool) -> DataFrame:
    """answers (attempt_id, seq, question_id, selected) with is_correct, points_available and points_earned."""
    key = questions.select(F.col("id").alias("question_id"), F.transform(F.filter("options", lambda o: o["is_correct"]), lambda o: o["id"]).alias("_right"), "double_weight")
    joined = answers.join(key, "question_id", "left").withColumn("is_correct", F.coalesce(text.same_answers(F.col("selected"), F.col("_right")) & F.col("_right").isNotNull(), F.lit(False)))
    available = text.points(is_exam, F.coalesce("double_weight", F.lit(False)), F.lit(True))
    return joined.withColumn("points_available", available).withColumn("points_earned", F.when(F.col("is_correct"), available).otherwise(0)).drop("_right", "double_weight")


def latest(rows: DataFrame, keys: list[str], seq: Column, *values: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("_v")).select(*keys, "_v.*")


def with_outcomes(questions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Questions with their last outcome; those unanswered keep nulls."""
    last = latest(outcomes, ["question_id"], F.col("seq"), "is_correct", "points_earned")
    return questions.join(last, questions["id"] == last["question_id"], "left").drop("question_id")


def outcome_filter(questions: DataFrame, outcomes: DataFrame, which: str = "all") -> DataFrame:
    """Answered questions with their last outcome: all, correct or incorrect ones. Unanswered ones never count."""
    answered = with_outcomes(questions, outcomes).where(F.col("is_correct").isNotNull())
    return answered if which == "all" else answered.where(F.col("is_correct") == (which == "correct"))


def default_size(questions: DataFrame, seed_size: int, most: int = 10) -> DataFrame:
    """published, default_size: the usual size of a practice, at most what is published (or the seed's size where nothing is)."""
    counted = questions.agg(F.count_if(F.col("status") == "published").alias("published"))
    return counted.withColumn("default_size", F.least(F.lit(most).cast("long"), F.when(F.col("published") > 0, F.col("published")).otherwise(F.lit(seed_size))))


def available(questions: DataFrame, chapters: list[str]) -> DataFrame:
    """How many published questions the chosen chapters have (all chapters, if none is chosen)."""
    mine = F.col("chapter_id").isin(chapters) if chapters else F.lit(True)
    return questions.agg(F.count_if((F.col("status") == "published") & mine).alias("available"))


def running(rows: DataFrame, key: str, order: list[str], value: str, out: str = "running") -> DataFrame:
    """Running sum in each key. The window holds one attempt, which is short."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(value).over(w))


def score(outcomes: DataFrame, passing: int) -> DataFrame:
    """Per attempt: correct, incorrect, points, percent, tier, passed."""
    per = outcomes.groupBy("attempt_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct"), F.sum("points_earned").alias("points"))
    pct = text.round_half_up(text.percent(F.col("correct"), F.col("total")))
    return per.withColumns({"incorrect": F.col("total") - F.col("correct"), "pct": pct, "tier": text.tier(pct), "passed": F.col("points") >= passing})


def first_middle_last(df: DataFrame, group: str, page: str, key: str) -> DataFrame:
    """The first row of the first, middle and last distinct page of each group."""
    by_page = df.groupBy(group, page).agg(F.min_by(F.struct(key), F.col(key)).alias("_f"))
    ranked = by_page.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(page))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    return ranked.where((F.col("_at") == 1) | (F.col("_at") == F.col("_n")) | (F.col("_at") == F.floor((F.col("_n") - 1) / 2) + 1)).select(group, page, f"_f.{key}")


def pilot_budget(kind: str, n: int) -> tuple[int, int]:
    """How many new questions and rewrites a run of n items makes."""
    if kind == "new":
        return n, 0
    if kind == "rewrite":
        return 0, n
    new = max(1, -(-n // 2))
    return new, max(0, n - new)


def size_presets(available: DataFrame, column: str = "available") -> DataFrame:
    """size, enabled for the usual sizes of a practice."""
    return available.select(F.explode(F.array(*map(F.lit, (5, 10, 20, 35)))).alias("size"), column).withColumn("enabled", F.col("size") <= F.col(column))
