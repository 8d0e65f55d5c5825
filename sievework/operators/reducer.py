"""The quiz reducer: what toggles, confirmations and steps of an ordered log of actions come to.

A quiz is a short list of questions, the same for all its attempts. An attempt starts at the first question with nothing
selected. `toggle` selects an option (in single selection in place of the others), or takes it back; `confirm` counts once
something is selected and the question is not answered yet; nothing but `next` changes an answered question; `next` goes on, at
the last question to the end, where toggles and confirmations mean nothing.

In a batch, a question's number is how many `next` came before, a running total over ranges; then each visit of a question
is a small fold of its own. In a stream (streaming/quiz.py) the same steps are taken one by one, with the state kept.

Actions: attempt_id, seq (distinct within an attempt), action, option_id. Questions: at (0, 1, ...), question_id, selection_mode,
correct (ids), double_weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators.order import running_total

#: The most questions of a quiz, which is broadcast.
MOST_QUESTIONS = 10_000
OUTCOME = ["attempt_id", "seq", "at", "question_id", "selected", "is_correct", "points_available", "points_earned", "score"]


def quiz_rows(questions: DataFrame) -> list:
    """The questions of a quiz in order; an error if they are no quiz."""
    rows = questions.select("at", "question_id", "selection_mode", "correct", "double_weight").orderBy("at").limit(MOST_QUESTIONS + 1).collect()
    if len(rows) > MOST_QUESTIONS or [r["at"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"a quiz has at most {MOST_QUESTIONS} questions, numbered from 0")
    return rows


def _step(s: Column, x: Column) -> Column:
    """The state of a visit (selected, confirmed: the seq of the confirmation that counts) after an action."""
    selected = F.when(F.col("selection_mode") == "single", F.array(x["option_id"])).otherwise(text.toggle(s["selected"], x["option_id"]))
    open_ = s["confirmed"].isNull()
    toggled = F.when(open_ & (x["action"] == "toggle"), selected).otherwise(s["selected"])
    confirmed = F.when(open_ & (x["action"] == "confirm") & (F.size(s["selected"]) > 0), x["seq"]).otherwise(s["confirmed"])
    return F.struct(toggled.alias("selected"), confirmed.alias("confirmed"))


def outcomes(actions: DataFrame, questions: DataFrame, is_exam: bool) -> DataFrame:
    """A row for each confirmation that counts: OUTCOME, with the attempt's score so far."""
    total = len(quiz_rows(questions))
    slim = actions.select("attempt_id", F.col("seq").cast("long").alias("seq"), "action", F.col("option_id").cast("string").alias("option_id"))
    counted = running_total(slim.withColumn("_next", (F.col("action") == "next").cast("int")), ["attempt_id"], [F.col("seq")], "_next", "_nexts")
    on = counted.where("action <> 'next'").withColumn("at", F.least("_nexts", F.lit(total)).cast("int")).join(F.broadcast(questions.withColumn("at", F.col("at").cast("int"))), "at")
    facts = ["question_id", "selection_mode", "correct", "double_weight"]
    visits = on.groupBy("attempt_id", "at", *facts).agg(F.array_sort(F.collect_list(F.struct("seq", "action", "option_id"))).alias("_log"))
    start = F.expr("named_struct('selected', cast(array() as array<string>), 'confirmed', cast(null as bigint))")
    done = visits.withColumn("_s", F.aggregate("_log", start, _step)).where("_s.confirmed is not null")
    correct = text.same_answers(F.col("_s.selected"), F.col("correct"))
    available = text.points(is_exam, F.col("double_weight"), F.lit(True))
    marked = done.select("attempt_id", F.col("_s.confirmed").alias("seq"), "at", "question_id", F.array_sort("_s.selected").alias("selected"), correct.alias("is_correct"), available.cast("long").alias("points_available"))
    earned = marked.withColumn("points_earned", F.when(F.col("is_correct"), F.col("points_available")).otherwise(0))
    return running_total(earned, ["attempt_id"], [F.col("seq")], "points_earned", "score").select(*OUTCOME)
