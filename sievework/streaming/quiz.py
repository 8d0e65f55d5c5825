"""The quiz reducer as a stream: a keyed state machine over the log of actions.

The state of an attempt is its question, what is selected there, whether it is answered, and the score. Actions of one
attempt must come in order of seq from batch to batch; within a batch they are sorted. An action whose seq is not above the
last one is a repeat, and is passed over, so a log that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from sievework.operators.reducer import OUTCOME, quiz_rows

#: The state store of the attempts: it keeps them on disk, not in the executor's heap.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Attempts are dealt out over so many keys, each with the states of its attempts: calling Python costs far more than an action
#: does. A checkpoint holds for the number that it was made with.
BUCKETS = 1 << 12
STATE = "attempt array<string>, seq array<long>, at array<int>, selected array<array<string>>, answered array<boolean>, score array<long>"
ROW = "attempt_id string, seq long, at int, question_id {}, selected array<string>, is_correct boolean, points_available long, points_earned long, score long"
START = (-1 << 63, 0, [], False, 0)


class Reducer:
    """Steps through the actions of the attempts of a bucket; gives a row for each confirmation that counts."""

    def __init__(self, quiz: list[tuple], is_exam: bool):
        self.quiz, self.is_exam = quiz, is_exam

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {x[0]: x[1:] for x in zip(*state.get, strict=True)} if state.exists else {}
        mine: dict[str | None, list] = {}
        for pdf in rows:
            for attempt, *action in zip(*(pdf[c].tolist() for c in ("attempt", "seq", "action", "option_id")), strict=True):
                mine.setdefault(attempt, []).append(action)
        out = []
        for attempt, log in mine.items():
            known[attempt] = self.stepped(attempt, sorted(log), known.get(attempt, START), out)
        state.update(tuple(map(list, zip(*((a, *s) for a, s in known.items()), strict=True))))
        if out:
            yield pd.DataFrame(out, columns=OUTCOME)

    def stepped(self, attempt: str | None, log: list, state: tuple, out: list) -> tuple:
        """The state of an attempt after the actions of log; what counts is appended to out."""
        last, at, selected, answered, score = state
        selected = list(selected)
        for seq, action, option in log:
            if seq <= last:
                continue
            last = seq
            if action == "next":
                at, selected, answered = min(at + 1, len(self.quiz)), [], False
                continue
            if at >= len(self.quiz) or answered:
                continue
            question_id, mode, correct, double = self.quiz[at]
            if action == "toggle":
                selected = [option] if mode == "single" else [x for x in selected if x != option] if option in selected else [*selected, option]
            elif action == "confirm" and selected:
                worth = 2 if self.is_exam and double else 1
                right = sorted(selected) == sorted(correct)
                answered, score = True, score + worth * right
                out.append((attempt, seq, at, question_id, sorted(selected), right, worth, worth * right, score))
        return last, at, selected, answered, score


def outcomes(actions: DataFrame, questions: DataFrame, is_exam: bool) -> DataFrame:
    """The stream of outcomes of a stream of actions; questions: the quiz, a batch. reducer.outcomes takes a batch of actions."""
    actions.sparkSession.conf.set(*PROVIDER)
    quiz = [(r["question_id"], r["selection_mode"], list(r["correct"]), bool(r["double_weight"])) for r in quiz_rows(questions)]
    kind, of_question = actions.schema["attempt_id"].dataType, questions.schema["question_id"].dataType.simpleString()
    slim = actions.selectExpr(f"cast(pmod(xxhash64(attempt_id), {BUCKETS}) as int) as bucket", "cast(attempt_id as string) as attempt", "cast(seq as bigint) as seq", "action", "coalesce(cast(option_id as string), '') as option_id")
    made = slim.groupBy("bucket").applyInPandasWithState(Reducer(quiz, is_exam), ROW.format(of_question), STATE, "append", "NoTimeout")
    return made.withColumn("attempt_id", F.col("attempt_id").cast(kind))


def run_to(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come so far to Parquet files, exactly once; the next run goes on from the checkpoint."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
