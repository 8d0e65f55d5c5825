"""Streams give what the batch functions give."""

import datetime as dt

from pyspark.sql import functions as F

from sievework.streaming import log


def make(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, f"q{i % 3}", a, t0 + dt.timedelta(minutes=10 * i)) for i, a in enumerate(["save_draft", "mark_reviewed", "publish", "publish", "archive", "save", "archive"])]
    df = spark.createDataFrame(rows, "id long, question_id string, action string, created_at timestamp")
    for i in range(2):
        df.where(F.col("id") % 2 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    return df, log.read_log(spark, f"{tmp_path}/log", df.schema)


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_counts_and_status(spark, tmp_path):
    batch, stream = make(spark, tmp_path)
    got = run(log.action_counts(stream, "created_at", "action"), "counts", "complete", tmp_path)
    want = log.action_counts(batch, "created_at", "action")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    status = run(log.current_status(stream), "status", "update", tmp_path)
    last = {r["question_id"]: (r["status"], r["events"]) for r in status.orderBy("events").collect()}
    assert {tuple(r) for r in log.current_status(batch).collect()} == {(q, *x) for q, x in last.items()}
    assert last == {"q0": ("archived", 3), "q1": ("archived", 2), "q2": ("published", 2)}


def test_sinks(spark, tmp_path):
    batch, stream = make(spark, tmp_path)
    log.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/cp1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.count()
    seen = []
    log.upsert_to(stream, f"{tmp_path}/cp2", lambda df, n: seen.append((n, df.count()))).awaitTermination()
    assert sum(n for _, n in seen) == batch.count()
    assert run(log.first_seen(stream, "created_at", "question_id", late="1 day"), "first", "append", tmp_path).count() == 3
