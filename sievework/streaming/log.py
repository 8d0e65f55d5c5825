"""Streams over the append-only event log. The batch functions serve both; these add state, watermarks and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def action_counts(events: DataFrame, ts: str, action: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and action, final once the watermark has passed. Runs on batches alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), action).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", action, "n")


def first_seen(events: DataFrame, ts: str, *keys: str, late: str = "2 hours") -> DataFrame:
    """Events but for repeats of the same keys within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("n")).select(user, "session_window.start", "session_window.end", "n")


STATUS = {"save_draft": "draft", "mark_reviewed": "reviewed", "publish": "published", "archive": "archived"}


def current_status(events: DataFrame, key: str = "question_id", ts: str = "created_at", action: str = "action") -> DataFrame:
    """Status of each question after its events so far: that of its last event that sets one. State is one row a question,
    late events don't undo later ones, and it runs on batches alike."""
    sets = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])[F.col(action)]
    last = F.max_by(sets, F.when(sets.isNotNull(), F.struct(ts, action)))
    return events.groupBy(key).agg(F.coalesce(last, F.lit("draft")).alias("status"), F.count(F.lit(1)).alias("events"))


def append_to(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to Parquet files, exactly once."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_to(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each micro-batch to write(batch, number), which must not mind a repeated number."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
