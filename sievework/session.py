"""Session settings used by the tests, the bench and local work, and tables between stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | None = None, app: str = "sievework") -> SparkSession:
    """A local session with the settings that the queries expect (UTC, adaptive execution)."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under spark.checkpoint.dir. Where that is unset, a local session (one machine, as in tests) gets a
    folder of its own, and a cluster an error: its executors share no local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.get(context.applicationId) or tempfile.mkdtemp(prefix="sievework-")
        _own[context.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows that make a task where much is made of each.
ROWS_A_TASK = 10_000


def spread(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """df dealt out over tasks of about so many rows. A file of a million narrow rows is small, and so one task; what is made of its rows
    would all be made there. A filter on what is made is put before the dealing out, but not before the generator of one row."""
    dealt = df.repartition(max(1, -(-df.count() // rows)))
    return dealt.select(F.inline(F.array(F.struct(*df.columns))))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: later stages start from files that all executors see."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
