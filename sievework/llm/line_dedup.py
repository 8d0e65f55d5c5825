"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, last_doc, again), bucketed and sorted by the hash: how many documents of a batch
hold a line and the greatest id among them. Each new batch is merge-anti-joined with the runs that exist. Lines that no
run knows are fresh and open an entry; lines that some run knows become increments (again = true). So every line is
opened once over all runs. When a level has FAN_IN runs they are merged into one run of the next level. Runs, batches
and merges have the same buckets, so that only the batches are shuffled, once, after counting on the map side.

A line can be frequent only if a later batch met it again or its opening batch alone holds it often enough: `frequent`
adds the increments to these entries and leaves all other lines, by far the most, untouched. A second pass over the
documents drops the frequent lines, except in the last document that holds them.

Skew: a line of a third of all documents is one row a task after the map side count. Its holders are found through a
broadcast of the frequent lines, if these are few; else only of those that stand in a large share of all (line, document)
pairs, of which there are few by the share, and all other lines are joined by a shuffle (see `lookup_join`).

Edge cases: a null or empty text is one empty line; a line counts once for each doc_id that holds it, however many rows
have that id; all rows without an id count as one document, which is before any other (a line held by it alone keeps
its lines); ties need no rule, as all lines of the last document stay; an empty table gives empty runs and no rows;
further columns of the input are kept, unless they have the names of the three that are added.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import ascii_lower, shared_dir, stored, whole
from sievework.operators.skew import lookup_join

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FAN_IN = 3, 2
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hash(line: Column) -> Column:
    """128 bits of a line's key; null for lines too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= MIN_CHARS, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))


def lines_of(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


class Runs:
    """The levels of runs. State is the list of written tables, so a lost executor costs nothing that is kept here."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.names: list[str] = []

    def _write(self, entries: DataFrame, level: int) -> None:
        name = f"run_{uuid.uuid4().hex}"
        # hash buckets of as many parts as a shuffle has: neither joins nor merges of runs move them again
        out = entries.select(*KEY, "n_docs", "last_doc", "again").write.format("parquet").option("compression", "zstd")
        out.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", shared_dir(self.spark, f"run-{level}")).saveAsTable(name)
        self.names.append(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.spark.table(name))

    def forget(self) -> None:
        """Takes the runs' names out of the session's catalog; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        self.names = []

    def tables(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def known(self, lines: DataFrame) -> DataFrame:
        """lines (h1, h2, ...) with _known, whether a run has opened the line: a merge join with each run."""
        flags = []
        for i, run in enumerate(self.tables()):
            lines = lines.join(run.where("not again").select(*KEY, F.lit(True).alias(f"_in{i}")), KEY, "left")
            flags.append(f"_in{i}")
        return lines.withColumn("_known", F.coalesce(*flags, F.lit(False))).drop(*flags)

    def fresh(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (h1, h2, ...) that no run has: the merge-anti-join."""
        return self.known(lines).where("not _known").drop("_known")

    def add(self, held: DataFrame) -> None:
        """Adds a batch of (h1, h2, doc), a row for each line of each document (or several)."""
        batch = held.select(*KEY, "doc").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
        self._write(self.known(batch).withColumnRenamed("_known", "again"), 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merges the runs of a level into one of the next."""
        runs, self.levels[level] = self.levels[level], []
        self._write(merged(runs), level + 1)

    def frequent(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """h1, h2, n_docs, last_doc of the lines that at least min_docs documents hold."""
        runs = self.tables()
        more = merged([run.where("again") for run in runs]).select(*KEY, F.col("n_docs").alias("_n"), F.col("last_doc").alias("_last"))
        found = [run.where("not again").drop("again").join(more, KEY, "left") for run in runs]
        total, last = F.col("n_docs") + F.coalesce("_n", F.lit(0)), F.greatest("last_doc", "_last")
        parts = [x.select(*KEY, total.alias("n_docs"), last.alias("last_doc")).where(F.col("n_docs") >= min_docs) for x in found]
        return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merged(runs: list[DataFrame]) -> DataFrame:
    """One row a line: an entry stays an opening if one of its rows is."""
    return _union(runs).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.min("again").alias("again"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs with _kept (the text without the dropped lines), _n_lines and _n_dropped added."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("_n_lines", "_n_dropped", "_kept")]
    # the struct carries the text; nothing else does
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.struct("*").alias("_row"))
    text = F.col(f"_row.`{text_col}`")
    keyed = rows.withColumn("_th", F.xxhash64(whole(text)))
    hashes = F.array_distinct(F.filter(F.transform(lines_of(text), line_hash), lambda h: h.isNotNull()))
    held = stored(keyed.select("_id", "_th", hashes.alias("_lines")), "lines")
    flat = held.select("_id", "_th", F.inline("_lines"))

    runs = Runs(spark)
    for k in range(batches):  # all rows of an id are in one batch
        runs.add(flat.where(F.pmod(F.xxhash64("_id"), F.lit(batches)) == k).select(*KEY, F.col("_id").alias("doc")))
    frequent = stored(runs.frequent(), "frequent-lines")
    runs.forget()
    pairs = held.agg(F.sum(F.size("_lines"))).first()[0] or 0
    drops = (
        lookup_join(flat, frequent, KEY, "n_docs", pairs)
        .where(~F.col("_id").eqNullSafe(F.col("last_doc")))
        .groupBy("_id", "_th")
        .agg(F.collect_set(F.struct(*KEY)).alias("_drop"))
        .withColumnsRenamed({"_id": "_did", "_th": "_dth"})
    )
    joined = keyed.join(drops, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_th") == F.col("_dth")), "left")
    lines = lines_of(text)
    stay = F.filter(lines, lambda line: ~F.coalesce(F.array_contains(F.col("_drop"), line_hash(line)), F.lit(False)))
    done = joined.withColumn("_stay", F.when(F.col("_drop").isNull(), lines).otherwise(stay))
    n_lines = F.size(lines).cast("long")
    outputs = [n_lines.alias("_n_lines"), (n_lines - F.size("_stay")).alias("_n_dropped"), F.array_join("_stay", "\n").alias("_kept")]
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], *outputs)
