"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, repeated up to MAX_REPEATS times and served word by word. A word's
virtual finish time is the number of its source's words up to and including it, divided by the source's target; a
document's is that of its last word. The mix takes words in the global order of finish times (ties: sources by code
point) until the budget, all words of the input, is spent; what documents in service have been given by then counts.

The global order is made by ranges: virtual time falls into RANGES ranges, the words of each range are added up (a
document counts by the part of it that finishes there), running totals over the ranges tell where the budget ends, and
that range is split again until few words are left. These are sorted, and the last word that the budget reaches is the
cut. So the order is global to the word, though no task holds more than a range, and words become rows only there.
`mixed` writes the mix itself, range-sorted by finish time.

Scale: one pass over the texts counts words; after it a document is one narrow row. Positions in a queue are running
totals within ranges of the shuffle key, whose number follows the number of documents, so no task holds a source.
Targets are made from one row a source.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; an
empty table gives no rows; if all sizes are 0, targets are 0; repeated rows are separate documents; columns named
like ours in the input are not read beyond id, text and source.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import TOKEN, stored, whole

MAX_REPEATS = 3
#: Documents of a range of shuffle keys, about, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1_000, 1 << 20
#: Ranges of virtual time, and words that are sorted as rows in the end.
RANGES, LAST_WORDS = 1024, 100_000


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.regexp_count(whole(text), F.lit(TOKEN)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target, rank (from 1, in code point order) of each source; a row a source.

    Weights 1, 2, 3 repeat over the sources in code point order. Water-filling: with sources ordered by the level
    at which they reach MAX_REPEATS times their size, the first k are capped and the others share the rest by
    weight, for the least k at which none of these is above its cap.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        per.withColumn("rank", F.row_number().over(order))
        .withColumn("weight", (F.col("rank") - 1) % 3 + 1)
        .withColumn("_cap", F.col("source_size") * MAX_REPEATS)
        .withColumn("_full_at", F.col("_cap") / F.col("weight"))
    )
    filled = (
        ranked.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_capped_before", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_share", (F.col("_total") - F.col("_capped_before")) / (F.col("_weights") - F.col("_weights_before")))
        .withColumn("_open", F.col("_full_at") > F.col("_share"))
        .withColumn("_first", F.when(F.col("_open"), F.struct(F.row_number().over(level).alias("at"), F.col("_share").alias("share"))))
        .withColumn("_level", F.min("_first").over(everything)["share"])
    )
    target = F.when(F.col("_full_at") <= F.col("_level"), F.col("_cap")).otherwise(F.col("weight") * F.col("_level"))
    return filled.select("source", "source_size", F.coalesce(target, F.col("_cap")).cast("double").alias("target"), "rank")


def queues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The queues, stored: doc_id, size, source, source_size, target, rank, begin (words of the queue before the document).

    A queue is in the order of the shuffle key. Keys fall into ranges, totals of ranges give each its start, and running
    totals are taken within (source, range).
    """
    slim = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat_ws("|", F.lit("mix"), F.col(id_col).cast("string"))).alias("_key"),
        ),
        "mix-sizes",
    )
    ranges = min(MOST_RANGES, max(1, slim.count() // RANGE_ROWS))
    prefix = F.conv(F.substring("_key", 1, 6), 16, 10).cast("long")
    slim = slim.withColumn("_range", F.floor(prefix * ranges / (1 << 24)).cast("int"))
    starts = (
        slim.groupBy("source", "_range")
        .agg(F.sum("size").alias("_in_range"))
        .withColumn("_start", F.sum("_in_range").over(Window.partitionBy("source").orderBy("_range")) - F.col("_in_range"))
        .drop("_in_range")
    )
    targets = source_targets(slim)
    known = starts.join(targets, starts["source"].eqNullSafe(targets["source"]), "inner").drop(targets["source"])
    known = known.withColumnsRenamed({"source": "_s", "_range": "_r"})
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = slim.withColumn("_upto", F.sum("size").over(within)).join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")), "inner")
    begin = (F.col("_start") + F.col("_upto") - F.col("size")).alias("begin")
    return stored(queued.select("doc_id", "size", "source", "source_size", "target", "rank", begin), "mix-queues")


def finish(place: Column) -> Column:
    """Virtual finish time of the word at a place (from 1) of its source's queue; null where the target is 0."""
    return place / F.when(F.col("target") > 0, F.col("target"))


def served_by(time: Column, before: Column, strictly: Column) -> Column:
    """How many words of the row's copy, of which `before` words of its queue come first, finish by a time (or before it)."""

    def late(place: Column) -> Column:
        at = finish(place)
        return F.when(strictly, at >= time).otherwise(at > time)

    guess = F.floor(time * F.col("target")).cast("long")  # off by one at most
    places = guess + (~late(guess + 1)).cast("long") - late(guess).cast("long")
    return F.coalesce(F.greatest(F.lit(0), F.least(F.col("size"), places - before)), F.lit(0)).cast("long")


class Cut(NamedTuple):
    """The last word that the budget reaches: its finish time and its source's rank."""

    time: float
    rank: int


def cut(queued: DataFrame) -> Cut | None:
    """Where the global order of finish times is cut, so that the words up to there are as many as the budget."""
    budget, last = queued.agg(F.sum("size"), F.max(finish(F.col("source_size") * MAX_REPEATS))).first()
    if not budget:
        return None
    copies = queued.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    copies = copies.withColumn("before", F.col("copy") * F.col("source_size") + F.col("begin"))
    low, high, spent, here = 0.0, float(last), 0, None
    never = F.lit(False)
    while here is None or here > LAST_WORDS:
        step = (high - low) / RANGES
        edges = [low + i * step for i in range(RANGES)] + [high]
        if not all(a < b for a, b in zip(edges, edges[1:])):
            break  # the range is as narrow as numbers are
        first, until = finish(F.col("before") + 1), finish(F.col("before") + F.col("size"))
        inside = copies.where((until > low) & (first <= high))
        of = lambda x: F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor((x - low) / step))).cast("int")  # noqa: E731, B023
        # the edges around the estimate, in case of rounding; ranges without words of the copy add nothing
        spread = inside.withColumn("_r", F.explode(F.sequence(F.greatest(F.lit(0), of(first) - 1), F.least(F.lit(RANGES - 1), of(until) + 1))))
        edge = F.lit(edges)
        words = served_by(F.get(edge, F.col("_r") + 1), F.col("before"), never) - served_by(F.get(edge, F.col("_r")), F.col("before"), never)
        totals = {r["_r"]: r["n"] for r in spread.groupBy("_r").agg(F.sum(words).alias("n")).collect()}  # RANGES rows at most
        for r in range(RANGES):
            here = totals.get(r, 0)
            if spent + here >= budget:
                low, high = edges[r], edges[r + 1]
                break
            spent += here
    done, upto = (served_by(F.lit(t), F.col("before"), never) for t in (low, high))
    words = copies.withColumn("_done", done).withColumn("_upto", upto).where("_upto > _done")
    words = words.withColumn("_place", F.explode(F.sequence(F.col("_done") + 1, F.col("_upto")))).select("rank", finish(F.col("before") + F.col("_place")).alias("time"))
    reached = words.orderBy("time", "rank").limit(budget - spent)
    return Cut(*reached.agg(F.max(F.struct("time", "rank")).alias("c")).select("c.*").first())


def taken_of_copy(copy: Column, at: Cut | None) -> Column:
    """Words taken of a copy of the row's document."""
    if at is None:
        return F.lit(0).cast("long")
    return served_by(F.lit(at.time), copy * F.col("source_size") + F.col("begin"), F.col("rank") > at.rank)


def mixed(queued: DataFrame, at: Cut | None) -> DataFrame:
    """The mix in serving order: doc_id, source, copy (from 0), finish (of the copy's last word), words. Range-sorted."""
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    whole_copy = finish(F.col("copy") * F.col("source_size") + F.col("begin") + F.col("size"))
    out = copies.select("doc_id", "source", "copy", whole_copy.alias("finish"), taken_of_copy(F.col("copy"), at).alias("words")).where("words > 0")
    return out.repartitionByRange("finish", "source", "doc_id").sortWithinPartitions("finish", "source", "doc_id", "copy")


def taken_by_document(docs: DataFrame, **cols: str) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken."""
    queued = queues(docs, **cols)
    at = cut(queued)
    taken = sum((taken_of_copy(F.lit(i), at) for i in range(1, MAX_REPEATS)), taken_of_copy(F.lit(0), at))
    return queued.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
