"""Benchmark decontamination over a distributed positional inverted index.

1. One pass over the texts stores the index: a posting (row, term, position) for each place of each benchmark term. It
   is partitioned by document. The terms are counted from the index.
2. The terms of each window of an item are ranked, the rarest in the corpus first. A window with a term that no document
   has can't occur.
3. The list of the rarest term, shifted by the term's place in the window, gives the candidates (row, window, start).
   They are intersected with the shifted list of the second rarest term, and what is left with those of all others. A
   phrase match is a candidate of which every term stands exactly where it belongs: proven by positions alone. A proximity
   match is one of which every term stands within SLOP places of where it belongs.

Positions are joined by cells of 2 * SLOP + 1 places, so that a word that fills a text is met only near its place. Lists
of the commonest terms are read only in rows that still have candidates.

A window is WINDOW consecutive words of an item; an item with fewer words, but not none, is one window.

Edge cases: null texts have no words; an item without words matches nothing; every row of the input is a document of its
own, so repeated rows get equal results, once a row; null ids are kept; an empty benchmark leaves all documents clean;
equal items each count; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import ascii_lower, row_key, sized, stored, whole, words

WINDOW, SLOP = 10, 2
CELL = 2 * SLOP + 1
#: Rows up to which the benchmark's tables (terms, windows) and the rows with candidates are broadcast; all are narrow.
MOST_TERMS = 200_000
#: A word before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PLACE = ["_row", "wid", "start"]


def windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, wid, phrase (array of its words): a row for each window of each item."""
    w = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1)))
    flat = w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), WINDOW).alias("phrase")).distinct()
    return flat.withColumn("wid", F.xxhash64(F.array_join("phrase", " ")))


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The postings (_row, term, pos) of the vocabulary's terms, and _row, _id, _th, n_words of each row of docs.

    Both come from one pass over the texts and are stored as one table. A vocabulary beyond MOST_TERMS is no filter:
    then the index has the postings of all terms.
    """
    keyed = row_key(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    raw = F.regexp_extract_all(whole(F.col("_text")), F.lit(RAW_WORD), F.lit(0))
    flat = keyed.select("_id", "_th", F.monotonically_increasing_id().alias("_row"), raw.alias("raw"))
    flat = flat.select("_id", "_th", "_row", F.size("raw").cast("long").alias("n_words"), F.posexplode_outer("raw").alias("pos", "_w"))
    flat = flat.withColumn("term", ascii_lower(F.col("_w"))).drop("_w")
    if vocabulary.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        flat = flat.join(F.broadcast(vocabulary.select("term", F.lit(True).alias("_hit"))), "term", "left")
    else:
        flat = flat.withColumn("_hit", F.col("term").isNotNull())
    begins = F.coalesce(F.col("pos"), F.lit(0)) == 0
    first = lambda c: F.when(begins, F.col(c)).alias(c)
    rows = flat.where(F.col("_hit") | begins).select("_row", F.when(F.col("_hit"), F.col("term")).alias("term"), "pos", first("_id"), first("_th"), first("n_words"))
    table = stored(rows, "postings")
    return table.where("term is not null").select("_row", "term", "pos"), table.where("n_words is not null").select("_row", "_id", "_th", "n_words")


def ranked_terms(wins: DataFrame, index: DataFrame) -> DataFrame:
    """wid, len, rank (0: rarest in the corpus), term, place of the windows that can occur at all."""
    counts = sized(stored(index.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts"), MOST_TERMS)
    flat = wins.select("wid", "phrase").distinct().select("wid", F.size("phrase").alias("len"), F.posexplode("phrase").alias("place", "term"))
    known = flat.join(counts, "term").groupBy("wid", "len").agg(F.array_sort(F.collect_list(F.struct("n", "term", "place"))).alias("by_n"))
    return known.where(F.size("by_n") == F.col("len")).select("wid", "len", F.posexplode("by_n").alias("rank", "a")).select("wid", "len", "rank", "a.term", "a.place")


def _list(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of some terms."""
    return index.join(sized(terms.select("term").distinct(), MOST_TERMS), "term", "left_semi")


def intersected(candidates: DataFrame, wanted: DataFrame, lists: DataFrame) -> DataFrame:
    """Candidates (_row, wid, start) against the lists of further terms of their windows (wanted: wid, rank, term, place):
    _row, wid, start, rank, off (least distance, at most SLOP, of the term from where it belongs); no row where there is none."""
    want = candidates.join(sized(wanted.select("wid", "rank", "term", "place"), MOST_TERMS), "wid").withColumn("want", F.col("start") + F.col("place"))
    cell = lambda p: F.floor(p / CELL).cast("int")
    left = want.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("want") - SLOP), cell(F.col("want") + SLOP)))))
    right = lists.withColumn("cell", cell(F.col("pos")))
    off = F.abs(F.col("pos") - F.col("want"))
    met = left.join(right, ["_row", "term", "cell"]).where(off <= SLOP)
    return met.groupBy(*PLACE, "rank").agg(F.min(off).alias("off"))


def matches(index: DataFrame, ranks: DataFrame) -> DataFrame:
    """_row, wid, start, len, exact: the phrase matches (exact) and the proximity matches."""
    lone = ranks.where("rank = 0")
    first = index.join(sized(lone.select("wid", "place", "term"), MOST_TERMS), "term").select("_row", "wid", (F.col("pos") - F.col("place")).alias("start")).where("start >= 0")
    second_terms = ranks.where("rank = 1")
    second = stored(intersected(first, second_terms, _list(index, second_terms)), "second-lists")
    others = ranks.where("rank > 1")
    alive = second.select("_row").distinct()
    if alive.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        lists = index.join(F.broadcast(alive), "_row", "left_semi")
    else:
        lists = index
    rest = intersected(second.select(*PLACE), others, _list(lists, others))
    held = second.unionByName(rest).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("off"))
    lens = sized(lone.select("wid", "len"), MOST_TERMS)
    several = held.join(lens, "wid").where("n = len - 1").select(*PLACE, "len", (F.col("off") == 0).alias("exact"))
    single = first.join(sized(lone.where("len = 1").select("wid", "len"), MOST_TERMS), "wid").select(*PLACE, "len", F.lit(True).alias("exact"))
    return several.unionByName(single)


def places_hit(exact: DataFrame) -> DataFrame:
    """_row, n_hit: how many places the phrase matches (_row, start, len) cover."""
    order = Window.partitionBy("_row").orderBy("start", "len")
    before = F.max(F.col("start") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col("start") + F.col("len") - F.greatest("start", F.coalesce(before, F.col("start")))
    return exact.withColumn("_new", F.greatest(F.lit(0), fresh)).groupBy("_row").agg(F.sum("_new").cast("long").alias("n_hit"))


def _texts(column: str) -> Column:
    return F.coalesce(F.col(column), F.expr("cast(array() as array<string>)"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (windows that stand nearby, but
    nowhere word by word), and _th, a hash of the text."""
    wins = stored(windows(bench), "windows")
    index, counted = build_index(docs, wins.select(F.explode("phrase").alias("term")).distinct(), id_col, text_col)
    found = stored(matches(index, stored(ranked_terms(wins, index), "ranked-terms")), "matches")
    exact = found.where("exact")
    windows_of = found.groupBy("_row", "wid").agg(F.max("exact").alias("exact"))
    near = windows_of.groupBy("_row").agg(F.count_if(~F.col("exact")).alias("n_near"))
    named = windows_of.where("exact").join(sized(wins.select("wid", "item").distinct(), MOST_TERMS), "wid")
    items = named.groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("_items"))
    per = near.join(places_hit(exact), "_row", "left").join(items, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return counted.join(per, "_row", "left").select(
        F.col("_id").alias(id_col),
        "_th",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(_texts("_items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(_texts("_items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
