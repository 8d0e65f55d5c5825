"""Exact set-similarity joins and first matches.

Near pairs come from a prefix-filtered join: tokens are ordered by how rare they are, and two sets can only be
similar enough if they share one of their first few tokens. The sets that share one are compared inside tasks by small sketches,
in blocks of bounded size; what these let through is verified by whole sets, so nothing is lost.

Rows of equal text are one class, named by 128 bits of its hash; classes are compared, so that groups of copies stay linear.
Only hashes of tokens travel, and of most sets only those of the prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import sketches
from sievework.operators.skew import checked, lookup_join
from sievework.session import stored

#: Similarity from which prompts count as near-duplicates, in percent.
NEAR = 82
CLASS = ["k1", "k2"]
#: Sets of one list that make a block.
BLOCK_ROWS = 1 << 13


def tokenized(df: DataFrame, id_col: str, text_col: str, *within: str) -> DataFrame:
    """id, k1, k2 (key of the folded text; null where that is empty), toks (hashes of the distinct tokens), and the columns
    within which rows are compared. Folding is the costly part: store the result where it is used several times.

    A filter on a computed column is moved below the projection that computes it, and both compute it then. It does not pass
    the two generators of one row, so texts are folded once and tokens made once, whatever is asked of them later."""
    folded = df.select(F.col(id_col).alias("id"), *within, F.explode(F.array(text.fold(F.col(text_col)))).alias("_f"))
    full = F.col("_f") != ""
    made = F.struct(
        F.when(full, F.xxhash64("_f")).alias("k1"),
        F.when(full, F.xxhash64(F.lit("text"), "_f")).alias("k2"),
        F.array_distinct(F.transform(text.folded_tokens(F.col("_f")), lambda t: F.xxhash64(t))).alias("toks"),
    )
    return folded.select("id", *within, F.inline(F.array(made)))


def classes(sets: DataFrame, *within: str) -> DataFrame:
    """One row for each class of equal text (in each part of within): the key, rep (its least id), n, toks."""
    return sets.where("k1 is not null").groupBy(*within, *CLASS).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min_by("toks", "id").alias("toks"))


def exact_groups(df: DataFrame) -> DataFrame:
    """id, first_id, group_size for each row of equal, non-empty folded text. Texts are equal by 128 bits of their hash: of n
    texts, two different ones meet with a chance of about n * n / 2^129."""
    rows = stored(df.where("k1 is not null").select("id", *CLASS), "text-keys")
    groups = stored(rows.groupBy(*CLASS).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("group_size")), "text-classes")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    return lookup_join(rows, groups, CLASS, "group_size", total).select("id", "first_id", "group_size")


def _least_overlap(n: Column, t: int) -> Column:
    """Smallest number of shared tokens of a set of n with any set it is similar to, by whole numbers."""
    return F.floor((n * t + 99) / 100).cast("int")


def token_ranks(*sets: DataFrame) -> DataFrame:
    """token, df over all given sets."""
    both = sets[0].select("toks")
    for s in sets[1:]:
        both = both.unionByName(s.select("toks"))
    return both.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def ordered(sets: DataFrame, ranks: DataFrame, id_col: str = "id", within: Sequence[str] = ()) -> DataFrame:
    """id, n, o (the tokens, the rarest first) of the sets that have any; ranks: token, df, stored."""
    flat = sets.where(F.size("toks") > 0).select(F.col(id_col).alias("id"), *within, F.explode("toks").alias("token"))
    total, size = ranks.agg(F.sum("df"), F.count(F.lit(1))).first()
    ranked = lookup_join(flat, ranks, ["token"], "df", total or 0, size)
    by_rank = ranked.groupBy("id", *within).agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    return by_rank.select("id", *within, F.size("r").alias("n"), F.transform("r", lambda x: x["token"]).alias("o"))


def lists(sets: DataFrame, within: Sequence[str], t: int) -> DataFrame:
    """The prefix index of ordered sets: id, n, token, at (its place in the set, from 1) of the tokens that index a set, its
    rarest n - least overlap + 1."""
    prefix = F.slice("o", 1, F.col("n") - _least_overlap(F.col("n"), t) + 1)
    return sets.select("id", *within, "n", F.posexplode(prefix).alias("_p", "token")).select("id", *within, "n", "token", (F.col("_p") + 1).alias("at"))


def _similar(pairs: DataFrame, t: int) -> DataFrame:
    scored = pairs.withColumn("similarity", F.col("common") / (F.col("n") + F.col("m") - F.col("common")))
    return scored.where(F.col("similarity") >= t / 100).select("a", "b", "similarity")


def _keyed(sets: DataFrame, within: Sequence[str], side: int) -> DataFrame:
    """sets that have tokens, as candidates takes them, with id."""
    part = F.xxhash64(*within) if within else F.lit(0)
    more = [c for c in (*within, *CLASS) if c in sets.columns]
    return sets.where(F.size("toks") > 0).select("id", *more, F.xxhash64("id").alias("h"), part.cast("long").alias("part"), F.lit(side).alias("side"), "toks")


def _verified(met: DataFrame, sides: Sequence[DataFrame], t: int) -> DataFrame:
    """a, b, similarity of the pairs of candidates (ha, hb, stored) that are similar enough, by their whole sets."""
    texts = []
    for name, keyed in zip(("ha", "hb"), sides, strict=True):
        needed = met.select("ha").union(met.select("hb")) if sides[0] is sides[1] else met.select(name)
        if not texts or sides[0] is not sides[1]:
            texts.append(stored(keyed.join(checked(needed.toDF("h").distinct()), "h", "left_semi").select("h", "id", "part", "toks"), "candidate-sets"))
    x, y = (texts[0], texts[-1])
    x, y = (d.select(F.col("h").alias(f"h{i}"), F.col("id").alias(i), F.col("part").alias(f"p{i}"), F.col("toks").alias(f"t{i}")).dropDuplicates([f"h{i}", i]) for d, i in ((x, "a"), (y, "b")))
    both = met.join(x, "ha").join(y, "hb").where("pa = pb")
    return _similar(both.select("a", "b", F.size("ta").alias("n"), F.size("tb").alias("m"), F.size(F.array_intersect("ta", "tb")).alias("common")), t)


def _near_reps(sets: DataFrame, reps: DataFrame, within: Sequence[str], t: int) -> DataFrame:
    """a, b (a < b), similarity of the classes (reps: rep, stored) of sets (stored) that are similar enough; stored.

    Candidates come from sketches of the sets; only these pairs meet with their whole sets."""
    keyed = _keyed(sets, within, 0)
    mine = keyed.join(checked(reps.select(F.col("rep").alias("id"), *within, *CLASS)), ["id", *within, *CLASS], "left_semi")
    met = stored(sketches.candidates(mine, keyed, t, BLOCK_ROWS), "candidates")
    found = _verified(met, (keyed, keyed), t)
    ahead = F.col("a") < F.col("b")
    return stored(found.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b"), "similarity"), "near-classes")


def _reps(sets: DataFrame, *within: str) -> DataFrame:
    """The classes of sets without their tokens, stored."""
    return stored(sets.where("k1 is not null").groupBy(*within, *CLASS).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "text-classes")


def near_links(sets: DataFrame, t: int = NEAR) -> DataFrame:
    """a, b (a < b), similarity: the pairs of classes of equal text that are similar enough, each named by its least id."""
    sets = stored(sets.where("k1 is not null"), "token-sets")
    return _near_reps(sets, _reps(sets), (), t)


def near_members(sets: DataFrame, t: int = NEAR) -> DataFrame:
    """id, class_id, n_copies, n_near: of each row its class of equal text, the other rows of that class, and the rows of
    classes near it; a row without text is a class of its own. With near_links this says all that pairs of rows would,
    without making them."""
    sets = stored(sets, "token-sets")
    reps = _reps(sets)
    near = _near_reps(sets, reps, (), t)
    sizes = reps.select(F.col("rep").alias("b"), F.col("n").alias("m"))
    counts = near.select("a", "b").union(near.select("b", "a")).join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("m").alias("n_near"))
    known = stored(reps.select(*CLASS, "rep", "n").join(counts, "rep", "left"), "class-sizes")
    total = reps.agg(F.sum("n")).first()[0] or 0
    rows = lookup_join(sets.where("k1 is not null").select("id", *CLASS), known, CLASS, "n", total)
    empty = sets.where("k1 is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_near"))
    return rows.select("id", F.col("rep").alias("class_id"), (F.col("n") - 1).alias("n_copies"), F.coalesce("n_near", F.lit(0)).alias("n_near")).unionByName(empty)


def near_matches(sets: DataFrame, bank: DataFrame, t: int = NEAR) -> DataFrame:
    """a (of sets), b (of bank), similarity; both stored. As within one set, but only sets of different sides meet."""
    left, right = _keyed(sets, (), 0), _keyed(bank, (), 1)
    columns = ["h", "part", "side", "toks"]
    both = left.select(*columns).unionByName(right.select(*columns))
    met = stored(sketches.candidates(both, both, t, BLOCK_ROWS, sided=True), "candidates")
    return _verified(met, (left, right), t)


def _first_two(rows: DataFrame, key: Sequence[str], *more: str) -> DataFrame:
    """For each key the row of the least id, and that of the least id with another skip: an array e of one or two."""
    order = Window.partitionBy(*key).orderBy("e")
    apart = rows.groupBy(*key, "_skip").agg(F.min(F.struct("id", "_skip", *more)).alias("e"))
    return apart.withColumn("_nth", F.row_number().over(order)).where("_nth <= 2").groupBy(*key).agg(F.array_sort(F.collect_list("e")).alias("e"))


def first_match(sets: DataFrame, t: int = NEAR, within: Sequence[str] = (), skip: str | None = None) -> DataFrame:
    """id, match_id, kind, similarity: the first other row in id order (of the same part of within) that is equal or near;
    the earliest wins, not the best. Rows with the same value in the column `skip` are not compared.

    A row's first match is the first row of its class or of those near, or the first with another skip: two rows a class
    are kept, so groups of copies stay linear."""
    key = [*within, *CLASS]
    sets = stored(sets.where("k1 is not null").withColumn("_skip", F.col(skip or "id")).select("id", *key, "_skip", "toks"), "token-sets")
    reps = _reps(sets, *within)
    leads = stored(_first_two(sets, key).withColumnRenamed("e", "equal").join(reps.select(*key, "rep", "n"), key), "first-rows")
    near = _near_reps(sets, reps, within, t)
    both = near.union(near.select("b", "a", "similarity"))
    around = both.join(leads.select(F.col("rep").alias("b"), F.inline("equal")), "b").select(F.col("a").alias("rep"), "id", "_skip", "similarity")
    known = leads.join(_first_two(around, ["rep"], "similarity").withColumnRenamed("e", "near"), "rep", "left").drop("rep")
    known = stored(known.where((F.size("equal") > 1) | F.col("near").isNotNull()), "class-matches")
    total = reps.agg(F.sum("n")).first()[0] or 0
    rows = lookup_join(sets.select("id", *key, F.col("_skip").alias("_mine")), known, key, "n", total)
    apart = lambda x: x["_skip"] != F.col("_mine")
    equal = F.transform(F.filter("equal", apart), lambda x: F.struct(x["id"].alias("match_id"), F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity")))
    close = F.transform(F.filter("near", apart), lambda x: F.struct(x["id"].alias("match_id"), F.lit("near").alias("kind"), x["similarity"].alias("similarity")))
    return rows.withColumn("m", F.array_min(F.concat(equal, F.coalesce(close, F.slice(equal, 1, 0))))).where("m is not null").select("id", "m.*")


def best_match(sets: DataFrame, t: int = NEAR) -> DataFrame:
    """As first_match, but the most similar row, the earlier of ties."""
    sets = stored(sets.where((F.size("toks") > 0) & F.col("k1").isNotNull()).withColumn("_skip", F.col("id")), "token-sets")
    reps = _reps(sets)
    near = _near_reps(sets, reps, (), t)
    best = near.union(near.select("b", "a", "similarity")).groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("b").alias("id"))).alias("near")).select(F.col("a").alias("rep"), "near")
    known = _first_two(sets, CLASS).withColumnRenamed("e", "equal").join(reps.select(*CLASS, "rep", "n"), CLASS).join(best, "rep", "left")
    known = stored(known.where((F.size("equal") > 1) | F.col("near").isNotNull()).drop("rep"), "class-matches")
    rows = lookup_join(sets.select("id", *CLASS), known, CLASS, "n", reps.agg(F.sum("n")).first()[0] or 0)
    copies = F.transform(F.filter("equal", lambda x: x["id"] != F.col("id")), lambda x: F.struct(F.lit(-1.0).alias("s"), x["id"].alias("id")))
    m = F.least(F.array_min(copies), F.col("near"))
    return rows.withColumn("m", m).select("id", F.col("m.id").alias("match_id"), (-F.col("m.s")).alias("similarity"))


def bank_match(sets: DataFrame, bank: DataFrame, t: int = NEAR) -> DataFrame:
    """id, match_id, kind, similarity: any equal row of the bank, else the first near one. Classes are matched on both sides; rows
    of the bank with too few or too many tokens to be near any set go no further."""
    sets = stored(sets.where("k1 is not null").select("id", *CLASS, "toks"), "token-sets")
    mine = stored(classes(sets), "text-classes")
    low, high = mine.agg(F.min(F.size("toks")), F.max(F.size("toks"))).first()
    sized = bank.where((F.size("toks") * 100 >= (low or 0) * t) & (F.size("toks") * t <= (high or 0) * 100))
    known = stored(classes(sized).select(*CLASS, F.col("rep").alias("id"), "toks"), "bank-classes")
    exact = mine.join(known.select(*CLASS, F.col("id").alias("match_id")), CLASS).select("rep", "match_id", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))
    near = near_matches(mine.select(F.col("rep").alias("id"), "toks"), known, t).groupBy(F.col("a").alias("rep")).agg(F.min(F.struct(F.col("b").alias("match_id"), "similarity")).alias("m"))
    late = near.join(exact, "rep", "left_anti").select("rep", "m.match_id", F.lit("near").alias("kind"), "m.similarity")
    found = stored(exact.unionByName(late).join(mine.select(*CLASS, "rep", "n"), "rep").drop("rep"), "bank-matches")
    total = mine.agg(F.sum("n")).first()[0] or 0
    return lookup_join(sets.select("id", *CLASS), found, CLASS, "n", total).select("id", "match_id", "kind", "similarity")


def not_in_bank(candidates: DataFrame, bank: DataFrame, text_col: str, bank_col: str) -> DataFrame:
    """The candidates whose fingerprint the bank lacks. Fingerprints are compared by two 64-bit hashes, which is all that moves
    of the bank; equality as in exact_groups."""
    hashed = lambda c: [F.xxhash64(c).alias("_f1"), F.xxhash64(F.lit("text"), c).alias("_f2")]
    known = bank.where(F.col(bank_col).isNotNull()).select(text.fingerprint(F.col(bank_col)).alias("_f")).select(*hashed(F.col("_f"))).distinct()
    mine = candidates.withColumn("_f", text.fingerprint(F.col(text_col)))
    keyed = mine.select("*", *[F.when(F.col("_f").isNotNull(), c) .alias(n) for c, n in zip(hashed(F.col("_f")), ("_f1", "_f2"), strict=True)]).drop("_f")
    return keyed.join(known, ["_f1", "_f2"], "left_anti").drop("_f1", "_f2")
