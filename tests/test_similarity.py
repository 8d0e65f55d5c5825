"""The prefix-filtered join against brute force."""

import random
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sievework.operators import similarity as s

WORDS = ["alfa", "beta", "gama", "delta", "eps", "zeta", "eta9", "theta"]


def brute(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def all_pairs(sets, t=s.NEAR):
    """The pairs of rows that links between classes and membership stand for."""
    of = {r["id"]: r["class_id"] for r in s.near_members(sets, t).collect()}
    members = {c: [i for i in of if of[i] == c] for c in set(of.values())}
    links = [(r["a"], r["b"], r["similarity"]) for r in s.near_links(sets, t).collect()] + [(c, c, 1.0) for c in members]
    return {(min(x, y), max(x, y)): sim for a, b, sim in links for x in members[a] for y in members[b] if x != y}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=9), min_size=2, max_size=14), st.sampled_from([50, 82]))
def test_near_pairs(spark, docs, t):
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id int, text string")
    want = {(i, j): brute(a, b) for i, a in enumerate(docs) for j, b in enumerate(docs) if i < j and brute(a, b) >= t / 100}
    assert all_pairs(s.tokenized(df, "id", "text"), t) == want


def test_the_threshold_is_inclusive(spark):
    fifty = [f"w{i:03d}" for i in range(50)]
    df = spark.createDataFrame([(1, " ".join(fifty)), (2, " ".join(fifty[:41])), (3, " ".join(fifty[9:]) + " other")], "id int, text string")
    assert set(all_pairs(s.tokenized(df, "id", "text"))) == {(1, 2)}


def test_lists_that_hold_all_rows_are_split(spark, monkeypatch):
    """Each text has 9 of 12 words, so every token is in most rows and every prefix list is long."""
    rnd = random.Random(3)
    vocabulary = [f"word{i}" for i in range(12)]
    docs = [sorted(rnd.sample(vocabulary, rnd.choice([8, 9, 10]))) for _ in range(300)] + [["the"]] * 3
    monkeypatch.setattr(s, "BLOCK_ROWS", 10)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id int, text string")
    sets = s.tokenized(df, "id", "text")
    want = {(i, j): brute(a, b) for i, a in enumerate(docs) for j, b in enumerate(docs) if i < j and brute(a, b) >= 0.82}
    assert all_pairs(sets) == want
    counts = Counter(i for pair in want for i in pair)
    assert {r["id"]: r["n_copies"] + r["n_near"] for r in s.near_members(sets).collect()} == {i: counts[i] for i in range(len(docs))}
    first = {i: min(x for pair in want if i in pair for x in pair if x != i) for i in counts}
    assert {r["id"]: r["match_id"] for r in s.first_match(sets).collect()} == first
    # the work of each pair of blocks is bounded: no group of records is as large as a list
    classes = s.stored(s.classes(sets).where("size(toks) > 0"), "t")
    index = s.lists(s.ordered(classes, s.stored(s.token_ranks(classes), "r"), "rep"), (), 82)
    longest = index.groupBy("token").count().agg({"count": "max"}).first()[0]
    assert longest > 5 * s.BLOCK_ROWS


def test_a_bank_of_long_lists(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = [f"word{i}" for i in range(12)]
    make = lambda n: [(i, sorted(rnd.sample(vocabulary, 9))) for i in range(n)]
    mine, bank = make(80), make(120)
    monkeypatch.setattr(s, "BLOCK_ROWS", 7)
    frames = [s.stored(s.tokenized(spark.createDataFrame([(i, " ".join(d)) for i, d in x], "id int, text string"), "id", "text"), "b") for x in (mine, bank)]
    got = {(r["a"], r["b"]): r["similarity"] for r in s.near_matches(*frames).collect()}
    assert got == {(i, j): brute(a, b) for i, a in mine for j, b in bank if brute(a, b) >= 0.82}


def test_first_match_hides_a_later_exact_one(spark):
    ten = [f"word{i}" for i in range(10)]
    rows = [(1, " ".join(ten[:9])), (2, " ".join(ten)), (3, " ".join(ten).upper()), (4, "..."), (5, "..."), (6, "")]
    sets = s.tokenized(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    got = {r["id"]: (r["match_id"], r["kind"]) for r in s.first_match(sets).collect()}
    assert got == {1: (2, "near"), 2: (1, "near"), 3: (1, "near"), 4: (5, "exact"), 5: (4, "exact")}
    assert {r["id"]: r["match_id"] for r in s.best_match(sets).collect()} == {1: 2, 2: 3, 3: 2}


def test_bank_prefers_exact(spark):
    ten = [f"word{i}" for i in range(10)]
    bank = s.tokenized(spark.createDataFrame([(1, " ".join(ten[:9])), (2, " ".join(ten))], "id int, text string"), "id", "text")
    sets = s.tokenized(spark.createDataFrame([(7, " ".join(ten)), (8, " ".join(ten[1:])), (9, "none")], "id int, text string"), "id", "text")
    assert {r["id"]: (r["match_id"], r["kind"]) for r in s.bank_match(sets, bank).collect()} == {7: (2, "exact"), 8: (2, "near")}


def test_rows_without_text_or_tokens_are_members(spark):
    """Every row has a class: one without text is a class of its own, equal texts without tokens are one."""
    df = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, ""), (4, None), (5, " "), (6, "alfa")], "id int, text string")
    got = {r["id"]: (r["class_id"], r["n_copies"], r["n_near"]) for r in s.near_members(s.tokenized(df, "id", "text")).collect()}
    assert got == {1: (1, 1, 0), 2: (1, 1, 0), 3: (3, 0, 0), 4: (4, 0, 0), 5: (5, 0, 0), 6: (6, 0, 0)}


def test_large_sets_travel_as_sketches(spark):
    """Sets of 2 to 3,000 tokens, near ones of all sizes among them: no link is lost, and the records of lists take less room than
    the sets themselves (whole sets in each list took over a hundred times that)."""
    from pyspark.sql import functions as F

    from sievework.operators import sketches

    rnd = random.Random(5)
    vocabulary = [f"word{i}" for i in range(9000)]
    docs = []
    for size in (2, 7, 60, 65, 120, 130, 500, 1020, 1030, 3000):
        whole = rnd.sample(vocabulary, size)
        docs += [whole, whole[: int(size * 0.9)], whole[: int(size * 0.815)], whole[int(size * 0.05) :] + rnd.sample(vocabulary, size // 25), rnd.sample(vocabulary, size)]
    sets = s.stored(s.tokenized(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id int, text string"), "id", "text"), "t")
    want = {(i, j): brute(a, b) for i, a in enumerate(docs) for j, b in enumerate(docs) if i < j and brute(a, b) >= 0.82}
    assert all_pairs(sets) == want and len(want) > 20
    keyed = s._keyed(sets, (), 0)
    records = sketches._records(keyed, spark.sparkContext.broadcast(sketches.bucket_counts(keyed)), 82, 8, {})
    assert records.agg(F.sum(40 + F.octet_length("sketch") + F.octet_length("keys"))).first()[0] < sets.agg(F.sum(F.size("toks") * 8)).first()[0]
