"""Conversation repair against a search over all edits."""

import functools
import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievework.llm import conversations as c

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"
sys.setrecursionlimit(20_000)


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(kind, text)
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_repair(rows):
    """rows: turn, role, text in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @functools.cache
    def best(i, state, inserts):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))

        def then(cost, letter, line, nxt, j, left):
            if nxt is not None and (rest := best(j, nxt, left)):
                options.append((cost + rest[0], letter + rest[1], (line, *rest[2]) if line is not None else rest[2]))

        for role in ("user", "assistant"):
            if inserts:
                then(5, "I", f"{role}:", follow.get((state, role[0])), i, inserts - 1)
        if i < len(rows):
            _, role, text = rows[i]
            then(2, "D", None, state, i + 1, 3)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                then(more, "K", f"{role}:{text}", follow.get((state, role[:1])), i + 1, 3)
                for to in ("user", "assistant"):
                    then(more + 1, "R", f"{to}:{text}", follow.get((state, to[0])), i + 1, 3)
        return min(options, key=lambda o: o[:2]) if options else None

    cost, audit, lines = best(0, "", 3)
    turns = [t for t, _, _ in rows if t is not None]
    roles = [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    n = Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute(rows, order):
    return Counter((conv, *brute_repair(sorted(mine, key=order))) for conv, mine in brute_damage(rows).items())


def found(df):
    names = ["conv_id", *(x.split()[0] for x in c.OUT.split(", "))]
    return Counter(tuple(r[n] for n in names) for r in df.select(names).collect())


def by_turn(row):
    return (row[0] is not None, row[0] or 0)


def test_the_given_conversations(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found(c.repair(c.damaged(table))) == brute(rows, by_turn)


def made(seed, convs=60, longest=14):
    """Conversations with all faults, odd roles and nulls; turns are told apart, so the order is given."""
    rnd = random.Random(seed)
    out = []
    for conv in [None, *range(convs)]:
        turns = rnd.sample(range(30), rnd.randint(1, longest))
        for turn in [*turns, *([None] if rnd.random() < 0.1 else [])]:
            role = rnd.choice(["user", "user", "assistant", "assistant", "system", "tool", "umpire", "", None])
            text = rnd.choice(["", " \n", "Yes.", "Yes.", "No!", "Is it?", "cut off", "Ünd so.", None, f"line {turn}.", f"line {turn}"])
            out.append((conv, turn, role, text))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_made_conversations(spark, seed):
    rows = made(seed)
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "text").selectExpr("*", "1 as part", "2 as seq", "'x' as blank", "4 as copies")
    assert found(c.repair(c.damaged(table))) == brute(rows, by_turn)


def test_conversations_over_many_segments_and_tasks(spark, monkeypatch):
    """One conversation holds most rows; segments are cut after a few rows, so all of the steps between them decide."""
    monkeypatch.setattr(c, "SEGMENT_ROWS", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rnd = random.Random(5)
        rows = made(3, convs=10) + [(99, t, rnd.choice(["user", "assistant", "assistant", "tool"]), rnd.choice(["Yes.", f"so {t % 40}.", f"cut {t}", " "])) for t in range(0, 160, 2)]
        table = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert found(c.repair(c.damaged(table))) == brute(rows, by_turn)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_segments_are_cut_inside_workers(spark):
    """The bounds hold in one process too, where the patched value is sure to be seen."""
    old = c.SEGMENT_ROWS
    c.SEGMENT_ROWS = 3
    try:
        rows = [{"conv_id": 1, "turn": t, "role": "user", "text": "a.", "blank": False, "cut": False, "copies": 1} for t in range(8)]
        parts = list(c.cut(iter(rows), 0))
        assert [len(s.turns) for s in parts] == [3, 3, 2] and all(s.edge for s in parts)
    finally:
        c.SEGMENT_ROWS = old


def test_equal_turns_and_repeated_rows(spark):
    rows = [(1, 3, "user", "a."), (1, 3, "user", "a."), (1, 3, "assistant", "b."), (2, None, "user", "x."), (2, None, "user", "x.")]
    got = {r["conv_id"]: r for r in c.repair(c.damaged(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(got) == {1, 2} and got[2]["gaps"] == 0 and got[2]["duplicate"] >= 1 and got[1]["gaps"] == 0


def test_dropped_conversations_stay_in_the_result(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = c.repair(c.damaged(spark.createDataFrame([(dropped, 0, "user", "Hello.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert c.repair(c.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_matrices_fold_to_the_cost_of_the_whole():
    rows = [r for r in made(7, convs=1, longest=14) if r[0] == 0]
    whole = c.Segment(0, 0, 0, False)
    pieces = []
    for i, (_, turn, role, text) in enumerate(rows):
        role, text = role or " ", text or " "
        bare = text.rstrip(SPACES)
        if i % 4 == 0:
            pieces.append(c.Segment(0, 0, len(pieces), True))
        for s in (whole, pieces[-1]):
            s.add(turn, role, f"{text}{i}" if bare else text, not bare, bool(bare) and i % 3 == 0)
    cost = next(c.solved([whole]))["cost"]
    after = c.CLOSING
    for s in reversed(pieces):
        _, tensors = next(c.buckets([s]))
        m = c.backward(*tensors, np.broadcast_to(c._ENDS, (1, 4, 4)))[0, 0]
        after = (m + after[None, :]).min(axis=1)
    assert after[c.START] == cost
