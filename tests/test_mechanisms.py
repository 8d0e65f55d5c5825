"""Numbers over ranges, interval joins, text scans, policies, salvage, indexes and the quiz reducer, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.operators import intervals, order, policies, reducer
from sievework.sources import scans, tables
from sievework.streaming import quiz as stream_quiz


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_and_totals_over_ranges(spark, many_ranges):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.randint(0, 30), rnd.randint(-5, 5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, v int, i int").repartition(3)
    by = [F.col("x"), F.col("i")]
    got = {r["i"]: r["n"] for r in order.numbered(df, by, "n").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda kv: kv[1])] == [r[3] for r in sorted(rows, key=lambda r: (r[1], r[3]))]
    within = {r["i"]: r["n"] for r in order.numbered_within(df.where("g is not null"), ["g"], by, "n").collect()}
    total = {r["i"]: r["s"] for r in order.running_total(df, ["g"], by, "v", "s").collect()}
    for g in ("hot", "a", None):
        mine, so_far = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[3])), 0
        for nth, r in enumerate(mine, 1):
            so_far += r[2]
            assert total[r[3]] == so_far and (g is None or within[r[3]] == nth)
    ties = order.numbered(spark.range(500).selectExpr("1 as x"), [F.col("x")], "n")
    assert sorted(r["n"] for r in ties.collect()) == list(range(1, 501))
    assert order.numbered(df.limit(0), by, "n").count() == 0


def test_windows_that_overlap(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), rnd.choice([rnd.uniform(-50, 50), float(rnd.randint(-50, 50)), None, float("nan")])) for i in range(200)]
    windows = [(w, rnd.choice("ab"), float(s), float(s) + rnd.choice([0, 1, 3, 8, 64, 500, -1])) for w in range(80) for s in [rnd.randint(-60, 60)]]
    met = intervals.within(spark.createDataFrame(rows, "id int, k string, v double"), spark.createDataFrame(windows, "w int, k string, window_start double, window_end double"), ["k"], "v")
    want = sorted((i, w) for i, k, v in rows for w, kw, a, b in windows if k == kw and v is not None and a <= v <= b)
    assert sorted((r["id"], r["w"]) for r in met.collect()) == want


def test_windows_that_hold_a_range_are_counted_without_pairs(spark):
    rnd = random.Random(7)
    ends = [None, float("nan"), float("inf"), *map(float, range(-20, 20))]
    rows = [(i, rnd.choice(["a", "b", None, "c"]), lo, None if lo is None else lo + rnd.choice([0, 1, 2.5])) for i in range(300) for lo in [rnd.choice(ends)]]
    windows = [(w, rnd.choice(["a", "b", None]), lo, None if lo is None else lo + rnd.choice([-1, 0, 1, 3, 8, 30])) for w in range(150) for lo in [rnd.choice(ends)]]
    given = spark.createDataFrame(rows, "id int, k string, lo double, hi double"), spark.createDataFrame(windows, "window_id int, k string, window_start double, window_end double")
    got = {r["id"]: (r["n_windows"], r["first_window"]) for r in intervals.holding(*given, "id", "k", "lo", "hi").collect()}
    finite = lambda x: x is not None and abs(x) < float("inf")
    met = {i: [w for w, kw, a, b in windows if k == kw and k is not None and finite(lo) and finite(a) and a <= b and a <= lo and hi <= b] for i, k, lo, hi in rows}
    assert got == {i: (len(ws), min(ws)) for i, ws in met.items() if ws}
    # 400 windows hold each of 400 rows: 160,000 pairs
    all_of = spark.range(400).selectExpr("id", "1 as k", "0.5 as lo"), spark.range(400).selectExpr("id as window_id", "1 as k", "-id as window_start", "id + 1 as window_end")
    held = intervals.holding(*all_of, "id", "k", "lo")
    assert {(r["n_windows"], r["first_window"]) for r in held.collect()} == {(400, 0)} and held.count() == 400


def test_matches_across_borders_are_found_once(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("ab1 \n") for _ in range(rnd.randint(0, 300)))) for i in range(20)] + [(99, None), (98, "ab" * 40)]
    patterns = {"run": "a+b?", "digits": "1[1 ]*"}
    got = {(r["id"], r["pattern"], r["start"], r["line"], r["found"]) for r in scans.matches(spark.createDataFrame(texts, "id int, text string"), "id", "text", patterns, piece=16, overlap=64).collect()}
    assert got == {(i, n, m.start(), x.count("\n", 0, m.start()) + 1, m[0]) for i, x in texts if x for n, p in patterns.items() for m in re.finditer(p, x)}


def test_matches_that_outlast_any_piece(spark):
    """Runs that adjoin through a text, and matches of any length, are those of a scan of the whole text."""
    long = "a" * 700 + "@" + "b" * 900
    texts = [(1, "x\n" + "1" * 1001 + "\n2 2 2 2 " * 300), (2, "y " * 90 + long + "\n" + long), (3, "7" * 199 + " " * 40 + "7" * 300)]
    patterns = {"address": r"[a-z0-9.]+@[a-z0-9.]+", "number": r"[0-9][0-9 ]{2,30}[0-9]"}
    got = {(r["id"], r["pattern"], r["start"], r["line"], r["found"]) for r in scans.matches(spark.createDataFrame(texts, "id int, text string"), "id", "text", patterns, piece=200, overlap=120).collect()}
    assert got == {(i, n, m.start(), x.count("\n", 0, m.start()) + 1, m[0]) for i, x in texts for n, p in patterns.items() for m in re.finditer(p, x)}


def test_linted_files_are_bundled(spark, tmp_path):
    """The number of files goes by tasks, not by texts."""
    rows = spark.range(0, 3000, 1, 2).selectExpr("concat('f-', id, '.txt') as name", "concat('AB ', id, ' CD\\nEF') as text")
    folder = tables.write_bundles(rows, str(tmp_path / "texts"), "name", "text")
    assert len(list((tmp_path / "texts").glob("part-*"))) == 2
    found = tables.encoding_lint(tables.read_bundles(spark, folder), {"capitals": "[A-Z]{2,}"}).agg({"n": "sum", "path": "count"}).first()
    assert sorted(found) == [3000, 9000]


def test_policies_deny_what_nothing_allows(spark):
    given = {"questions": spark.createDataFrame([(1, "published"), (2, "draft")], "id int, status string"), "secrets": spark.createDataFrame([(1,)], "id int"), "attempt_answers": spark.createDataFrame([(1,)], "id int")}
    allow = spark.createDataFrame([("Boss@x.org",)], "email string")
    seen = lambda table, who: {r["id"] for r in policies.scan(given, table, allow, who).collect()}
    assert seen("questions", None) == {1} and seen("questions", "boss@X.org") == {1, 2} and seen("questions", "x") == {1}
    assert seen("secrets", "boss@x.org") == set() and seen("attempt_answers", "boss@x.org") == set()


def test_salvage_keeps_good_fields(spark):
    rows = [(1, '{"n": 5, "s": "x"}'), (2, '{"n": "five", "s": "x"}'), (3, "{broken"), (4, None), (5, '{"s": null}'), (6, "[1]")]
    got = {r["k"]: (r["n"], r["s"], r["status"]) for r in tables.salvaged(spark.createDataFrame(rows, "k int, v string"), "k", "v", "n bigint, s string", {"n": F.lit(0)}).collect()}
    assert got == {1: (5, "x", "ok"), 2: (0, "x", "defaulted"), 3: (0, None, "corrupt"), 4: (0, None, "corrupt"), 5: (0, None, "defaulted"), 6: (0, None, "corrupt")}


def scanned(df) -> int:
    """Rows that the file scans of a plan gave, after it ran."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found += node.metrics().apply("numOutputRows").value()
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_an_index_reads_fewer_rows(spark, tmp_path):
    df = spark.range(40_000).selectExpr("id", "cast(hash(id) as long) as other")
    path = tables.write_indexed(df.repartition(4, "other"), str(tmp_path), "t", ["id"], ["other"], rows_a_group=1_000)
    indexed = spark.read.parquet(path)
    assert scanned(indexed.where("id = 17")) <= 2_000
    wanted = df.where("id = 12345").first()["other"]
    by_filter = indexed.where(F.col("other") == wanted)
    assert scanned(by_filter) <= 10_000 and by_filter.count() == 1


def quiz(spark):
    rows = [(i, f"q{i}", "multiple" if i % 2 else "single", ["a", "c"] if i % 2 else ["b"], i == 0) for i in range(4)]
    return spark.createDataFrame(rows, "at int, question_id string, selection_mode string, correct array<string>, double_weight boolean")


def made_actions():
    rnd = random.Random(6)
    kinds = ["toggle"] * 4 + ["confirm"] * 2 + ["next"]
    return [(a, seq, k, rnd.choice("abc") if k == "toggle" else None) for a in ("x", "y", "long") for seq in range(300 if a == "long" else 40) for k in [rnd.choice(kinds)]]


def plain_outcomes(actions, quiz_rows):
    out = []
    for attempt in {a[0] for a in actions}:
        at, selected, done, score = 0, [], False, 0
        for _, seq, kind, option in sorted((a for a in actions if a[0] == attempt), key=lambda a: a[1]):
            if kind == "next":
                at, selected, done = min(at + 1, len(quiz_rows)), [], False
            elif at < len(quiz_rows) and not done:
                q = quiz_rows[at]
                if kind == "toggle":
                    selected = [option] if q["selection_mode"] == "single" else [x for x in selected if x != option] if option in selected else [*selected, option]
                elif selected:
                    worth = 2 if q["double_weight"] else 1
                    right = sorted(selected) == sorted(q["correct"])
                    done, score = True, score + worth * right
                    out.append((attempt, seq, at, q["question_id"], tuple(sorted(selected)), right, worth, worth * right, score))
    return sorted(out)


def flat(rows):
    return sorted(tuple(tuple(r[c]) if c == "selected" else r[c] for c in reducer.OUTCOME) for r in rows)


def test_the_reducer_in_a_batch_and_in_a_stream(spark, many_ranges, tmp_path):
    actions, q = made_actions(), quiz(spark)
    want = plain_outcomes(actions, q.orderBy("at").collect())
    df = spark.createDataFrame(actions, "attempt_id string, seq int, action string, option_id string")
    assert want and flat(reducer.outcomes(df.repartition(3), q, is_exam=True).collect()) == want
    for part in (df.where("seq < 20"), df.where("seq >= 15")):  # some actions come again
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/log")
        stream_quiz.run_to(stream_quiz.outcomes(stream, q, is_exam=True), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert flat(spark.read.parquet(f"{tmp_path}/out").collect()) == want
    with pytest.raises(ValueError, match="numbered"):
        reducer.quiz_rows(q.where("at > 0"))
