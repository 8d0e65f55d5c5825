"""Every operator against a brute-force version in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.llm import decontam, html_text, licenses, line_dedup, matroska, mixing, near_dup, pii, quality, warc
from sievework.operators import skew

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_warc_round_trip(spark, monkeypatch):
    base = spark.read.parquet(f"{SMALL}/pages.parquet")
    big = "<html>" + "équal " * 40 + "</html>"
    extra = spark.createDataFrame([(9001, "http://a/", None), (9002, None, "short"), (9003, "http://b/", "short"), (9005, "http://b/", big), (9004, "http://c/ d", big), (9006, "http://c/", big), (9004, "http://c/ d", big), (None, "u", big), (None, None, "only null ids hold this page " * 9)], base.schema)
    pages = base.unionByName(extra).withColumn("payload", F.lit(1)).repartition(3)
    data = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    first = {}
    for p, b in data:
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    want = Counter((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if first.get(b, p) != p else "response", first[b] if first.get(b, p) != p else None) for p, b in data)
    got = warc.round_trip(pages)
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    monkeypatch.setattr(skew, "MOST_ROWS", 0)  # more repeated payloads than are broadcast
    assert rows(warc.round_trip(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert not warc.round_trip(pages.limit(0)).count()


def test_warc_reads_single_records_from_small_frames(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(20).coalesce(1)
    index = warc.write(warc.decided(pages), f"file://{tmp_path}/w")
    want = index.orderBy("page_id").first()
    got = warc.fetch(spark, index, [want["record_id"]]).collect()
    html = pages.where(F.col("page_id") == want["page_id"]).first()["html"]
    assert [(r["page_id"], bytes(r["payload"]).decode()) for r in got] == [(want["page_id"], html)]
    assert index.select("frame").distinct().count() > 1


def test_a_revisit_names_the_record_of_its_response():
    rid, _ = warc.record(3, "u", "response", "ab" * 32, 200, None, b"x" * 200)
    _, raw = warc.record(9, "u", "revisit", "ab" * 32, 200, 3, b"x" * 200)
    fields, payload = warc.parse(raw)
    assert fields["WARC-Refers-To"] == rid and payload == b""


def test_a_page_longer_than_a_frame(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 1000)
    html = "".join(chr(97 + i * i % 26) for i in range(5000))
    pages = spark.createDataFrame([(1, "u", html), (2, "u", "small"), (3, "u", html)], "page_id long, url string, html string")
    index = warc.write(warc.decided(pages.coalesce(1)), warc.shared_dir(spark, "long"))
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_back(index, with_payload=True).collect()}
    assert got == {1: html, 2: "small", 3: ""} and index.where("length > 5000").count() == 1


def test_license_scan(docs, texts, empty_docs):
    phrases = {tuple(k.split()): v for k, v in licenses.BASE.items()}
    want = Counter()
    for d, t in texts:
        w = WORD.findall(t.translate(AZ))
        at = [(i, v) for p, v in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        places = [i for i, _ in at]
        want[d, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({v for _, v in at}))] += 1
    got = licenses.scan(docs)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert not licenses.scan(empty_docs).count()


def test_license_spans_survive_edits(spark):
    text = "bla Permission is hereby granted, free of charge, to any odd person obtaining copies of this software and associated documentation files bla"
    df = spark.createDataFrame([(1, text), (2, "permission to speak is hereby given to any person")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}
    assert got == {1: "mit", 2: ""}


def test_licenses_compete_and_stand_in_order(spark):
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    shuffled = " ".join(" ".join(mit.split()[i : i + 4]) for i in (16, 12, 8, 4, 0))
    texts = {
        1: "This work is licensed under the GNU General Public License version 3. More text follows here.",
        2: "This work is licensed under the GNU General Public License version 2.",
        3: "x " * 30 + mit + " y" * 50 + " licensed under the Apache License, Version 2.0 z",
        4: shuffled,
        5: "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        6: " ".join(f"{w} q q q" for w in mit.split()),
        7: f"{mit} " * 40,
    }
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "gpl,gpl-3.0", 2: "gpl,gpl-2.0", 3: "apache-2.0,mit", 4: "", 5: "gpl,gpl-3.0", 6: "", 7: "mit"}


def test_main_text(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies<article><h1>Head &amp; line</h1><p>One <b>bold</b>&nbsp;word<br>next<p>Two &copy; 3 &lt; 4
    <aside>aside</aside><form>f<input></form><script>var a="</p>";</script><ul><li>first<li>second</ul><div class="comments"><p>nice!</p></div></article><footer>foot"""
    plain = "<body><p>Just <i>text</i></p>\n<table><tr><td>a</td><td>b</td></tr></table><div hidden>no</div><div id=side-bar class='x sidebar'>no</div></body>"
    template = [(100 + i, "http://h.example/x", f"<body><div><span>Read our other stories today</span></div><p>own text {i}</p></body>") for i in range(20)]
    data = [(1, "http://a.example/", page), (2, None, plain), (3, "bad url", None), (4, "http://a.example/", ""), (5, "http://a.example/", "no <b markup"), *template]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    want = {1: "Head & line\n\nOne bold word next\n\nTwo © 3 < 4\n\nfirst\n\nsecond", 2: "Just text\n\na b", 3: "", 4: "", 5: "no"} | {100 + i: f"own text {i}" for i in range(20)}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_main_text_keeps_copied_articles(spark):
    """Articles copied on a host stay whole in containers, as bare text and without markup; what recurs beside them goes."""
    words = " ".join(f"word{i}" for i in range(30))
    paragraphs = f"<h1>Head</h1><p>One {words}</p><p>Two</p><ul><li>a<li>b</ul>"
    other = "<div><span>Read our other stories</span></div>"
    bodies = {
        1: (f'<article><div class="entry">{paragraphs}</div>{other}</article>', f"Head\n\nOne {words}\n\nTwo\n\na\n\nb"),
        2: (f"{paragraphs.replace('word', 'plain')}{other}", f"Head\n\nOne {words}\n\nTwo\n\na\n\nb".replace("word", "plain")),
        3: (f"{other}<div><section>{paragraphs.replace('word', 'held')}</section></div>", f"Head\n\nOne {words}\n\nTwo\n\na\n\nb".replace("word", "held")),
        4: (f"<article><div>Bare {words}</div></article>", f"Bare {words}"),
    }
    data = [(100 * k + i, "http://c.example/", f"<body>{body}</body>") for k, (body, _) in bodies.items() for i in range(12)]
    data += [(900 + i, "http://c.example/", f"<body><article><p>own {i} {words}</p><div><p>Follow us today</p></div></article></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    want = {100 * k + i: text for k, (_, text) in bodies.items() for i in range(12)} | {900 + i: f"own {i} {words}" for i in range(12)}
    assert got == want


def test_main_text_of_the_pages(spark):
    """The article of each page, cut out by its tags."""
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", article))]
        assert got[r["page_id"]] == "\n\n".join(filter(None, blocks))


def luhn(x: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(x)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[str, int, int]]:
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        out += [(kind, *m.span()) for m in re.finditer(pattern, t) if good(m)]
    return out


def test_pii(docs, texts, empty_docs):
    want = Counter()
    for d, t in texts:
        s = base_spans(t)
        n = Counter(k for k, _, _ in s)
        want[d, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in s))] += 1
    got = pii.find(docs)
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    texts_by = {(d, sha(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t)))): base_spans(t) for d, t in texts}
    for r in got.collect():
        spans = r["spans"].split(",")
        assert {f"{k}:{a}:{b}" for k, a, b in texts_by[r["doc_id"], r["base_sha256"]]} <= set(spans)
    assert any("secret:" in r["spans"] for r in got.where("doc_id = 9014").collect())
    assert not pii.find(empty_docs).count()


def test_secrets_of_any_length_are_whole(spark):
    texts = ["see token = " + "aB3+" * n + " end" for n in (2, 50, 51, 5000)]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select("text", pii.located(F.col("text"), "secret").alias("m")).collect()
    assert {r["text"]: [(x["start"], x["value"]) for x in r["m"]] for r in found} == {t: [(4, t[4:-4])] for t in texts}


def test_media(docs, texts, empty_docs):
    want = Counter()
    for d, t in texts:
        raw = t.encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want[d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    got = matroska.media_digest(docs).cache()
    assert rows(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == want
    assert got.where("media_bytes <= payload_bytes or length(media_sha256) <> 64 or feature like '%!%'").count() == 0
    assert not matroska.media_digest(empty_docs).count()


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_lacing_of_all_kinds(kind):
    sizes = [[700], [3, 0, 255, 256, 900, 1], [40, 40, 40], [500, 300, 3000, 20000, 1]][kind]
    frames = [bytes([i + 1]) * n for i, n in enumerate(sizes)]
    data = matroska.laced(frames, kind) if kind else frames[0]
    assert [data[a : a + n] for a, n in matroska.frame_ranges(data, 0, len(data), kind)] == frames


def test_packets_of_foreign_files():
    block = matroska.vint(2) + b"\x00\x05\x00" + b"data"
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, block))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.number(matroska.TIMESTAMP, 70) + group  # of unknown size
    data = matroska.element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + cluster + cluster
    got = matroska.packets(data)
    assert [(t, time, c) for t, time, _, _, _, c in got] == [(2, 75, 0), (2, 75, 1)] and all(data[a : a + n] == b"data" for *_, a, n, _ in got)
    assert len(matroska.packets(data[:-3])) >= 1


def test_quality_learns_and_holds_out(spark, docs, empty_docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    done = quality.classify(base, labels).withColumn("held", quality.held_out("doc_id")).cache()
    truth = done.join(labels.select("doc_id", "quality"), "doc_id").where("held").select("quality", "_predicted", "_score").collect()
    right = sum(r["quality"] == r["_predicted"] for r in truth)
    assert len(truth) > 60 and right / len(truth) > 0.93
    want = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in base.select("doc_id").collect()}
    assert {r["doc_id"]: r["held"] for r in done.select("doc_id", "held").collect()} == want
    odd = labels.limit(0).union(spark.createDataFrame([(9001, None, 0), (None, 1, 0), (9004, 1, 0), (9004, 0, 0)], labels.schema))
    again = quality.classify(docs, odd)
    assert again.count() == docs.count() and again.where("_score is null or _score < 0 or _score > 1").count() == 0
    assert not quality.classify(empty_docs, labels).count()


def test_decontamination(spark, docs, texts, empty_docs):
    base = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    some = [t for d, t in texts if len(WORD.findall(t)) > 40][:3]
    cut = lambda t, a, n: " ".join(WORD.findall(t)[a : a + n])
    extra = [(900, None), (901, ""), (902, "one two"), (903, cut(some[0], 3, 25)), (904, cut(some[1], 5, 10).upper() + " zzz qqq"), (905, "word " * 12), (906, "word word"), (907, "école"), (908, "ÉCOLE"), (902, "three four")]
    bench = base.unionByName(spark.createDataFrame(extra, base.schema))
    wins = defaultdict(set)
    for r in bench.collect():
        w = WORD.findall((r["text"] or "").translate(AZ))
        for i in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[i : i + 10])].add(str(r["item_id"]))
    sizes = {len(x) for x in wins}
    want = Counter()
    for d, t in texts:
        w = WORD.findall(t.translate(AZ))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        want[d, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)] += 1
    got = decontam.contamination(docs, bench)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert not decontam.contamination(empty_docs, bench).count()
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_phrases_and_proximity_come_from_positions(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "solo")], "item_id long, text string")
    texts_ = ["alpha beta gamma", "x alpha extra beta gamma", "alpha one two three four five six beta gamma", "gamma", "Solo alpha alpha beta beta gamma"]
    docs = spark.createDataFrame(list(enumerate(texts_, 1)), "doc_id long, text string")
    wins = decontam.windows(bench)
    index, counted = decontam.build_index(docs, wins.select(F.explode("phrase").alias("term")).distinct())
    ranks = decontam.ranked_terms(wins, index)
    names = {r["_row"]: r["_id"] for r in counted.collect()}
    found = lambda ix: Counter((names[r["_row"]], r["len"], r["exact"]) for r in decontam.matches(ix, ranks).collect())
    want = {(1, 3, True), (2, 3, False), (5, 1, True), (5, 3, False)}
    assert set(found(index)) == want
    row = {v: k for k, v in names.items()}[1]
    for term in ("alpha", "beta", "gamma"):  # without one posting there is no match
        assert set(found(index.where(f"not (_row = {row} and term = '{term}')"))) == want - {(1, 3, True)}
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["n_near"]) for r in decontam.contamination(docs, bench).collect()}
    assert got == {1: (3, 1, 0), 2: (0, 0, 1), 3: (0, 0, 0), 4: (0, 0, 0), 5: (1, 1, 1)}


def test_decontamination_beyond_the_bounds_of_broadcasts(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark"))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
    want = rows(decontam.contamination(docs, bench), *cols)
    monkeypatch.setattr(decontam, "MOST_TERMS", 0)
    assert rows(decontam.contamination(docs, bench), *cols) == want and any(k[5] for k in want)


def test_mix(docs, texts, empty_docs):
    got = mixing.taken_by_document(docs).collect()
    size = Counter((d, len(TOKEN.findall(t))) for d, t in texts)
    assert Counter((r["doc_id"], r["size"]) for r in got) == size
    of = {(r["doc_id"], r["text"] or ""): r["source"] for r in docs.select("doc_id", "text", "source").collect()}
    total = defaultdict(int)
    for d, t in texts:
        total[of[d, t]] += len(TOKEN.findall(t))
    order = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    budget, full, target = sum(total.values()), set(), {}
    while True:
        left = budget - sum(3 * total[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s, x in share.items() if x > 3 * total[s]}
        if not over:
            break
        full |= over
    target = {s: share.get(s, 3 * total[s]) for s in order}
    taken = defaultdict(int)
    for r in got:
        s = of[next((d, t) for d, t in texts if d == r["doc_id"] and len(TOKEN.findall(t)) == r["size"])]
        taken[s] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_by_document(docs.repartition(5)).collect()))
    assert not mixing.taken_by_document(empty_docs).count()
    queued = mixing.queues(docs)
    mix = mixing.mixed(queued, mixing.cut(queued)).collect()
    assert [r["finish"] for r in mix] == sorted(r["finish"] for r in mix)
    assert sum(r["words"] for r in mix) == sum(r["taken"] for r in got) == budget


def test_mix_is_the_head_of_the_global_order(spark, monkeypatch):
    """Words of all copies sorted by finish time and source, cut at the budget; ranges are split down to single words."""
    monkeypatch.setattr(mixing, "RANGES", 4)
    monkeypatch.setattr(mixing, "LAST_WORDS", 1)
    data = [(i, "w " * (i * 7 % 23), ["a", "b", "c", None][i % 4]) for i in range(60)] + [(900 + i, "", "empty") for i in range(3)]
    queued = mixing.queues(spark.createDataFrame(data, "doc_id long, text string, source string"))
    rows_ = queued.collect()
    words = [((c * r["source_size"] + r["begin"] + k) / r["target"], r["rank"], r["doc_id"]) for r in rows_ for c in range(3) for k in range(1, r["size"] + 1)]
    words.sort()
    budget = sum(r["size"] for r in rows_)
    want = Counter(d for _, _, d in words[:budget])
    at = mixing.cut(queued)
    assert tuple(at) == words[budget - 1][:2]
    taken = sum((mixing.taken_of_copy(F.lit(c), at) for c in range(3)), F.lit(0))
    assert {r["doc_id"]: r["t"] for r in queued.select("doc_id", taken.alias("t")).collect()} == {r["doc_id"]: want[r["doc_id"]] for r in rows_}
    # the order decides: with other finish times other words are taken
    moved = queued.withColumn("target", F.when(F.col("source") == "a", F.col("target") * 2).otherwise(F.col("target") / 2))
    assert mixing.cut(moved) != at


def test_mix_of_nothing_and_of_many_sources(spark):
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert rows(mixing.taken_by_document(none), "doc_id", "size", "source_size", "target", "taken") == Counter([(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])
    many = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i:03}") for i in range(150)], "doc_id long, text string, source string")
    got = mixing.taken_by_document(many).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in got) and sum(r["taken"] for r in got) == sum(r["size"] for r in got)


def brute_lines(texts):
    """Lines count once for each doc_id; rows without an id are one document, before all others."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    low = lambda d: -1 if d is None else d
    held = defaultdict(set)
    for d, t in texts:
        for k in {key(x) for x in t.split("\n")}:
            held[k].add(low(d))
    want = Counter()
    for d, t in texts:
        keep = [x for x in t.split("\n") if len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)]) == low(d)]
        want[d, len(t.split("\n")), len(t.split("\n")) - len(keep), sha("\n".join(keep))] += 1
    return want


def test_line_dedup(docs, texts, empty_docs, monkeypatch):
    got = line_dedup.drop_repeated_lines(docs).withColumn("sha", F.sha2("_kept", 256))
    assert rows(got, "doc_id", "_n_lines", "_n_dropped", "sha") == brute_lines(texts)
    assert got.where("_n_dropped > 0").count() > 0 and "host" in got.columns
    assert not line_dedup.drop_repeated_lines(empty_docs).count()
    monkeypatch.setattr(skew, "MOST_ROWS", 0)  # beyond the bound of the broadcast: hot and cold lines
    monkeypatch.setattr(skew, "HOT_PARTS", 50)
    got = line_dedup.drop_repeated_lines(docs).withColumn("sha", F.sha2("_kept", 256))
    assert rows(got, "doc_id", "_n_lines", "_n_dropped", "sha") == brute_lines(texts)


def test_line_dedup_counts_documents_not_rows(spark):
    line = "a line of more than forty characters that several rows hold"
    data = [(1, f"{line}\nrow {i}") for i in range(4)] + [(2, line), *[(None, f"{line} too\n{i}") for i in range(6)], *[(i, f"{line} too") for i in (5, 6, 7, 8)]]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(data, "doc_id long, text string")).withColumn("sha", F.sha2("_kept", 256))
    assert rows(got, "doc_id", "_n_lines", "_n_dropped", "sha") == brute_lines(data)


def test_runs_levels_and_anti_join(spark):
    runs = line_dedup.Runs(spark, fan_in=2)
    frame = lambda xs: spark.createDataFrame(xs, "h1 long, h2 long, doc long")
    for i in range(5):
        runs.add(frame([(1, 1, i), (2, i, i), (3, i % 2, i), (3, i % 2, i)]))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {tuple(r) for r in runs.fresh(frame([(1, 1, 9), (7, 7, 9)])).collect()} == {(7, 7, 9)}
    assert [tuple(r) for r in runs.frequent(5).collect()] == [(1, 1, 5, 4)]
    assert sorted(tuple(r) for r in runs.frequent(2).collect()) == [(1, 1, 5, 4), (3, 0, 3, 4), (3, 1, 2, 3)]
    opened = [(r["h1"], r["h2"]) for run in runs.tables() for r in run.where("not again").collect()]
    assert len(opened) == len(set(opened)) == 8  # the anti-join: every line is opened once over all runs


def test_merges_of_runs_need_no_shuffle(spark, capsys):
    runs = line_dedup.Runs(spark, fan_in=9)
    for i in range(3):
        runs.add(spark.createDataFrame([(1, 1, i), (2, i, i)], "h1 long, h2 long, doc long"))
    runs.frequent(2).explain()
    assert "hashpartitioning" not in capsys.readouterr().out


def brute_components(texts, percent=85):
    def shingles(t):
        w = TOKEN.findall(t.translate(AZ))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {}
    for d, t in texts:
        sets.setdefault((d, t), shingles(t))
    keys = [k for k in sets if k[0] is not None and sets[k]]
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if a[0] == b[0] or (min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y)):
                parent[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min(k[0], least.get(find(k), k[0]))
    want = Counter()
    for d, t in texts:
        k = (d, t)
        comp = least[find(k)] if k in parent else d
        want[d, len(sets[k]), comp, comp == d] += 1
    return want


def variants(n, base, edits, seed):
    import random

    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates(spark, docs, texts, empty_docs):
    got = near_dup.cluster(docs)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(texts)
    assert not near_dup.cluster(empty_docs).count()


def test_near_duplicates_in_large_groups(spark):
    base = [f"w{i}" for i in range(400)]
    data = [*variants(60, base, 4, 1), *variants(60, base, 9, 2), *variants(30, base[:200], 2, 3), " ".join(base)]
    texts = [(1000 - i, t) for i, t in enumerate(data)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(near_dup.cluster(df), "doc_id", "n_shingles", "component_id", "kept") == brute_components(texts)


def test_texts_of_one_id_are_all_compared(spark):
    """Doc 5 leads two classes; what is near either of its texts joins it. A chain of ids with several texts joins as well."""
    a, b, c = ([f"{x}{i}" for i in range(120)] for x in "abc")
    near = lambda w: " ".join([*w[:60], "other", *w[61:]])
    texts = [(5, " ".join(a)), (5, " ".join(b)), (7, near(a)), (9, near(b)), (11, " ".join(c)), (12, near(c)), (12, near(b)), (20, " ".join(a[:60])), (3, "one two")]
    got = near_dup.cluster(spark.createDataFrame(texts, "doc_id long, text string"))
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == brute_components(texts)
    assert {r["component_id"] for r in got.collect()} == {3, 5, 20}


def test_components_of_long_chains(spark):
    """A chain in an unlucky order, which a link a round would need hundreds of rounds for, and some small components."""
    order = sorted(range(400), key=lambda i: (i * 7919) % 401)
    links = [*zip(order, order[1:]), (1000, 1001), (1002, 1001), (2000, 2001)]
    got = {r["node"]: r["comp"] for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(400), 0) | dict.fromkeys((1000, 1001, 1002), 1000) | dict.fromkeys((2000, 2001), 2000)


def test_blocks_join_all_that_is_linked_across_components(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(near_dup, "BLOCK", 4)
    texts = {i: " ".join(f"w{j}" for j in range(200)) if i < 20 else " ".join(f"w{j}" for j in range(3 * (i - 19), 200)) for i in range(30)}
    texts |= {30 + i: " ".join(f"v{j}" for j in range(100 + i)) for i in range(4)}
    sets = {i: near_dup.shingles(t) for i, t in texts.items()}
    sig = {i: near_dup.minhash(s) for i, s in sets.items()}
    for s in sig.values():
        s[: near_dup.ROWS] = 1  # all share the bucket of band 0, and the same members that of band 1
    sigs = spark.createDataFrame([(i, bytearray(sig[i].tobytes()), bytearray(sets[i].tobytes())) for i in sets], "node long, sig binary, set binary")
    buckets = spark.createDataFrame([(7 + b, b, i, len(sets[i])) for i in sets for b in (0, 1)], "key long, band int, node long, n long")
    comp = {i: 0 if i < 20 else i // 2 for i in sets}
    comps = spark.createDataFrame(list(comp.items()), "node long, comp long")
    spanning = near_dup.spanning_buckets(buckets, comps)
    assert {r["band"] for r in spanning.select("band").distinct().collect()} == {0}
    got = {(r["a"], r["b"]) for r in near_dup.rest_links(spanning, sigs).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and comp[a] != comp[b] and near_dup.linked(sets[a], sets[b])}
    assert got <= want

    def joined(links):
        label = dict(comp)
        for a, b in links:
            low, high = sorted((label[a], label[b]))
            label = {n: low if x == high else x for n, x in label.items()}
        return label

    assert joined(got) == joined(want) and len(set(joined(got).values())) < len(set(comp.values()))


def test_sets_check_one_against_many():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, n, dtype=np.uint64)) for n in (30, 80, 80, 90, 5, 1, 120)]
    packed = near_dup._Sets(pd.Series([x.tobytes() for x in sets]))
    others = np.array([6, 3, 1, 2, 5])
    assert list(packed.linked(0, others)) == [near_dup.linked(sets[0], sets[x]) for x in others]
    assert list(packed.linked(6, others)) == [near_dup.linked(sets[6], sets[x]) for x in others]
