"""Template removal by recurrence, and what must stay."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sievework.llm import html_text as h

SCHEMA = "page_id long, url string, html string"


def texts(spark, data, **kw):
    return {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(data, SCHEMA), **kw).collect()}


def site(n, host="http://s.example/a"):
    menu = "<div><a href=/>Start</a> <a href=/b>Stories</a></div>"
    notice = "<section><span>We have moved</span></section>"
    return [(i, host, f"<body>{menu}{notice}<h1>Title {i}</h1><p>own text number {i} of the page</p><div>Printed in our house</div></body>") for i in range(n)]


def test_recurrence_decides_without_any_marks(spark):
    """Menu, notice and footer have no telling names: they go by recurring, from three pages of a host on."""
    data = site(4) + [(100 + i, "http://two.example/", x) for i, _, x in site(2)]
    got, off = texts(spark, data), texts(spark, data, templates=False)
    assert [got[i] for i in range(4)] == [f"Title {i}\n\nown text number {i} of the page" for i in range(4)]
    whole = [f"Start Stories\n\nWe have moved\n\nTitle {i}\n\nown text number {i} of the page\n\nPrinted in our house" for i in range(4)]
    assert [off[i] for i in range(4)] == whole and got[100] == whole[0] and got[101] == whole[1]


def test_beyond_the_bound_of_the_broadcast(spark, monkeypatch):
    data = site(12) + [(100 + i, "http://other.example/", x) for i, _, x in site(3)] + [(7, "http://s.example/a", site(8)[7][2]), (None, "http://s.example/a", site(9)[8][2])]
    want = texts(spark, data)
    monkeypatch.setattr(h, "MOST_TEMPLATES", 0)
    monkeypatch.setattr(h, "HOT_PARTS", 8)
    assert texts(spark, data) == want


def test_counts_of_subtrees_are_those_of_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", F.coalesce("html", F.lit("")).alias("html")).withColumn("host", h.host_of("url"))
    held, n = defaultdict(Counter), Counter()
    for r in pages.collect():
        n[r["host"]] += 1
        held[r["host"]].update(h.walk(r["html"])[1])
    want = {(host, x, c) for host, counts in held.items() for x, c in counts.items() if c >= 3 and c >= min(10, n[host] / 2) and c >= 0.05 * n[host]}
    hashed = pages.select("host", h.subtree_hashes("html").alias("hashes"))
    assert {tuple(r) for r in h.recurring(hashed).select("host", "hash", "n").collect()} == want


def blocks(page):
    return h.walk(page)[0]


def test_names_inside_articles_do_not_delete_text():
    page = '<article><h2 id="cookies">Cookies</h2><p class="notice-period">One month.</p><p>tail</p><section id="related-work"><p>Others</p></section><div class="comments"><p>nice!</p></div><div class="ad">buy</div></article>'
    assert blocks(page) == ["Cookies", "One month.", "tail", "Others"]


def test_attributes_of_any_length_and_odd_quotes():
    assert blocks(f'<p title="{"x" * 5000}> leaked text">kept</p>') == ["kept"]
    assert blocks("<p title='a > b'>one</p><p it's>two</p><p class=\"open>three</p>") == ["one", "two", "three"]
    assert blocks("<p>a<!-->b<!-- x > y -->c</p>") == ["abc"]


def test_fallbacks_and_formulas_stay():
    page = "<article><p>Let <math><mi>x</mi></math> be</p><object><p>a table instead</p></object><noscript><p>a picture instead</p></noscript><audio>a sound</audio></article><noscript>Turn it on</noscript>"
    assert blocks(page) == ["Let x be", "a table instead", "a picture instead", "a sound"]


def test_a_page_in_one_form_is_the_page():
    assert blocks("<body><form><h1>Title</h1><p>All the text of the page</p><button>Go</button></form></body>") == ["Title", "All the text of the page"]
    assert blocks("<body><p>All the text of the page</p><form><p>Your name</p></form></body>") == ["All the text of the page"]
    assert blocks("<body><form><article><p>text</p></article></form><article><p>more</p><form>x</form></article></body>") == ["text", "more"]


def test_odd_rows(spark):
    long_page = "<p>" + "word " * 60_000 + "</p>" + "<div>" * 3000 + "deep"
    data = [(1, None, None), (1, None, None), (None, "http://a.example/", "<p>x</p>"), (2, "http://a.example/", long_page)]
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in ("_id", "_th", "host", "hash", "drops", "n", "text")})
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in h.extract(df).collect())
    deep = ("word " * 60_000).strip() + "\n\ndeep"
    assert got == Counter({(1, "", 0): 2, (None, "x", 1): 1, (2, deep, len(deep)): 1})
    assert not h.extract(df.limit(0)).count()


MAIN = "<article><h1>T</h1><p>The real text of the page.</p></article>"


def test_articles_inside_what_is_none_are_none():
    for chrome in (
        '<div id="comments"><li class="comment"><article class="comment-body">a reader</article></li></div>',
        '<aside class="related"><article class="teaser">teaser</article></aside>',
        '<section class="comments"><article>a reader</article></section>',
        "<nav><article>menu</article></nav>",
    ):
        assert blocks(MAIN + chrome) == blocks(chrome + MAIN) == ["T", "The real text of the page."]
    assert blocks('<nav><a>menu<div><article><p>after a menu left open</p></article><nav>x</nav>') == ["after a menu left open"]
    assert blocks('<article><p>a</p><div class="user-comment">c</div></article>') == ["a"]


def test_only_whole_names_decide_and_not_over_most_of_a_page():
    assert blocks('<div id="search-algorithms"><p>Text of algorithms.</p></div>') == ["Text of algorithms."]
    assert blocks('<div class="notice-of-appeal"><p>Appeal.</p></div>') == ["Appeal."]
    assert blocks('<div class="page-header"><h1>Title</h1></div><p>Body</p>') == ["Title", "Body"]
    assert blocks('<div class="notice"><p>The whole page is one notice.</p></div><p>x</p>') == ["The whole page is one notice.", "x"]
    assert blocks('<div class="notice"><p>Short.</p></div><p>The page itself is longer.</p>') == ["The page itself is longer."]


def test_deep_pages_cost_in_proportion():
    import time

    def seconds(n):
        began = time.perf_counter()
        h.walk("<div>" * n + "x")
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)
