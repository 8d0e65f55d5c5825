"""Main text of web pages, with site templates removed.

Every block element's subtree is hashed (tags and text, without attributes). Spark counts on how many pages of its
host each hash stands, and subtrees that recur on many pages of the host are deleted: menus, notices, adverts and
footers go by recurring, whatever they are called. What recurs follows the number of pages: at least MIN_PAGES, half of
the host's pages up to FULL_PAGES, and MIN_SHARE of them; so hosts of fewer than MIN_PAGES pages have no templates.

Besides, what HTML itself declares to be no article goes (nav, footer, aside, forms, dialogs, hidden elements, roles,
scripts), and elements whose class names say so: by whole names of the class or id of a container, outside an article those
of menus, adverts, comments and the like, inside a marked article fewer. Ids and classes of headings and paragraphs decide
nothing. Where a page marks its article, only the article counts; an article inside an element that is none of the page's
article (a comment, a teaser in a sidebar, an entry of a menu) is none either, unless that element was left open. Forms and
named containers that hold more than half of the text of a page without a marked article are the page itself, and stay.

Copies of articles are no template: in a marked article, running text (paragraphs, headings, lists) is not deleted for
recurring, nor are containers with running text, if what recurs of it is more than a small part of the article
(ARTICLE_SHARE) or, where no article is marked, at least half of the page's text (PAGE_SHARE): then the page is a copy,
and only recurring containers without running text are deleted.

Scale: the templates of a host are as many as its pages have in common, not as its pages; up to MOST_TEMPLATES of all hosts
they are broadcast, and no html is shuffled. Beyond, pages meet their own templates by a shuffle; those that stand on
more than 1 / HOT_PARTS of all subtrees, fewer than HOT_PARTS, are broadcast, so that a template of a large host is
no hot key.

Edge cases: null html is an empty page with empty text; a null or odd url is a host of its own kind (''); unclosed and
stray tags end with their parents; the hash counts each page of a host once, repeated rows count as pages; a page cut
off in the middle gives the text it has; null and repeated ids are kept; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import row_key, sized, stored

#: A subtree recurs if it stands on so many pages of the host (at least, and half of them up to), and on such a share.
MIN_PAGES, FULL_PAGES, MIN_SHARE = 3, 10, 0.05
#: Templates up to which all are broadcast (16 bytes and the host's name each), and the bound on hot ones beyond.
MOST_TEMPLATES, HOT_PARTS = 200_000, 2_000
#: Recurring running text is the page's own from such a share of the article's text, or of a page's without article.
ARTICLE_SHARE, PAGE_SHARE = 0.2, 0.5
#: Words of a block that make it running text whatever its element.
LONG_BLOCK = 20

#: Elements by what they do to text.
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul head".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea template iframe svg noembed noframes".split())
CHROME = set("nav footer aside button select dialog menu search datalist".split())
PROSE = set("article main p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tfoot tr figure figcaption caption".split())
RUNNING = set("p blockquote pre".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "thead": {"thead", "tbody"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Whole names in class and id of containers that hold no article text, inside articles as outside.
INSIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsbygoogle ad-slot ad-container ad-wrapper ad-banner sponsored promo banner cookie-notice cookie-banner "
    "cookie-consent sidebar side-bar comment comments comment-list commentlist comment-body comments-area comment-section user-comment user-comments reader-comments disqus_thread respond reply replies share sharing share-buttons "
    "social social-share related related-posts related-articles recommended newsletter newsletter-signup subscribe signup breadcrumb breadcrumbs pagination widget".split()
)
#: Further such names outside articles.
CHROME_NAMES = INSIDE_NAMES | set(
    "adsense sponsor promotion cookie cookies consent gdpr notice notices alert popup modal overlay menu main-menu nav navbar navigation main-nav main-navigation site-nav site-navigation nav-menu topnav "
    "footer site-footer page-footer footer-widgets disqus subscription login search search-form searchform search-box widgets widget-area pager toolbar masthead skip skip-link header site-header topbar top-bar "
    "sidebar-left sidebar-right left-sidebar right-sidebar cookie-bar".split()
)
CONTAINERS = BLOCKS - set("p h1 h2 h3 h4 h5 h6 html body article main".split()) | {"span", "ins"}

_OPENING = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_LETTERS = re.compile(r"[a-z]+")


def tag_end(page: str, at: int) -> int:
    """The place after the > that ends the tag whose name ends at a place. Quoted values may hold any > and any length;
    a value whose quote never ends is taken as if it had none."""
    i = at
    while stop := _STOP.search(page, i):
        if not stop[1]:
            return stop.end()
        i = page.find(stop[1], stop.end()) + 1
        if not i:
            break
    return (page.find(">", at) + 1) or len(page)


class _Open:
    """An open element."""

    __slots__ = ("begin", "chrome", "content", "digest", "form", "name", "named", "running", "seen", "start")

    def __init__(self, name: str, chrome: bool, named: bool, content: bool, form: bool, start: int, begin: int):
        self.name, self.chrome, self.named, self.content, self.form, self.start, self.begin = name, chrome, named, content, form, start, begin
        self.digest, self.seen = hashlib.blake2b(name.encode(), digest_size=8), False
        self.running = False


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if "=" in raw or raw.strip(" />") else {}


def declared_chrome(name: str, attributes: dict[str, str], in_content: bool) -> bool:
    """Whether HTML itself says that an element holds no article text."""
    if name in CHROME or (name in ("header", "noscript") and not in_content):
        return True
    if not attributes or name in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return True
    return "display:none" in attributes.get("style", "").replace(" ", "").lower()


def named_chrome(name: str, attributes: dict[str, str], in_content: bool) -> bool:
    """Whether the names that its author gave a container say so."""
    if not attributes or name not in CONTAINERS:
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    return not (INSIDE_NAMES if in_content else CHROME_NAMES).isdisjoint(names)


class _Ends:
    """Where the elements of a page end; each name is looked up once a page, whatever the number of its elements."""

    def __init__(self, page: str):
        self.page, self.of = page, {}

    def closed(self, name: str, begin: int) -> bool:
        """Whether the element that begins at a place has an end tag of its own."""
        if name not in self.of:
            ends, open_ = set(), []
            for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", self.page, re.I):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    ends.add(open_.pop())
            self.of[name] = ends
        return begin in self.of[name]


def _recurring(found: list[tuple[int, int, str, bool]], blocks: list[tuple[str, bool, bool, bool]], marked: bool) -> set[int]:
    """The blocks to delete; found has the recurring subtrees: first block, end, name, whether they hold running text."""
    found = [(a, b, name, running or any(len(x[0].split()) >= LONG_BLOCK for x in blocks[a:b])) for a, b, name, running in found]
    sizes = [len(x) if (inside or not marked) and not named else 0 for x, inside, _, named in blocks]
    held = {i for a, b, _, running in found if running for i in range(a, b)}
    share = ARTICLE_SHARE if marked else PAGE_SHARE
    if held and sum(sizes[i] for i in held) >= share * sum(sizes):
        found = [x for x in found if not x[3] and x[2] not in PROSE]
    return {i for a, b, _, _ in found for i in range(a, b)}


def _set_aside(blocks: list[tuple[str, bool, bool, bool]], marked: bool) -> set[int]:
    """The blocks of forms and of named containers, unless either are the page: more than half of the text where no article
    is marked."""
    gone, everything = set(), sum(len(x[0]) for x in blocks)
    for field in (2, 3):
        mine = {i for i, x in enumerate(blocks) if x[field]}
        if marked or 2 * sum(len(blocks[i][0]) for i in mine) <= everything:
            gone |= mine
    return gone


def walk(page: str, drop: frozenset[int] | set[int] = frozenset()) -> tuple[list[str], set[int]]:
    """The blocks of the main text, and the hashes of the subtrees that may be deleted for recurring."""
    stack: list[_Open] = []
    blocks: list[tuple[str, bool, bool, bool]] = []  # with whether the article holds it, a form does, a named container does
    ends, counts = _Ends(page), Counter()
    buffer: list[str] = []
    hashes: set[int] = set()
    found: list[tuple[int, int, str, bool]] = []
    marked = False

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((text, bool(stack) and stack[-1].content, bool(stack) and stack[-1].form, bool(stack) and stack[-1].named))

    def close() -> None:
        top = stack.pop()
        counts[top.name] -= 1
        digest = top.digest.digest()
        top.running |= top.seen and top.name in RUNNING and not top.chrome and not top.named
        if stack:
            stack[-1].digest.update(digest)
            stack[-1].seen |= top.seen
            stack[-1].running |= top.running
        if top.seen and top.name in BLOCKS and top.name not in ("html", "body") and not (top.content and top.name in PROSE):
            key = int.from_bytes(digest, "big", signed=True)
            hashes.add(key)
            if key in drop:
                found.append((top.start, len(blocks), top.name, top.running))

    def text(chunk: str) -> None:
        if chunk:
            if stack:
                bare = chunk.strip()
                if bare:
                    stack[-1].digest.update(bare.encode("utf-8", "surrogatepass"))
                    stack[-1].seen = True
            if not stack or not stack[-1].chrome:
                buffer.append(chunk)

    def opened(names: set[str], stop: set[str]) -> bool:
        if not any(counts[n] for n in names):
            return False
        for x in reversed(stack):
            if x.name in names:
                return True
            if x.name in stop:
                return False
        return False

    def close_to(names: set[str]) -> None:
        flush()
        while stack:
            name = stack[-1].name
            close()
            if name in names:
                return

    at, end = 0, len(page)
    while at < end:
        tag = _OPENING.search(page, at)
        if tag is None:
            text(page[at:])
            break
        text(page[at : tag.start()])
        name = tag[2]
        if not name:
            mark = "-->" if tag[0] == "<!--" else ">"
            at = page.find(mark, tag.start() + 2)
            at = end if at < 0 else at + len(mark)
            continue
        at = tag_end(page, tag.end())
        name = name.lower()
        if tag[1]:
            stop = set() if name in BLOCKS and name != "p" else BLOCKS - {name}
            if opened({name}, stop):
                if name in BLOCKS:
                    close_to({name})
                else:
                    while stack[-1].name != name:
                        close()
                    close()
            continue
        if name in VOID:
            if name in ("br", "hr", "img"):
                text(" ")
            if name == "hr":
                flush()
            continue
        if name in RAW:
            if page[at - 2] != "/":
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        attributes = _attributes(page[tag.end() : at].removesuffix(">"))
        root = name in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"
        if name in BLOCKS:
            if name not in ("html", "head", "body") and opened({"p"}, {"table", "button"}):
                close_to({"p"})
            if name in CLOSED_BY and opened(CLOSED_BY[name], {"ul", "ol", "dl", "table", "select"}):
                close_to(CLOSED_BY[name])
            flush()
        elif name in ("td", "th"):
            text(" ")
        in_content = bool(stack) and stack[-1].content
        chrome, named = declared_chrome(name, attributes, in_content or root), named_chrome(name, attributes, in_content)
        if root and not chrome and not in_content:
            # an element left open before the article ends there; an article inside any other is not the page's
            at_open = next((i for i, x in enumerate(stack) if (x.chrome or x.named) and not ends.closed(x.name, x.begin)), None)
            if at_open is not None:
                while len(stack) > at_open:
                    close()
        form = name == "form" or (bool(stack) and stack[-1].form and not root)
        inherited = bool(stack) and stack[-1].chrome
        named |= bool(stack) and stack[-1].named
        content = in_content or (root and not chrome and not named and not inherited)
        marked |= content
        counts[name] += 1
        stack.append(_Open(name, chrome or inherited, named, content, form, len(blocks), tag.start()))
    flush()
    while stack:
        close()
    gone = _set_aside(blocks, marked) | (_recurring(found, blocks, marked) if found else set())
    return [x[0] for i, x in enumerate(blocks) if (x[1] or not marked) and i not in gone], hashes


def host_of(url: str) -> object:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


@F.pandas_udf(T.ArrayType(T.LongType()))
def subtree_hashes(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: sorted(walk(p)[1]))


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series, drops: pd.Series) -> pd.Series:
    return pd.Series(["\n\n".join(walk(p, frozenset(d) if d is not None else frozenset())[0]) for p, d in zip(pages, drops, strict=True)], dtype=object)


def recurring(hashed: DataFrame) -> DataFrame:
    """host, hash, n (pages) of the subtrees that recur; hashed has a row a page: host, hashes."""
    pages = hashed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = hashed.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    enough = (F.col("n") >= F.least(F.lit(FULL_PAGES), F.col("pages") / 2)) & (F.col("n") >= MIN_SHARE * F.col("pages"))
    return counts.join(sized(pages, MOST_TEMPLATES), "host").where(enough).select("host", "hash", "n")


def with_drops(rows: DataFrame, hashed: DataFrame, sites: DataFrame) -> DataFrame:
    """rows with drops: the recurring hashes of the host, or of the page where hosts have too many to broadcast them."""
    if sites.count() <= MOST_TEMPLATES:
        of_host = sites.groupBy("host").agg(F.collect_set("hash").alias("drops"))
        return rows.join(F.broadcast(of_host), "host", "left")
    flat = hashed.select("_id", "_th", "host", F.explode("hashes").alias("hash"))
    hot = F.broadcast(sites.where(F.col("n") * HOT_PARTS > flat.count()).select("host", "hash"))
    met = flat.join(hot, ["host", "hash"]).unionByName(flat.join(hot, ["host", "hash"], "left_anti").join(sites.join(hot, ["host", "hash"], "left_anti").select("host", "hash"), ["host", "hash"]))
    drops = met.groupBy("_id", "_th", "host").agg(F.collect_set("hash").alias("drops"))
    drops = stored(drops.withColumnsRenamed({"_id": "_i", "_th": "_t", "host": "_h"}), "drops")
    here = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")) & (F.col("host") == F.col("_h"))
    return rows.join(drops, here, "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", templates: bool = True) -> DataFrame:
    """The id, the url and the main text of each row; without `templates`, recurring subtrees stay."""
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    rows = row_key(rows, "_id", "_html").withColumn("host", host_of("_url"))
    if templates:
        hashed = stored(rows.select("_id", "_th", "host", subtree_hashes("_html").alias("hashes")), "subtrees")
        rows = with_drops(rows, hashed, stored(recurring(hashed), "templates"))
    else:
        rows = rows.withColumn("drops", F.lit(None).cast("array<long>"))
    done = rows.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), main_text("_html", "drops").alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
