"""Text hygiene as Column functions: white space, folding, tokens, repairs, small formatters."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts for browsers know it: ASCII blanks, the Unicode space separators, line and paragraph separators, the byte order mark.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
MARKS = r"[\u0300-\u036F]"
#: Letters and digits, one by one: a class of single characters is a look into a table, one of several ranges a chain of calls a character.
LOWER = "abcdefghijklmnopqrstuvwxyz0123456789"
ALNUM = LOWER + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_TOKEN = 3


def collapse(c: Column, space: str = SPACE) -> Column:
    """Runs of white space become one blank; no blanks, nor other space separators, at the ends. Most characters are printable
    ASCII, which a look at one range tells from white space; the class itself has many ranges."""
    done = F.regexp_replace(c, f"(?![!-~]){space}+", " ")
    return F.trim(done) if space == SPACE else F.regexp_replace(done, r"^\p{Zs}+|\p{Zs}+\z", "")


@functools.cache
def accent_map() -> tuple[str, str]:
    """Characters of one code unit that decompose to one character plus marks, and these characters."""
    marked, bare = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        left = [x for x in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(x) <= 0x36F]
        if len(left) == 1 and left[0] != chr(code):
            marked.append(chr(code))
            bare.append(left[0])
    return "".join(marked), "".join(bare)


def strip_accents(c: Column) -> Column:
    """Accents go. ASCII texts, most of a corpus, skip the map."""
    folded = F.regexp_replace(F.translate(c, *accent_map()), MARKS, "")
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(folded)


def fold(c: Column) -> Column:
    """Without accents, in lower case, white space collapsed."""
    return collapse(F.lower(strip_accents(c)))


def tokens(c: Column) -> Column:
    """Alphanumeric pieces of the folded text with at least MIN_TOKEN characters, repeats kept."""
    return folded_tokens(fold(c))


def folded_tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(f"[{LOWER}]{{{MIN_TOKEN},}}"), F.lit(0))


def fold_for_contains(c: Column) -> Column:
    """Folded, with only letters, digits and blanks left."""
    return bare(fold(c))


def bare(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, f"[^{LOWER} ]", ""))


def fingerprint(c: Column) -> Column:
    """Lower case, white space collapsed, accents kept."""
    return F.lower(collapse(c))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: What UTF-8 read as Latin-1 (or its Windows cousin) shows, and the replacement character.
MARKER = "Ã[^\n\r\u2028\u2029]|Â[^\n\r\u2028\u2029]|â€|ï¿½"
LOST = "\ufffd"


def marker_count(c: Column) -> Column:
    """Sequences that hint at wrongly decoded text."""
    return F.regexp_count(c, F.lit(MARKER)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decoded_again(c: Column) -> Column:
    """The low bytes of c's UTF-16 units (of each character's first) read as UTF-8; what is no UTF-8 is replaced, and a byte
    order mark in front goes."""
    low = F.transform(F.split(c, ""), lambda x: F.substring(F.hex(F.encode(x, "UTF-16BE")), 3, 2))
    raw = F.when(c.rlike(r"[^\x00-\xFF]"), F.unhex(F.array_join(low, ""))).otherwise(F.encode(c, "ISO-8859-1"))
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "^\ufeff", "")


def repair(c: Column, lenient: bool = False) -> Column:
    """Text decoded once more, at most twice, while that lowers its score: its markers, and two for each lost character.
    lenient, as for imports: losses don't count against a repair. Texts without markers stay as they are."""

    def score(x: Column) -> Column:
        marks = F.regexp_count(x, F.lit(MARKER))
        return marks if lenient else marks + 2 * F.regexp_count(x, F.lit(LOST))

    def once(x: Column) -> Column:
        return let(decoded_again(x), lambda again: F.when(score(again) < score(x), again).otherwise(x))

    return F.when(c.rlike(MARKER), let(c, lambda x: let(once(x), once))).otherwise(c)


def logged_change(field: str, before: Column, after: Column, action: str | None = None) -> Column:
    """A record of a change, null where nothing changed."""
    named = [] if action is None else [F.lit(action).alias("action")]
    return F.when(~before.eqNullSafe(after), F.struct(F.lit(field).alias("field"), *named, before.alias("before"), after.alias("after")))


def chapter_id(c: Column) -> Column:
    """Digits become chapter-N; other text is trimmed; null is empty."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    return F.when(bare.rlike("^[0-9]+$"), F.concat(F.lit("chapter-"), bare)).otherwise(bare)


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, f"[^{ALNUM}-]", "-"))


@functools.cache
def long_capitals() -> dict[str, str]:
    """Characters whose capital form is several characters, with the one that stands for it (the title form where that is one
    character; the sharp s has its own), or themselves."""
    forms = {chr(x): chr(x).title() for x in range(0x80, 0x110000) if len(chr(x).upper()) > 1}
    return {x: "\u1e9e" if x == "\u00df" else form if len(form) == 1 else x for x, form in forms.items()}


def capital(c: Column) -> Column:
    """The capital of one character, as one character."""
    single = F.translate(c, "".join(long_capitals()), "".join(long_capitals().values()))
    return F.when(F.length(F.upper(c)) > 1, single).otherwise(F.upper(c))


def rewrite(c: Column, lead_ins: list[str], space: str = SPACE, upper: Callable[[Column], Column] = F.upper) -> Column:
    """Without known lead-ins, collapsed, capitalised unless it opens with an inverted mark; null where nothing changes. space and
    upper: what counts as white space, and how the first character is capitalised."""
    out = c
    for lead in lead_ins:
        out = F.regexp_replace(out, f"(?i)^{lead}{space}*", "")
    capitalised = let(collapse(out, space), lambda x: F.when(F.startswith(x, F.lit("¿")), x).otherwise(F.concat(upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))))
    return let(capitalised, lambda x: F.when(x != c, x))


def title_from_slug(c: Column) -> Column:
    """Parts between hyphens, each capitalised with the rest kept."""
    return F.array_join(F.transform(F.split(c, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), " ")


def topics(tags: Column) -> Column:
    """The first two tags that are not blank. A function of two parameters, as collapse, would get the place as its second."""
    clean = F.filter(F.transform(tags, lambda t: collapse(t)), lambda t: t != "")
    return F.slice(clean, 1, 2)


def topic_key(tags: Column) -> Column:
    """The first two tags that are not blank, joined."""
    return F.array_join(topics(tags), "-")


def topic_title(tags: Column) -> Column:
    return F.array_join(F.transform(topics(tags), title_from_slug), " y ")


def none_if_blank(c: Column) -> Column:
    return F.nullif(collapse(c), F.lit(""))


def number(c: Column) -> Column:
    """A text as a number: blank and null are 0, what is no number is NaN."""
    bare = F.trim(c.cast("string"))
    return F.when(bare.isNull() | (bare == ""), F.lit(0.0)).otherwise(F.coalesce(bare.try_cast("double"), F.lit(float("nan"))))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def whole_number(c: Column) -> Column:
    return finite(c) & (c == F.floor(c))


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def percent(part: Column, total: Column) -> Column:
    """part of total in percent; 0 of nothing."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def json_object(c: Column) -> Column:
    """c if it is a JSON object, else the part from its first to its last brace if that is one, else null."""
    salvaged = F.regexp_extract(c, r"(?s)\{.*\}", 0)

    def valid(x: Column) -> Column:
        return F.when(F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{"), x)

    return F.coalesce(valid(c), valid(salvaged))


def has_word(c: Column, words: list[str]) -> Column:
    """Whether one of the words stands alone between ASCII word borders."""
    return c.rlike(rf"(?<![{ALNUM}_])(?:{'|'.join(words)})(?![{ALNUM}_])")


def first_underscore_to_space(c: Column) -> Column:
    at = F.instr(c, "_")
    return F.when(at > 0, F.overlay(c, F.lit(" "), at, F.lit(1))).otherwise(c)


def same_answers(a: Column, b: Column) -> Column:
    """Whether two answer lists hold the same, order aside."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def points(exam: bool, double_weight: Column, correct: Column) -> Column:
    worth = F.when(F.lit(exam) & double_weight, 2).otherwise(1)
    return F.when(correct, worth).otherwise(0)


def tier(pct: Column, high: float = 80, middle: float = 60) -> Column:
    return F.when(pct >= high, "high").when(pct >= middle, "middle").otherwise("low")


def toggle(a: Column, x: Column) -> Column:
    """x taken out of the array if it is there, else put at its end."""
    return F.when(F.array_contains(a, x), F.array_remove(a, x)).otherwise(F.array_append(a, x))


def answer_text(options: Column) -> Column:
    """The correct options as text: A. one · C. three."""
    right = F.filter(options, lambda o: o["is_correct"])
    return F.array_join(F.transform(right, lambda o: F.concat(o["label"], F.lit(". "), o["text"])), " · ")


def mark_option(options: Column, label: Column, checked: Column, mode: Column) -> Column:
    """Options after one of them is marked or unmarked; in single selection the others are unmarked."""
    return F.transform(options, lambda o: o.withField("is_correct", F.when(o["label"] == label, checked).otherwise(o["is_correct"] & (mode != "single"))))


def clamp_size(wanted: Column, available: Column) -> Column:
    """A wanted number within 1 and what is available; 1 for what is no number."""
    return F.greatest(F.lit(1), F.least(F.coalesce(wanted.try_cast("int"), F.lit(1)), F.greatest(F.lit(1), available)))


def on_each(columns: list[str], f: Callable[[Column], Column]) -> dict[str, Column]:
    return {c: f(F.col(c)) for c in columns}
