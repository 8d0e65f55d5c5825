"""Personal data by weak supervision.

Candidate spans come from patterns: the four base kinds, and wide ones for eight more: any assignment (secrets), any long run
of letters and digits (keys), account numbers (IBAN), groups of nine digits (social security numbers), numbers beside
capitalised words (street addresses), runs of capitalised words (names of persons), dates (of birth) and words at a host
(masked mail addresses). Four labelers vote on each: form, gazetteer, the words before, and the words after with the borders.
Votes are 1, 0 or -1: a labeler that knows nothing abstains. Expectation-maximisation over the counts of vote patterns
estimates, by kind, how common personal data is and what each labeler says of it and of the rest; a logistic span classifier
is trained on these soft labels with features of votes, kind and length. A candidate of a base kind is a span if its base rule
holds. Any other is a span if the classifier gives it THRESHOLD; a pattern alone makes none. A checksum or range that
fails (PROVEN) excludes a candidate, which still teaches the models.

All of it runs on DataFrame functions: texts are scanned once, candidates are stored, and the models are fitted to
grouped pattern counts, whose number is bounded by the labelers and kinds, not by the corpus.

Edge cases: a null or empty text has no spans (counts 0, the hash of the empty string, empty spans); each row is
scanned by itself, so repeated rows and null ids change nothing but the pattern counts; an empty table gives no
rows and untrained models; positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import stored, whole

KINDS = ("email", "ip", "card", "phone", "secret", "key", "iban", "ssn", "address", "name", "birth", "masked_email")
BASE_KINDS = KINDS[:4]
#: Kinds whose rule is a proof (a checksum, a range): what fails it only teaches the models.
PROVEN = ("ip", "card", "phone", "iban", "ssn")
THRESHOLD = 0.5
#: Characters before and after a candidate that the labelers see.
CONTEXT, FOLLOWING = 40, 24
EM_ROUNDS, FIT_ROUNDS = 50, 300

#: Words of the patterns and of the labelers.
MONTHS = (
    "January February March April May June July August September October November December "
    "Januar Februar März Mai Juni Juli Oktober Dezember janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
).split()
STREET_ENDS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Square".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Monsieur Madame".split()
INTRODUCTIONS = r"[Mm]y name is|[Ii]ch heiße|[Mm]e llamo|[Jj]e m'appelle"
MAIL_ENDINGS = ["com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "pl", "se", "us", "ca", "au", "jp", "br", "mx"]
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED_NETS = r"^(?:0|127|224|239|255)\."
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
IBAN_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK TR".split()
GIVEN_NAMES = (
    "Anna Anne Maria Marie Elena Sofia Laura Julia Sarah Emma Lena Lisa Eva Clara Sophie Camille Carmen Ana Lucia Isabel Mary Linda Susan Karen Nancy Emily Grace Alice Helen Ruth "
    "John James Robert Michael David William Thomas Daniel Peter Paul Mark George Hans Karl Klaus Stefan Martin Lukas Felix Jan Pierre Jean Louis Jacques Antoine Luc Jose Juan Carlos Luis Pedro Miguel Pablo Diego Javier Antonio"
).split()
#: Words that stand in names of things, not of persons, or only begin sentences.
NO_NAMES = (
    "The This That These And But For From With When While After Our Your All Any New North South East West General Public Creative Commons Apache License National United "
    "Street Road Avenue City River Lake Park Island Bank Company Inc Ltd Corp GmbH University College School Institute Hospital Museum Store Pizza Bakery Version Chapter Section Software Foundation Monday Sunday"
).split()
#: Words that are numbered without being streets.
NUMBERED = "Page Pages Figure Fig Chapter Section Table Version Part Volume Vol Step Room Level Line Item Class Number Order Question Grade Windows Highway Route For In On At By The About Over".split()
SECRET_WORDS = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|key|pin|passwort|kennwort|contraseña|clave|passe"
#: Assignments whose values are no secrets.
PLAIN_WORDS = "http|https|id|name|title|date|time|page|note|version|type|class|size|width|height|color|colour|file|path|url|format|lang|charset|model|part|code|build|room|flight"
#: Words before "at" that are no mailbox.
NO_MAILBOX = "meet|met|look|looks|available|sold|visit|stay|hosted|live|online|us|them|him|her|found|shop|read|register|and|or"

MONTH = rf"(?:{'|'.join(MONTHS)})"
CAPITAL = r"\p{Lu}[\p{Ll}'-]{1,20}"
STREET_END = rf"(?:{'|'.join(STREET_ENDS)})"
#: A street address as it is written in English, German, Spanish or French.
STREETS = (
    rf"[0-9]{{1,5}} (?:\p{{Lu}}[\p{{L}}']{{1,20}} ){{1,3}}{STREET_END}",
    r"\p{Lu}\p{Ll}{2,20}(?:stra(?:ße|sse)|weg|gasse|platz) [0-9]{1,4}[a-z]?",
    r"(?:Calle|Avenida|Plaza) (?:de |del |la )*+\p{Lu}\p{L}{2,20},? [0-9]{1,4}",
    r"[0-9]{1,4},? (?:rue|avenue|boulevard) (?:de |du |des |la )*+\p{Lu}\p{L}{2,20}",
)

#: The patterns, written without backtracking: a run is entered at its first character only, and
#: unbounded repeats of groups are possessive, as others need stack by their length. \G is where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"""(?<![\p{L}\p{N}_-])[\p{L}_][\p{L}\p{N}_-]{1,60}+(?:\s{0,3}+[=:]\s{0,3}+["']?|\s(?:is|lautet|est|es)\s["']?(?=[A-Za-z]{0,40}+[0-9]))[^\s"',;<>()]{4,}(?<![.:])""",
    "key": r"(?<![A-Za-z0-9_-])(?:eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+|(?=[A-Za-z_-]*+[0-9]|AKIA|sk-|xox|gh[oprsu]_)[A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])",
    "address": rf"(?<![0-9\p{{L}}])(?:{'|'.join(STREETS)}|[0-9]{{1,5}}(?: \p{{Lu}}[\p{{L}}']{{1,20}}){{1,4}}|\p{{Lu}}\p{{L}}{{2,30}} [0-9]{{1,4}}[a-z]?(?!(?: \p{{Lu}}[\p{{L}}']{{1,20}}){{1,3}} {STREET_END}))(?![\p{{L}}\p{{N}}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(TITLES)})\.? {CAPITAL}(?: {CAPITAL}){{0,2}}|(?<=(?:{INTRODUCTIONS}) ){CAPITAL}(?: {CAPITAL}){{0,2}}|{CAPITAL}(?: {CAPITAL}){{1,2}})(?![\p{{L}}])",
    "birth": rf"(?<![\p{{L}}0-9./-])(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}\.? {MONTH} [0-9]{{4}}|{MONTH} [0-9]{{1,2}},? [0-9]{{4}})(?![0-9/-])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?: ?(?:\(at\)|\[at\]|\{at\}) ?| at )[A-Za-z0-9-]{2,40}+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z][A-Za-z0-9-]{1,20}+)++",
}
#: Where a text has none of these, the kind need not be looked for.
NEEDS = {"email": ["@"], "ip": ["."], "phone": ["+"], "secret": ["=", ":", " is ", " lautet ", " est ", " es "], "masked_email": [" at ", "(at)", "[at]", "{at}"]}

PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Whole words before a candidate that speak for its kind, and against it.
HINTS = {
    "email": "e-?mail|mail|contact|write|kontakt|correo|courriel",
    "ip": "address|server|host|login|adresse",
    "card": "card|visa|mastercard|amex|payment|karte|kreditkarte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|telefon|rufnummer",
    "secret": "login|user|username|config|env|auth|credentials?",
    "key": "api[_-]?key|key|secret|aws|bearer|authorization",
    "iban": "iban|account|konto|cuenta|compte|bank",
    "ssn": "ssn|social security(?: number)?|soc\\.? sec",
    "address": "address|live|lives|lived|street|adresse|wohnt|wohne|dirección|vive|domicile|habite|office",
    "name": "name|dear|signed|regards|sincerely|sehr geehrte[r]?|estimad[oa]|cher|chère|patient|customer|attn",
    "birth": "born|birth|birthday|dob|geboren|geb|geburtsdatum|nacid[oa]|nació|nacimiento|née?|naissance",
    "masked_email": "e-?mail|mail|contact|write|reach|kontakt|correo|courriel",
}
AGAINST_ALL = "version|isbn|issn|figure|section|example|order no"
AGAINST = {
    "birth": "published|updated|posted|modified|released|copyright|retrieved|founded|dated|meeting|due|expires|version|order",
    "ssn": "part|serial|order|item|no|number of|ref|reference",
    "key": "commit|sha1|sha256|md5|checksum|uuid|build|digest|hash|revision",
    "secret": "example|default|sample",
    "name": "university of|city of|the|in|at|near|brand",
    "address": "see|on|in the|version|figure|example",
}
#: What stands right after a candidate and speaks for its kind, and against it.
AFTER = {
    "name": r"^,? (?:said|says|wrote|lives|lived|was born|called|sagte?|schrieb|wohnt|dijo|vive|escribió|dit|habite)(?!\p{L})",
    "address": r"^,? (?:[0-9]{4,5}(?![0-9])|in \p{Lu})",
    "birth": r"^ in \p{Lu}",
    "secret": r"^[\"']",
}
AFTER_AGAINST = {"secret": r"^\(", "name": r"^ (?:Street|Inc|Ltd|GmbH|[0-9])", "address": r"^(?:%| percent| of )", "key": r"^\.[a-z]{2,4}"}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def located(text: Column, kind: str) -> Column:
    """array<struct<start, value, before, after>> of the leftmost, non-overlapping matches: pieces between matches give the
    places and the surroundings. before is at most CONTEXT characters of the last match and what follows it, after is
    at most FOLLOWING characters up to the next match.

    Places are running totals. They are taken in blocks of about the square root of the number of matches, so that a
    text of n matches costs n * sqrt(n) steps at most, although arrays are copied to grow."""
    none = F.expr("cast(array() as array<struct<start:int,value:string,before:string,after:string>>)")
    empty = F.expr("cast(array() as array<array<struct<start:int,value:string,before:string,after:string>>>)")
    match_type = "struct<at:int,last:string,out:array<array<struct<start:int,value:string,before:string,after:string>>>>"

    def step(s: Column, x: Column) -> Column:
        match = F.struct(
            (s["at"] + F.length(x["p"])).alias("start"),
            x["m"].alias("value"),
            F.right(F.concat(s["last"], x["p"]), F.lit(CONTEXT)).alias("before"),
            F.left(F.coalesce(x["q"], F.lit("")), F.lit(FOLLOWING)).alias("after"),
        )
        at = s["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))
        out = F.when(x["m"].isNull(), s["out"]).otherwise(F.array_append(s["out"], match))
        return F.struct(at.alias("at"), F.right(F.coalesce(x["m"], F.lit("")), F.lit(CONTEXT)).alias("last"), out.alias("out"))

    def block(s: Column, b: Column) -> Column:
        inside = F.aggregate(b, F.struct(s["at"].alias("at"), s["last"].alias("last"), none.alias("out")), step)
        return let(inside, lambda i: F.struct(i["at"].alias("at"), i["last"].alias("last"), F.array_append(s["out"], i["out"]).alias("out")))

    def places(pairs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(pairs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / size).cast("int")), lambda b: F.slice(pairs, b * size + 1, size))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), empty.alias("out")).cast(match_type)
        return F.flatten(F.aggregate(blocks, start, block, lambda s: s["out"]))

    def paired(p: Column, m: Column) -> Column:
        return F.transform(p, lambda x, i: F.struct(x.alias("p"), F.get(m, i).alias("m"), F.get(p, i + 1).alias("q")))

    pieces, matches = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    found = let(pieces, lambda p: let(matches, lambda m: let(paired(p, m), places)))
    wanted = functools.reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in NEEDS[kind]]) if kind in NEEDS else F.lit(True)
    return F.when(wanted & text.rlike(PATTERNS[kind].replace(r"\G|", "")), found).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    places = F.sequence(F.lit(1), F.length(digits))

    def part(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """The remainder that checks an account number: country and check digits last, letters as 10 to 35."""
    bare = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def proven(kind: str, value: Column) -> Column:
    """Whether the checksum or range of the kind holds; true for kinds without one."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, " ", "")).between(15, 34) & (mod97(value) == 1)
    if kind == "ssn":
        return ~digits.rlike("^(?:000|666|9)|^...00|0000$")
    return F.lit(True)


def vote(yes: Column | None, no: Column | None) -> Column:
    """1 if yes holds, else 0 if no does, else -1 (the labeler abstains)."""
    abstain = F.lit(-1) if no is None else F.when(no, 0).otherwise(-1)
    return abstain if yes is None else F.when(yes, 1).otherwise(abstain)


def any_word(words: list[str] | str) -> str:
    """A pattern of these as whole words."""
    return rf"(?<![\p{{L}}\p{{N}}])(?:{words if isinstance(words, str) else '|'.join(words)})(?![\p{{L}}\p{{N}}])"


def form(kind: str, value: Column, before: Column) -> Column:
    """The first labeler: how the candidate is written."""
    if kind in ("ip", "card", "phone", "iban"):
        return vote(proven(kind, value), F.lit(True))
    if kind == "email":
        return F.lit(1)
    if kind == "secret":
        inner = F.regexp_extract(value, r"""(?s)^[^\s=:]+(?:\s{0,3}[=:]\s{0,3}|\s[a-z]+\s)["']?(.*)$""", 1)
        return vote((F.length(inner) >= 6) & inner.rlike(r"\p{L}") & inner.rlike("[0-9]") & ~inner.rlike(r"^\p{L}+[0-9]{1,4}$"), inner.rlike(r"^(?:\p{L}+|[0-9.:/-]+)$") | inner.startswith("//"))
    if kind == "key":
        return vote(value.rlike(r"^(?:AKIA[0-9A-Z]{16}$|gh[oprsu]_[A-Za-z0-9]{36}$|sk-|xox[abp]-|eyJ|-----BEGIN)"), None)
    if kind == "ssn":
        return vote(None, ~proven(kind, value))
    if kind == "address":
        return vote(value.rlike(rf"^(?:{'|'.join(STREETS)})$"), value.rlike(rf"^{MONTH} |^[0-9]+ {MONTH}$"))
    if kind == "name":
        return vote(value.rlike(rf"^(?:{'|'.join(TITLES)})\.? ") | before.rlike(rf"(?:{INTRODUCTIONS}) $"), None)
    if kind == "birth":
        return vote(before.rlike(r"(?i)(?:born(?: on)?|birth:?|dob:?|geb\.|geboren(?: am)?|nació el|née? le|\*) ?$"), F.regexp_extract(value, "([0-9]{4})", 1).cast("int") < 1900)
    return vote(value.rlike(r"[(\[{]at[)\]}]| dot |[(\[]dot[)\]]"), value.rlike(rf"(?i)^(?:{NO_MAILBOX}) "))


def gazetteer(kind: str, value: Column, before: Column) -> Column:
    """The second labeler: what lists know of the candidate's parts."""
    if kind in ("email", "masked_email"):
        known = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1)).isin(MAIL_ENDINGS)
        return vote(known, ~known if kind == "masked_email" else None)
    if kind == "ip":
        return vote(None, value.rlike(RESERVED_NETS))
    if kind == "card":
        return vote(value.rlike(CARD_ISSUERS), F.lit(True))
    if kind == "phone":
        return vote(value.rlike(CALLING_CODES), F.lit(True))
    if kind == "secret":
        return vote(value.rlike(rf"(?i)^(?:[\p{{L}}0-9]+[_-])*(?:{SECRET_WORDS})(?![\p{{L}}])"), value.rlike(rf"(?i)^(?:[\p{{L}}0-9]+[_-])*(?:{PLAIN_WORDS})(?![\p{{L}}])"))
    if kind == "key":
        mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") & ~value.rlike("[a-z]{6}")
        return vote(mixed | value.rlike("^(?:AKIA|gh[oprsu]_|sk-|xox[abp]-|eyJ|-----BEGIN)"), value.rlike(r"^[0-9a-f-]+$|^[0-9A-F-]+$|^\p{L}+[_-]\p{L}+[_-]"))
    if kind == "iban":
        return vote(F.substring(value, 1, 2).isin(IBAN_COUNTRIES), F.lit(True))
    if kind == "ssn":
        return vote(None, value.isin("123-45-6789", "078-05-1120"))
    if kind == "address":
        street = rf"{any_word(STREET_ENDS)}|\p{{Ll}}(?:stra(?:ße|sse)|weg|gasse|platz) |{any_word('Calle|Avenida|Plaza|rue|avenue|boulevard')}"
        return vote(value.rlike(street), value.rlike(any_word(NUMBERED)))
    if kind == "name":
        first = rf"^(?:(?:{'|'.join(TITLES)})\.? )?(?:{'|'.join(GIVEN_NAMES)})(?!\p{{L}})"
        return vote(value.rlike(first) & ~value.rlike(any_word(NO_NAMES)), value.rlike(any_word(NO_NAMES)))
    year = F.regexp_extract(value, "([0-9]{4})", 1).cast("int")
    return vote(before.rlike(any_word(GIVEN_NAMES)), ~year.between(1900, 2015))


def context(kind: str, before: Column) -> Column:
    """The third labeler: whole words before the candidate."""
    low = F.lower(before)
    against = f"{AGAINST[kind]}|{AGAINST_ALL}" if kind in AGAINST else AGAINST_ALL
    hinted = low.rlike(any_word(HINTS[kind]))
    return vote(hinted, low.rlike(rf"{any_word(against)}[\s:#.]*$"))


def surroundings(kind: str, before: Column, after: Column) -> Column:
    """The fourth labeler: what follows, and letters or digits that touch the candidate."""
    glued = before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]")
    yes = after.rlike(AFTER[kind]) & ~glued if kind in AFTER else None
    return vote(yes, glued | after.rlike(AFTER_AGAINST[kind]) if kind in AFTER_AGAINST else glued)


def candidates(text: Column) -> Column:
    """array of candidates of all kinds, by kind and place: kind number, start, end, base, ok, votes v0..v3, length class."""
    return F.concat(*[F.transform(located(text, kind), judge(k, kind)) for k, kind in enumerate(KINDS)])


def judge(k: int, kind: str) -> Callable[[Column], Column]:
    """A function from a located match to a candidate with the labelers' votes."""

    def votes(x: Column) -> Column:
        value, before, after = x["value"], x["before"], x["after"]
        holds = proven(kind, value)
        return F.struct(
            F.lit(k).alias("kind"),
            x["start"].alias("start"),
            (x["start"] + F.length(value)).alias("end"),
            (holds & F.lit(kind in BASE_KINDS)).alias("base"),
            holds.alias("ok"),
            form(kind, value, before).alias("v0"),
            gazetteer(kind, value, before).alias("v1"),
            context(kind, before).alias("v2"),
            surroundings(kind, before, after).alias("v3"),
            F.least(F.lit(3), F.floor(F.length(value) / 12)).cast("int").alias("size"),
        )

    return votes


VOTES = ("v0", "v1", "v2", "v3")
Pattern = tuple[int, tuple[int, ...], int, int]  # kind, votes, length class, count


def patterns(found: DataFrame) -> list[Pattern]:
    """Counts of the patterns over all candidates: at most kinds x 3^votes x length classes rows, whatever the corpus."""
    rows = found.select(F.inline("_found")).groupBy("kind", *VOTES, "size").count().orderBy("kind", *VOTES, "size").collect()
    return [(r["kind"], tuple(r[v] for v in VOTES), r["size"], r["count"]) for r in rows]


#: What labelers are taken to say of personal data (1) and of the rest (0) before any is seen, worth START candidates.
SAYS = {1: {1: 0.6, -1: 0.3, 0: 0.1}, 0: {1: 0.1, -1: 0.5, 0: 0.4}}
START, START_PRIOR = 10, 0.3


def expectation_maximisation(seen: list[Pattern], rounds: int = EM_ROUNDS) -> dict[Pattern, float]:
    """Chance that a candidate of each pattern is personal data. By kind, a prior and what each labeler says, abstaining
    included, of both sorts. A labeler that would speak for the wrong sort, or abstains from all of a kind, has no say there. What no
    labeler speaks for is taken as no personal data: that holds the two sorts apart where a kind has nothing but noise."""
    chance: dict[Pattern, float] = {}
    for k in sorted({p[0] for p in seen}):
        mine = [p for p in seen if p[0] == k]
        n = sum(p[3] for p in mine)
        voting = [v for v in range(len(VOTES)) if any(p[1][v] >= 0 for p in mine)]
        prior, says = START_PRIOR, {(v, truth): SAYS[truth] for v in range(len(VOTES)) for truth in (0, 1)}
        for _ in range(rounds):
            for p in mine:
                odds = math.log(prior / (1 - prior)) + sum(math.log(says[v, 1][p[1][v]] / says[v, 0][p[1][v]]) for v in voting)
                chance[p] = 1 / (1 + math.exp(max(-700.0, min(700.0, -odds)))) if 1 in p[1] else 0.0
            prior = (sum(chance[p] * p[3] for p in mine) + 1) / (n + 2)
            for v in voting:
                for truth in (0, 1):
                    weight = [(p[1][v], p[3] * (chance[p] if truth else 1 - chance[p])) for p in mine]
                    total = sum(w for _, w in weight) + START
                    says[v, truth] = {x: (sum(w for y, w in weight if y == x) + START * SAYS[truth][x]) / total for x in (-1, 0, 1)}
                if says[v, 1][1] < says[v, 0][1] or says[v, 1][0] > says[v, 0][0]:
                    says[v, 1] = says[v, 0] = {x: (says[v, 1][x] + says[v, 0][x]) / 2 for x in (-1, 0, 1)}
    return chance


def features(kind: int, votes: tuple[int, ...], size: int) -> list[str]:
    """Names of a pattern's features: kind, length, and each vote by itself and with the kind."""
    alone = [f"{name}={x}" for name, x in zip(VOTES, votes, strict=True)]
    return [f"kind={kind}", f"size={size}", *alone, *(f"{kind}:{x}" for x in alone)]


def fit(seen: list[Pattern], chance: dict[Pattern, float], rounds: int = FIT_ROUNDS) -> dict[str, float]:
    """Weights of the logistic span classifier, by gradient steps on the soft labels, each feature at its own pace. A pattern
    weighs by the logarithm of its count, so that the many candidates of one pattern don't drown the rare ones."""
    weights: dict[str, float] = {}
    pace: dict[str, float] = {}
    names = {p: features(*p[:3]) for p in seen}
    for _ in range(rounds):
        step: dict[str, float] = {}
        for p in seen:
            score = sum(weights.get(x, 0.0) for x in names[p])
            error = (chance[p] - 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))) * math.log1p(p[3])
            for x in names[p]:
                step[x] = step.get(x, 0.0) + error
        for x, g in step.items():
            g -= 1e-3 * weights.get(x, 0.0)
            pace[x] = pace.get(x, 1e-12) + g * g
            weights[x] = weights.get(x, 0.0) + 0.5 * g / math.sqrt(pace[x])
    return weights


def classified(c: Column, weights: dict[str, float]) -> Column:
    """The classifier's chance for candidate c: weights are looked up in arrays by kind and vote."""

    def table(names: list[list[str]]) -> Column:
        return F.array(*[F.lit(sum(weights.get(x, 0.0) for x in group)) for group in names])

    score = F.get(table([[f"kind={k}"] for k in range(len(KINDS))]), c["kind"]) + F.get(table([[f"size={i}"] for i in range(4)]), c["size"])
    for v in VOTES:
        by_kind = [[f"{v}={x}", f"{k}:{v}={x}"] for k in range(len(KINDS)) for x in (-1, 0, 1)]
        score = score + F.get(table(by_kind), c["kind"] * 3 + c[v] + 1)
    return 1 / (1 + F.exp(-score))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(k: int) -> Callable[[Column], Column]:
    return lambda c: c["kind"] == k


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    text = whole(F.col(text_col))
    found = stored(docs.select(F.col(id_col), candidates(text).alias("_found")), "candidates")
    seen = patterns(found)
    weights = fit(seen, expectation_maximisation(seen))
    base = F.filter("_found", lambda c: c["base"])
    spans = F.filter("_found", lambda c: c["base"] | (c["ok"] & (classified(c, weights) >= THRESHOLD)))
    counts = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return found.select(
        id_col,
        *counts,
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        (F.size(spans) - F.size(base)).cast("long").alias("n_added"),
    )
