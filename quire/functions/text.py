"""Text functions of the ranker as column expressions; all run inside the JVM.

Every function takes and returns columns. Null text counts as the empty string.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[A-Za-z0-9][A-Za-z0-9'\-]{1,}"
# Words that carry no subject in a remembered question.
STOPWORDS = (
    "the a an and or but with where when that this was were is are of to in on at by as for from my i me mine you your yours we our ours it its "
    "paper study article publication report about around approximately some something one thing kind sort had has have been being because saved "
    "save remember remembered recall take taking over"
).split()
# Markers of passages that are not about the paper's subject.
BACK_MATTER = ("declaration of interest", "conflicts of interest", "conflict of interest", "financial interest", "role of sponsors", "author contributions", "acknowledgments")
VOLUME_MARKERS = ("recommended annual procedure volumes", "recommended number of procedures", "procedure type case volume", "requisite annual institutional", "fellowship accreditation")
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50}
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def text_of(col: Column | str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def query_terms(col: Column | str) -> Column:
    """Distinct terms of two or more characters, lower case, in order of first occurrence."""
    return F.array_distinct(all_terms(col))


def all_terms(col: Column | str) -> Column:
    """All terms in order, repeats included."""
    return F.regexp_extract_all(F.lower(text_of(col)), F.lit(TERM.replace("A-Z", "")), F.lit(0))


def content_terms(col: Column | str) -> Column:
    """Query terms without stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(query_terms(col), lambda t: ~F.array_contains(stop, t))


def terms_of(query: str) -> list[str]:
    """Content terms of a literal query."""
    found = dict.fromkeys(re.findall(TERM.replace("A-Z", ""), query.lower()))
    return [t for t in found if t not in STOPWORDS]


def fts_query(col: Column | str, most: int = 24) -> Column:
    """An OR of quoted terms; terms of four or more characters match as prefixes."""
    quoted = F.transform(F.slice(query_terms(col), 1, most), lambda t: F.concat(F.lit('"'), t, F.lit('"'), F.when(F.length(t) >= 4, "*").otherwise("")))
    return F.when(F.size(quoted) == 0, F.lit('""')).otherwise(F.array_join(quoted, " OR "))


def term_matches(term: Column, token: Column) -> Column:
    """Equal, or one is the other with a plural s."""
    return (term == token) | ((F.length(term) > 3) & (term == F.concat(token, F.lit("s")))) | ((F.length(token) > 3) & (token == F.concat(term, F.lit("s"))))


def forms(term: str) -> list[str]:
    """The tokens that match a literal term."""
    out = [term]
    if len(term) > 3 and term.endswith("s"):
        out.append(term[:-1])
    if len(term) + 1 > 3:
        out.append(term + "s")
    return out


def matched(terms: list[str], tokens: Column) -> Column:
    """The literal terms that some token matches, in order."""
    hits = [F.when(F.arrays_overlap(tokens, F.array(*[F.lit(f) for f in forms(t)])), F.lit(t)) for t in terms]
    return F.filter(F.array(*hits), lambda t: t.isNotNull())


def coverage(query: str, col: Column | str) -> Column:
    """Share of the query's content terms that the text holds; 0 without terms."""
    terms = terms_of(query)
    if not terms:
        return F.lit(0.0)
    return F.size(matched(terms, query_terms(col))) / F.lit(float(len(terms)))


def window_span(terms: list[str], col: Column | str, part: bool = False) -> Column:
    """Smallest distance between the first and last of a run of distinct tokens that holds every term; null if none.

    With ``part`` it is every term that the text holds at all.
    """
    tokens = query_terms(col)

    def code(x: Column) -> Column:
        out = F.lit(-1)
        for k, t in reversed(list(enumerate(terms))):
            out = F.when(x.isin(*forms(t)), F.lit(k)).otherwise(out)
        return out

    at = F.filter(F.transform(tokens, lambda x, i: F.struct(code(x).alias("k"), i.cast("int").alias("i"))), lambda p: p["k"] >= 0)
    if part:  # a term that is not there never is the earliest
        never = [F.when(F.arrays_overlap(tokens, F.array(*[F.lit(f) for f in forms(t)])), F.lit(-1)).otherwise(F.lit(1 << 30)) for t in terms]
    else:
        never = [F.lit(-1)] * len(terms)
    start = F.struct(F.array(*never).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(acc: Column, p: Column) -> Column:
        last = F.transform(acc["last"], lambda v, j: F.when(j == p["k"], p["i"]).otherwise(v))
        span = F.when(F.array_min(last) >= 0, p["i"] - F.array_min(last))
        return F.struct(last.alias("last"), F.least(acc["best"], span).alias("best"))

    return F.aggregate(at, start, step, lambda acc: acc["best"])


def within_window(terms: list[str], col: Column | str, window: int = 18) -> Column:
    """Whether every term stands within ``window`` distinct tokens."""
    if not terms:
        return F.lit(False)
    if len(terms) == 1:
        return F.size(matched(terms, query_terms(col))) == 1
    return F.coalesce(window_span(terms, col) <= window, F.lit(False))


def topic_terms(n: int) -> int:
    """How many of a topic's terms a text must hold."""
    return n if n <= 2 else max(2, math.ceil(n * 0.75))


def topic_matches(topic: str, col: Column | str, window: int = 18) -> Column:
    """Whether the text holds enough of the topic's terms, and those it holds within ``window`` distinct tokens."""
    terms = terms_of(topic)
    if not terms:
        return F.lit(False)
    held = F.size(matched(terms, query_terms(col)))
    if len(terms) == 1:
        return held == 1
    # A text without the letters of enough terms is never cut into tokens.
    low = F.lower(text_of(col))
    letters = [low.contains(t.removesuffix("s") if len(t) > 3 else t).cast("int") for t in terms]
    likely = reduce(lambda a, b: a + b, letters) >= topic_terms(len(terms))
    return F.when(likely & (held >= topic_terms(len(terms))), F.coalesce(window_span(terms, col, part=True) <= window, F.lit(False))).otherwise(F.lit(False))


# Fixed value: the headings that end a first page's zone of authors.
SECTION = r"(?im)^\s*(?:abstract|background|introduction|methods?|results?|key\s+points?|keywords?)\s*:?\s*$"


def author_zone(page: Column | str, title: Column | str) -> Column:
    """What a first page has before its first section, without the title."""
    text, head = text_of(page), text_of(title)
    at = F.instr(F.lower(text), F.lower(head))
    rest = F.when((head != "") & (at > 0), F.concat(F.substr(text, F.lit(1), at - 1), F.lit(" "), F.substr(text, at + F.length(head)))).otherwise(text)
    return F.get(F.split(rest, SECTION, 2), 0)


def folded_numbers(col: Column | str) -> Column:
    """Lower-case text with number words before ``percent`` as figures."""
    out = F.lower(text_of(col))
    for word, n in NUMBER_WORDS.items():
        out = F.regexp_replace(out, rf"\b{word}\s+(?=percent\b)", f"{n} ")
    return out


PERCENT = r"(?<![\d.])(\d+(?:\.\d+)?)\s*(?:%|percent\b)"


def percentages(col: Column | str) -> Column:
    """All percentages, in order."""
    return F.transform(F.regexp_extract_all(folded_numbers(col), F.lit(PERCENT), F.lit(1)), lambda x: x.cast("double"))


def plain_numbers(col: Column | str) -> Column:
    """All numbers that are neither percentages nor whole years from 1900 to 2100, in order."""
    masked = F.regexp_replace(folded_numbers(col), PERCENT, " ")
    found = F.transform(F.regexp_extract_all(masked, F.lit(r"(?<![\d.])(\d+(?:\.\d+)?)(?![\d.])"), F.lit(1)), lambda x: x.cast("double"))
    return F.filter(found, lambda x: ~(x.between(1900, 2100) & (x == F.floor(x))))


def numeric_bonus(query_percentages: list[float], query_numbers: list[float], col: Column | str) -> Column:
    """Mean closeness of each number asked for to the nearest of its kind in the text; zero meets only zero."""
    wanted = [(v, percentages(col)) for v in query_percentages] + [(v, plain_numbers(col)) for v in query_numbers]
    if not wanted:
        return F.lit(0.0)

    def closest(value: float, found: Column) -> Column:
        if value == 0:
            return F.exists(found, lambda c: c == 0).cast("double")
        near = F.transform(found, lambda c: F.when(c == 0, 0.0).otherwise(F.exp(-0.9 * F.abs(F.ln(c / F.lit(abs(value)))))))
        return F.coalesce(F.array_max(near), F.lit(0.0))

    total = F.lit(0.0)
    for value, found in wanted:
        total = total + closest(value, found)
    return total / len(wanted)


def lexical_evidence(query: str, col: Column | str, query_percentages: list[float] = (), query_numbers: list[float] = ()) -> Column:
    """Whether the text answers enough of the query's terms, or fewer of them and its numbers."""
    terms = terms_of(query)
    if not terms:
        return F.lit(False)
    n = F.size(matched(terms, query_terms(col)))
    enough = n >= (len(terms) if len(terms) <= 2 else max(2, math.ceil(len(terms) / 2)))
    lexical = F.when(enough, within_window(terms, col, 12) if len(terms) == 2 else F.lit(True))
    if not query_percentages and not query_numbers:
        return F.coalesce(lexical, F.lit(False))
    words = [t for t in terms if not t.isdigit() and t not in ("percent", "percentage", "percentages")]
    some = F.size(matched(words, query_terms(col))) >= max(1, math.ceil(len(words) / 2)) if words else F.lit(False)
    return F.coalesce(lexical, some & (numeric_bonus(list(query_percentages), list(query_numbers), col) >= 0.25))


def compact(col: Column | str) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text_of(col), r"(?U)\s+", " "))


def is_reference_passage(col: Column | str) -> Column:
    """Bibliography text: a heading near the start, or several years with citation marks."""
    low = F.lower(text_of(col))
    flat = F.regexp_replace(low, r"(?U)\s+", " ")
    heading = F.substring(low, 1, 1800).rlike(r"(?:^|\n)\s*(?:references|bibliography|literature cited)\s*(?:\n|$)")
    years = F.regexp_count(flat, F.lit(r"\b(?:19|20)\d{2}\b"))
    numbered = F.regexp_count(low, F.lit(r"(?:^|\n)\s*(?:\[\d+\]|\d{1,3}\.)\s*"))
    volumes = F.regexp_count(flat, F.lit(r"\b\d{4}\s*;\s*\d{1,4}(?:\s*\(\s*\d+\s*\))?\s*:\s*\d+"))
    et_al = F.regexp_count(flat, F.lit(r"\bet\s+al\b"))
    journals = F.regexp_count(flat, F.lit(r"\b(?:chest|thorax|respir(?:ation|atory)|bronchol|eur respir j|am j respir|j thorac|lung)\b"))
    return heading | ((years >= 3) & ((numbered >= 2) | (volumes >= 2) | ((et_al >= 2) & (journals >= 2))))


def has_any(col: Column, markers: tuple[str, ...]) -> Column:
    """Whether the text holds one of the markers."""
    out = F.lit(False)
    for m in markers:
        out = out | col.contains(m)
    return out


def is_back_matter(col: Column | str) -> Column:
    """Disclosures and acknowledgements."""
    return has_any(F.regexp_replace(F.lower(text_of(col)), r"(?U)\s+", " "), BACK_MATTER)


def is_incidental(col: Column | str) -> Column:
    """References, back matter or lists of procedure volumes."""
    return is_reference_passage(col) | is_back_matter(col) | has_any(F.regexp_replace(F.lower(text_of(col)), r"(?U)\s+", " "), VOLUME_MARKERS)


def strip(col: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text_of(col), r"(?U)^\s+|\s+$", "")


def snippet(query: str, col: Column | str, size: int = 480, lead: int = 120) -> Column:
    """The whole text if short, else ``size`` characters from a word's beginning shortly before the first term."""

    def around(body: Column, low: Column) -> Column:
        places = [F.nullif(F.instr(low, t), F.lit(0)) for t in terms_of(query)]
        hit = F.least(*places) if len(places) > 1 else (places[0] if places else F.lit(None).cast("int"))
        start = F.greatest(F.coalesce(hit, F.lit(1)) - 1 - lead, F.lit(0))
        skip = F.when(start > 0, F.instr(F.substr(body, start + 1), " ")).otherwise(0)
        return F.when(F.length(body) <= size, body).otherwise(strip(F.substr(body, start + skip + 1, F.lit(size))))

    return let(strip(col), lambda body: let(F.lower(body), lambda low: around(body, low)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def truncate(col: Column | str, limit: int = 220) -> Column:
    """At most ``limit`` characters, the last one an ellipsis if something is cut."""
    body = compact(col)
    return F.when(F.length(body) <= limit, body).otherwise(F.concat(F.regexp_replace(F.substring(body, 1, limit - 1), r"\s+$", ""), F.lit("…")))


def slug(col: Column | str) -> Column:
    """Lower-case letters and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(text_of(col)), ACCENTED, PLAIN), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalise_title(col: Column | str) -> Column:
    """Accents of Latin letters dropped, other signs as blanks, one blank between words."""
    plain = F.translate(F.lower(text_of(col)), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^\\x00-\\x7f]", ""), "[^a-z0-9]+", " "))


def author_list(col: Column | str) -> Column:
    """Names of a list parted by ; or the word and."""
    return F.filter(F.transform(F.split(text_of(col), r"\s*;\s*|\s+and\s+"), strip), lambda x: x != "")


def bibtex_escape(col: Column | str) -> Column:
    """Backslash, braces, ampersand and percent escaped."""
    out = F.replace(text_of(col), F.lit("\\"), F.lit("\\textbackslash "))
    for sign in "{}&%":
        out = F.replace(out, F.lit(sign), F.lit("\\" + sign))
    return out


def citation_key(authors: Column | str, year: Column | str, title: Column | str) -> Column:
    """First author's family name, year or nd, first title word."""
    first = F.element_at(F.concat(author_list(authors), F.array(F.lit("anon"))), 1)
    family = F.when(first.contains(","), F.substring_index(first, ",", 1)).otherwise(F.element_at(F.split(first, r"\s+"), -1))
    name = F.regexp_replace(F.translate(F.lower(family), ACCENTED, PLAIN), "[^a-z0-9]", "")
    word = F.regexp_extract(F.translate(F.lower(text_of(title)), ACCENTED, PLAIN), "[a-z0-9]+", 0)
    return F.concat(F.when(name == "", "anon").otherwise(name), F.coalesce((F.col(year) if isinstance(year, str) else year).cast("string"), F.lit("nd")), word)


def xml_escape(col: Column | str) -> Column:
    """The five characters that XML reserves."""
    out = text_of(col)
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def strip_markup(col: Column | str) -> Column:
    """Without the tags of highlighted headlines."""
    return F.regexp_replace(text_of(col), "</?[bB]>|</?mark>", "")


def title_from_file_name(col: Column | str) -> Column:
    """A readable title from a file name."""
    return F.trim(F.regexp_replace(F.regexp_replace(text_of(col), r"(?i)\.pdf$", ""), "[-_]+", " "))
