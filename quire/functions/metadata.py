"""Bibliographic facts out of running text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import text_of

# Source types in the order in which their words are looked for.
SOURCE_RULES = (
    ("guideline", ("guideline", "consensus statement", "recommendations")),
    ("systematic_review", ("systematic review", "meta-analysis")),
    ("randomized_trial", ("randomized", "randomised")),
    ("prospective_cohort", ("prospective",)),
    ("retrospective_cohort", ("retrospective",)),
    ("case_report", ("case report", "case series")),
    ("review", ("review",)),
)

YEAR = r"((?:19|20)[0-9]{2})"
# Where a year is one of publication, surest first (MD3), and the journals known by their citations (MD4).
YEAR_RULES = (
    rf"\b{YEAR}\s*;\s*\d{{1,4}}(?:\s*\(\d+\))?\s*[:;]",
    rf"\(\s*{YEAR}\s*\)\s*\d+\s*[-\u2013\u2014]",
    rf"\b(?:CHEST|Clin(?:ics)?\s+Chest\s+Med|ERJ\s+Open\s+Res)\s+{YEAR}\s*[;,:]",
    rf"\bJ(?:ournal)?\s+[A-Za-z][A-Za-z .&-]{{2,70}}\s+{YEAR}\s*[;,:]",
    rf"\b(?:Volume|Vol\.?)\s+\d+[^.\n]{{0,50}}\b{YEAR}\b",
    rf"\b(?:published(?:\s+online)?|first\s+published)[^.\n]{{0,80}}\b{YEAR}\b",
    rf"(?:copyright|\u00a9)\s*{YEAR}\b",
)
JOURNAL_RULES = (
    r"\b(Clin(?:ics)?\s+Chest\s+Med)\s+\d+\s*\(\d{4}\)",
    r"\b(CHEST)\s+\d{4}\s*;",
    r"\b(ERJ\s+Open\s+Res)\s+\d{4}\s*;",
    r"\b(J\s+Natl\s+Compr\s+Canc\s+Netw)\s+\d{4}\s*;",
    r"\b(Thorax)\s+\d{4}\s*;",
    r"\b(Current\s+Opinion\s+in\s+Anaesthesiology)\s+\d{4}\b",
    r"\b(Journal\s+of\s+Thoracic\s+Disease),\s+Vol\b",
    r"\b(European\s+Clinical\s+Respiratory\s+Journal)\b",
    r"\b(International\s+Journal\s+of\s+Critical\s+Illness\s+and\s+Injury\s+Science)\b",
)


def doi_in(col: Column | str) -> Column:
    """The first explicit DOI of the first 6000 characters, lower case, without closing signs."""
    found = F.regexp_extract(F.lower(F.substring(text_of(col), 1, 6000)), r"(?:doi\.org/|doi:?\s*)(10\.[0-9]{4,9}/\S+)", 1)
    return F.regexp_replace(found, r"[.,;)\]}]+$", "")


def pmid_in(col: Column | str) -> Column:
    """The first PubMed id of the first 6000 characters."""
    return F.regexp_extract(F.substring(text_of(col), 1, 6000), r"(?i)\bPMID:?\s*([0-9]{5,9})\b", 1)


def years_in(col: Column | str) -> Column:
    """All years from 1900 to 2099, in order."""
    return F.transform(F.regexp_extract_all(text_of(col), F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def source_type(title: Column | str, abstract: Column | str) -> Column:
    """The first rule whose words stand in title or abstract."""
    text = F.lower(F.concat_ws(" ", text_of(title), text_of(abstract)))
    out = F.lit("journal_article")
    for kind, words in reversed(SOURCE_RULES):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, kind).otherwise(out)
    return out


def clean(col: Column | str) -> Column:
    """Soft hyphens gone, blanks before punctuation closed, one blank between words."""
    text = F.regexp_replace(text_of(col), "­", "")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r" +([,.;:])", "$1"))


def plausible_title(col: Column | str) -> Column:
    """Long enough, mostly letters, not a generic heading."""
    text = F.trim(text_of(col))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    generic = F.lower(text).isin("untitled", "document", "editorial", "erratum", "correction", "reply", "in this issue", "book review", "news and notes", "letter to the editor")
    return (F.length(text) >= 8) & (letters >= 0.5 * F.length(text)) & ~generic


def publication_year(head: Column | str, latest: Column) -> Column:
    """The year of publication in the first pages: the first year of the surest rule that names one up to ``latest``."""
    text = F.substring(text_of(head), 1, 80_000)
    years = [F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + rule), F.lit(1)), lambda y: y.try_cast("int")), lambda y: y.between(1900, latest)) for rule in YEAR_RULES]
    return F.coalesce(*[F.get(y, 0) for y in years])


def journal_in(head: Column | str) -> Column:
    """The journal whose citation stands in the first pages, by the first rule that fits; empty if none."""
    text = F.substring(text_of(head), 1, 80_000)
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, "(?iU)" + rule, 1), F.lit("")) for rule in JOURNAL_RULES], F.lit(""))
    return F.substring(F.trim(F.regexp_replace(found, r"(?U)\s+", " ")), 1, 500)


def abstract_in(head: Column | str) -> Column:
    """The abstract in the first pages: from its heading to that of the next section, else 4000 characters."""
    start = r"(?md)^[ \t]*(?:ABSTRACT[ \t]*:?[ \t]*|Abstract[ \t]*(?:[:\u2014-][ \t]*|(?=\n|[A-Z])))([\s\S]*)"
    parts = F.split(F.regexp_extract(text_of(head), start, 1), r"(?iU)\n\s*(?:keywords?|introduction|background|methods?|materials and methods)\b", 2)
    body = F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise(F.substring(F.get(parts, 0), 1, 4000))
    return F.substring(F.trim(F.regexp_replace(body, r"(?U)\s+", " ")), 1, 5000)


def abstract_heading(col: Column | str) -> Column:
    """Whether a line of the first 6000 characters is nothing but the heading of an abstract."""
    return F.substring(text_of(col), 1, 6000).rlike(r"(?imdU)^\s*abstract\s*[:\u2014-]?\s*$")
