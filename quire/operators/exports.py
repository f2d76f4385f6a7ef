"""Text exports of bibliographic records, one row a record or an ordered aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import library as L


def bibtex(authors: str = "authors", year: str = "publication_year", title: str = "title", journal: str = "journal", doi: str = "doi") -> Column:
    """A BibTeX article; empty fields are left out."""
    fields = [("title", T.bibtex_escape(title)), ("author", T.bibtex_escape(F.array_join(T.author_list(authors), " and "))), ("journal", T.bibtex_escape(journal)), ("year", F.coalesce(F.col(year).cast("string"), F.lit(""))), ("doi", T.bibtex_escape(doi))]
    kept = F.filter(F.array(*[F.when(v != "", F.concat(F.lit(f"  {n} = {{"), v, F.lit("}"))) for n, v in fields]), lambda x: x.isNotNull())
    return F.concat(F.lit("@article{"), T.citation_key(authors, year, title), F.lit(",\n"), F.array_join(kept, ",\n"), F.lit("\n}"))


def ris(authors: str = "authors", year: str = "publication_year", title: str = "title", journal: str = "journal", doi: str = "doi") -> Column:
    """A RIS record; empty tags are left out."""
    flat = lambda c: F.regexp_replace(T.text_of(c), r"[\r\n]+", " ")
    single = [("TI", flat(title)), ("JO", flat(journal)), ("PY", F.coalesce(F.col(year).cast("string"), F.lit(""))), ("DO", flat(doi))]
    lines = F.concat(F.array(F.lit("TY  - JOUR")), F.transform(T.author_list(authors), lambda a: F.concat(F.lit("AU  - "), a)), F.filter(F.array(*[F.when(v != "", F.concat(F.lit(f"{n}  - "), v)) for n, v in single]), lambda x: x.isNotNull()), F.array(F.lit("ER  - ")))
    return F.array_join(lines, "\n")


def markdown_row(*cols: str) -> Column:
    """A row of a Markdown table; bars escaped, underscores as blanks."""
    cells = [F.replace(F.replace(F.regexp_replace(T.text_of(F.col(c).cast("string")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|")), F.lit("_"), F.lit(" ")) for c in cols]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def xfdf_highlight(page: str, quad: str, text: str) -> Column:
    """An XFDF highlight of a list of coordinates; pages count from 0."""
    coords = F.array_join(F.transform(F.col(quad), lambda v: F.format_string("%.4f", v.cast("double"))), ",")
    return F.concat(F.lit('<highlight page="'), (F.col(page) - 1).cast("string"), F.lit('" coords="'), coords, F.lit('"><contents>'), T.xml_escape(text), F.lit("</contents></highlight>"))


def table_lines(df: DataFrame, group: str, order: list[Column], line: str, head: list[str]) -> DataFrame:
    """(group, line_no, line): the lines of one table per group, under the lines of a head. A group of any size is
    numbered in parts and never held in one place; write it with ``sortWithinPartitions`` to get the files."""
    rows = L.positions(df, [group], order).select(group, (F.col("position") + len(head)).cast("long").alias("line_no"), line)
    heads = df.select(group).distinct().select(group, F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("line_no"), F.lit(h).alias(line)) for i, h in enumerate(head, 1)])).alias("h"))
    return rows.unionByName(heads.select(group, "h.*"))
