"""Queries of ingestion, metadata inference and export over the library's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import metadata as M
from quire.functions import text as T
from quire.operators import exports as E
from quire.operators import ingest as I
from quire.operators import library as L
from quire.session import read


# A PMID of zeros is a placeholder.
DOI = L.DOI
PMID = "^0*[1-9][0-9]*$"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same text: digest, first id, size."""
    return _docs(spark, sf_dir).where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def identifier_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newcomers by what their DOI or PMID meets in the accepted history; placeholders meet nothing."""
    doi = F.when(F.lower("doi").rlike(DOI), F.lower("doi"))
    docs = _docs(spark, sf_dir).select("doc_id", "import_batch", doi.alias("doi"), F.when(F.col("pmid").rlike(PMID), F.col("pmid")).alias("pmid"))
    old, new = docs.where("import_batch = 0"), docs.where("import_batch >= 1").select("doc_id", "doi", "pmid")
    # Old records are counted per key before they are met, so a key of many records costs one row.
    met = new
    for name, keys in (("d", ["doi"]), ("p", ["pmid"]), ("b", ["doi", "pmid"])):
        per = old.dropna(subset=keys).groupBy(*keys).agg(F.count_distinct("doc_id").alias(f"n_{name}"), F.min("doc_id").alias(f"first_{name}"))
        met = met.join(per, keys, "left")
    zero = F.lit(0).cast("long")
    n = F.coalesce("n_d", zero) + F.coalesce("n_p", zero) - F.coalesce("n_b", zero)
    return met.select("doc_id", n.alias("n_matches"), F.least("first_d", "first_p").alias("first_id"), I.match_state(n).alias("state"))


def title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose normalised title of 24 characters or more an earlier one has."""
    docs = _docs(spark, sf_dir).where("length(normalized_title) >= 24").select("doc_id", "normalized_title")
    first = docs.groupBy("normalized_title").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "normalized_title").where("first_id < doc_id").select("doc_id", "first_id")


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review state of each document as an import would set it, counted."""
    docs = _docs(spark, sf_dir)
    first = docs.where("length(normalized_title) >= 24").groupBy("normalized_title").agg(F.min("doc_id").alias("first_id"))
    pages = read(spark, sf_dir, "document_pages").groupBy(F.col("document_id").alias("doc_id")).agg(F.min("extraction_confidence").alias("worst"))
    joined = docs.join(first, "normalized_title", "left").join(pages, "doc_id", "left")
    no = F.lit(False)
    state = I.review_state(F.coalesce(F.col("publication_year") > 2030, no), T.text_of("title").rlike(r"(?i)\b(?:part|teil) [0-9]"), F.coalesce(F.col("first_id") < F.col("doc_id"), no), F.coalesce(F.col("worst") < 0.55, no), T.text_of("text") == "")
    return joined.select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def metadata_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which records of the same DOI differ from its first record."""
    docs = _docs(spark, sf_dir).where("doi like '10.%' and doi not like '10.0000%'").select(F.lower("doi").alias("doi"), "doc_id", "title", "publication_year", "pmid")
    first = docs.groupBy("doi").agg(F.min_by(F.struct("doc_id", "title", "publication_year", "pmid"), "doc_id").alias("f"))
    pairs = docs.join(first, "doi").where("f.doc_id < doc_id").select("doc_id", *[F.col(f"f.{c}").alias(f"{c}_a") for c in ("title", "publication_year", "pmid")], *[F.col(c).alias(f"{c}_b") for c in ("title", "publication_year", "pmid")])
    return I.conflicts(pairs, "doc_id", ["title", "publication_year", "pmid"])


def version_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version label each file would get, in order of its id."""
    files = read(spark, sf_dir, "document_files").select("document_id", "file_id").distinct()
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("file_id"))
    return files.select("file_id", F.concat(F.lit("v"), n.cast("string")).alias("label"))


def asset_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files by what a migration finds: missing, without digest, changed or in order."""
    state = F.when(F.col("availability") == "missing", "missing").when(F.coalesce("sha256", F.lit("")) == "", "undigested").when(F.col("availability") == "source_changed", "changed").otherwise("migrated")
    return read(spark, sf_dir, "document_files").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 600 characters every 520 of each text: length and digest of each."""
    return I.fixed_windows(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows that end where sentences or words end."""
    return I.sentence_chunks(_docs(spark, sf_dir).where("text is not null"), "doc_id", "text")


def page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines that come back on most pages of a document."""
    pages = read(spark, sf_dir, "document_pages").select("document_id", "page_number", F.split("text", "\n").alias("lines"))
    edges = pages.select("document_id", "page_number", F.explode(F.array(F.element_at("lines", 1), F.element_at("lines", -1))).alias("line"))
    return I.repeated_margins(edges)


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each page as blocks of a grid 14 points high, cut to the page: how many stay, and their area."""
    pages = read(spark, sf_dir, "document_pages").select("document_id", "page_number", "width", "height", F.posexplode(F.split("text", "\n")).alias("at", "line")).distinct()
    y0 = F.col("at") * 28.0 + 36.0
    blocks = pages.select("document_id", "page_number", "width", "height", F.lit(36.0).alias("x0"), (F.length("line") * 8.0 + 36.0).alias("x1"), y0.alias("y0"), (y0 + 26.0).alias("y1"))
    return I.clip_blocks(blocks).groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.round(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), 2).alias("area"))


def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading position of every line where even lines stand in a right column: lines of two-column pages."""
    pages = read(spark, sf_dir, "document_pages").select("document_id", "page_number", "width", F.posexplode(F.split("text", "\n")).alias("at", "line")).distinct()
    right = F.col("at") % 2 == 1
    wide = F.length("line") > 70
    x0 = F.when(right & ~wide, F.col("width") * 0.52).otherwise(F.col("width") * 0.05)
    x1 = F.when(wide, F.col("width") * 0.95).otherwise(x0 + F.col("width") * 0.4)
    y0 = F.when(wide, F.col("at") * 12.0).otherwise(F.floor(F.col("at") / 2) * 24.0)
    blocks = pages.select("document_id", "page_number", "at", "width", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), (y0 + 10.0).alias("y1"))
    return I.reading_order(blocks, ["document_id", "page_number"]).select("document_id", "page_number", "at", "position")


def inferred_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI, PMID, first year, source type and the plausibility of the title, from the text."""
    return _docs(spark, sf_dir).select("doc_id", M.doi_in("text").alias("doi_in_text"), M.pmid_in("text").alias("pmid_in_text"), F.get(M.years_in("text"), 0).alias("first_year"), M.source_type("title", "abstract").alias("inferred_type"), M.plausible_title("title").alias("plausible_title"))


def year_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent year of each text, the earliest place at a tie."""
    years = _docs(spark, sf_dir).select("doc_id", F.posexplode(M.years_in("text")).alias("at", "year"))
    votes = years.groupBy("doc_id", "year").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    return votes.groupBy("doc_id").agg(F.max_by("year", F.struct(F.col("n"), -F.col("first_at"))).alias("year"), F.max("n").alias("n_votes"))


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year of publication, journal and abstract of each document as its first pages give them."""
    pages = read(spark, sf_dir, "document_pages")
    made = _docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), (F.year("created_at") + 1).alias("latest"))
    two = I.first_pages(pages, 2).join(made, "document_id").select("document_id", M.publication_year("head", F.col("latest")).alias("year"), M.journal_in("head").alias("journal"))
    return two.join(I.first_pages(pages, 4).select("document_id", M.abstract_in("head").alias("abstract")), "document_id")


def multi_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that seem to hold several articles, by their later pages."""
    return I.multi_articles(read(spark, sf_dir, "document_pages"))


def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles cleaned, cut, as slug and as file name."""
    return _docs(spark, sf_dir).select("doc_id", F.length(M.clean("title")).alias("n_clean"), T.truncate("title", 40).alias("short_title"), T.slug("title").alias("slug"), T.title_from_file_name(F.concat(T.slug("title"), F.lit(".pdf"))).alias("from_file"))


def normalised_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised titles beside the stored ones: how many agree, by language."""
    same = (T.normalise_title("title") == F.coalesce("normalized_title", F.lit(""))).cast("long")
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum(same).alias("n_same"), F.max(F.length(T.normalise_title("title"))).alias("longest"))


def bibtex_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as BibTeX."""
    return _docs(spark, sf_dir).select("doc_id", E.bibtex().alias("record"))


def ris_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as RIS."""
    return _docs(spark, sf_dir).select("doc_id", E.ris().alias("record"))


def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one Markdown table of titles per journal, newest first, with their numbers."""
    docs = _docs(spark, sf_dir).where("deleted_at is null and journal is not null").select("journal", "doc_id", F.coalesce("publication_year", F.lit(0)).alias("year"), E.markdown_row("publication_year", "title", "source_type").alias("line"))
    return E.table_lines(docs, "journal", [F.col("year").desc(), F.col("doc_id").asc()], "line", ["| year | title | type |", "| --- | --- | --- |"])


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a project's CSV export for all projects, blanks for nulls."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return _docs(spark, sf_dir).where("deleted_at is null").select("doc_id", *[blank(c) for c in ("source", "title", "authors", "journal", "publication_year", "doi", "pmid", "source_type", "reading_status", "importance")])


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pairs of each title hashed to 512 places, counted and scaled to length one (sparse)."""
    words = F.filter(T.all_terms("title"), lambda w: ~F.array_contains(F.array(*[F.lit(x) for x in T.STOPWORDS]), w))
    titles = _docs(spark, sf_dir).select("doc_id", words.alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = titles.select("doc_id", F.explode(F.concat("w", pairs)).alias("gram"))
    place = F.conv(F.substring(F.md5("gram"), 1, 4), 16, 10).cast("int") % 512
    counts = grams.groupBy("doc_id", place.alias("place")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return counts.select("doc_id", "place", F.round(F.col("n") / norm, 6).alias("weight"))


def size_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median size and spread of files per kind and role, and the default of each role (join on a constant)."""
    files = read(spark, sf_dir, "document_files")
    roles = files.select("file_role").distinct()
    keys = ["source_kind", "file_role"]
    kinds = files.groupBy(*keys).agg(F.round(F.stddev_samp("size_bytes"), 3).alias("spread"), F.count("*").alias("n"), F.count("size_bytes").alias("sized_"))
    # The middle rows by position: no group's sizes are held in one place.
    placed = L.positions(files.where("size_bytes is not null").select(*keys, "size_bytes", F.monotonically_increasing_id().alias("row_")), keys, [F.col("size_bytes").asc(), F.col("row_").asc()])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys])
    middle = placed.select(*[F.col(k).alias(f"{k}_") for k in keys], "size_bytes", "position")
    at = F.col("position").isin(F.floor((F.col("sized_") + 1) / 2), F.ceil((F.col("sized_") + 1) / 2))
    medians = kinds.join(middle, same, "left").groupBy(*keys, "spread", "n").agg(F.avg(F.when(at, F.col("size_bytes"))).alias("median_bytes"))
    kinds = medians.select(*keys, "median_bytes", "spread", "n")
    default = files.groupBy("source_kind").agg(F.max("size_bytes").alias("largest")).where("source_kind = 'legacy'").select("largest")
    return kinds.join(roles, "file_role", "left_semi").join(F.broadcast(default))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    own = (exact_duplicates, identifier_matches, title_duplicates, review_states, metadata_conflicts, version_labels, asset_states, fixed_chunks, sentence_chunks, page_margins, page_blocks, block_order, inferred_metadata, year_votes, page_metadata, multi_articles, clean_titles, normalised_titles, bibtex_records, ris_records, markdown_tables, csv_rows, hash_embedding, size_medians)
    return {f.__name__: f for f in own}


ESC = "replace(replace(replace(replace(replace(coalesce({0}, ''), '\\', '\\textbackslash '), '{{', '\\{{'), '}}', '\\}}'), '&', '\\&'), '%', '\\%')"
AUTHORS = "list_filter(list_transform(regexp_split_to_array(coalesce(authors, ''), '[\\s\\x0b]*;[\\s\\x0b]*|[\\s\\x0b]+and[\\s\\x0b]+'), lambda x: regexp_replace(regexp_replace(x, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '')), lambda x: x <> '')"
LOW = "translate(lower({0}), '" + T.ACCENTED + "', '" + T.PLAIN + "')"


def _type_rule() -> str:
    both = "lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, '')))"
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({both}, '{w}')" for w in words) + f" THEN '{kind}'" for kind, words in M.SOURCE_RULES) + " ELSE 'journal_article' END"


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    slug = f"regexp_replace(regexp_replace({LOW.format("coalesce(title, '')")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    key = f"""CASE WHEN len(au) = 0 THEN 'anon' ELSE coalesce(nullif(regexp_replace({LOW.format("CASE WHEN contains(au[1], ',') THEN split_part(au[1], ',', 1) ELSE regexp_split_to_array(au[1], '[\\s\\x0b]+')[-1] END")}, '[^a-z0-9]', '', 'g'), ''), 'anon') END || coalesce(CAST(publication_year AS VARCHAR), 'nd') || regexp_extract({LOW.format("coalesce(title, '')")}, '[a-z0-9]+')"""
    flat = "regexp_replace(coalesce({0}, ''), '[\\r\\n]+', ' ', 'g')"
    cell = "replace(replace(regexp_replace(coalesce(CAST({0} AS VARCHAR), ''), '[\\r\\n]+', ' ', 'g'), '|', '\\|'), '_', ' ')"
    compact = "trim(regexp_replace(coalesce(title, ''), '[\\s\\p{Z}]+', ' ', 'g'))"
    return {
        "exact_duplicates": "SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "identifier_matches": """WITH k AS (SELECT doc_id, import_batch, CASE WHEN regexp_matches(lower(doi), '""" + DOI + """') THEN lower(doi) END AS doi, CASE WHEN regexp_matches(pmid, '""" + PMID + """') THEN pmid END AS pmid FROM documents),
  o AS (SELECT * FROM k WHERE import_batch = 0), w AS (SELECT * FROM k WHERE import_batch >= 1),
  h AS (SELECT w.doc_id, o.doc_id AS old_id FROM w JOIN o ON o.doi = w.doi UNION SELECT w.doc_id, o.doc_id FROM w JOIN o ON o.pmid = w.pmid),
  n AS (SELECT doc_id, count(*) AS n_matches, min(old_id) AS first_id FROM h GROUP BY 1)
SELECT w.doc_id, coalesce(n_matches, 0) AS n_matches, first_id, CASE WHEN n_matches = 1 THEN 'version' WHEN n_matches > 1 THEN 'conflict' ELSE 'new' END AS state FROM w LEFT JOIN n USING (doc_id)""",
        "title_duplicates": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY normalized_title) AS first_id FROM documents WHERE length(normalized_title) >= 24) WHERE first_id < doc_id",
        "review_states": """WITH f AS (SELECT normalized_title, min(doc_id) AS first_id FROM documents WHERE length(normalized_title) >= 24 GROUP BY 1),
  p AS (SELECT document_id AS doc_id, min(extraction_confidence) AS worst FROM document_pages GROUP BY 1)
SELECT CASE WHEN coalesce(text, '') = '' THEN 'needs_ocr' WHEN worst < 0.55 THEN 'partial_extraction' WHEN first_id < d.doc_id THEN 'possible_duplicate'
  WHEN regexp_matches(coalesce(title, ''), '(?i)\\b(?:part|teil) [0-9]') THEN 'multi_article' WHEN publication_year > 2030 THEN 'metadata_conflict' ELSE 'ready' END AS state, count(*) AS n
FROM documents d LEFT JOIN f ON f.normalized_title = d.normalized_title LEFT JOIN p ON p.doc_id = d.doc_id GROUP BY 1""",
        "metadata_conflicts": """WITH d AS (SELECT lower(doi) AS doi, doc_id, title, CAST(publication_year AS VARCHAR) AS publication_year, pmid FROM documents WHERE doi LIKE '10.%' AND doi NOT LIKE '10.0000%'),
  p AS (SELECT d.*, f.title AS t, f.publication_year AS y, f.pmid AS m FROM d JOIN d f ON f.doi = d.doi AND f.doc_id = (SELECT min(doc_id) FROM d x WHERE x.doi = d.doi) WHERE f.doc_id < d.doc_id),
  r AS (SELECT doc_id, 'title' AS field, trim(lower(t)) AS old, trim(lower(title)) AS new FROM p UNION ALL SELECT doc_id, 'publication_year', y, publication_year FROM p UNION ALL SELECT doc_id, 'pmid', trim(lower(m)), trim(lower(pmid)) FROM p)
SELECT * FROM r WHERE old <> '' AND new <> '' AND old <> new""",
        "version_labels": "SELECT file_id, 'v' || row_number() OVER (PARTITION BY document_id ORDER BY file_id) AS label FROM (SELECT DISTINCT document_id, file_id FROM document_files)",
        "asset_states": "SELECT CASE WHEN availability = 'missing' THEN 'missing' WHEN coalesce(sha256, '') = '' THEN 'undigested' WHEN availability = 'source_changed' THEN 'changed' ELSE 'migrated' END AS state, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM document_files GROUP BY 1",
        "fixed_chunks": "SELECT doc_id, CAST(k AS INT) AS chunk_no, CAST(length(substr(text, k * 520 + 1, 600)) AS INT) AS n_chars, md5(substr(text, k * 520 + 1, 600)) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(ceil((length(text) - 600) / 520.0), 0) AS BIGINT))) AS k FROM documents WHERE length(text) > 0)",
        "page_margins": """WITH e AS (SELECT document_id, page_number, unnest([string_split(text, chr(10))[1], string_split(text, chr(10))[-1]]) AS line FROM document_pages),
  s AS (SELECT DISTINCT document_id, page_number, substr(regexp_replace(trim(lower(line)), '[0-9]+', '#', 'g'), 1, 180) AS line FROM e),
  p AS (SELECT document_id, count(DISTINCT page_number) AS pages FROM e GROUP BY 1)
SELECT document_id, line, count(*) AS n_pages FROM s JOIN p USING (document_id) WHERE line <> '' GROUP BY document_id, line, pages HAVING pages >= 3 AND count(*) >= greatest(3, round_even(0.6 * pages, 0))""",
        "page_blocks": """WITH l AS (SELECT DISTINCT document_id, page_number, width, height, unnest(range(0, len(string_split(text, chr(10))))) AS at_, unnest(string_split(text, chr(10))) AS line FROM document_pages),
  b AS (SELECT *, least(greatest(36.0, 0), width) AS x0, least(length(line) * 8.0 + 36.0, width) AS x1, least(at_ * 28.0 + 36.0, height) AS y0, least(at_ * 28.0 + 62.0, height) AS y1 FROM l)
SELECT document_id, count(*) AS n_blocks, round(CAST(sum(CAST((x1 - x0) AS DOUBLE) * (y1 - y0)) AS DOUBLE), 2) AS area FROM b WHERE x1 > x0 AND y1 > y0 GROUP BY document_id""",
        "block_order": """WITH l AS (SELECT DISTINCT document_id, page_number, width, unnest(range(0, len(string_split(text, chr(10))))) AS at_, unnest(string_split(text, chr(10))) AS line FROM document_pages),
  g AS (SELECT *, length(line) > 70 AS long_, at_ % 2 = 1 AS odd_ FROM l),
  x AS (SELECT *, CASE WHEN odd_ AND NOT long_ THEN width * 0.52::DOUBLE ELSE width * 0.05::DOUBLE END AS x0, CASE WHEN long_ THEN at_ * 12.0::DOUBLE ELSE (at_ // 2) * 24.0::DOUBLE END AS y0 FROM g),
  b AS (SELECT *, CASE WHEN long_ THEN width * 0.95::DOUBLE ELSE x0 + width * 0.4::DOUBLE END AS x1, y0 + 10 AS y1 FROM x),
  k AS (SELECT *, x1 - x0 >= 0.66::DOUBLE * width AS wide, (x0 + x1) / 2 < width / 2 AS lft FROM b),
  m AS (SELECT *, sum(CAST(wide AS INT)) OVER (PARTITION BY document_id, page_number ORDER BY y0, x0, x1, y1) AS band FROM k),
  t AS (SELECT *, sum(CAST(NOT wide AND lft AS INT)) OVER w >= 2 AND sum(CAST(NOT wide AND NOT lft AS INT)) OVER w >= 2 AS two FROM m WINDOW w AS (PARTITION BY document_id, page_number, band))
SELECT document_id, page_number, CAST(at_ AS INT) AS "at", CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY band, CASE WHEN wide THEN -1 WHEN two AND NOT lft THEN 1 ELSE 0 END, y0, x0, x1, y1) AS INT) AS position FROM t""",
        "inferred_metadata": f"""SELECT doc_id, regexp_replace(regexp_extract(lower(substr(coalesce(text, ''), 1, 6000)), '(?:doi\\.org/|doi:?\\s*)(10\\.[0-9]{{4,9}}/\\S+)', 1), '[.,;)\\]}}]+$', '') AS doi_in_text,
  regexp_extract(substr(coalesce(text, ''), 1, 6000), '(?i)\\bPMID:?\\s*([0-9]{{5,9}})\\b', 1) AS pmid_in_text, CAST(regexp_extract_all(coalesce(text, ''), '\\b((?:19|20)[0-9]{{2}})\\b', 1)[1] AS INT) AS first_year, {_type_rule()} AS inferred_type,
  length(trim(coalesce(title, ''))) >= 8 AND length(regexp_replace(trim(coalesce(title, '')), '[^\\p{{L}}]', '', 'g')) >= 0.5 * length(trim(coalesce(title, '')))
    AND lower(trim(coalesce(title, ''))) NOT IN ('untitled', 'document', 'editorial', 'erratum', 'correction', 'reply', 'in this issue', 'book review', 'news and notes', 'letter to the editor') AS plausible_title FROM documents""",
        "year_votes": """WITH y AS (SELECT doc_id, unnest(l) AS year, unnest(range(0, len(l))) AS at_ FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\b((?:19|20)[0-9]{2})\\b', 1) AS l FROM documents)),
  v AS (SELECT doc_id, CAST(year AS INT) AS year, count(*) AS n, min(at_) AS first_at FROM y GROUP BY 1, 2)
SELECT doc_id, year, n AS n_votes FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) = 1""",
        "clean_titles": f"""SELECT doc_id, CAST(length(trim(regexp_replace(regexp_replace(replace(coalesce(title, ''), chr(173), ''), '[\\s\\p{{Z}}]+', ' ', 'g'), ' +([,.;:])', '\\1', 'g'))) AS INT) AS n_clean,
  CASE WHEN length({compact}) <= 40 THEN {compact} ELSE rtrim(substr({compact}, 1, 39)) || '…' END AS short_title, {slug} AS slug, trim(regexp_replace(regexp_replace({slug} || '.pdf', '(?i)\\.pdf$', ''), '[-_]+', ' ', 'g')) AS from_file FROM documents""",
        "normalised_titles": f"""WITH t AS (SELECT lang, normalized_title, trim(regexp_replace(regexp_replace({LOW.format("coalesce(title, '')")}, '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS n FROM documents)
SELECT lang, count(*) AS n, CAST(sum(CAST(t.n = coalesce(normalized_title, '') AS INT)) AS BIGINT) AS n_same, CAST(max(length(t.n)) AS INT) AS longest FROM t GROUP BY lang""",
        "bibtex_records": f"""WITH a AS (SELECT *, {AUTHORS} AS au FROM documents)
SELECT doc_id, '@article{{' || {key} || ',' || chr(10) || array_to_string(list_filter([CASE WHEN coalesce(title, '') <> '' THEN '  title = {{' || {ESC.format('title')} || '}}' END,
  CASE WHEN len(au) > 0 THEN '  author = {{' || {ESC.format("array_to_string(au, ' and ')")} || '}}' END, CASE WHEN coalesce(journal, '') <> '' THEN '  journal = {{' || {ESC.format('journal')} || '}}' END,
  CASE WHEN publication_year IS NOT NULL THEN '  year = {{' || publication_year || '}}' END, CASE WHEN coalesce(doi, '') <> '' THEN '  doi = {{' || {ESC.format('doi')} || '}}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS record FROM a""",
        "ris_records": f"""WITH a AS (SELECT *, {AUTHORS} AS au FROM documents)
SELECT doc_id, array_to_string(list_concat(['TY  - JOUR'], list_concat(list_transform(au, lambda x: 'AU  - ' || x), list_concat(list_filter([CASE WHEN coalesce(title, '') <> '' THEN 'TI  - ' || {flat.format('title')} END,
  CASE WHEN coalesce(journal, '') <> '' THEN 'JO  - ' || {flat.format('journal')} END, CASE WHEN publication_year IS NOT NULL THEN 'PY  - ' || publication_year END, CASE WHEN coalesce(doi, '') <> '' THEN 'DO  - ' || {flat.format('doi')} END], lambda x: x IS NOT NULL), ['ER  - ']))), chr(10)) AS record FROM a""",
        "markdown_tables": f"""WITH d AS (SELECT * FROM documents WHERE deleted_at IS NULL AND journal IS NOT NULL)
SELECT DISTINCT journal, CAST(1 AS BIGINT) AS line_no, '| year | title | type |' AS line FROM d UNION ALL SELECT DISTINCT journal, 2, '| --- | --- | --- |' FROM d UNION ALL
SELECT journal, 2 + row_number() OVER (PARTITION BY journal ORDER BY coalesce(publication_year, 0) DESC, doc_id), '| ' || {cell.format('publication_year')} || ' | ' || {cell.format('title')} || ' | ' || {cell.format('source_type')} || ' |' FROM d""",
        "hash_embedding": f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9][a-z0-9''\\-]{{1,}}'), lambda x: NOT list_contains({[*T.STOPWORDS]}, x)) AS w FROM documents),
  g AS (SELECT doc_id, unnest(w) AS gram FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM t),
  c AS (SELECT doc_id, CAST(('0x' || substr(md5(gram), 1, 4)) AS INT) % 512 AS place, count(*) AS n FROM g GROUP BY 1, 2)
SELECT doc_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""",
        "size_medians": "SELECT source_kind, file_role, median(size_bytes) AS median_bytes, round(stddev_samp(size_bytes), 3) AS spread, count(*) AS n, (SELECT max(size_bytes) FROM document_files WHERE source_kind = 'legacy') AS largest FROM document_files GROUP BY 1, 2",
        "csv_rows": "SELECT doc_id, " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ("source", "title", "authors", "journal", "publication_year", "doi", "pmid", "source_type", "reading_status", "importance")) + " FROM documents WHERE deleted_at IS NULL",
    }
