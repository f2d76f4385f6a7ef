"""Queries over the library's relational side. A source stands for a project, its documents for the members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import library as L
from quire.session import read


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "document_files")


def filters_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active unread trials of some years that have a file."""
    ids = _files(spark, sf_dir).select(F.col("document_id").alias("doc_id")).distinct()
    return L.search_filter(_docs(spark, sf_dir), 1995, 2020, "randomized_trial", "unread", ids).select("doc_id", "title", "publication_year")


def library_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25 of a filtered list, newest year first, then title, then id."""
    found = _docs(spark, sf_dir).where("deleted_at is null").where(L.contains_any("study", "title", "authors", "journal", "abstract"))
    order = [F.col("publication_year").desc_nulls_last(), F.col("title").asc_nulls_first(), F.col("doc_id").asc()]
    return L.page(found, order, 25, 50).select("doc_id", "title", "publication_year", "reading_status")


def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 documents of a substring search over five columns with the number of all."""
    found = _docs(spark, sf_dir).where("deleted_at is null").where(L.contains_any("asthma", "title", "authors", "journal", "doi", "abstract")).select("doc_id", "title")
    total = found.agg(F.count("*").alias("total"))
    return L.page(found, [F.col("doc_id").asc()], 20).join(F.broadcast(total))


def review_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the front page: all, to review, in the bin, unread, important."""
    live = F.col("deleted_at").isNull()
    return _docs(spark, sf_dir).agg(
        F.count_if(live).alias("n_documents"),
        F.count_if(live & (F.coalesce("review_state", F.lit("")) != "ready")).alias("n_review"),
        F.count_if(~live).alias("n_deleted"),
        F.count_if(live & (F.col("reading_status") == "unread")).alias("n_unread"),
        F.count_if(live & (F.col("importance") >= 4)).alias("n_important"),
        F.coalesce(F.max("doc_id"), F.lit(0).cast("long")).alias("last_id"),
    )


def recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most recently changed documents."""
    live = _docs(spark, sf_dir).where("deleted_at is null").select("doc_id", "title", "updated_at")
    return L.page(live, [F.col("updated_at").desc_nulls_last(), F.col("doc_id").asc()], 6)


def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project with the number of its members, of active and of included ones (left joins)."""
    docs = _docs(spark, sf_dir)
    projects = docs.select("source").where("source is not null").distinct()
    members = docs.select("source", "doc_id", "deleted_at", "reading_status")
    return projects.join(members, "source", "left").groupBy("source").agg(F.count("doc_id").alias("n_members"), F.count_if(F.col("deleted_at").isNull()).alias("n_active"), F.sum(F.when(F.col("reading_status") == "reference", 1).otherwise(0)).alias("n_included"))


def project_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All projects and whether document 42 is attached: the predicate stands in the join."""
    docs = _docs(spark, sf_dir)
    projects = docs.select("source").where("source is not null").distinct()
    one = docs.where("doc_id = 42").select(F.col("source"), F.col("doc_id").alias("attached_id"))
    return projects.join(F.broadcast(one), "source", "left").select("source", F.col("attached_id").isNotNull().alias("attached"))


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by reading status and review state."""
    return _docs(spark, sf_dir).groupBy("reading_status", "review_state").agg(F.count("*").alias("n"), F.avg("importance").alias("mean_importance")).withColumn("mean_importance", F.round("mean_importance", 6))


def ranked_status_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of each project's documents: by status rank, then year, then title whatever its case."""
    rank = F.when(F.col("reading_status") == "reading", 0).when(F.col("reading_status") == "unread", 1).when(F.col("reading_status") == "read", 2).otherwise(3)
    rows = _docs(spark, sf_dir).where("deleted_at is null").select("source", "doc_id", rank.alias("rank"), "publication_year", F.lower(F.coalesce("title", F.lit(""))).alias("low"))
    placed = L.positions(rows, ["source"], [F.col("rank").asc(), F.col("publication_year").desc_nulls_last(), F.col("low").asc(), F.col("doc_id").asc()])
    return placed.select("source", "doc_id", F.col("position").cast("int").alias("position"))


def primary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first file: primary ones before others, then the smallest id."""
    files = _files(spark, sf_dir).groupBy("document_id").agg(F.min_by(F.struct("file_id", "file_name"), F.struct((~F.coalesce("is_primary", F.lit(False))).alias("later"), "file_id")).alias("f"), F.count("*").alias("n_files"))
    return _docs(spark, sf_dir).select("doc_id").join(files.withColumnRenamed("document_id", "doc_id"), "doc_id", "left").select("doc_id", F.col("f.file_id").alias("file_id"), F.col("f.file_name").alias("file_name"), F.coalesce("n_files", F.lit(0).cast("long")).alias("n_files"))


def file_names_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of each document's files, ordered and joined (group_concat)."""
    return _files(spark, sf_dir).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("file_name")), " | ").alias("file_names"))


def documents_without_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no file belongs to (anti join)."""
    return _docs(spark, sf_dir).select("doc_id", "title").join(_files(spark, sf_dir).select(F.col("document_id").alias("doc_id")), "doc_id", "left_anti")


def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents all of whose files are missing, with their number (semi and anti joins)."""
    files = _files(spark, sf_dir)
    there = files.where("availability = 'available'").select("document_id")
    gone = files.join(there, "document_id", "left_anti").groupBy("document_id").agg(F.count("*").alias("n_missing"))
    return gone.join(_docs(spark, sf_dir).where("deleted_at is null").select(F.col("doc_id").alias("document_id"), "title"), "document_id")


def article_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its files as one nested, ordered list, as JSON."""
    one = F.struct(F.col("file_id"), F.col("file_role"), F.col("availability"))
    files = _files(spark, sf_dir).groupBy(F.col("document_id").alias("doc_id")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("files"))
    return _docs(spark, sf_dir).select("doc_id", "title").join(files, "doc_id")


def purge_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When what is in the bin goes for good, and its files."""
    files = _files(spark, sf_dir).select(F.col("document_id").alias("doc_id"), "file_id")
    gone = _docs(spark, sf_dir).where("deleted_at is not null").select("doc_id", F.expr("deleted_at + interval 30 days").alias("purge_at"))
    return gone.join(files, "doc_id", "left").select("doc_id", "purge_at", "file_id").distinct()


def soft_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, files and pages left after purging what was deleted 30 days before the last change."""
    docs = _docs(spark, sf_dir)
    last = docs.agg(F.max("updated_at").alias("now"))
    doomed = docs.where("deleted_at is not null").join(F.broadcast(last)).where("deleted_at <= now - interval 30 days").select("doc_id")
    left = docs.select("doc_id").join(doomed, "doc_id", "left_anti")
    files = _files(spark, sf_dir).select(F.col("document_id").alias("doc_id"), "sha256").join(doomed, "doc_id", "left_anti")
    pages = read(spark, sf_dir, "document_pages").select(F.col("document_id").alias("doc_id")).join(doomed, "doc_id", "left_anti")
    kinds = [left.agg(F.lit("documents").alias("kind"), F.count("*").alias("n_left")), files.agg(F.lit("files").alias("kind"), F.count("*").alias("n_left")), pages.agg(F.lit("pages").alias("kind"), F.count("*").alias("n_left"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def metadata_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional overwrite: fields of records not yet reviewed are refreshed, others stay."""
    fresh = F.col("review_state") != "ready"
    return _docs(spark, sf_dir).select("doc_id", F.when(fresh, F.trim("journal")).otherwise(F.col("journal")).alias("journal"), F.when(fresh, F.lit("local")).otherwise(F.lit("user")).alias("metadata_status"))


def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of batches 1 to 6 written over those of batch 0 by (document, digest): rows by outcome."""
    files = _files(spark, sf_dir).where("sha256 <> ''").select("document_id", "sha256", "file_id", "import_batch")
    base = L.first_of(files.where("import_batch = 0"), ["document_id", "sha256"], [F.col("file_id").asc()])
    later = L.first_of(files.where("import_batch >= 1"), ["document_id", "sha256"], [F.col("file_id").desc()])
    return L.upsert(base, later, ["document_id", "sha256"]).groupBy("import_batch").agg(F.count("*").alias("n"), F.sum("file_id").alias("sum_file_id"))


def insert_ignore_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of later batches entered only where the normalised title is new."""
    docs = _docs(spark, sf_dir).where("normalized_title <> ''").select("normalized_title", "doc_id", "import_batch")
    base = L.first_of(docs.where("import_batch = 0"), ["normalized_title"], [F.col("doc_id").asc()])
    grown = L.insert_new(base, docs.where("import_batch >= 1"), ["normalized_title"])
    return grown.groupBy((F.col("import_batch") >= 1).alias("is_new")).agg(F.count("*").alias("n"))


def bulk_add_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adding all documents of the later batches to the project of one source: requested, added, present."""
    docs = _docs(spark, sf_dir)
    existing = docs.where("source = 'scan_room'").select("doc_id")
    wanted = docs.where("import_batch >= 1 or source = 'scan_room'").select("doc_id")
    return L.bulk_add(existing, wanted, docs.select("doc_id"), ["doc_id"], "doc_id")


def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of two candidate sets."""
    docs = _docs(spark, sf_dir)
    a = docs.where(L.contains_any("cohort", "title")).select("doc_id")
    b = read(spark, sf_dir, "document_pages").select(F.col("document_id").alias("doc_id")).distinct()
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))]
    rows = [df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.sum("doc_id").alias("sum_id")) for name, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, what one tenant (a batch) may see beside everything."""
    docs = _docs(spark, sf_dir)
    own = L.scoped(docs, import_batch=2).groupBy(F.col("lang").alias("own_lang")).agg(F.count("*").alias("n_own"))
    every = docs.groupBy("lang").agg(F.count("*").alias("n_all"))
    return every.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left").select("lang", "n_all", F.coalesce("n_own", F.lit(0).cast("long")).alias("n_own"))


def backup_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of active packs' kind that a policy would copy: equal keys, a residual condition, none queued twice."""
    files = _files(spark, sf_dir).select("file_id", "source_kind", "file_role", "size_bytes", "import_batch")
    policy = files.where("import_batch = 0").groupBy("source_kind", "file_role").agg(F.avg("size_bytes").alias("limit_bytes"))
    queued = files.where("import_batch = 1").select("file_id")
    return files.join(policy, ["source_kind", "file_role"]).where("size_bytes <= limit_bytes").join(queued, "file_id", "left_anti").groupBy("source_kind", "file_role").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def needle_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active documents that hold a word in one of six fields or on one of their pages."""
    pages = read(spark, sf_dir, "document_pages").where(L.contains_any("spirometry", "text")).select(F.col("document_id").alias("doc_id")).distinct().withColumn("on_page", F.lit(True))
    told = L.contains_any("spirometry", "title", "authors", "journal", "doi", "pmid", "abstract")
    found = _docs(spark, sf_dir).where("deleted_at is null").select("doc_id", told.alias("in_fields")).join(pages, "doc_id", "left").withColumn("on_page", F.coalesce("on_page", F.lit(False)))
    return found.where("in_fields or on_page")


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a DOI: the first one's fields, overridden by what the last one gives, with the revision that makes."""
    fields = ["title", "authors", "journal", "publication_year", "pmid", "source_type"]
    rows = _docs(spark, sf_dir).where(F.lower("doi").rlike(L.DOI)).select(F.trim(F.lower("doi")).alias("doi"), "doc_id", *fields)
    ends = rows.groupBy("doi").agg(F.min_by(F.struct("doc_id", *fields), "doc_id").alias("a"), F.max_by(F.struct(*fields), "doc_id").alias("b"), F.count("*").alias("n_records"))
    return L.merged(ends, "a", "b", fields).select("doi", F.col("a.doc_id").alias("doc_id"), "n_records", *fields, "revision")


def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two joins and a grouping over the star tables: lines and quantity per nation and year."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "year").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.countDistinct("o_custkey").alias("n_customers"))


def line_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sums and means of all lines by flag and status."""
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_shipdate").alias("first_ship"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    own = (needle_filter, metadata_merge, filters_conjunctive, library_page, page_with_total, review_needed, recent_documents, project_counts, project_attached, status_histogram, ranked_status_sort, primary_file, file_names_concat, documents_without_file, missing_sources, article_detail, purge_dates, soft_delete_cascade, metadata_refresh, upsert_files, insert_ignore_titles, bulk_add_members, id_sets, tenant_scope, backup_queue, orders_by_customer, line_status_summary)
    return {f.__name__: f for f in own}


def _like(needle: str, *cols: str) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({c}, '')), '{needle}')" for c in cols) + ")"


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    return {
        "filters_conjunctive": "SELECT doc_id, title, publication_year FROM documents WHERE deleted_at IS NULL AND publication_year BETWEEN 1995 AND 2020 AND source_type = 'randomized_trial' AND reading_status = 'unread' AND doc_id IN (SELECT document_id FROM document_files)",
        "library_page": f"SELECT doc_id, title, publication_year, reading_status FROM documents WHERE deleted_at IS NULL AND {_like('study', 'title', 'authors', 'journal', 'abstract')} ORDER BY publication_year DESC NULLS LAST, title NULLS FIRST, doc_id LIMIT 25 OFFSET 50",
        "page_with_total": f"SELECT doc_id, title, count(*) OVER () AS total FROM documents WHERE deleted_at IS NULL AND {_like('asthma', 'title', 'authors', 'journal', 'doi', 'abstract')} ORDER BY doc_id LIMIT 20",
        "review_needed": "SELECT count(*) FILTER (deleted_at IS NULL) AS n_documents, count(*) FILTER (deleted_at IS NULL AND coalesce(review_state, '') <> 'ready') AS n_review, count(*) FILTER (deleted_at IS NOT NULL) AS n_deleted, count(*) FILTER (deleted_at IS NULL AND reading_status = 'unread') AS n_unread, count(*) FILTER (deleted_at IS NULL AND importance >= 4) AS n_important, coalesce(max(doc_id), 0) AS last_id FROM documents",
        "recent_documents": "SELECT doc_id, title, updated_at FROM documents WHERE deleted_at IS NULL ORDER BY updated_at DESC NULLS LAST, doc_id LIMIT 6",
        "project_counts": "SELECT p.source, count(d.doc_id) AS n_members, count(*) FILTER (deleted_at IS NULL) AS n_active, CAST(sum(CASE WHEN reading_status = 'reference' THEN 1 ELSE 0 END) AS BIGINT) AS n_included FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) p LEFT JOIN documents d ON d.source = p.source GROUP BY p.source",
        "project_attached": "SELECT p.source, d.doc_id IS NOT NULL AS attached FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) p LEFT JOIN documents d ON d.source = p.source AND d.doc_id = 42",
        "status_histogram": "SELECT reading_status, review_state, count(*) AS n, round(avg(importance), 6) AS mean_importance FROM documents GROUP BY 1, 2",
        "needle_filter": f"""WITH p AS (SELECT DISTINCT document_id FROM document_pages WHERE {_like('spirometry', 'text')}),
  d AS (SELECT doc_id, {_like('spirometry', 'title', 'authors', 'journal', 'doi', 'pmid', 'abstract')} AS in_fields, doc_id IN (SELECT document_id FROM p) AS on_page FROM documents WHERE deleted_at IS NULL)
SELECT * FROM d WHERE in_fields OR on_page""",
        "metadata_merge": f"""WITH r AS (SELECT trim(lower(doi)) AS k, * FROM documents WHERE regexp_matches(lower(doi), '{L.DOI}')),
  e AS (SELECT k, min(doc_id) AS i, max(doc_id) AS j, count(*) AS n_records FROM r GROUP BY 1)
SELECT k AS doi, a.doc_id, n_records, {", ".join(f"coalesce(nullif(CAST(b.{c} AS VARCHAR), ''), CAST(a.{c} AS VARCHAR))" + (" :: INT" if c == "publication_year" else "") + f" AS {c}" for c in ("title", "authors", "journal", "publication_year", "pmid", "source_type"))},
  CAST(1 + CAST({" OR ".join(f"(coalesce(CAST(b.{c} AS VARCHAR), '') <> '' AND CAST(b.{c} AS VARCHAR) IS DISTINCT FROM CAST(a.{c} AS VARCHAR))" for c in ("title", "authors", "journal", "publication_year", "pmid", "source_type"))} AS INT) AS INT) AS revision
FROM e JOIN documents a ON a.doc_id = i JOIN documents b ON b.doc_id = j""",
        "ranked_status_sort": "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE reading_status WHEN 'reading' THEN 0 WHEN 'unread' THEN 1 WHEN 'read' THEN 2 ELSE 3 END, publication_year DESC NULLS LAST, lower(coalesce(title, '')), doc_id) AS INT) AS position FROM documents WHERE deleted_at IS NULL",
        "primary_file": "SELECT d.doc_id, f.file_id, f.file_name, coalesce(f.n_files, 0) AS n_files FROM documents d LEFT JOIN (SELECT document_id, file_id, file_name, count(*) OVER (PARTITION BY document_id) AS n_files, row_number() OVER (PARTITION BY document_id ORDER BY NOT coalesce(is_primary, false), file_id) AS k FROM document_files) f ON f.document_id = d.doc_id AND f.k = 1",
        "file_names_concat": "SELECT document_id, string_agg(file_name, ' | ' ORDER BY file_name) AS file_names FROM document_files GROUP BY document_id",
        "documents_without_file": "SELECT doc_id, title FROM documents WHERE doc_id NOT IN (SELECT document_id FROM document_files WHERE document_id IS NOT NULL)",
        "missing_sources": "SELECT f.document_id, count(*) AS n_missing, d.title FROM document_files f JOIN documents d ON d.doc_id = f.document_id AND d.deleted_at IS NULL WHERE f.document_id NOT IN (SELECT document_id FROM document_files WHERE availability = 'available') GROUP BY f.document_id, d.title",
        "article_detail": "SELECT doc_id, title, '[' || string_agg(j, ',' ORDER BY file_id, file_role, availability) || ']' AS files FROM (SELECT document_id, file_id, file_role, availability, '{' || array_to_string(list_filter(['\"file_id\":' || file_id, '\"file_role\":\"' || file_role || '\"', '\"availability\":\"' || availability || '\"'], lambda x: x IS NOT NULL), ',') || '}' AS j FROM document_files) f JOIN documents d ON d.doc_id = f.document_id GROUP BY doc_id, title",
        "purge_dates": "SELECT DISTINCT doc_id, deleted_at + INTERVAL 30 DAY AS purge_at, file_id FROM documents d LEFT JOIN document_files f ON f.document_id = d.doc_id WHERE deleted_at IS NOT NULL",
        "soft_delete_cascade": """WITH doomed AS (SELECT doc_id FROM documents WHERE deleted_at <= (SELECT max(updated_at) FROM documents) - INTERVAL 30 DAY)
SELECT 'documents' AS kind, count(*) AS n_left FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doomed)
UNION ALL SELECT 'files', count(*) FROM document_files WHERE document_id NOT IN (SELECT doc_id FROM doomed)
UNION ALL SELECT 'pages', count(*) FROM document_pages WHERE document_id NOT IN (SELECT doc_id FROM doomed)""",
        "metadata_refresh": "SELECT doc_id, CASE WHEN review_state <> 'ready' THEN trim(journal) ELSE journal END AS journal, CASE WHEN review_state <> 'ready' THEN 'local' ELSE 'user' END AS metadata_status FROM documents",
        "upsert_files": """WITH b AS (SELECT document_id, sha256, min(file_id) AS file_id FROM document_files WHERE sha256 <> '' AND import_batch = 0 GROUP BY 1, 2),
  l AS (SELECT document_id, sha256, max(file_id) AS file_id, arg_max(import_batch, file_id) AS import_batch FROM document_files WHERE sha256 <> '' AND import_batch >= 1 GROUP BY 1, 2)
SELECT import_batch, count(*) AS n, CAST(sum(file_id) AS BIGINT) AS sum_file_id FROM (SELECT file_id, import_batch FROM l UNION ALL SELECT file_id, 0 FROM b WHERE (document_id, sha256) NOT IN (SELECT (document_id, sha256) FROM l)) GROUP BY 1""",
        "insert_ignore_titles": """WITH b AS (SELECT DISTINCT normalized_title FROM documents WHERE normalized_title <> '' AND import_batch = 0),
  l AS (SELECT DISTINCT normalized_title FROM documents WHERE normalized_title <> '' AND import_batch >= 1 AND normalized_title NOT IN (SELECT normalized_title FROM b))
SELECT * FROM (SELECT false AS is_new, count(*) AS n FROM b UNION ALL SELECT true, count(*) FROM l) WHERE n > 0""",
        "bulk_add_members": "SELECT count(*) AS requested, count(*) FILTER (source IS DISTINCT FROM 'scan_room') AS added, count(*) FILTER (source = 'scan_room') AS already_present, CAST(0 AS BIGINT) AS unknown FROM documents WHERE import_batch >= 1 OR source = 'scan_room'",
        "id_sets": """WITH a AS (SELECT doc_id FROM documents WHERE contains(lower(coalesce(title, '')), 'cohort')), b AS (SELECT DISTINCT document_id AS doc_id FROM document_pages)
SELECT 'union' AS kind, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS sum_id FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*), CAST(sum(doc_id) AS BIGINT) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*), CAST(sum(doc_id) AS BIGINT) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
        "tenant_scope": "SELECT lang, count(*) AS n_all, count(*) FILTER (import_batch = 2) AS n_own FROM documents GROUP BY lang",
        "backup_queue": """WITH p AS (SELECT source_kind, file_role, avg(size_bytes) AS limit_bytes FROM document_files WHERE import_batch = 0 GROUP BY 1, 2)
SELECT source_kind, file_role, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM document_files f JOIN p USING (source_kind, file_role)
WHERE size_bytes <= limit_bytes AND file_id NOT IN (SELECT file_id FROM document_files WHERE import_batch = 1) GROUP BY 1, 2""",
        "orders_by_customer": "SELECT n_name, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity, count(DISTINCT o_custkey) AS n_customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
        "line_status_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1, 2",
    }
