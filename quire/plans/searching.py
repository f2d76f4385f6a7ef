"""Retrieval queries over the library's pages, documents and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import retrieval, vectors
from quire.session import read, scratch_dir, spread

QUESTION = "hospital readmission after cognitive behavioural therapy"
TOPIC = "intravenous iron epilepsy"
TWO_TERMS = "awake proning"
NUMBERS = "study with around 200 patients and five percent severe bleeding"
AUTHOR = "Robert"
OWNER = "trial_portal"
SUBJECT = "respiratory intensive care units"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "document_pages").select("document_id", "page_number", "text"))


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("deleted_at is null")


INDEXES: dict[tuple[str, str], str] = {}


def page_index(spark: SparkSession, sf_dir: str) -> str:
    """The full-text index of a directory's pages, built by the session's first query that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in INDEXES:
        INDEXES[key] = retrieval.write_index(_pages(spark, sf_dir), ["document_id", "page_number"], "text", scratch_dir(spark))
    return INDEXES[key]


def _page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = retrieval.bm25_indexed(spark, page_index(spark, sf_dir), QUESTION).select("document_id", "page_number", F.round("score", 6).alias("score"))
    return scored.distinct()


def bm25_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 best pages for a question."""
    return retrieval.best(_page_scores(spark, sf_dir), 200, "score", "document_id", "page_number")


def fts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by their best page, of those not deleted."""
    best = retrieval.roll_up(_page_scores(spark, sf_dir), "document_id", "page_number")
    kept = best.join(_active(spark, sf_dir).select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    return retrieval.best(kept, 10, "score", "document_id")


def bm25_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best pages of active documents with an available file, with title and year: the four-way join."""
    files = read(spark, sf_dir, "document_files").where("availability = 'available'").select("document_id").distinct()
    docs = _active(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "title", "publication_year")
    joined = _page_scores(spark, sf_dir).join(docs, "document_id").join(files, "document_id", "left_semi")
    return retrieval.best(joined, 50, "score", "document_id", "page_number")


def query_terms_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each abstract: how many distinct ones, how many with content, and the first."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.query_terms("abstract")).alias("n_terms"), F.size(T.content_terms("abstract")).alias("n_content"), F.coalesce(F.get(T.content_terms("abstract"), 0), F.lit("")).alias("first_term"))


def fts_query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title as a full-text query."""
    return read(spark, sf_dir, "documents").select("doc_id", T.fts_query("title").alias("fts_query"))


def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the question's terms in each title and abstract."""
    both = F.concat_ws(" ", T.text_of("title"), T.text_of("abstract"))
    return read(spark, sf_dir, "documents").select("doc_id", F.round(T.coverage(QUESTION, both), 6).alias("coverage")).where("coverage > 0")


def lexical_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose title and abstract hold both terms close together."""
    both = F.concat_ws(" ", T.text_of("title"), T.text_of("abstract"))
    rows = read(spark, sf_dir, "documents").select("doc_id", T.lexical_evidence(TWO_TERMS, both).alias("evident"), F.size(T.matched(T.terms_of(TWO_TERMS), T.query_terms(both))).alias("n_matched"))
    return rows.where("n_matched > 0")


def numeric_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near the numbers of each abstract come to those asked for."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.size(T.percentages("abstract")).alias("n_percentages"), F.size(T.plain_numbers("abstract")).alias("n_numbers"), F.round(T.numeric_bonus([5.0], [200.0], "abstract"), 6).alias("bonus"))
    return rows.where("n_percentages + n_numbers > 0")


def passage_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, back matter and incidental passages among the documents' texts."""
    return read(spark, sf_dir, "documents").select("doc_id", T.is_reference_passage("text").alias("is_reference"), T.is_back_matter("text").alias("is_back_matter"), T.is_incidental("text").alias("is_incidental"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each text around the question's first hit."""
    return spread(read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")).select("doc_id", T.snippet(QUESTION, "text").alias("snippet"))


def snippet_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, snippets and those that are not a part of its text."""
    rows = read(spark, sf_dir, "documents").where("text is not null").select("lang", "text", T.snippet(QUESTION, "text").alias("snippet"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_snippets"), F.sum((~F.col("text").contains(F.col("snippet"))).cast("long")).alias("n_failures"))


def title_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each title would ask for as a question: an author, a topic or something general."""
    title = T.compact("title")
    author = title.rlike(r"(?i)\b(?:written|authored)\s+by\s+.+$") | title.rlike(r"(?i)\b(?:paper|article|study|publication)\s+by\s+.+$") | title.rlike(r"(?i)\bauthor(?:ed)?\s*(?:is|:)?\s+.+$")
    topic = title.rlike(r"(?i)\b(?:paper|article|study|publication|review)\s+(?:about|on|regarding|concerning)\s+.+$")
    n = F.size(T.content_terms("title"))
    terse = n.between(2, 4) & (n == F.size(T.query_terms("title"))) & ~F.exists(T.content_terms("title"), lambda t: t.rlike("^[0-9]+$"))
    return read(spark, sf_dir, "documents").select("doc_id", F.when(author, "author").when(topic | terse, "topic").otherwise("general").alias("intent"))


def metadata_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the weighted coverage of their bibliographic fields."""
    scored = _active(spark, sf_dir).select("doc_id", F.round(retrieval.metadata_score(TOPIC), 6).alias("score")).where("score > 0")
    return retrieval.best(scored, 400, "score", "doc_id")


def rrf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by fusion of the full-text, coverage and metadata rankings."""
    both = F.concat_ws(" ", T.text_of("title"), T.text_of("abstract"))
    docs = _active(spark, sf_dir).withColumn("both", both)
    lexical = retrieval.bm25(docs.select("doc_id", "both"), TOPIC, "both").select("doc_id", F.round("score", 6).alias("score"))
    covered = docs.select("doc_id", F.round(T.coverage(TOPIC, "both"), 6).alias("score")).where("score > 0")
    named = docs.select("doc_id", F.round(retrieval.metadata_score(TOPIC), 6).alias("score")).where("score > 0")
    rankings = [(retrieval.best(x, 200, "score", "doc_id"), w) for x, w in ((lexical, 1.0), (covered, 0.5), (named, 1.0))]
    fused = retrieval.fuse(rankings, ["doc_id"]).withColumn("fused", F.round("fused", 9))
    return retrieval.best(fused, 20, "fused", "doc_id").join(docs.select("doc_id", "title"), "doc_id")


def _passages(spark: SparkSession, sf_dir: str, query: str, percentages: list[float] = (), numbers: list[float] = ()) -> DataFrame:
    """Fused passages of active documents with an available file; the tables have no vectors of pages."""
    files = read(spark, sf_dir, "document_files").where("availability = 'available'").select("document_id").distinct()
    active = _active(spark, sf_dir).select(F.col("doc_id").alias("document_id"))
    pages = retrieval.bm25(_pages(spark, sf_dir).distinct(), query, "text").withColumn("score", F.round("score", 6))
    allowed = pages.join(active, "document_id", "left_semi").join(files, "document_id", "left_semi")
    return retrieval.fused_passages(retrieval.best(allowed, 200, "score", "document_id", "page_number"), query, "text", ["document_id", "page_number"], percentages, numbers)


def _documents(spark: SparkSession, sf_dir: str, query: str, k: int) -> DataFrame:
    named = _active(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.round(retrieval.metadata_score(query), 6).alias("score")).where("score > 0")
    fused = retrieval.fuse([(retrieval.best(named, 200, "score", "document_id"), 1.0)], ["document_id"])
    return retrieval.final_documents(_passages(spark, sf_dir, query), fused, "document_id", "page_number", k)


def hybrid_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best passages for a question with numbers, by all rankings."""
    found = _passages(spark, sf_dir, NUMBERS, [5.0], [200.0]).withColumn("score", F.round("score", 9))
    return retrieval.best(found.drop("text"), 20, "score", "document_id", "page_number")


def hybrid_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for a question: best passage and metadata together."""
    return _documents(spark, sf_dir, QUESTION, 20)


def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents found by the title of the first one, itself left out."""
    first = _active(spark, sf_dir).where("title <> ''").orderBy("doc_id").select("doc_id", "title").first()
    if first is None:
        return _documents(spark, sf_dir, "", 5)
    found = _documents(spark, sf_dir, first["title"], 6).where(F.col("document_id") != first["doc_id"])
    return retrieval.best(found.drop("rank"), 5, "score", "document_id")


def author_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of an author: by the author list, and by the first page's zone of authors."""
    name = AUTHOR.lower()
    docs = _active(spark, sf_dir).select("doc_id", "title", "authors")
    listed = F.lower(T.text_of("authors")).contains(name)
    pages = _pages(spark, sf_dir).where("page_number = 1").select(F.col("document_id").alias("doc_id"), "text").join(docs.select("doc_id", "title"), "doc_id")
    first = pages.groupBy("doc_id").agg(F.max(F.lower(T.author_zone("text", "title")).contains(name).cast("int")).alias("on_page"))
    exact = F.exists(T.author_list("authors"), lambda a: F.lower(a) == name)
    scored = docs.join(first, "doc_id", "left").select("doc_id", "title", (3 * listed.cast("int") + 2 * F.coalesce("on_page", F.lit(0)) + 0.5 * exact.cast("int")).cast("double").alias("score"))
    return scored.where("score > 0")


def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document each record resolves to: by DOI, then PMID, then normalised title, the smallest id of each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lower("doi").alias("doi"), "pmid", "normalized_title")
    out = docs
    for key in ("doi", "pmid", "normalized_title"):
        first = docs.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.min("doc_id").alias(f"by_{key}"))
        out = out.join(first, key, "left")
    return out.select("doc_id", F.coalesce("by_doi", "by_pmid", "by_normalized_title", "doc_id").alias("resolved_id"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = read(spark, sf_dir, "embeddings")
    return vectors.neighbours(data, data.where("vec_id % 20 = 0"), 10)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth vector, among all."""
    return _neighbours(spark, sf_dir).select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity"), "rank")


def vector_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those, what is similar enough to count as evidence."""
    kept = vectors.qualified(_neighbours(spark, sf_dir), 0.3, 0.1)
    return kept.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


def _approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = read(spark, sf_dir, "embeddings")
    return vectors.approximate(data, data.where("vec_id % 20 = 0"), 10)


def vector_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth vector as the inverted file finds them."""
    return _approximate(spark, sf_dir).select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity"), "rank")


def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the inverted file finds of the exact nearest 1, 5 and 10."""
    return vectors.recall_at(_approximate(spark, sf_dir), _neighbours(spark, sf_dir), 1, 5, 10)


def tenant_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best pages within one owner's documents."""
    own = _active(spark, sf_dir).where(F.col("source") == OWNER).select(F.col("doc_id").alias("document_id"), "title")
    return retrieval.best(_page_scores(spark, sf_dir).join(own, "document_id"), 20, "score", "document_id", "page_number")


def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of neighbours with the query's own label, per label."""
    labels = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _neighbours(spark, sf_dir).join(labels.withColumnRenamed("vec_id", "id"), "id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return found.groupBy("own").agg(F.count("*").alias("n"), F.round(F.avg((F.col("own") == F.col("label")).cast("double")), 6).alias("same_share"))


def size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank median and 95th percentile of text length per source type, index rounded half to even."""
    docs = read(spark, sf_dir, "documents").where("n_chars is not null").select(F.coalesce("source_type", F.lit("")).alias("source_type"), "n_chars")
    # Lengths are counted first, so what a type sorts is its distinct lengths.
    counted = docs.groupBy("source_type", "n_chars").agg(F.count("*").alias("k"))
    w = Window.partitionBy("source_type")
    upto = counted.withColumn("upto", F.sum("k").over(w.orderBy("n_chars"))).withColumn("n", F.sum("k").over(w))
    pick = lambda q, name: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * q, 0), F.col("n_chars"))).alias(name)
    return upto.groupBy("source_type").agg(pick(0.5, "p50"), pick(0.95, "p95"), F.max("n").alias("n"))


def topic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are about a topic: by title, by title and abstract, or by their substantive pages."""
    docs = _active(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "title", "abstract")
    both = F.concat_ws(" ", T.text_of("title"), T.text_of("abstract"))
    told = T.topic_matches(SUBJECT, "title", 12) | (F.length(T.text_of("abstract")) > 0) & ~T.is_incidental("abstract") & T.topic_matches(SUBJECT, both, 28)
    pages = _pages(spark, sf_dir).where(T.topic_matches(SUBJECT, "text", 18) & ~T.is_incidental("text"))
    met = pages.groupBy("document_id").agg(F.count_distinct("page_number").alias("n_pages"), F.min("page_number").alias("first_page"))
    joined = docs.withColumn("told", told).join(met, "document_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0).cast("long")))
    deep = (F.col("n_pages") >= 2) | (F.coalesce(F.col("first_page") <= 2, F.lit(False)) & F.lit(len(T.terms_of(SUBJECT)) >= 2))
    return joined.where(F.col("told") | deep).select("document_id", "told", "n_pages")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    own = (bm25_passages, fts_documents, bm25_available, query_terms_stats, fts_query_strings, term_coverage, lexical_evidence, numeric_closeness, passage_kinds, snippets, snippet_provenance, title_intents, metadata_scores, rrf_documents, hybrid_passages, hybrid_documents, related_documents, author_search, topic_documents, document_lookup, vector_topk, vector_qualified, vector_ann, vector_recall, tenant_passages, nearest_label, size_percentiles)
    return {f.__name__: f for f in own}


def _terms(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), '[a-z0-9][a-z0-9''\\-]{{1,}}')"


def _distinct(expr: str) -> str:
    """Distinct terms in order of first occurrence."""
    return f"list_filter({_terms(expr)}, lambda x, i: list_position({_terms(expr)}, x) = i)"


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _content(expr: str) -> str:
    return f"list_filter({_distinct(expr)}, lambda x: NOT list_contains({STOP}, x))"


def _strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _coverage(query: str, expr: str) -> str:
    terms = T.terms_of(query)
    hits = " + ".join(f"CAST(list_has_any({_terms(expr)}, {_strings(T.forms(t))}) AS INT)" for t in terms)
    return f"(({hits}) / {float(len(terms))})"


def _bm25(query: str, source: str, ids: str, text: str) -> str:
    """CTEs ending in ``scored`` (ids, score)."""
    terms = T.terms_of(query)
    f = ", ".join(f"len(list_filter(tok, lambda x: {'starts_with(x, ' + chr(39) + t + chr(39) + ')' if len(t) >= 4 else 'x = ' + chr(39) + t + chr(39)})) AS f{i}" for i, t in enumerate(terms))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((total - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * (f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean)))" for i in range(len(terms)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""t AS (SELECT {ids}, {_terms(text)} AS tok FROM {source}),
  c AS (SELECT {ids}, len(tok) AS size, {f} FROM t),
  s AS (SELECT count(*) AS total, avg(size) AS mean, {n} FROM c),
  scored AS (SELECT {ids}, round(CAST({score} AS DOUBLE), 6) AS score FROM c, s WHERE {some})"""


PAGE_SCORES = _bm25(QUESTION, "document_pages", "document_id, page_number", "text") + ", p AS (SELECT DISTINCT document_id, page_number, score FROM scored)"
FLAT = "regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')"
TITLE = "trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))"


def _metadata(query: str) -> str:
    return (
        f"(CASE WHEN contains(lower(coalesce(title, '')), '{query.lower()}') THEN 1.0::DOUBLE ELSE 0.7::DOUBLE * {_coverage(query, 'title')} END"
        f" + 0.35::DOUBLE * {_coverage(query, 'authors')} + 0.3::DOUBLE * {_coverage(query, 'journal')} + 0.45::DOUBLE * {_coverage(query, 'abstract')})"
    )


def _span(terms: list[str], tokens: str) -> str:
    """The smallest distance between tokens of all those terms that occur; one token of each."""
    names = [f"p{i}" for i in range(len(terms))]
    inner = f"greatest({', '.join(names)}) - least({', '.join(names)})"
    for name, term in reversed(list(zip(names, terms, strict=True))):
        places = f"list_filter(range(1, len({tokens}) + 1), lambda i: list_contains({_strings(T.forms(term))}, {tokens}[i]))"
        inner = f"list_min(list_transform(CASE WHEN len({places}) = 0 THEN [NULL] ELSE {places} END, lambda {name}: {inner}))"
    return inner


def _topic(query: str, tokens: str, window: int) -> str:
    terms = T.terms_of(query)
    n = " + ".join(f"CAST(list_has_any({tokens}, {_strings(T.forms(t))}) AS INT)" for t in terms)
    return f"(({n}) >= {T.topic_terms(len(terms))} AND {_span(terms, tokens)} <= {window})"


def _incidental(col: str) -> str:
    low, flat = f"lower(coalesce({col}, ''))", f"regexp_replace(lower(coalesce({col}, '')), '\\s+', ' ', 'g')"
    reference = f"""regexp_matches(substr({low}, 1, 1800), '(?:^|\\n)\\s*(?:references|bibliography|literature cited)\\s*(?:\\n|$)')
    OR (len(regexp_extract_all({flat}, '\\b(?:19|20)\\d{{2}}\\b')) >= 3 AND (len(regexp_extract_all({low}, '(?:^|\\n)\\s*(?:\\[\\d+\\]|\\d{{1,3}}\\.)\\s*')) >= 2
      OR len(regexp_extract_all({flat}, '\\b\\d{{4}}\\s*;\\s*\\d{{1,4}}(?:\\s*\\(\\s*\\d+\\s*\\))?\\s*:\\s*\\d+')) >= 2
      OR (len(regexp_extract_all({flat}, '\\bet\\s+al\\b')) >= 2 AND len(regexp_extract_all({flat}, '\\b(?:chest|thorax|respir(?:ation|atory)|bronchol|eur respir j|am j respir|j thorac|lung)\\b')) >= 2)))"""
    return f"({reference} OR {' OR '.join(f'contains({flat}, {chr(39)}{m}{chr(39)})' for m in T.BACK_MATTER + T.VOLUME_MARKERS)})"


def _numbers(query_percentages: list[float], query_numbers: list[float]) -> str:
    """CTEs ending in ``found`` (doc_id, ps, ns, bonus). Each run of figures and points gets a mark before it, which does for the look-behind."""
    text = "lower(coalesce(abstract, ''))"
    for word, n in T.NUMBER_WORDS.items():
        text = f"regexp_replace({text}, '\\b{word}\\s+(percent\\b)', '{n} \\1', 'g')"
    percent, number = "\\x01(\\d+(?:\\.\\d+)?)\\s*(?:%|percent\\b)", "\\x01(\\d+(?:\\.\\d+)?)(?:[^\\d.]|$)"
    close = [f"coalesce(list_max(list_transform({ls}, lambda c: CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE exp(-0.9::DOUBLE * abs(ln(c / {v}::DOUBLE))) END)), 0)" for ls, vs in (("ps", query_percentages), ("ns", query_numbers)) for v in vs]
    return f"""m AS (SELECT doc_id, regexp_replace({text}, '([0-9.]+)', chr(1) || '\\1', 'g') AS t FROM documents),
  l AS (SELECT doc_id, list_transform(regexp_extract_all(t, '{percent}', 1), lambda x: CAST(x AS DOUBLE)) AS ps,
    list_filter(list_transform(regexp_extract_all(regexp_replace(t, '{percent}', ' ', 'g'), '{number}', 1), lambda x: CAST(x AS DOUBLE)), lambda x: NOT (x BETWEEN 1900 AND 2100 AND x = floor(x))) AS ns FROM m),
  found AS (SELECT *, ({' + '.join(close)}) / {len(close)} AS bonus FROM l)"""


def _snippet() -> str:
    places = ", ".join(f"nullif(instr(lower(b), '{t}'), 0)" for t in T.terms_of(QUESTION))
    return f"""WITH b AS (SELECT doc_id, lang, text, regexp_replace(regexp_replace(text, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '') AS b FROM documents WHERE text IS NOT NULL),
  h AS (SELECT *, greatest(coalesce(least({places}), 1) - 1 - 120, 0) AS start FROM b),
  k AS (SELECT *, CASE WHEN start > 0 THEN instr(substr(b, start + 1), ' ') ELSE 0 END AS skip FROM h),
  z AS (SELECT doc_id, lang, text, CASE WHEN length(b) <= 480 THEN b ELSE regexp_replace(regexp_replace(substr(b, start + skip + 1, 480), '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '') END AS snippet FROM k)
"""


VECTORS = """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
  m AS (SELECT q.vec_id AS query_id, d.vec_id, d.label, q.label AS own, list_dot_product(q.e, d.e) AS similarity FROM u q, u d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM m)
"""


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    both = "concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))"
    return {
        "bm25_passages": f"WITH {PAGE_SCORES} SELECT document_id, page_number, score, row_number() OVER (ORDER BY score DESC, document_id, page_number) AS rank FROM p ORDER BY rank LIMIT 200",
        "fts_documents": f"""WITH {PAGE_SCORES}, b AS (SELECT document_id, min(page_number) FILTER (score = top) AS page_number, max(score) AS score, count(*) AS n_hits
  FROM (SELECT *, max(score) OVER (PARTITION BY document_id) AS top FROM p) GROUP BY document_id)
SELECT document_id, page_number, score, n_hits, row_number() OVER (ORDER BY score DESC, document_id) AS rank FROM b
WHERE document_id IN (SELECT doc_id FROM documents WHERE deleted_at IS NULL) ORDER BY rank LIMIT 10""",
        "bm25_available": f"""WITH {PAGE_SCORES} SELECT p.document_id, page_number, score, title, publication_year, row_number() OVER (ORDER BY score DESC, p.document_id, page_number) AS rank
FROM p JOIN documents d ON d.doc_id = p.document_id AND d.deleted_at IS NULL WHERE p.document_id IN (SELECT document_id FROM document_files WHERE availability = 'available') ORDER BY rank LIMIT 50""",
        "query_terms_stats": f"SELECT doc_id, CAST(len({_distinct('abstract')}) AS INT) AS n_terms, CAST(len({_content('abstract')}) AS INT) AS n_content, coalesce({_content('abstract')}[1], '') AS first_term FROM documents",
        "fts_query_strings": f"""SELECT doc_id, CASE WHEN len({_terms('title')}) = 0 THEN '""' ELSE array_to_string(list_transform({_distinct('title')}[1:24], lambda x: '"' || x || '"' || CASE WHEN length(x) >= 4 THEN '*' ELSE '' END), ' OR ') END AS fts_query FROM documents""",
        "term_coverage": f"SELECT doc_id, coverage FROM (SELECT doc_id, round({_coverage(QUESTION, both)}, 6) AS coverage FROM documents) WHERE coverage > 0",
        "numeric_closeness": f"WITH {_numbers([5.0], [200.0])} SELECT doc_id, CAST(len(ps) AS INT) AS n_percentages, CAST(len(ns) AS INT) AS n_numbers, round(bonus, 6) AS bonus FROM found WHERE len(ps) + len(ns) > 0",
        "lexical_evidence": f"""WITH t AS (SELECT doc_id, {_distinct(both)} AS tok FROM documents), m AS (SELECT *, {" + ".join(f"CAST(list_has_any(tok, {_strings(T.forms(t))}) AS INT)" for t in T.terms_of(TWO_TERMS))} AS n FROM t)
SELECT doc_id, n = 2 AND {_span(T.terms_of(TWO_TERMS), 'tok')} <= 12 AS evident, CAST(n AS INT) AS n_matched FROM m WHERE n > 0""",
        "topic_documents": f"""WITH d AS (SELECT doc_id AS document_id, abstract, {_distinct('title')} AS a, {_distinct(both)} AS b FROM documents WHERE deleted_at IS NULL),
  q AS (SELECT document_id, page_number, text, {_distinct('text')} AS tok FROM document_pages WHERE {" OR ".join(f"contains(lower(text), '{t[:-1]}')" for t in T.terms_of(SUBJECT))}),
  p AS (SELECT document_id, count(DISTINCT page_number) AS n_pages, min(page_number) AS first_page FROM q WHERE {_topic(SUBJECT, 'tok', 18)} AND NOT {_incidental('text')} GROUP BY 1),
  j AS (SELECT d.document_id, coalesce({_topic(SUBJECT, 'a', 12)} OR (coalesce(abstract, '') <> '' AND NOT {_incidental('abstract')} AND {_topic(SUBJECT, 'b', 28)}), false) AS told, coalesce(n_pages, 0) AS n_pages, first_page FROM d LEFT JOIN p USING (document_id))
SELECT document_id, told, n_pages FROM j WHERE told OR n_pages >= 2 OR coalesce(first_page <= 2, false)""",
        "passage_kinds": f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS l, {FLAT} AS f FROM documents),
  y AS (SELECT *, regexp_matches(substr(l, 1, 1800), '(?:^|\\n)\\s*(?:references|bibliography|literature cited)\\s*(?:\\n|$)')
    OR (len(regexp_extract_all(f, '\\b(?:19|20)\\d{{2}}\\b')) >= 3 AND (len(regexp_extract_all(l, '(?:^|\\n)\\s*(?:\\[\\d+\\]|\\d{{1,3}}\\.)\\s*')) >= 2
      OR len(regexp_extract_all(f, '\\b\\d{{4}}\\s*;\\s*\\d{{1,4}}(?:\\s*\\(\\s*\\d+\\s*\\))?\\s*:\\s*\\d+')) >= 2
      OR (len(regexp_extract_all(f, '\\bet\\s+al\\b')) >= 2 AND len(regexp_extract_all(f, '\\b(?:chest|thorax|respir(?:ation|atory)|bronchol|eur respir j|am j respir|j thorac|lung)\\b')) >= 2))) AS r FROM x)
SELECT doc_id, r AS is_reference, ({' OR '.join(f"contains(f, '{m}')" for m in T.BACK_MATTER)}) AS is_back_matter,
  (r OR {' OR '.join(f"contains(f, '{m}')" for m in T.BACK_MATTER + T.VOLUME_MARKERS)}) AS is_incidental FROM y""",
        "snippets": _snippet() + "SELECT doc_id, snippet FROM z",
        "snippet_provenance": _snippet() + "SELECT lang, count(*) AS n_snippets, CAST(sum(CAST(NOT contains(text, snippet) AS INT)) AS BIGINT) AS n_failures FROM z GROUP BY lang",
        "title_intents": f"""SELECT doc_id, CASE
  WHEN regexp_matches({TITLE}, '(?i)\\b(?:written|authored)\\s+by\\s+.+$') OR regexp_matches({TITLE}, '(?i)\\b(?:paper|article|study|publication)\\s+by\\s+.+$') OR regexp_matches({TITLE}, '(?i)\\bauthor(?:ed)?\\s*(?:is|:)?\\s+.+$') THEN 'author'
  WHEN regexp_matches({TITLE}, '(?i)\\b(?:paper|article|study|publication|review)\\s+(?:about|on|regarding|concerning)\\s+.+$') THEN 'topic'
  WHEN len({_content('title')}) BETWEEN 2 AND 4 AND len({_content('title')}) = len({_distinct('title')}) AND len(list_filter({_content('title')}, lambda x: regexp_full_match(x, '[0-9]+'))) = 0 THEN 'topic'
  ELSE 'general' END AS intent FROM documents""",
        "metadata_scores": f"WITH m AS (SELECT doc_id, round({_metadata(TOPIC)}, 6) AS score FROM documents WHERE deleted_at IS NULL) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM m WHERE score > 0 ORDER BY rank LIMIT 400",
        "rrf_documents": f"""WITH {_bm25(TOPIC, f"(SELECT doc_id, {both} AS body FROM documents WHERE deleted_at IS NULL)", "doc_id", "body")},
  a AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS gain FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 200),
  cv AS (SELECT doc_id, round({_coverage(TOPIC, both)}, 6) AS score FROM documents WHERE deleted_at IS NULL),
  b AS (SELECT doc_id, 0.5::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS gain FROM cv WHERE score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 200),
  mt AS (SELECT doc_id, round({_metadata(TOPIC)}, 6) AS score FROM documents WHERE deleted_at IS NULL),
  e AS (SELECT doc_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS gain FROM mt WHERE score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 200),
  g AS (SELECT doc_id, round(sum(gain), 9) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY doc_id),
  h AS (SELECT *, row_number() OVER (ORDER BY fused DESC, doc_id) AS rank FROM g)
SELECT h.doc_id, fused, rank, title FROM h JOIN documents USING (doc_id) WHERE rank <= 20""",
        "author_search": f"""WITH z AS (SELECT document_id AS doc_id, coalesce(p.text, '') AS t, coalesce(title, '') AS h, instr(lower(coalesce(p.text, '')), lower(coalesce(title, ''))) AS at_ FROM document_pages p JOIN documents ON doc_id = document_id WHERE page_number = 1 AND deleted_at IS NULL),
  y AS (SELECT doc_id, regexp_split_to_array(CASE WHEN h <> '' AND at_ > 0 THEN substr(t, 1, at_ - 1) || ' ' || substr(t, at_ + length(h)) ELSE t END, '{T.SECTION}')[1] AS zone FROM z),
  f AS (SELECT doc_id, max(CAST(contains(lower(zone), '{AUTHOR.lower()}') AS INT)) AS on_page FROM y GROUP BY 1),
  s AS (SELECT d.doc_id, title, CAST(3 * CAST(contains(lower(coalesce(authors, '')), '{AUTHOR.lower()}') AS INT) + 2 * coalesce(on_page, 0)
    + 0.5 * CAST(len(list_filter(regexp_split_to_array(coalesce(authors, ''), '\\s*;\\s*|\\s+and\\s+'), lambda x: lower(trim(x)) = '{AUTHOR.lower()}')) > 0 AS INT) AS DOUBLE) AS score
    FROM documents d LEFT JOIN f USING (doc_id) WHERE deleted_at IS NULL)
SELECT doc_id, title, score FROM s WHERE score > 0""",
        "document_lookup": """WITH a AS (SELECT lower(doi) AS k, min(doc_id) AS m FROM documents WHERE coalesce(doi, '') <> '' GROUP BY 1),
  b AS (SELECT pmid AS k, min(doc_id) AS m FROM documents WHERE coalesce(pmid, '') <> '' GROUP BY 1),
  c AS (SELECT normalized_title AS k, min(doc_id) AS m FROM documents WHERE coalesce(normalized_title, '') <> '' GROUP BY 1)
SELECT doc_id, coalesce(a.m, b.m, c.m, doc_id) AS resolved_id FROM documents d LEFT JOIN a ON a.k = lower(d.doi) LEFT JOIN b ON b.k = d.pmid LEFT JOIN c ON c.k = d.normalized_title""",
        "vector_topk": VECTORS + "SELECT query_id, vec_id, round(similarity, 5) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10",
        "vector_qualified": VECTORS + ", t AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS top FROM r WHERE rank <= 10) SELECT query_id, vec_id, round(similarity, 5) AS similarity FROM t WHERE top >= 0.3 AND similarity >= greatest(0.3, top - 0.1)",
        "tenant_passages": f"""WITH {PAGE_SCORES} SELECT p.document_id, page_number, score, title, row_number() OVER (ORDER BY score DESC, p.document_id, page_number) AS rank
FROM p JOIN documents d ON d.doc_id = p.document_id AND d.deleted_at IS NULL AND d.source = '{OWNER}' ORDER BY rank LIMIT 20""",
        "nearest_label": VECTORS + "SELECT own, count(*) AS n, round(avg(CAST(own = label AS DOUBLE)), 6) AS same_share FROM r WHERE rank <= 10 GROUP BY own",
        "size_percentiles": """WITH r AS (SELECT coalesce(source_type, '') AS source_type, n_chars, row_number() OVER w - 1 AS at_, count(*) OVER (PARTITION BY coalesce(source_type, '')) - 1 AS last_
    FROM documents WHERE n_chars IS NOT NULL WINDOW w AS (PARTITION BY coalesce(source_type, '') ORDER BY n_chars))
SELECT source_type, max(n_chars) FILTER (at_ = round_even(last_ * 0.5, 0)) AS p50, max(n_chars) FILTER (at_ = round_even(last_ * 0.95, 0)) AS p95, count(*) AS n FROM r GROUP BY source_type""",
    }
