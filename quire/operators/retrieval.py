"""Retrieval operators: BM25 without an index or over one, fusion of rankings, roll-up to documents.

A query's few terms are counted inside each passage, so a ranking is two scans without any shuffle of
text: one for the statistics (a single row), one for the scores; only the best rows leave a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import cut

K1, B = 1.2, 0.75


def _frequency(tokens: Column, term: str) -> Column:
    """Tokens equal to the term, or beginning with it if it has four or more characters."""
    test = (lambda x: x.startswith(term)) if len(term) >= 4 else (lambda x: x == term)
    return F.when(tokens.isNotNull(), F.size(F.filter(tokens, test)))


def bm25(passages: DataFrame, query: str, text_col: str, terms: list[str] | None = None) -> DataFrame:
    """``passages`` with ``score``, greater is better, for every passage that holds a term.

    Terms weigh ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; passages are of equal standing at equal score.
    """
    terms = T.terms_of(query) if terms is None else terms
    if not terms:
        return passages.withColumn("score", F.lit(0.0)).limit(0)
    # A passage that does not hold a term anywhere is counted by its length only and never cut into tokens.
    low = F.lower(T.text_of(text_col))
    holds = F.lit(False)
    for t in terms:
        holds = holds | low.contains(t)
    counts = [F.col(f"f{i}") for i in range(len(terms))]
    counted = passages.withColumn("size_", F.regexp_count(low, F.lit(T.TERM.replace("A-Z", "")))).withColumn("tokens_", F.when(holds, T.all_terms(text_col)))
    for i, t in enumerate(terms):
        counted = counted.withColumn(f"f{i}", F.coalesce(_frequency(F.col("tokens_"), t), F.lit(0)))
    stats = counted.agg(F.count("*").alias("total_"), F.avg("size_").alias("mean_"), *[F.sum((c > 0).cast("long")).alias(f"n{i}") for i, c in enumerate(counts)])
    found = counted.where(holds).drop("tokens_").join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        weight = F.greatest(F.ln((F.col("total_") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6))
        damped = F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * (1 - B + B * F.col("size_") / F.col("mean_")))
        score = score + weight * damped
    # Every weight is above 0, so the score tells whether a token matched.
    return found.withColumn("score", score).where("score > 0").drop("total_", "mean_", "size_", *[f"n{i}" for i in range(len(terms))], *[f"f{i}" for i in range(len(terms))])


def write_index(passages: DataFrame, ids: list[str], text_col: str, path: str) -> str:
    """An inverted index below ``path``: ``passages`` (row, ids, size), their number and mean size in ``sizes``, and
    ``postings`` (term, row, tf), sorted by term over all files, so a query's terms and prefixes reach only the
    parts that hold them. Repeated rows stay rows."""
    parts = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut_up = cut(passages.select(*ids, F.monotonically_increasing_id().alias("row"), T.all_terms(text_col).alias("tokens")))
    sized = cut_up.select("row", *ids, F.size("tokens").alias("size"))
    sized.write.parquet(f"{path}/passages")
    sized.agg(F.count("*").alias("total_"), F.avg("size").alias("mean_")).write.parquet(f"{path}/sizes")
    terms = cut_up.select(F.explode("tokens").alias("term"), "row").repartitionByRange(parts, "term", "row").groupBy("term", "row").agg(F.count("*").alias("tf"))
    terms.sortWithinPartitions("term", "row").write.parquet(f"{path}/postings")
    return path


def bm25_indexed(spark: SparkSession, path: str, query: str, terms: list[str] | None = None) -> DataFrame:
    """The passages of an index that hold a term of the query, with ``score`` as in :func:`bm25`."""
    terms = T.terms_of(query) if terms is None else terms
    passages = spark.read.parquet(f"{path}/passages")
    if not terms:
        return passages.drop("row", "size").withColumn("score", F.lit(0.0)).limit(0)
    tests = [F.col("term").startswith(t) if len(t) >= 4 else F.col("term") == t for t in terms]
    counts = [f"f{i}" for i in range(len(terms))]
    held = spark.read.parquet(f"{path}/postings").where(reduce(lambda a, b: a | b, tests))
    held = held.groupBy("row").agg(*[F.sum(F.when(test, F.col("tf")).otherwise(0)).alias(c) for test, c in zip(tests, counts, strict=True)])
    stats = spark.read.parquet(f"{path}/sizes").crossJoin(held.agg(*[F.sum((F.col(c) > 0).cast("long")).alias(f"n_{c}") for c in counts]))  # one row each
    found = passages.join(held, "row").join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for c in counts:
        weight = F.greatest(F.ln((F.col("total_") - F.col(f"n_{c}") + 0.5) / (F.col(f"n_{c}") + 0.5)), F.lit(1e-6))
        score = score + weight * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("size") / F.col("mean_")))
    return found.withColumn("score", score).drop("row", "size", "total_", "mean_", *counts, *[f"n_{c}" for c in counts])


def best(df: DataFrame, k: int, score: str, *ids: str) -> DataFrame:
    """The ``k`` best rows with their rank; ties by id."""
    top = df.orderBy(F.col(score).desc(), *[F.col(i).asc() for i in ids]).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), *[F.col(i).asc() for i in ids])))


def fuse(rankings: list[tuple[DataFrame, float]], ids: list[str], constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: sum of weight / (constant + rank) over (ids, rank) frames."""
    parts = [r.select(*ids, (F.lit(w) / (F.lit(constant) + F.col("rank"))).alias("gain")) for r, w in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*ids).agg(F.sum("gain").alias("fused"))


def roll_up(hits: DataFrame, doc: str, page: str, score: str = "score") -> DataFrame:
    """(doc, best page, score, n_hits): the best hit of each document, the first page at a tie."""
    return hits.groupBy(doc).agg(F.max_by(page, F.struct(score, -F.col(page))).alias(page), F.max(score).alias(score), F.count("*").alias("n_hits"))


def metadata_score(query: str) -> Column:
    """Weighted coverage of a document's bibliographic fields."""
    phrase = F.lower(T.text_of("title")).contains(query.lower())
    title = F.when(phrase, 1.0).otherwise(0.7 * T.coverage(query, "title"))
    return title + 0.35 * T.coverage(query, "authors") + 0.3 * T.coverage(query, "journal") + 0.45 * T.coverage(query, "abstract")


def fused_passages(lexical: DataFrame, query: str, text_col: str, ids: list[str], percentages: list[float] = (), numbers: list[float] = (), semantic: DataFrame | None = None, constant: int = 60) -> DataFrame:
    """(ids, text, score, reasons): passages by the fusion of four rankings.

    ``lexical`` (ids, text, score) has the best matches; references and passages without evidence go before the
    rank is counted. ``semantic`` (ids, text, rank) is optional. Coverage, at half weight, and nearness of numbers
    rank what the two have found, later ids first at a tie; 0 earns nothing.
    """
    order = lambda score: Window.orderBy(F.col(score).desc(), *[F.col(i).desc() for i in ids])
    gain = lambda rank, w=1.0: F.lit(w) / (F.lit(constant) + rank)
    kept = lexical.where(~T.is_reference_passage(text_col) & T.lexical_evidence(query, text_col, percentages, numbers))
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), *[F.col(i).asc() for i in ids]))
    hits = kept.select(*ids, text_col, gain(rank).alias("lex"), F.lit(0.0).alias("sem"))
    if semantic is not None:
        near = semantic.select(*ids, text_col, F.lit(0.0).alias("lex"), gain(F.col("rank")).alias("sem"))
        own = hits.select(*ids, F.lit(True).alias("met"))
        near = near.join(own, ids, "left").where(F.col("met") | ~T.is_reference_passage(text_col)).drop("met")
        hits = hits.unionByName(near).groupBy(*ids).agg(F.first(text_col).alias(text_col), F.sum("lex").alias("lex"), F.sum("sem").alias("sem"))
    hits = hits.withColumn("cov", T.coverage(query, text_col)).withColumn("num", T.numeric_bonus(list(percentages), list(numbers), text_col))
    for c, w in (("cov", 0.5), ("num", 1.0)):
        hits = hits.withColumn(f"{c}_gain", F.when(F.col(c) > 0, gain(F.row_number().over(order(c)), w)).otherwise(0.0))
    told = (("full-text term match", F.col("lex") > 0), ("local semantic similarity", F.col("sem") > 0), ("remembered details occur together", F.col("cov") >= 0.65), ("approximate numerical detail", F.col("num") >= 0.65))
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in told]))
    return hits.select(*ids, text_col, (F.col("lex") + F.col("sem") + F.col("cov_gain") + F.col("num_gain")).alias("score"), reasons.alias("reasons"))


def final_documents(passages: DataFrame, metadata: DataFrame, doc: str, page: str, k: int) -> DataFrame:
    """The ``k`` best of (doc, page, score, reasons): each document's best passage plus its fused metadata (doc, fused);
    a document may have either alone."""
    top = passages.groupBy(doc).agg(F.max_by(F.struct(page, "reasons"), F.struct("score", -F.col(page))).alias("hit"), F.max("score").alias("passage"))
    both = top.join(metadata.select(doc, "fused"), doc, "full_outer")
    reasons = F.coalesce(F.nullif(F.col("hit.reasons"), F.array().cast("array<string>")), F.array(F.lit("related library metadata")))
    scored = both.select(doc, F.col(f"hit.{page}").alias(page), F.round(F.coalesce("passage", F.lit(0.0)) + F.coalesce("fused", F.lit(0.0)), 9).alias("score"), reasons.alias("reasons"))
    return best(scored, k, "score", doc)
