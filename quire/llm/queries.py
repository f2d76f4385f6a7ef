"""The queries of the operators of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chosenpath, confusables, history, mixing, names, packing, scans, tokens
from quire.session import cut, read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings in the author lists that mean the same person or body."""
    return names.name_pairs(read(spark, sf_dir, "documents"))


def p1_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person or body with its most used spelling, the number of spellings and of mentions."""
    who = names.people(read(spark, sf_dir, "documents"))
    best = F.max_by("spelling", F.struct("n", F.length("spelling"), "spelling")).alias("best_spelling")
    return who.groupBy("who").agg(best, F.count("*").alias("n_spellings"), F.sum("n").alias("n_mentions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged lines of the scanned pages: page matter, broken words, misread characters."""
    found = scans.defects(read(spark, sf_dir, "document_pages"), read(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("document_id"), F.col("page").alias("page_number"), F.col("line").alias("line_no"), "defect").distinct()


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's running paragraphs, repaired."""
    text = scans.paragraphs(read(spark, sf_dir, "document_pages"), read(spark, sf_dir, "documents"))
    return text.select(F.col("doc").alias("document_id"), F.col("page").alias("page_number"), "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each newcomer of a later batch whose work the library holds, with the first record of its work."""
    found = history.newcomers(read(spark, sf_dir, "documents"), read(spark, sf_dir, "document_files"))
    return found.select(F.col("first_id").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"))


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each later batch the number of its records, of known works among them, and of first records."""
    documents = read(spark, sf_dir, "documents")
    found = history.newcomers(documents, read(spark, sf_dir, "document_files")).groupBy("batch").agg(F.count("*").alias("n_known"))
    every = documents.where("import_batch >= 1").groupBy(F.col("import_batch").alias("batch")).agg(F.count("*").alias("n_records"))
    joined = every.join(found, "batch", "left").withColumn("n_known", F.coalesce("n_known", F.lit(0).cast("long")))
    return joined.select(F.col("batch").alias("import_batch"), "n_records", "n_known", (F.col("n_records") - F.col("n_known")).alias("n_new"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that share at least 60 % of their three-word sequences."""
    pairs = chosenpath.near_duplicate_pairs(read(spark, sf_dir, "documents"))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of links of every record, five words and 0.8."""
    groups = chosenpath.near_duplicate_groups(read(spark, sf_dir, "documents"), size=5, threshold=0.8)
    return groups.withColumnRenamed("id", "doc_id")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), keep=("source",))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(_sizes(spark, sf_dir).select("id", "n_tokens"), read(spark, sf_dir, "token_windows"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window, the container of every text or piece of a text."""
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window, how many containers there are and how much of them is unused."""
    return packing.unused_space(cut(_packed(spark, sf_dir)))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for each mix, with their repeats."""
    drawn = mixing.mixture(_sizes(spark, sf_dir), read(spark, sf_dir, "mix_targets"))
    return drawn.withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target and the actual share of each source in each mix."""
    targets = read(spark, sf_dir, "mix_targets")
    return mixing.mixture_report(mixing.mixture(_sizes(spark, sf_dir), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose texts look the same and are stored in different characters."""
    pairs = confusables.same_look_pairs(read(spark, sf_dir, "documents"))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of same-looking texts with the class of equally stored ones."""
    return confusables.same_look_groups(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def p8_consistent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one consistent form."""
    return read(spark, sf_dir, "documents").select("doc_id", confusables.consistent_text("text").alias("consistent_text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    return {
        "p1_found": p1_found,
        "p1_people": p1_people,
        "p2_found": p2_found,
        "p2_paragraphs": p2_paragraphs,
        "p3_found": p3_found,
        "p3_batches": p3_batches,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p6_containers": p6_containers,
        "p6_unused": p6_unused,
        "p7_mixture": p7_mixture,
        "p7_shares": p7_shares,
        "p8_found": p8_found,
        "p8_groups": p8_groups,
        "p8_consistent_text": p8_consistent_text,
    }


def oracle_sql() -> dict[str, str]:
    """Name -> SQL; the other operators are tested against brute force in tests/llm."""
    return {
        "p5_found": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || abstract), '[\\p{L}\\p{N}]+') AS l FROM documents WHERE trim(abstract) <> ''),
  s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(l) - 1, 1)), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a AS doc_id_a, b AS doc_id_b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.6 * (x.c + y.c - k)""",
    }
