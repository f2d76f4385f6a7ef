"""File sources and sinks: folder scans with resume, query sets, catalog bundles, snapshots with a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession, path: str, suffix: str = ".pdf", recursive: bool = True, after: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, name, modificationTime, length, sha256, magic_ok) of the files of a folder, whatever the suffix's case.

    ``after`` resumes behind the last path that was done; files over ``most_bytes`` are left out before their
    content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    found = files.where(F.lower("path").endswith(suffix.lower()))
    if after is not None:
        found = found.where(F.col("path") > after)
    if most_bytes is not None:
        found = found.where(F.col("length") <= most_bytes)
    magic = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime", "length", F.sha2("content", 256).alias("sha256"), magic.alias("magic_ok"))


def folder_stream(spark: SparkSession, path: str, suffix: str = ".pdf", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream of (path, modificationTime, length, sha256)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").endswith(suffix.lower())).select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected, tags) of a JSON-lines file; blank lines and lines that begin with # are left out,
    and so are lines without a query."""
    schema = "query string, expected struct<article_id: bigint, doi: string, pmid: string, title: string>, tags array<string>"
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", schema).alias("q")).select("q.*").where("query <> ''")


def bundle(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON catalog file read strictly: a record that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables below ``path`` with a manifest (table, n_rows, digest); the digest does not depend on row order."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        rows.append(_digest(spark.read.schema(df.schema).parquet(f"{path}/{name}"), name))
    manifest = rows[0]
    for r in rows[1:]:
        manifest = manifest.unionByName(r)
    manifest.coalesce(1).write.parquet(f"{path}/_manifest_table")
    return spark.read.parquet(f"{path}/_manifest_table")


def verify_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(table, ok): the tables of a snapshot counted and digested again."""
    kept = spark.read.parquet(f"{path}/_manifest_table")
    names = [r["table"] for r in kept.select("table").collect()]  # one row a table
    now = None
    for name in names:
        one = _digest(spark.read.parquet(f"{path}/{name}"), name)
        now = one if now is None else now.unionByName(one)
    again = now.select("table", F.col("n_rows").alias("n_now"), F.col("digest").alias("digest_now"))
    return kept.join(again, "table").select("table", ((F.col("n_rows") == F.col("n_now")) & F.col("digest").eqNullSafe(F.col("digest_now"))).alias("ok"))


def _digest(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))
