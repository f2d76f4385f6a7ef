"""Relational operators of a library: filters, paging, changes expressed as rewrites of whole tables.

A change never updates in place: each function takes frames and returns the new rows of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut


# A registrant below 1000 is a placeholder.
DOI = "^10[.]0*[1-9][0-9]{3,}[./]"


def contains_any(needle: str, *cols: str) -> Column:
    """Whether one of the columns holds the text, whatever its case."""
    hits = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(needle.lower()) for c in cols]
    return reduce(lambda a, b: a | b, hits)


def search_filter(df: DataFrame, year_min: int | None = None, year_max: int | None = None, source_type: str | None = None, reading_status: str | None = None, ids: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """Active rows that pass every given condition; ``ids`` keeps only listed rows, none if it is empty."""
    out = df.where("deleted_at is null")
    for condition, value in (("publication_year >= {}", year_min), ("publication_year <= {}", year_max)):
        if value is not None:
            out = out.where(condition.format(int(value)))
    if source_type:
        out = out.where(F.col("source_type") == source_type)
    if reading_status:
        out = out.where(F.col("reading_status") == reading_status)
    return out if ids is None else out.join(ids, id_col, "left_semi")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page of an order that must be total; limits are clamped to 1..most."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank_ = 1").drop("rank_")


def positions(df: DataFrame, groups: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's position within its group, from 1; the order must be total.

    Rows are range-partitioned by group and order and numbered inside (group, partition); the partitions' sizes
    are added up. So a group with a third of all rows spreads over as many partitions as it fills.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *[F.col(g) for g in groups], *order).withColumn("part_", F.spark_partition_id()))
    sizes = ranged.groupBy(*groups, "part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*groups).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(g).alias(f"{g}_") for g in groups], F.col("part_").alias("at_"), before.alias("before_"))
    here = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in groups], F.col("part_") == F.col("at_"))
    rank = F.row_number().over(Window.partitionBy(*groups, "part_").orderBy(*order))
    return ranged.withColumn("rank_", rank).join(sizes, here).withColumn(name, F.col("rank_") + F.col("before_")).select(*df.columns, name)


def merged(df: DataFrame, own: str, other: str, fields: list[str]) -> DataFrame:
    """``df`` with each field of struct ``own`` overridden by what ``other`` has, blanks aside, and ``revision``: 1, and
    one more if that changes anything."""
    given = {f: F.col(f"{other}.{f}").isNotNull() & (F.col(f"{other}.{f}").cast("string") != "") for f in fields}
    changed = reduce(lambda a, b: a | b, [given[f] & ~F.col(f"{other}.{f}").eqNullSafe(F.col(f"{own}.{f}")) for f in fields])
    return df.withColumns({f: F.when(given[f], F.col(f"{other}.{f}")).otherwise(F.col(f"{own}.{f}")) for f in fields} | {"revision": F.lit(1) + changed.cast("int")})


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace existing ones of the same key; an incoming key should occur once."""
    return incoming.select(existing.columns).unionByName(existing.join(incoming.select(*keys).distinct(), keys, "left_anti"))


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, and incoming ones whose key is not there yet; the smallest row of a repeated incoming key."""
    fresh = incoming.select(existing.columns).join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(first_of(fresh, keys, [F.col(c).asc_nulls_last() for c in existing.columns]).select(existing.columns))


def bulk_add(existing: DataFrame, wanted: DataFrame, known: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(requested, added, already_present, unknown): the outcome of adding rows, all or nothing."""
    asked = wanted.select(*keys).distinct()
    have = asked.join(existing.select(*keys).distinct().withColumn("there_", F.lit(1)), keys, "left").join(known.select(id_col).distinct().withColumn("known_", F.lit(1)), id_col, "left")
    count = have.agg(F.count("*").alias("requested"), F.count_if(F.col("there_").isNull()).alias("new"), F.count_if(F.col("there_").isNotNull()).alias("already_present"), F.count_if(F.col("known_").isNull()).alias("unknown"))
    return count.select("requested", F.when(F.col("unknown") > 0, F.lit(0).cast("long")).otherwise(F.col("new")).alias("added"), "already_present", "unknown")


def scoped(df: DataFrame, **owner: object) -> DataFrame:
    """Rows of one tenant only."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), owner.items(), df)
