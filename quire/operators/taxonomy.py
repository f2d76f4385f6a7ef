"""Operators of the concept catalog: search, checks, installation, pack trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How deep each level of detail shows the tree.
DETAIL = {"broad": 2, "balanced": 4, "detailed": 8}


def display_id(pack: str, parent: str, node: str) -> Column:
    """A stable id of a node's place below a parent in a pack."""
    parts = F.concat_ws("|", F.col(pack), F.coalesce(F.col(parent), F.lit("")), F.col(node))
    return F.concat(F.lit("display."), F.substring(F.sha2(parts, 256), 1, 24))


def places(memberships: DataFrame) -> DataFrame:
    """Distinct places (pack_id, parent, node_id) with their smallest order; a blank parent is the top."""
    parent = F.nullif(F.col("display_parent_node_id"), F.lit(""))
    return memberships.where("pack_id <> '' and node_id <> ''").groupBy("pack_id", parent.alias("parent"), "node_id").agg(F.min("sort_order").alias("sort_order"), F.count("*").alias("n_rows"))


def install_plan(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action) for installing a catalog over another: insert, update, keep or retire."""
    a = old.select(F.col(key), F.struct(*fields).alias("was"))
    b = new.select(F.col(key), F.struct(*fields).alias("will"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("will").isNull(), "retire").when(F.col("was") == F.col("will"), "keep").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def first_pack(memberships: DataFrame, packs: DataFrame) -> DataFrame:
    """Memberships of several packs united: for each (node, parent, role) the first pack in order wins."""
    joined = memberships.join(packs.select("pack_id", "pack_order"), "pack_id")
    parent = F.coalesce(F.nullif(F.col("display_parent_node_id"), F.lit("")), F.lit(""))
    w = Window.partitionBy("node_id", "parent", "membership_role").orderBy("pack_order", "pack_id", "sort_order")
    return joined.withColumn("parent", parent).withColumn("k_", F.row_number().over(w)).where("k_ = 1").select("node_id", "parent", "membership_role", "pack_id")


def navigated(nodes: DataFrame, above: DataFrame, pins: DataFrame, gone: DataFrame) -> DataFrame:
    """(pack_id, node_id, pinned, hidden): ``nodes`` as navigation shows them; a node is hidden if it or one above it
    (``above``: pack_id, ancestor_node_id, node_id) is among those ``gone``, whatever its pins."""
    own = nodes.join(gone.select("node_id"), "node_id", "left_semi").select("pack_id", "node_id")
    below = above.join(gone.select(F.col("node_id").alias("ancestor_node_id")), "ancestor_node_id", "left_semi").select("pack_id", "node_id")
    hidden = own.unionByName(below).distinct().withColumn("hidden", F.lit(True))
    pinned = pins.select("pack_id", "node_id").distinct().withColumn("pinned", F.lit(True))
    no = F.lit(False)
    return nodes.join(pinned, ["pack_id", "node_id"], "left").join(hidden, ["pack_id", "node_id"], "left").select("pack_id", "node_id", F.coalesce("pinned", no).alias("pinned"), F.coalesce("hidden", no).alias("hidden"))


def revision(*cols: str) -> Column:
    """The first 24 digits of the SHA-256 of a row's canonical JSON: keys in order, no blanks, nulls kept."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256), 1, 24)


def protected_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], locked: str, value: str) -> DataFrame:
    """Incoming values over existing ones, but for rows that a person has locked; ``changed`` tells which."""
    both = existing.select(*keys, F.col(locked).alias("locked_"), F.col(value).alias("was_")).join(incoming.select(*keys, F.col(value).alias("will_")), keys, "full_outer")
    keep = F.coalesce("locked_", F.lit(False)) | F.col("will_").isNull()
    return both.select(*keys, F.when(keep, F.col("was_")).otherwise(F.col("will_")).alias(value), (~keep & ~F.col("will_").eqNullSafe(F.col("was_"))).alias("changed"))
