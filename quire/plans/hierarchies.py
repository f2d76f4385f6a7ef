"""Problem 4 over the tables of the library: packs, their members and the nodes above them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import hierarchy
from quire.session import cut, read


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = read(spark, sf_dir, "specialty_packs").select(F.col("pack_id").alias("tree"), F.col("selection_node_id").alias("node"))
    return hierarchy.links(read(spark, sf_dir, "memberships"), "pack_id", "node_id", "display_parent_node_id", roots)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "memberships").select(F.col("pack_id").alias("tree"), F.col("node_id").alias("node"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_id, ancestor_node_id, node_id): every node with every node above it in its pack."""
    above = hierarchy.ancestors(_links(spark, sf_dir))
    return above.select(F.col("tree").alias("pack_id"), F.col("ancestor").alias("ancestor_node_id"), F.col("node").alias("node_id"))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth and root of every node along its first parent, and whether a loop keeps it from a root."""
    found = hierarchy.paths(cut(_links(spark, sf_dir)), _nodes(spark, sf_dir))
    return found.select(F.col("tree").alias("pack_id"), F.col("node").alias("node_id"), F.array_join("path", " > ").alias("path"), "depth", F.col("root").alias("root_node_id"), "looped")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every node of a pack the number of nodes below and above it, and whether it lies on a loop."""
    above = cut(hierarchy.ancestors(_links(spark, sf_dir)))
    roots = read(spark, sf_dir, "specialty_packs").select(F.col("pack_id").alias("tree"), F.col("selection_node_id").alias("node"))
    nodes = _nodes(spark, sf_dir).unionByName(roots).where("tree <> '' and node <> ''").distinct()
    below = above.groupBy("tree", F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"), F.max((F.col("ancestor") == F.col("node")).cast("int")).alias("on_loop"))
    over = above.groupBy("tree", "node").agg(F.count("*").alias("n_ancestors"))
    joined = nodes.join(below, ["tree", "node"], "left").join(over, ["tree", "node"], "left")
    zero = F.lit(0).cast("long")
    return joined.select(F.col("tree").alias("pack_id"), F.col("node").alias("node_id"), F.coalesce("n_descendants", zero).alias("n_descendants"), F.coalesce("n_ancestors", zero).alias("n_ancestors"), (F.coalesce("on_loop", F.lit(0)) == 1).alias("on_loop"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    return {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants}


CLOSURE = """
WITH RECURSIVE n AS (
  SELECT DISTINCT pack_id, node_id FROM memberships WHERE pack_id <> '' AND node_id <> ''
), known AS (
  SELECT pack_id, node_id FROM n
  UNION SELECT pack_id, selection_node_id FROM specialty_packs WHERE pack_id <> '' AND selection_node_id <> ''
), e AS (
  SELECT DISTINCT m.pack_id, m.node_id, k.node_id AS parent
  FROM memberships m JOIN known k ON k.pack_id = m.pack_id AND k.node_id = m.display_parent_node_id
  WHERE m.node_id <> ''
), r AS (
  SELECT pack_id, parent AS ancestor_node_id, node_id FROM e
  UNION SELECT r.pack_id, e.parent, r.node_id FROM r JOIN e ON e.pack_id = r.pack_id AND e.node_id = r.ancestor_node_id
)
"""

PATHS = """, f AS (
  SELECT pack_id, node_id, min(parent) AS parent FROM e GROUP BY 1, 2
), w AS (
  SELECT pack_id, node_id, node_id AS here, [node_id] AS way, false AS looped FROM n
  UNION ALL
  SELECT w.pack_id, w.node_id, f.parent, list_prepend(f.parent, w.way), list_contains(w.way, f.parent)
  FROM w JOIN f ON f.pack_id = w.pack_id AND f.node_id = w.here WHERE NOT w.looped
), l AS (
  SELECT pack_id, node_id, arg_max(here, len(way)) AS top, arg_max(way, len(way)) AS way, bool_or(looped) AS looped FROM w GROUP BY 1, 2
)
SELECT pack_id, node_id, CASE WHEN NOT looped THEN array_to_string(way, ' > ') END AS path,
  CASE WHEN NOT looped THEN CAST(len(way) - 1 AS INT) END AS depth,
  CASE WHEN NOT looped THEN top END AS root_node_id, looped
FROM l
"""


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    return {
        "p4_found": CLOSURE + "SELECT pack_id, ancestor_node_id, node_id FROM r",
        "p4_paths": CLOSURE + PATHS,
        "p4_descendants": CLOSURE
        + """SELECT k.pack_id, k.node_id, count(d.node_id) AS n_descendants,
  (SELECT count(*) FROM r u WHERE u.pack_id = k.pack_id AND u.node_id = k.node_id) AS n_ancestors,
  coalesce(bool_or(d.node_id = k.node_id), false) AS on_loop
FROM known k LEFT JOIN r d ON d.pack_id = k.pack_id AND d.ancestor_node_id = k.node_id
GROUP BY k.pack_id, k.node_id""",
    }
