"""Queries over the concept catalog and its packs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import taxonomy as X
from quire.plans.hierarchies import CLOSURE, PATHS, p4_found, p4_paths
from quire.session import cut, read


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "taxonomy_nodes")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "memberships")


def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active nodes whose name holds a word and that are placed in some pack, by name whatever its case."""
    hits = _nodes(spark, sf_dir).where("node_status = 'active'").where(F.lower("canonical_name").contains("asthma") | F.lower("canonical_name").contains("failure"))
    placed = _members(spark, sf_dir).select("node_id")
    return hits.join(placed, "node_id", "left_semi").select("node_id", "node_type", "canonical_name", F.lower("canonical_name").alias("sort_name"))


def pack_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active packs with the numbers of their members, nodes and roles."""
    packs = read(spark, sf_dir, "specialty_packs").where("active")
    counts = _members(spark, sf_dir).groupBy("pack_id").agg(F.count("*").alias("n_rows"), F.countDistinct("node_id").alias("n_nodes"), F.countDistinct("membership_role").alias("n_roles"))
    zero = F.lit(0).cast("long")
    return packs.join(counts, "pack_id", "left").select("pack_id", "display_name", "pack_type", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_nodes", zero).alias("n_nodes"), F.coalesce("n_roles", zero).alias("n_roles"))


def catalog_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's faults, counted: repeated ids, dangling nodes and parents, repeated places, unknown packs."""
    nodes, members = _nodes(spark, sf_dir), _members(spark, sf_dir)
    known = nodes.select("node_id")
    parents = members.where("display_parent_node_id <> ''").select(F.col("display_parent_node_id").alias("node_id"))
    checks = {
        "repeated_node_ids": nodes.groupBy("node_id").count().where("count > 1"),
        "members_without_node": members.select("node_id").join(known, "node_id", "left_anti"),
        "parents_without_node": parents.join(known, "node_id", "left_anti"),
        "repeated_places": X.places(members).where("n_rows > 1"),
        "members_of_unknown_packs": members.join(read(spark, sf_dir, "specialty_packs").select("pack_id"), "pack_id", "left_anti"),
        "nodes_in_no_pack": known.join(members.select("node_id"), "node_id", "left_anti"),
    }
    rows = [df.agg(F.lit(name).alias("fault"), F.count("*").alias("n")) for name, df in checks.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acyclicity: the nodes that lie on a loop in their pack."""
    return p4_found(spark, sf_dir).where("ancestor_node_id = node_id").select("pack_id", "node_id")


def unreachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a pack that its selection node does not lead to."""
    above = p4_found(spark, sf_dir)
    packs = read(spark, sf_dir, "specialty_packs").select("pack_id", F.col("selection_node_id").alias("ancestor_node_id"))
    reached = above.join(packs, ["pack_id", "ancestor_node_id"], "left_semi").select("pack_id", "node_id")
    roots = packs.withColumnRenamed("ancestor_node_id", "node_id")
    nodes = _members(spark, sf_dir).where("pack_id <> '' and node_id <> ''").select("pack_id", "node_id").distinct()
    return nodes.join(reached, ["pack_id", "node_id"], "left_anti").join(roots, ["pack_id", "node_id"], "left_anti")


def display_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct place with its stable id."""
    return X.places(_members(spark, sf_dir)).select(X.display_id("pack_id", "parent", "node_id").alias("display_id"), "pack_id", "parent", "node_id", "sort_order")


def visible_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes shown at each level of detail, by depth along the first parent."""
    paths = cut(p4_paths(spark, sf_dir)).where("depth is not null")
    shown = [paths.where(F.col("depth") <= d).groupBy("pack_id").agg(F.lit(name).alias("detail"), F.count("*").alias("n_visible")) for name, d in X.DETAIL.items()]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


def navigated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every pack with its pin and whether a retired node hides it, itself or one above it."""
    members = _members(spark, sf_dir).where("pack_id <> '' and node_id <> ''")
    pins = members.where(F.get_json_object("config_json", "$.pinned") == "true")
    gone = _nodes(spark, sf_dir).where("node_status = 'retired'").select("node_id").distinct()
    return X.navigated(members.select("pack_id", "node_id").distinct(), p4_found(spark, sf_dir), pins, gone)


def pack_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision of each pack's record that changes with any of its fields."""
    return read(spark, sf_dir, "specialty_packs").select("pack_id", X.revision("pack_id", "display_name", "pack_type", "selection_node_id", "curation_status").alias("revision"))


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose names are the same once normalised."""
    named = _nodes(spark, sf_dir).select("node_id", T.normalise_title("canonical_name").alias("name_key")).where("name_key <> ''")
    return named.groupBy("name_key").agg(F.count_distinct("node_id").alias("n_nodes"), F.min("node_id").alias("first_node")).where("n_nodes > 1")


def catalog_install(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What installing the nodes of all versions after v0 over v0's does, by action and type."""
    nodes = _nodes(spark, sf_dir)
    base = nodes.where("catalog_version = 'v0' or node_type = 'phenotype'")
    later = nodes.where("catalog_version <> 'v0'").withColumn("node_status", F.when(F.col("node_status") == "active", "active").otherwise("retired"))
    plan = X.install_plan(base, later, "node_id", ["node_type", "canonical_name", "node_status"])
    return plan.groupBy("action").agg(F.count("*").alias("n"), F.min("node_id").alias("first_node"))


def united_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships of all active packs united, the first pack by name winning: rows each pack contributes."""
    packs = read(spark, sf_dir, "specialty_packs").where("active").select("pack_id", F.col("display_name").alias("pack_order"))
    return X.first_pack(_members(spark, sf_dir).where("node_id <> ''"), packs).groupBy("pack_id").agg(F.count("*").alias("n"))


def assignment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of extended memberships written over core ones, except where the node is deprecated (locked)."""
    members = _members(spark, sf_dir).where("pack_id <> '' and node_id <> ''")
    retired = _nodes(spark, sf_dir).select("node_id", (F.col("node_status") != "active").alias("locked"))
    old = members.where("membership_role = 'core'").groupBy("pack_id", "node_id").agg(F.min("sort_order").alias("weight")).join(retired, "node_id", "left")
    new = members.where("membership_role = 'extended'").groupBy("pack_id", "node_id").agg(F.max("sort_order").alias("weight"))
    return X.protected_upsert(old, new, ["pack_id", "node_id"], "locked", "weight").groupBy("changed").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per concept: node names found in titles, by the node's own words (distinct documents)."""
    nodes = _nodes(spark, sf_dir).where("node_status = 'active'").select("node_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("canonical_name"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("word"))
    docs = read(spark, sf_dir, "documents").where("deleted_at is null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z]{6,}"), F.lit(0)))).alias("word"))
    counts = docs.groupBy("word").agg(F.countDistinct("doc_id").alias("n_documents"))
    return nodes.join(counts, "word").groupBy("node_id").agg(F.max("n_documents").alias("n_documents"), F.count("*").alias("n_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query."""
    own = (navigated_nodes, pack_revisions, name_keys, node_search, pack_listing, catalog_checks, loops, unreachable_nodes, display_places, visible_nodes, catalog_install, united_memberships, assignment_upsert, facet_counts)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    return {
        "node_search": "SELECT node_id, node_type, canonical_name, lower(canonical_name) AS sort_name FROM taxonomy_nodes WHERE node_status = 'active' AND (contains(lower(canonical_name), 'asthma') OR contains(lower(canonical_name), 'failure')) AND node_id IN (SELECT node_id FROM memberships)",
        "pack_listing": "SELECT p.pack_id, display_name, pack_type, count(m.pack_id) AS n_rows, count(DISTINCT m.node_id) AS n_nodes, count(DISTINCT m.membership_role) AS n_roles FROM specialty_packs p LEFT JOIN memberships m ON m.pack_id = p.pack_id WHERE active GROUP BY 1, 2, 3",
        "catalog_checks": """SELECT 'repeated_node_ids' AS fault, count(*) AS n FROM (SELECT node_id FROM taxonomy_nodes GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'members_without_node', count(*) FROM memberships m WHERE NOT EXISTS (SELECT 1 FROM taxonomy_nodes t WHERE t.node_id = m.node_id)
UNION ALL SELECT 'parents_without_node', count(*) FROM memberships m WHERE display_parent_node_id <> '' AND NOT EXISTS (SELECT 1 FROM taxonomy_nodes t WHERE t.node_id = m.display_parent_node_id)
UNION ALL SELECT 'repeated_places', count(*) FROM (SELECT 1 FROM memberships WHERE pack_id <> '' AND node_id <> '' GROUP BY pack_id, nullif(display_parent_node_id, ''), node_id HAVING count(*) > 1)
UNION ALL SELECT 'members_of_unknown_packs', count(*) FROM memberships m WHERE NOT EXISTS (SELECT 1 FROM specialty_packs p WHERE p.pack_id = m.pack_id)
UNION ALL SELECT 'nodes_in_no_pack', count(*) FROM taxonomy_nodes t WHERE NOT EXISTS (SELECT 1 FROM memberships m WHERE m.node_id = t.node_id)""",
        "navigated_nodes": CLOSURE + """, g AS (SELECT node_id FROM taxonomy_nodes WHERE node_status = 'retired'),
  h AS (SELECT pack_id, node_id FROM n WHERE node_id IN (SELECT node_id FROM g) UNION SELECT pack_id, node_id FROM r WHERE ancestor_node_id IN (SELECT node_id FROM g)),
  q AS (SELECT DISTINCT pack_id, node_id FROM memberships WHERE json_extract_string(config_json, '$.pinned') = 'true')
SELECT n.pack_id, n.node_id, q.node_id IS NOT NULL AS pinned, h.node_id IS NOT NULL AS hidden FROM n LEFT JOIN q ON q.pack_id = n.pack_id AND q.node_id = n.node_id LEFT JOIN h ON h.pack_id = n.pack_id AND h.node_id = n.node_id""",
        "pack_revisions": "SELECT pack_id, substr(sha256(CAST(to_json({'curation_status': curation_status, 'display_name': display_name, 'pack_id': pack_id, 'pack_type': pack_type, 'selection_node_id': selection_node_id}) AS VARCHAR)), 1, 24) AS revision FROM specialty_packs",
        "name_keys": f"""SELECT name_key, count(DISTINCT node_id) AS n_nodes, min(node_id) AS first_node FROM (SELECT node_id, trim(regexp_replace(regexp_replace(translate(lower(coalesce(canonical_name, '')), '{T.ACCENTED}', '{T.PLAIN}'), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM taxonomy_nodes)
WHERE name_key <> '' GROUP BY 1 HAVING count(DISTINCT node_id) > 1""",
        "loops": CLOSURE + "SELECT pack_id, node_id FROM r WHERE ancestor_node_id = node_id",
        "unreachable_nodes": CLOSURE + "SELECT pack_id, node_id FROM n EXCEPT SELECT r.pack_id, r.node_id FROM r JOIN specialty_packs p ON p.pack_id = r.pack_id AND p.selection_node_id = r.ancestor_node_id EXCEPT SELECT pack_id, selection_node_id FROM specialty_packs",
        "display_places": "SELECT 'display.' || substr(sha256(pack_id || '|' || coalesce(parent, '') || '|' || node_id), 1, 24) AS display_id, pack_id, parent, node_id, sort_order FROM (SELECT pack_id, nullif(display_parent_node_id, '') AS parent, node_id, min(sort_order) AS sort_order FROM memberships WHERE pack_id <> '' AND node_id <> '' GROUP BY 1, 2, 3)",
        "visible_nodes": CLOSURE + PATHS.replace("\nSELECT pack_id, node_id, CASE", ", z AS (SELECT pack_id, node_id, CASE") + ") SELECT pack_id, detail, count(*) AS n_visible FROM z, (VALUES ('broad', 2), ('balanced', 4), ('detailed', 8)) v(detail, most) WHERE depth <= most GROUP BY 1, 2",
        "catalog_install": """WITH o AS (SELECT node_id, (node_type, canonical_name, node_status) AS was FROM taxonomy_nodes WHERE catalog_version = 'v0' OR node_type = 'phenotype'),
  w AS (SELECT node_id, (node_type, canonical_name, CASE WHEN node_status = 'active' THEN 'active' ELSE 'retired' END) AS will FROM taxonomy_nodes WHERE catalog_version <> 'v0')
SELECT CASE WHEN o.node_id IS NULL THEN 'insert' WHEN w.node_id IS NULL THEN 'retire' WHEN was = will THEN 'keep' ELSE 'update' END AS action, count(*) AS n, min(coalesce(o.node_id, w.node_id)) AS first_node
FROM o FULL JOIN w ON o.node_id = w.node_id GROUP BY 1""",
        "united_memberships": """SELECT pack_id, count(*) AS n FROM (SELECT m.pack_id, row_number() OVER (PARTITION BY node_id, coalesce(display_parent_node_id, ''), membership_role ORDER BY display_name, m.pack_id, sort_order) AS k
  FROM memberships m JOIN specialty_packs p ON p.pack_id = m.pack_id AND active WHERE node_id <> '') WHERE k = 1 GROUP BY 1""",
        "assignment_upsert": """WITH m AS (SELECT * FROM memberships WHERE pack_id <> '' AND node_id <> ''),
  o AS (SELECT pack_id, m.node_id, min(sort_order) AS was, bool_or(t.node_status <> 'active') AS locked FROM m LEFT JOIN taxonomy_nodes t ON t.node_id = m.node_id WHERE membership_role = 'core' GROUP BY 1, 2),
  w AS (SELECT pack_id, node_id, max(sort_order) AS will FROM m WHERE membership_role = 'extended' GROUP BY 1, 2),
  b AS (SELECT was, will, coalesce(locked, false) OR will IS NULL AS keep FROM o FULL JOIN w ON o.pack_id = w.pack_id AND o.node_id = w.node_id)
SELECT NOT keep AND will IS DISTINCT FROM was AS changed, count(*) AS n, CAST(sum(CASE WHEN keep THEN was ELSE will END) AS BIGINT) AS weight FROM b GROUP BY 1""",
        "facet_counts": """WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{6,}')) AS word FROM documents WHERE deleted_at IS NULL),
  c AS (SELECT word, count(*) AS n FROM d GROUP BY 1), t AS (SELECT DISTINCT node_id, unnest(regexp_extract_all(lower(canonical_name), '[a-z]{6,}')) AS word FROM taxonomy_nodes WHERE node_status = 'active')
SELECT node_id, max(n) AS n_documents, count(*) AS n_words FROM t JOIN c USING (word) GROUP BY 1""",
    }
