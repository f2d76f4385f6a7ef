"""Problem 4: parent-child links to full hierarchies, of unknown depth, with several parents and loops.

Method: a deterministic hash makes about one node in ``every`` a splitter. Every node walks up to its
next splitters (a walk ends there), the splitters' walks form a reduced graph that is solved by doubling,
and the exact ancestors or paths are put together from the pieces. A loop without a splitter never
leaves a walk: the walk ends when it meets nothing new, and its loop is exact then and there.

All steps are joins on (tree, node). Walks of all nodes move together, one step a round, so a round's
work is shared by all trees; nothing is gathered per tree.

Defined results: links with a blank tree or node are left out; a blank parent is no parent; repeated
links count once; a node that is its own parent is a loop of one; empty tables give empty results;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

EVERY = 3


def _splitter(tree: str, node: str, every: int):
    return F.pmod(F.xxhash64(F.col(tree), F.col(node)), F.lit(every)) == 0


def links(rows: DataFrame, tree: str, node: str, parent: str, also: DataFrame | None = None) -> DataFrame:
    """(tree, node, parent): the distinct links whose parent has a row in the same tree or is listed in
    ``also`` (tree, node)."""
    own = rows.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent")).where("tree <> '' and node <> ''")
    known = own.select("tree", "node")
    if also is not None:
        known = known.unionByName(also.select("tree", "node").where("tree <> '' and node <> ''"))
    known = known.distinct().withColumnRenamed("node", "parent")
    return own.where("parent <> ''").distinct().join(known, ["tree", "parent"], "left_semi").select("tree", "node", "parent")


def ancestors(edges: DataFrame, every: int = EVERY) -> DataFrame:
    """(tree, ancestor, node) for every node and every node above it, over any number of steps; a node on
    a loop is its own ancestor. ``edges`` is (tree, node, parent) as :func:`links` gives it."""
    edges = cut(edges.select("tree", "node", "parent"))
    local = _walks(edges, every)
    # The reduced graph: from splitter to splitter, solved by doubling.
    ends = local.where(_splitter("tree", "top", every))
    steps = ends.where(_splitter("tree", "node", every)).select("tree", "node", "top")
    reach = cut(_closure(steps))
    # Put together: a node's own walk; then, for each splitter it ended at, the walks of all splitters above it.
    last = ends.select("tree", "node", F.col("top").alias("gate"))
    beyond = last.unionByName(last.join(reach.select("tree", F.col("node").alias("gate"), "top"), ["tree", "gate"]).select("tree", "node", F.col("top").alias("gate"))).distinct()
    above = local.select("tree", F.col("node").alias("gate"), "top")
    whole = local.select("tree", "node", "top").unionByName(beyond.join(above, ["tree", "gate"]).select("tree", "node", "top"))
    return whole.distinct().select("tree", F.col("top").alias("ancestor"), "node")


def _walks(edges: DataFrame, every: int) -> DataFrame:
    """(tree, node, top): everything each node meets on its way up until splitters stop it.

    A round takes two steps and keeps what no round before it has met.
    """
    up = edges.select("tree", F.col("node").alias("top"), F.col("parent").alias("next"))
    met = front = edges.select("tree", "node", F.col("parent").alias("top"))
    while True:
        once = _step(front, up, every)
        new = once.unionByName(_step(once, up, every)).distinct().join(met, ["tree", "node", "top"], "left_anti")
        front = cut(new)
        if front.isEmpty():
            return cut(met)
        met = met.unionByName(front)


def _step(front: DataFrame, up: DataFrame, every: int) -> DataFrame:
    on = front.where(~_splitter("tree", "top", every))
    return on.join(up, ["tree", "top"]).select("tree", "node", F.col("next").alias("top"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _closure(steps: DataFrame) -> DataFrame:
    """(tree, node, top): transitive closure by doubling; ends when a round adds nothing."""
    reach = cut(steps.distinct())
    n = reach.count()
    while n:
        far = reach.join(reach.select("tree", F.col("node").alias("top"), F.col("top").alias("next")), ["tree", "top"]).select("tree", "node", F.col("next").alias("top"))
        reach = cut(reach.unionByName(far).distinct())
        now = reach.count()
        if now == n:
            break
        n = now
    return reach


def paths(edges: DataFrame, nodes: DataFrame, order: str | None = None, every: int = EVERY) -> DataFrame:
    """(tree, node, path, depth, root, looped) along each node's first parent.

    ``nodes`` (tree, node) lists the nodes asked for. A node's first parent is the one with the smallest
    ``order`` (a column of ``edges``), ties by code point. ``path`` runs from the root to the node,
    ``depth`` counts its links. A node on a loop or below one has no root: ``looped`` is true, ``root`` and
    ``depth`` are null and ``path`` is null.
    """
    key = F.struct(*[F.col(c) for c in ([order] if order else []) + ["parent"]])
    first = cut(edges.groupBy("tree", "node").agg(F.min_by("parent", key).alias("parent")))
    start = nodes.select("tree", "node").where("tree <> '' and node <> ''").distinct()
    everyone = start.unionByName(first.select("tree", F.col("parent").alias("node"))).unionByName(first.select("tree", "node")).distinct()
    # Walk to the next splitter: ``way`` runs from the node up to, not including, where it stands.
    front = cut(everyone.withColumn("at", F.col("node")).withColumn("way", F.array().cast("array<string>")))
    done = []
    up = first.select("tree", F.col("node").alias("at"), F.col("parent").alias("next"))
    front = front.withColumn("state", F.lit("on"))
    while True:
        for _ in range(3):
            front = _pointer_step(front, up, every)
        front = cut(front)
        done.append(front.where("state <> 'on'"))
        front = front.where("state = 'on'")
        if front.isEmpty():
            break
    local = cut(_all(done))
    # Splitters by pointer doubling: ``way`` grows until it ends at a root or in a loop.
    gates = cut(local.where(_splitter("tree", "node", every)))
    total, reached = gates.count(), 1
    while reached <= total * 2:
        if gates.where("state = 'gate'").isEmpty():
            break
        ahead = gates.select("tree", F.col("node").alias("at"), F.col("at").alias("then"), F.col("way").alias("more"), F.col("state").alias("later"))
        open_ = gates.where("state = 'gate'").join(ahead, ["tree", "at"])
        turned = open_.withColumn("loops", F.arrays_overlap("way", "more"))
        joined = turned.select("tree", "node", F.col("then").alias("at"), F.when(F.col("loops"), F.col("way")).otherwise(F.concat("way", "more")).alias("way"), F.when(F.col("loops"), "loop").otherwise(F.col("later")).alias("state"))
        gates = cut(gates.where("state <> 'gate'").unionByName(joined))
        reached *= 2
    solved = gates.select("tree", F.col("node").alias("at"), F.col("way").alias("more"), F.when(F.col("state") == "root", "root").otherwise("loop").alias("later"))
    whole = local.join(solved, ["tree", "at"], "left")
    full = F.when(F.col("state") == "gate", F.concat("way", "more")).otherwise(F.col("way"))
    state = F.when(F.col("state") == "gate", F.col("later")).otherwise(F.col("state"))
    out = whole.select("tree", "node", full.alias("way"), (state != "root").alias("looped")).join(start, ["tree", "node"], "left_semi")
    path = F.when(~F.col("looped"), F.reverse("way"))
    return out.select("tree", "node", path.alias("path"), (F.size(path) - 1).alias("depth"), F.when(~F.col("looped"), F.element_at("way", -1)).alias("root"), "looped").withColumn("depth", F.when(~F.col("looped"), F.col("depth")))


def _pointer_step(front: DataFrame, up: DataFrame, every: int) -> DataFrame:
    """Moves every walk that is still on by one link; the others stay as they are."""
    moved = front.join(up, ["tree", "at"], "left")
    on = F.col("state") == "on"
    way = F.concat("way", F.array("at"))
    gate = F.pmod(F.xxhash64("tree", "next"), F.lit(every)) == 0
    state = F.when(F.col("next").isNull(), "root").when(F.array_contains(way, F.col("next")), "loop").when(gate, "gate").otherwise("on")
    return moved.select("tree", "node", F.when(on, F.col("next")).otherwise(F.col("at")).alias("at"), F.when(on, way).otherwise(F.col("way")).alias("way"), F.when(on, state).otherwise(F.col("state")).alias("state"))
