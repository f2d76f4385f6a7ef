"""Connected components of an edge list, by alternating large-star and small-star rounds.

Each round is two joins-free regroupings of the edges; every neighbourhood is reduced by a partial
``min`` before it is shuffled and is never gathered into a list, so a node with a third of all edges is
no trouble. The rounds end when no edge changes, after about log(n) of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of ``edges`` the smallest node it is joined to.

    Null ends and edges from a node to itself join nothing; a node known only from such edges is its
    own component. Repeated edges count once. An empty edge list gives an empty result.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    ends = cut(ends.distinct())
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = ends.where("u <> v")
    mark = _mark(links)
    for _ in range(max_rounds):
        links = _small_star(_large_star(links))
        links = cut(links)
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest of that node and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    tied = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
