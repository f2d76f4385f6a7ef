"""Nearest neighbours of many query vectors: exact in blocks, or by the lists of an inverted file.

Data rows are packed into blocks of a bounded number of rows, queries likewise; every query block meets every
data block once in a matrix product, and only each query's best rows of the block go on. Both sides are
partitioned, neither is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _blocks(df: DataFrame, id_col: str, vector_col: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, name): rows packed into blocks of about BLOCK rows, within the keys if there are any."""
    keys = keys or []
    rows = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(*keys, F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    if keys:
        rows = rows.join(rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), keys)
    else:
        rows = rows.withColumn("blocks", F.lit(max(1, -(-rows.count() // BLOCK))))
    return rows.groupBy(*keys, F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias(name)).drop("block")


def _best_of_blocks(met: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, rank) of the ``k`` best over all meetings of a block of queries with one of rows."""

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, d in zip(pdf["q"], pdf["d"], strict=True):
                qi, di = np.array([r["id"] for r in q]), np.array([r["id"] for r in d])
                qv, dv = unit([r["v"] for r in q]), unit([r["v"] for r in d])
                sims = qv @ dv.T
                sims[qi[:, None] == di[None, :]] = -np.inf
                most = min(k, len(di))
                least = -np.partition(-sims, most - 1, axis=1)[:, most - 1]
                row, col = np.nonzero((sims >= least[:, None]) & np.isfinite(sims))
                order = np.lexsort((di[col], -sims[row, col], row))
                row, col = row[order], col[order]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[kept], col[kept]
                yield pd.DataFrame({"query_id": qi[row], "id": di[col], "similarity": sims[row, col]})

    found = met.select("q", "d").mapInPandas(multiply, "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` most similar other rows of each query by cosine; ties by id.

    Null vectors take no part; a vector of zeros has similarity 0 to all.
    """
    return _best_of_blocks(_blocks(queries, id_col, vector_col, "q").crossJoin(_blocks(df, id_col, vector_col, "d")), k)


def centroids(df: DataFrame, vector_col: str, lists: int, sample: int = 50_000, seed: int = 7) -> np.ndarray:
    """The centres of an inverted file, fitted on about ``sample`` rows drawn from all."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))
    share = min(1.0, sample / max(1, rows.count()))
    norm = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda t, x: t + x.cast("double") * x))
    drawn = rows.where(F.rand(seed) <= share).withColumn("norm_", norm).where("norm_ > 0")
    fitted = KMeans(k=lists, maxIter=10, seed=seed, featuresCol="f").fit(drawn.select(array_to_vector(F.transform(vector_col, lambda x: x / F.col("norm_"))).alias("f")))
    return np.array(fitted.clusterCenters())


def approximate(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, share: float = 0.7, seed: int = 7) -> DataFrame:
    """(query_id, id, similarity, rank) as :func:`neighbours`, but a query meets the rows of its nearest lists only.

    Every row is in the list of its nearest centre. ``share`` of the lists are probed, which decides the recall
    (0.7 gives nine in ten on vectors without structure, much less does on clustered ones);
    their number is the root of the rows', 4,096 at most, so that the centres fit every task.
    """
    lists = lists or int(min(4096, max(1, round(df.count() ** 0.5))))
    centres = centroids(df, vector_col, lists, seed=seed)
    probes = max(1, round(len(centres) * share))

    def listed(n: int):
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                near = np.argsort(-(unit(list(pdf["v"])) @ unit(list(centres)).T), axis=1, kind="stable")[:, :n]
                at = np.repeat(np.arange(len(pdf)), near.shape[1])
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "v": pdf["v"].to_numpy()[at], "list": near.ravel()})

        return assign

    def rows(frame: DataFrame, n: int) -> DataFrame:
        kept = frame.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return kept.mapInPandas(listed(n), "id long, v array<double>, list int")

    left, right = _blocks(rows(queries, probes), "id", "v", "q", ["list"]), _blocks(rows(df, 1), "id", "v", "d", ["list"])
    return _best_of_blocks(left.join(right, "list"), k)


def recall_at(found: DataFrame, wanted: DataFrame, *ks: int) -> DataFrame:
    """For each k the share of ``wanted`` (query_id, id, rank) nearest rows up to rank k that ``found`` holds up to rank k."""
    both = wanted.select("query_id", "id", F.col("rank").alias("at")).join(found.select("query_id", "id", F.col("rank").alias("met")), ["query_id", "id"], "left")
    rows = both.select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"), "at", "met").where("at <= k")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg((F.coalesce("met", F.lit(1 << 30)) <= F.col("k")).cast("double")), 6).alias("recall"))


def unit(vectors: list) -> np.ndarray:
    """Rows scaled to length one."""
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def qualified(found: DataFrame, least: float = 0.68, near: float = 0.04) -> DataFrame:
    """Keeps what is similar enough, and near enough to the best of its query."""
    top = F.max("similarity").over(Window.partitionBy("query_id"))
    return found.withColumn("top_", top).where((F.col("top_") >= least) & (F.col("similarity") >= F.greatest(F.lit(least), F.col("top_") - near))).drop("top_")
