"""Problem 5: near-duplicate records by a chosen-path similarity join.

Every record becomes its set of word sequences (shingles). Equal sets are one class; the join runs on
one representative per class. A run sends each set down a random tree: at a node it follows every
sketch position that the node drew (each with probability 1 / (threshold * positions)) and goes to the
child named after its value there, so sets that share much meet often and sets that share little part.
Buckets of at most ``bucket`` sets are compared by brute force, larger ones split on. Runs repeat until
a pair exactly at the threshold is met with the target recall; every pair met is verified on the whole
shingle sets.

Spark shuffles each run's first-level buckets once; a task then splits its buckets level by level in
numpy, all of them together. A first-level bucket too large for a task is split on by Spark instead.

Defined results: a record whose title and abstract have fewer words than a shingle has no set and no
partner; null counts as empty text; rows with a blank abstract take no part where that column is asked
for; equal records always pair up; a repeated id counts once; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, spread

WORDS = re.compile(r"[^\W_]+")
POSITIONS = 32
WIDTH = 2 * POSITIONS  # a row carries its run's positions, and the next run's for comparing only
MOST_HELD = 1 << 20  # pairs that a task holds before it passes them on
NODE = "path long, id long, sketch binary, left int"  # left: levels below the node


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of ``size`` successive words, sorted."""
    words = WORDS.findall(text.lower())
    if len(words) < size:
        return np.empty(0, np.uint64)
    rows = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(r.encode("utf-8", "surrogatepass")) for r in rows), np.uint64, len(rows)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads any change of the input over all bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def survival(depth: int, threshold: float, similarity: float) -> float:
    """Chance that two sets of this similarity meet at least once ``depth`` levels down one run's tree."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-similarity / threshold * p)
    return p


def runs_needed(depth: int, threshold: float, recall: float) -> int:
    """Runs after which a pair exactly at the threshold has been met with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(depth, threshold, threshold))))


def depth_for(n: int, bucket: int, background: float = 0.05) -> int:
    """Levels after which unrelated sets, alike by ``background``, fill a bucket no more."""
    return max(1, math.ceil(math.log(max(n / bucket, 1.0001)) / math.log(1 / background)))


def _sketch(sets: list[np.ndarray], runs: int) -> list[bytes]:
    """One byte of MinHash for every position of every run."""
    seeds = mix(np.arange(1, runs * POSITIONS + 1, dtype=np.uint64))[:, None]
    out = []
    for s in sets:
        with np.errstate(over="ignore"):
            h = (s[None, :] ^ seeds) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
        low = h.min(axis=1)
        out.append(((low ^ (low >> np.uint64(17))) & np.uint64(0xFF)).astype(np.uint8).tobytes())
    return out


def children(paths: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for every position that each row's node drew."""
    rows, out = [], []
    limit = np.uint64(int((1 << 64) / (threshold * POSITIONS)) - 1)
    for c in range(POSITIONS):
        with np.errstate(over="ignore"):
            node = mix(paths + np.uint64((c + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            hit = np.flatnonzero(node <= limit)
            child = mix(node[hit] + np.uint64(0x100) + sketches[hit, c].astype(np.uint64))
        rows.append(hit)
        out.append(child)
    return np.concatenate(rows), np.concatenate(out)


def _buckets(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by path, the start of each bucket and its size."""
    order = np.argsort(paths, kind="stable")
    sorted_paths = paths[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_paths[1:] != sorted_paths[:-1])))
    return order, starts, np.diff(np.concatenate((starts, [len(paths)])))


def _brute(ids: np.ndarray, sketches: np.ndarray, paths: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Pairs within each bucket whose sketches agree in at least ``least`` of the positions."""
    order, starts, sizes = _buckets(paths)
    ids, sketches = ids[order], sketches[order]
    bucket = np.repeat(np.arange(len(starts)), sizes)
    for step in range(1, int(sizes.max(initial=1))):
        left = np.flatnonzero(bucket[step:] == bucket[:-step])
        if not len(left):
            break
        for at in range(0, len(left), 1 << 18):
            i = left[at : at + (1 << 18)]
            near = i[(sketches[i] == sketches[i + step]).mean(axis=1) >= least]
            if len(near):
                yield np.stack([ids[near], ids[near + step]], axis=1)


def split_and_compare(ids: np.ndarray, sketches: np.ndarray, paths: np.ndarray, left: np.ndarray, threshold: float, bucket: int, least: float) -> Iterator[np.ndarray]:
    """All pairs that meet in a small bucket below these nodes, in pieces.

    ``left`` is the number of levels below each row's node; what is still large with none left is compared whole.
    """
    found: list[np.ndarray] = []
    held = 0
    rows = np.arange(len(ids))
    while len(rows):
        order, starts, sizes = _buckets(paths)
        size = np.empty(len(paths), np.int64)
        size[order] = np.repeat(sizes, sizes)
        large = (size > bucket) & (left > 0)
        done = (size > 1) & ~large
        for piece in _brute(ids[rows[done]], sketches[rows[done]], paths[done], least):
            found.append(piece)
            held += len(piece)
            if held >= MOST_HELD:
                yield _ordered(found)
                found, held = [], 0
        below, child = children(paths[large], sketches[rows[large]], threshold)
        rows, paths, left = rows[large][below], child, left[large][below] - 1
    if found:
        yield _ordered(found)


def _ordered(found: list[np.ndarray]) -> np.ndarray:
    """The distinct pairs, the smaller id first."""
    pairs = np.concatenate(found)
    pairs = np.stack([pairs.min(axis=1), pairs.max(axis=1)], axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def records(df: DataFrame, id_col: str, text_cols: list[str], need_col: str | None) -> DataFrame:
    """(id, text): the columns joined by a space; rows whose ``need_col`` is blank are left out."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])
    rows = df.where(F.col(need_col).rlike(r"(?U)\S")) if need_col else df
    return spread(rows.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where("id is not null"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_cols: list[str] | None = None, need_col: str | None = "abstract", size: int = 3, threshold: float = 0.6, recall: float = 0.99, bucket: int = 40, hot: int = 20000) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``members`` (id, rep) has every record with the representative of its class of
    equal shingle sets, ``pairs`` (rep_a, rep_b, similarity) the classes at or above ``threshold``.

    ``recall`` is the chance with which a pair exactly at the threshold is met; pairs above are met more
    often. ``hot`` is the number of rows from which Spark, not a task, splits a first-level bucket.
    """
    spark = df.sparkSession
    base = records(df, id_col, text_cols or ["title", "abstract"], need_col)
    n = df.count()
    depth = depth_for(n, bucket)
    runs = max(2, runs_needed(depth, threshold, recall))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, size) for t in pdf["text"]]
            keep = [i for i, s in enumerate(sets) if len(s)]
            sets = [sets[i] for i in keep]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[keep], "key": keys, "sketch": _sketch(sets, runs)})

    sketched = cut(base.mapInPandas(sketch, "id long, key binary, sketch binary"))
    classes = sketched.groupBy("key").agg(F.min("id").alias("rep"), F.min_by("sketch", "id").alias("sketch"))
    members = sketched.select("id", "key").join(classes.select("key", "rep"), "key").select("id", "rep").distinct()

    def first_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            whole = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), runs, POSITIONS)
            ids = pdf["rep"].to_numpy()
            for run in range(runs):
                own = np.concatenate([whole[:, run], whole[:, (run + 1) % runs]], axis=1)
                rows, path = children(mix(np.full(len(pdf), run + 1, np.uint64)), own, threshold)
                yield pd.DataFrame({"path": path.view(np.int64), "id": ids[rows], "sketch": [own[r].tobytes() for r in rows], "left": np.full(len(rows), depth - 1, np.int32)})

    nodes = classes.select("rep", "sketch").mapInPandas(first_level, NODE)
    if n > hot:
        nodes = _split_hot(cut(nodes), threshold, hot, depth - 1)
    return members, verified(_met(nodes, threshold, bucket), base, size, threshold)


def _met(nodes: DataFrame, threshold: float, bucket: int) -> DataFrame:
    """(rep_a, rep_b): the pairs that meet below these nodes and whose sketches do not rule them out."""
    least = threshold - 3.5 * math.sqrt(threshold * (1 - threshold) / WIDTH)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) < 100_000:
                continue
            last = held["path"].to_numpy() == held["path"].iloc[-1]
            if not last.all():
                yield from pairs_of(held[~last])
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield from pairs_of(held)

    def pairs_of(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sketches = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), WIDTH)
        for found in split_and_compare(pdf["id"].to_numpy(), sketches, pdf["path"].to_numpy().view(np.uint64), pdf["left"].to_numpy(), threshold, bucket, least):
            yield pd.DataFrame({"rep_a": found[:, 0], "rep_b": found[:, 1]})

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(parts, "path").sortWithinPartitions("path").mapInPandas(compare, "rep_a long, rep_b long").distinct()


def _split_hot(nodes: DataFrame, threshold: float, hot: int, levels: int) -> DataFrame:
    """Splits every bucket of more than ``hot`` rows one level on, again while levels remain.

    The hot paths are joined; none comes to the driver. Buckets that stay hot at the
    last level hold sets alike in every drawn position; they are cut into blocks and every two blocks
    meet in a bucket of their own, with no levels left, so it is compared whole, no pair is lost and no
    task gets an unbounded bucket.
    """

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sketches = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), WIDTH)
            rows, path = children(pdf["path"].to_numpy().view(np.uint64), sketches, threshold)
            yield pd.DataFrame({"path": path.view(np.int64), "id": pdf["id"].to_numpy()[rows], "sketch": pdf["sketch"].to_numpy()[rows], "left": pdf["left"].to_numpy()[rows] - 1})

    ready: list[DataFrame] = []
    for level in range(levels + 1):
        large = cut(nodes.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > hot))
        if large.isEmpty():
            return _union([*ready, nodes])
        ready.append(nodes.join(large.select("path"), "path", "left_anti").select("path", "id", "sketch", "left"))
        if level == levels:
            blocks = nodes.join(large, "path").withColumn("blocks", F.ceil(F.col("n") * 2 / hot).cast("int"))
            mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
            other = blocks.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            ready.append(other.select(F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")).alias("path"), "id", "sketch", F.lit(0).alias("left")))
            return _union(ready)
        nodes = cut(nodes.join(large.select("path"), "path", "left_semi").select("path", "id", "sketch", "left").mapInPandas(deeper, NODE))
    return _union(ready)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verified(met: DataFrame, base: DataFrame, size: int, threshold: float) -> DataFrame:
    """(rep_a, rep_b, similarity): the pairs whose whole shingle sets reach the threshold, exactly."""
    sides = met.select("rep_a", "rep_b", F.explode(F.array("rep_a", "rep_b")).alias("id"))
    texts = base.join(sides.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    both = (
        sides.join(texts, "id")
        .groupBy("rep_a", "rep_b")
        .agg(F.min_by("text", "id").alias("text_a"), F.max_by("text", "id").alias("text_b"))
    )

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = []
            for a, b in zip(pdf["text_a"], pdf["text_b"], strict=True):
                x, y = shingles(a, size), shingles(b, size)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                value.append(shared / (len(x) + len(y) - shared))
            out = pdf[["rep_a", "rep_b"]].assign(similarity=value)
            yield out[out["similarity"] >= threshold]

    return both.mapInPandas(measure, "rep_a long, rep_b long, similarity double")


def near_duplicate_pairs(df: DataFrame, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records at or above the threshold, equal ones included."""
    members, pairs = near_duplicates(df, **options)
    members = cut(members)
    a = members.select(F.col("id").alias("x"), F.col("rep").alias("rep_a"))
    b = members.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    across = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("x", "y")
    many = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    again = members.join(many, "rep", "left_semi")
    equal = again.select("rep", F.col("id").alias("x")).join(again.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    return across.unionByName(equal).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(df: DataFrame, **options) -> DataFrame:
    """(id, class_id, group_id, n_links): for every record the class of equal sets it is in, the group
    that chains of links put it in (smallest id), and the number of other classes its class links to."""
    from quire.operators.components import components

    members, pairs = near_duplicates(df, **options)
    members, pairs = cut(members), cut(pairs)
    links = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    groups = components(pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    return (
        members.join(links, "rep", "left")
        .join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
