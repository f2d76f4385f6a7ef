"""Problem 4 against brute force: several parents, loops with and without splitters, nulls, repeats, empties."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import hierarchy

SCHEMA = "pack string, node string, parent string, tree string, top string"


def closure(edges):
    up = {}
    for t, n, p in edges:
        up.setdefault((t, n), set()).add(p)
    out = set()
    for t, n in up:
        seen, todo = set(), list(up[t, n])
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo.extend(up.get((t, p), ()))
        out |= {(t, p, n) for p in seen}
    return out


def rows(kind):
    rnd = random.Random(kind)
    if kind == "chain":
        return [("a", f"n{i}", f"n{i - 1}") for i in range(1, 41)] + [("a", "n0", None)]
    if kind == "loops":
        return [("a", "x", "x"), ("a", "p", "q"), ("a", "q", "p"), ("a", "r", "q"), ("b", "p", ""), ("b", "r", "p"), ("a", "r", "lost"), ("a", "p", "q")]
    if kind == "hot":  # one node is the parent of most others
        return [("a", "top", None), *[("a", f"c{i}", "top") for i in range(900)], *[("a", f"g{i}", f"c{i % 7}") for i in range(200)]]
    return [(rnd.choice("ab"), f"n{rnd.randrange(30)}", rnd.choice([None, "", *(f"n{rnd.randrange(32)}" for _ in range(6))])) for _ in range(70)]


@pytest.mark.parametrize("kind", ["chain", "loops", "dag1", "dag2", "hot"])
def test_ancestors_equal_brute_force(spark, kind):
    data = rows(kind)
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in [*data, *data[:3], (None, "n1", "n2"), ("a", None, "n2"), ("a", "", "n2")]], SCHEMA)
    known = {(t, n) for t, n, _ in data}
    edges = {(t, n, p) for t, n, p in data if p and (t, p) in known}
    found = hierarchy.ancestors(hierarchy.links(frame, "pack", "node", "parent"))
    got = [tuple(r) for r in found.select("tree", "ancestor", "node").collect()]
    assert len(got) == len(set(got))
    assert set(got) == closure(edges)


def test_paths_of_a_forest_with_loops(spark):
    data = [("a", "r", None), ("a", "c", "r"), ("a", "d", "c"), ("a", "d", "a0"), ("a", "a0", None), ("a", "l", "m"), ("a", "m", "l"), ("a", "below", "m"), ("a", "self", "self")]
    frame = spark.createDataFrame([(*r, "", "") for r in data], SCHEMA)
    nodes = frame.select(F.col("pack").alias("tree"), "node")
    found = {r["node"]: r for r in hierarchy.paths(hierarchy.links(frame, "pack", "node", "parent"), nodes).collect()}
    assert set(found) == {n for _, n, _ in data}
    assert found["c"]["path"] == ["r", "c"] and found["c"]["depth"] == 1 and found["c"]["root"] == "r"
    assert found["d"]["path"] == ["a0", "d"]  # the first parent by code point
    for n in ("l", "m", "below", "self"):
        assert found[n]["looped"] and found[n]["path"] is None and found[n]["root"] is None
    long = [("a", f"n{i:03}", f"n{i - 1:03}" if i else None, "", "") for i in range(60)]
    frame = spark.createDataFrame(long, SCHEMA)
    deep = hierarchy.paths(hierarchy.links(frame, "pack", "node", "parent"), frame.select(F.col("pack").alias("tree"), "node"))
    assert sorted(r["depth"] for r in deep.collect()) == list(range(60))


def test_empty_tables(spark):
    frame = spark.createDataFrame([], SCHEMA)
    edges = hierarchy.links(frame, "pack", "node", "parent")
    assert hierarchy.ancestors(edges).count() == 0
    assert hierarchy.paths(edges, frame.select(F.col("pack").alias("tree"), "node")).count() == 0
