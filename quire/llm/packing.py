"""Problem 6: filling fixed-capacity containers with items, as little unused space as possible.

Method: variable-capacity best-fit over several permitted container sizes at once. The largest item left
opens a container; for every permitted size that holds it the container is filled best-fit (always the
item that leaves the least space) from the lengths still left, and the size of least cost, the smallest
unused share, is opened. In the end each container is downsized to the smallest permitted size that holds
its contents.

Only (id, length) is shuffled. An item longer than the capacity gives full pieces, which fill containers of their
own where they are read, and a rest. What is left, one piece an item at most, is dealt at random into lots
of about ``lot`` pieces; a lot is packed in one task on its histogram of lengths, so tasks stay equal whatever the
source, length or id of the items, and all lots together leave no more than a container or two each unfilled.

Defined results: an item longer than the capacity is split into pieces of the capacity and a rest, any
other stays whole; an item of length 0 (blank or null text) is in a container too and takes no space;
repeated ids are items of their own; no rows give no containers; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "window_name string, id long, piece_no int, start_token long, n_tokens long, container_id string, container_tokens int, filled_tokens int"


def pack(lengths: list[int], sizes: list[int]) -> list[tuple[list[int], int]]:
    """Containers as (indices of their items, size); no length exceeds the largest size."""
    left: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        left[n].append(i)
    zeros = left.pop(0, [])
    mask = 0
    for n in left:
        mask |= 1 << n
    sizes = sorted(sizes)
    out: list[tuple[list[int], int]] = []
    while mask:
        first = mask.bit_length() - 1
        best: tuple[float, int, list[int]] | None = None
        for size in sizes:
            if size < first:
                continue
            took, used, room, free = [first], {first: 1}, size - first, mask
            if len(left[first]) == 1:
                free &= ~(1 << first)
            while room > 0:
                fits = free & ((2 << room) - 1)
                if not fits:
                    break
                n = fits.bit_length() - 1
                took.append(n)
                room -= n
                used[n] = used.get(n, 0) + 1
                if used[n] == len(left[n]):
                    free &= ~(1 << n)
            cost = room / size
            if best is None or cost < best[0] or (cost == best[0] and size > best[1]):
                best = (cost, size, took)
        items = []
        for n in best[2]:
            items.append(left[n].pop())
            if not left[n]:
                mask &= ~(1 << n)
        held = sum(best[2])
        out.append((items, next(s for s in sizes if s >= held)))
    if zeros:
        if out:
            out[0][0].extend(zeros)
        else:
            out.append((zeros, sizes[0]))
    return out


def containers(items: DataFrame, windows: DataFrame, lot: int = 50_000) -> DataFrame:
    """One row per piece: (window_name, id, piece_no, start_token, n_tokens, container_id, container_tokens,
    filled_tokens).

    ``items`` is (id, n_tokens); ``windows`` (window_name, capacity_tokens), a handful of rows. A window's
    permitted sizes are its own capacity and all smaller ones of the table.
    """
    rows = [(r["window_name"], r["capacity_tokens"]) for r in windows.where("window_name is not null and capacity_tokens > 0").distinct().collect()]
    every = sorted({c for _, c in rows})
    n = items.count()
    lots = max(1, math.ceil(n / lot))
    if not rows:
        return items.sparkSession.createDataFrame([], PACKED)
    windows_ = F.array(*[F.struct(F.lit(w).alias("window_name"), F.lit(c).cast("int").alias("capacity")) for w, c in sorted(rows)])
    base = items.select("id", "n_tokens", F.monotonically_increasing_id().alias("row")).select("*", F.explode(windows_).alias("w")).select("id", "n_tokens", "row", "w.*")
    base = base.withColumn("full", F.floor(F.col("n_tokens") / F.col("capacity")).cast("int")).withColumn("rest", F.col("n_tokens") - F.col("full").cast("long") * F.col("capacity"))
    whole = (
        base.where("full > 0")
        .withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.col("full"))))
        .select(
            "window_name", "id", "piece_no", ((F.col("piece_no") - 1).cast("long") * F.col("capacity")).alias("start_token"), F.col("capacity").cast("long").alias("n_tokens"),
            F.concat_ws("-", F.lit("full"), "row", "piece_no").alias("container_id"), F.col("capacity").alias("container_tokens"), F.col("capacity").alias("filled_tokens"),
        )
    )
    rests = base.where("rest > 0 or n_tokens = 0").select(
        "window_name", F.pmod(F.xxhash64("row"), F.lit(lots)).cast("int").alias("lot"), "capacity", "id", (F.col("full") + 1).alias("piece_no"), (F.col("full").cast("long") * F.col("capacity")).alias("start_token"), F.col("rest").alias("piece_tokens")
    )

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        name, number = key
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["id", "piece_no"], kind="stable").reset_index(drop=True)
        found = pack(pdf["piece_tokens"].tolist(), [c for c in every if c <= capacity])
        at, where, size, held = [], [], [], []
        lengths = pdf["piece_tokens"].tolist()
        for k, (members, room) in enumerate(found):
            at.extend(members)
            where.extend([f"{number}-{k}"] * len(members))
            size.extend([room] * len(members))
            held.extend([sum(lengths[m] for m in members)] * len(members))
        rows = pdf.iloc[at]
        return pd.DataFrame({"window_name": name, "id": rows["id"].to_numpy(), "piece_no": rows["piece_no"].to_numpy(), "start_token": rows["start_token"].to_numpy(), "n_tokens": rows["piece_tokens"].to_numpy(), "container_id": where, "container_tokens": size, "filled_tokens": held})

    return whole.unionByName(rests.groupBy("window_name", "lot").applyInPandas(fill, PACKED))


def unused_space(packed: DataFrame) -> DataFrame:
    """(window_name, n_containers, n_texts, n_split, tokens, container_tokens, unused_tokens, unused_share)."""
    each = packed.groupBy("window_name", "container_id").agg(F.max("container_tokens").alias("size"), F.sum("n_tokens").alias("held"))
    space = each.groupBy("window_name").agg(F.count("*").alias("n_containers"), F.sum("held").alias("tokens"), F.sum(F.col("size").cast("long")).alias("container_tokens"))
    texts = packed.groupBy("window_name").agg(F.sum((F.col("piece_no") == 1).cast("long")).alias("n_texts"), F.sum((F.col("piece_no") == 2).cast("long")).alias("n_split"))
    unused = F.col("container_tokens") - F.col("tokens")
    return space.join(texts, "window_name").select("window_name", "n_containers", "n_texts", "n_split", "tokens", "container_tokens", unused.alias("unused_tokens"), F.round(unused / F.col("container_tokens"), 6).alias("unused_share"))
