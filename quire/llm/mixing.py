"""Problem 7: mixing sources to target weights, repeating small sources at most a capped number of times.

Method: systematic sampling. The size of the mix, the one asked for or else the largest in which every source
reaches its share, fixes how many copies a document of each source is expected to give (at most the cap; what a
capped source falls short of is shared out among the others, in their proportions); the expected copies are summed up along the source, one
random offset is added, and a document is emitted once for every integer that its stretch crosses. Documents
stand in order of size class, so that every stretch of the sum holds the source's usual sizes and the
tokens drawn come very close to the share.

The prefix sum never puts a source into one task: documents are numbered inside (source, size class, salt)
cells, and the cells, a bounded number per source, carry the offsets.

Defined results: source labels are compared in lower case, trimmed, with blanks and hyphens as underscores;
a blank label matches nothing; texts without tokens are never drawn; a target without any tokens gives no
rows and its mix is drawn from the others in their own proportions, its report showing 0; a label typed in two
ways within a mix is one source, with the sum of its shares and the smaller cap; repeated ids are
documents of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES_PER_DOUBLING = 8
CELL = 100_000  # documents of a source to a salt


def source_key(col: Column) -> Column:
    """One form for carelessly typed source labels."""
    return F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]+", "_")


def _offset(seed: int) -> Column:
    """One offset in [0, 1) for each mix and source: a multiple of 2**-20, so sums stay exact."""
    return F.pmod(F.xxhash64("mix_name", "source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _folded(targets: DataFrame) -> DataFrame:
    """One row a mix and source."""
    wanted = targets.select("mix_name", source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    return wanted.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def mixture(items: DataFrame, targets: DataFrame, seed: int = 7, total_tokens: int | None = None) -> DataFrame:
    """(mix_name, source, id, n_tokens, copies), copies >= 1.

    ``items`` is (id, n_tokens, source), ``targets`` (mix_name, source, target_share, max_repeats), a table
    that does not grow with the data: it and the totals of its sources are held by the driver. ``total_tokens`` is
    the size of each mix; without it a mix is as large as its scarcest source allows.
    """
    spark = items.sparkSession
    size_class = F.floor(F.log2(F.col("n_tokens").cast("double")) * CLASSES_PER_DOUBLING).cast("int")
    wanted = [r.asDict() for r in _folded(targets).where("target_share > 0 and max_repeats > 0").collect()]
    rows = items.select("id", "n_tokens", source_key(F.col("source")).alias("source")).where("n_tokens > 0 and source <> ''").where(F.col("source").isin(sorted({w["source"] for w in wanted if w["source"]})))
    totals = {r["source"]: (r["n"], r["tokens"]) for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()}
    salts = F.broadcast(spark.createDataFrame([(s, -(-n // CELL)) for s, (n, _) in totals.items()], "source string, salts int"))
    rates = F.broadcast(spark.createDataFrame(_rates(wanted, totals, total_tokens), "mix_name string, source string, rate double"))
    cells = rows.join(salts, "source").withColumn("size_class", size_class).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("salts")).cast("int")).drop("salts")
    counted = cells.groupBy("source", "size_class", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("size_class", "salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.withColumn("before", F.coalesce(before, F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("source", "size_class", "salt").orderBy("n_tokens", "id"))
    placed = cells.withColumn("rank", rank).join(offsets.select("source", "size_class", "salt", "before"), ["source", "size_class", "salt"])
    place = (F.col("before") + F.col("rank")).cast("double")
    copies = F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))
    drawn = placed.join(rates.withColumn("offset", _offset(seed)), "source").withColumn("copies", copies.cast("int"))
    return drawn.where("copies > 0").select("mix_name", "source", "id", "n_tokens", "copies")


def _rates(wanted: list[dict], totals: dict[str, tuple[int, int]], total_tokens: int | None) -> list[tuple[str, str, float]]:
    """(mix_name, source, expected copies of each document)."""
    out = []
    for mix in sorted({w["mix_name"] for w in wanted}, key=str):
        open_ = {w["source"]: (w["target_share"], w["max_repeats"] * totals[w["source"]][1]) for w in wanted if w["mix_name"] == mix and w["source"] in totals}
        if not open_:
            continue
        given: dict[str, float] = {}
        left = min(most / share for share, most in open_.values()) * sum(share for share, _ in open_.values()) if total_tokens is None else float(total_tokens)
        while open_:
            shares = sum(share for share, _ in open_.values())
            capped = {s: most for s, (share, most) in open_.items() if left * share / shares >= most}
            if not capped:
                given |= {s: left * share / shares for s, (share, _) in open_.items()}
                break
            given |= capped
            left -= sum(capped.values())
            open_ = {s: x for s, x in open_.items() if s not in capped}
        out += [(mix, s, tokens / totals[s][1]) for s, tokens in given.items() if tokens > 0]
    return out


def mixture_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, shortfall, tokens, n_documents, n_copies, most_copies, max_repeats)."""
    per = drawn.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_documents"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    wanted = _folded(targets)
    zero = F.lit(0).cast("long")
    all_ = wanted.join(per, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", zero))
    share = F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy("mix_name")), zero)
    actual = F.round(F.coalesce(share, F.lit(0.0)), 6)
    short = F.round(F.greatest(F.col("target_share") - actual, F.lit(0.0)), 6)
    return all_.select("mix_name", "source", "target_share", actual.alias("actual_share"), short.alias("shortfall"), "tokens", F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("n_copies", zero).alias("n_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats")
