"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id that has an edge.

    ``edges``: two long columns, any order, repeats and loops allowed. Returns
    ``(id, root)`` without the roots themselves; no edges give no rows. Alternates
    large-star and small-star steps, so a hub costs one row per neighbour and round,
    and writes each round to the shared folder; a round's table goes when the next stands.
    """
    tables = Scratch(edges.sparkSession, "edges")
    a, b = edges.columns
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    e, path = tables.put(e)
    before = None
    for _ in range(rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state
        e, new = tables.put(_small_star(_large_star(e).distinct()).distinct())
        tables.drop(path)
        path = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
