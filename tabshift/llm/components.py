"""Connected components of an edge table, by rounds of large-star and small-star (Kiveris et al., 2014).

No component is gathered anywhere: each round is two shuffles of edges, and edges shrink to one for each node. Every round
is written to the shared folder, so a lost executor costs at most one round. The number of rounds grows with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm.common import discard, staged

MAX_ROUNDS = 60
HOT_DEGREE, HOT_SHARE = 100_000, 10_000


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Large: a node's larger neighbours go to its least neighbour. Small: its smaller ones and itself do.

    The nodes of more than HOT_DEGREE and of more than one in HOT_SHARE of the ``n`` edges are few (2 * HOT_SHARE at most): their least neighbours are
    broadcast, so that their edges stay spread over all tasks.
    """
    both = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).withColumn("m", F.least("m", "u"))
    limit = max(HOT_DEGREE, n // HOT_SHARE)
    if n > limit:
        hot = F.broadcast(least.filter(F.col("d") > limit).select("u", "m"))
        joined = both.join(hot, "u").unionByName(both.join(hot, "u", "left_anti").join(least.filter(F.col("d") <= limit).select("u", "m"), "u"))
    else:
        joined = both.join(least.select("u", "m"), "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the smallest node of the component."""
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = staged(now, "components")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not mark.n or mark == before:
            break
        before = mark
        last, now = now, staged(_star(_star(now, True, mark.n), False, mark.n), "components")
        discard(last)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
