"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _hang(pairs: DataFrame) -> DataFrame:
    """For links (u, v): the smallest of u and its v as m, beside every link.  An aggregation
    (combined before the shuffle) and a join Spark can split, so a hub is no single task."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(low, "u")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (columns u, v; any order, repeats and self links
    allowed) that is not itself the smallest of its component; ``root`` is that smallest node."""
    cur = staged(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "cc-links")
    last = None
    for _ in range(max_rounds):
        now = tuple(cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last or now[0] == 0:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _hang(large)
        cur = staged(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc-links")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
