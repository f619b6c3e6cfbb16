"""Links dealt once to a grid of blocks, so that an iteration moves positions and no links.

Ids are hashed to q rows as sources and to q columns as targets; a link lies in the block of its
source's row and its target's column, so a vertex is needed by at most 2 q - 1 of the q^2 blocks,
however many links it has.  A block with more than ``block_links`` links (that of a hub) is cut into
parts by a hash of both ends, which bounds every block; the hub is then needed by more blocks, about
its links / ``block_links``.  Copies of a link are one row with their number and summed weight.

Two tables are kept partitioned on the executors' disks and backed by work tables, from which a lost
executor's share is built again: the links by block, with the places of both ends in the block's
sorted list of ids, and the routes (id, block, place) by id.  ``LinkBlocks.triplets`` sends each
position to the blocks that need it, packs one list per block and joins on the block: the links are
read where they lie.  Links with a null end, or with an end that is no vertex, are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vec
from ..session import Scratch
from . import build

BLOCK_LINKS = 1 << 17


def grid_side(n_links: int, block_links: int = BLOCK_LINKS) -> int:
    """The smallest q with n_links / q^2 <= block_links."""
    return max(1, math.ceil(math.sqrt(n_links / block_links)))


def _drawn(n, *parts):
    return F.floor(vec.unit_hash(*parts) * n).cast("long")


def _resident(df: DataFrame, key: str) -> DataFrame:
    """Rows kept partitioned and sorted by ``key``.  Built at once: the layout of a cached table is known to
    the plans that read it only when it is complete."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = df.repartition(n, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)
    kept.count()
    return kept


@dataclass(frozen=True)
class LinkBlocks:
    links: DataFrame    # block, src, dst, copies, weight, s, t (places of the ends in the block's list)
    routes: DataFrame   # id, block, at
    work: Scratch

    def triplets(self, vertices: DataFrame) -> DataFrame:
        """(src, dst, copies, weight, src_x, src_y, dst_x, dst_y) of every dealt link.  ``vertices`` holds an
        id once."""
        sent = self.routes.join(vertices.select("id", "x", "y"), "id", "left")
        packed = sent.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "x", "y"))).alias("p"))
        packed = packed.select("block", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))
        at = lambda axis, end: F.col(axis)[F.col(end)]
        return self.links.join(packed, "block").select(
            "src", "dst", "copies", "weight", at("xs", "s").alias("src_x"), at("ys", "s").alias("src_y"),
            at("xs", "t").alias("dst_x"), at("ys", "t").alias("dst_y")).dropna(subset=["src_x", "dst_x"])

    def sizes(self) -> DataFrame:
        """(block, n_links, n_vertices): what each block holds and how many positions an iteration sends to it."""
        return self.links.groupBy("block").agg(F.count(F.lit(1)).alias("n_links")).join(
            self.routes.groupBy("block").agg(F.count(F.lit(1)).alias("n_vertices")), "block")

    def drop(self) -> None:
        self.links.unpersist()
        self.routes.unpersist()
        self.work.drop()


def deal(edges: DataFrame, block_links: int = BLOCK_LINKS) -> LinkBlocks:
    """Deal the links (src, dst and, where there is one, weight).  The caller drops the result; only the two
    tables it keeps are on disk afterwards."""
    work, steps = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    one = steps.table(edges.dropna(subset=["src", "dst"]).groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("copies"), F.sum(weight).alias("weight")), "links")
    q = grid_side(one.count(), block_links)
    placed = one.withColumns({"row": _drawn(q, F.lit("row"), F.col("src")), "col": _drawn(q, F.lit("col"), F.col("dst"))})
    cut = steps.table(placed.groupBy("row", "col").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_links)).cast("long").alias("parts")), "parts")
    most = cut.agg(F.coalesce(F.max("parts"), F.lit(1))).first()[0]
    part = _drawn(F.col("parts"), F.lit("part"), F.col("src"), F.col("dst"))
    block = (F.col("row") * F.lit(q) + F.col("col")) * F.lit(most) + part
    dealt = steps.table(placed.join(cut, ["row", "col"]).select(
        block.alias("block"), "src", "dst", "copies", "weight"), "dealt")
    # a block is bounded, so its ends meet in one task: they are shuffled once, for the distinct and for the places
    ends = dealt.select("block", F.explode(F.array("src", "dst")).alias("id")).repartition("block").distinct()
    place = (F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).alias("at")
    routes = work.table(ends.select("id", "block", place), "routes")
    of = lambda end, at: routes.select("block", F.col("id").alias(end), F.col("at").alias(at))
    links = work.table(dealt.join(of("src", "s"), ["block", "src"]).join(of("dst", "t"), ["block", "dst"]).select(
        "block", "src", "dst", "copies", "weight", "s", "t"), "placed")
    steps.drop()
    return LinkBlocks(_resident(links, "block"), _resident(routes, "id"), work)


@dataclass(frozen=True)
class DealtLinks:
    """What the iterations of one layout read: the links and, for repulsion from neighbours, the linked pairs."""

    links: LinkBlocks
    pairs: LinkBlocks | None = None

    def drop(self) -> None:
        self.links.drop()
        if self.pairs is not None:
            self.pairs.drop()


def deal_for_layout(edges: DataFrame, repulsion: str, block_links: int = BLOCK_LINKS) -> DealtLinks:
    pairs = None
    if repulsion == "neighbors":
        pairs = deal(build.unordered_pairs(edges), block_links)
    return DealtLinks(deal(edges, block_links), pairs)
