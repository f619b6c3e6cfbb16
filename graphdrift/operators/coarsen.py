"""Multilevel layout: contract heavy links, lay out the small graph, unfold it level by level.

A level is made by heavy-edge matching in rounds of mutual choice: every free vertex chooses its heaviest link to
another free one, and two that choose each other are matched.  Links are ranked by weight, then by a hash of their
ends, the same from both sides, so the best free link of any neighbourhood is always mutual and rounds match
many vertices at once.  A vertex left with matched neighbours only joins the heaviest one's cluster, so a hub's leaves do
not stop the contraction.  Choices are aggregations (max of a struct), never a window over a hub's links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..model import Graph, LayoutParams
from ..session import Scratch
from . import build, layout, step

MATCH_ROUNDS = 4


def ranked_pairs(edges: DataFrame) -> DataFrame:
    """(u, v, rank) in both directions: the simple undirected graph with summed positive weights (a null weight counts
    1), ``rank`` = (weight, hash of the ends, ends), alike from both sides."""
    lo, hi = F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")
    once = (edges.filter("src <> dst").select(lo, hi, F.coalesce(F.col("weight"), F.lit(1.0)).alias("w"))
            .groupBy("lo", "hi").agg(F.sum("w").alias("w")).filter("w > 0"))
    rank = F.struct("w", vec.unit_hash(F.lit("match"), F.col("lo"), F.col("hi")).alias("h"), "lo", "hi").alias("rank")
    return once.select(F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")),
                                         F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")))).alias("e"), rank) \
               .select("e.u", "e.v", "rank")


def clusters(g: Graph, rounds: int = MATCH_ROUNDS, kept: Scratch | None = None) -> DataFrame:
    """(id, cluster) for every vertex: matched vertices share a cluster, named by the smaller of the two ids; a vertex
    still free after ``rounds`` joins its heaviest matched neighbour, and is alone if it has none.  The result is a work
    table in ``kept`` (without one it stays until ``session.clear_work``)."""
    spark = g.vertices.sparkSession
    scratch, kept = Scratch(spark), kept or Scratch(spark)
    pairs = scratch.table(ranked_pairs(g.edges), "pairs")
    free, matched = pairs, None
    for _ in range(rounds):
        best = free.groupBy("u").agg(F.max("rank").alias("rank"))
        # a link that is the best of both its ends
        both = scratch.table(best.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
                             .select(F.explode(F.array("rank.lo", "rank.hi")).alias("id"), F.col("rank.lo").alias("cluster")), "matched")
        matched = both if matched is None else matched.unionByName(both)
        taken = both.select("id")
        free = scratch.table(free.join(taken.withColumnRenamed("id", "u"), "u", "left_anti")
                             .join(taken.withColumnRenamed("id", "v"), "v", "left_anti"), "free")
        if free.isEmpty():
            break
    matched = scratch.table(matched, "all")
    joined = (pairs.join(matched.withColumnRenamed("id", "u").drop("cluster"), "u", "left_anti")
              .join(matched.withColumnRenamed("id", "v"), "v")
              .groupBy("u").agg(F.max(F.struct("rank", "cluster")).alias("best")).select(F.col("u").alias("id"), "best.cluster"))
    every = g.vertices.select("id").join(matched.unionByName(joined), "id", "left")
    out = kept.table(every.select("id", F.coalesce("cluster", "id").alias("cluster")), "clusters")
    scratch.drop()
    return out


def contract(g: Graph, cluster: DataFrame) -> Graph:
    """One vertex per cluster (id, label, members; at the origin) and one link, with the summed weight, per pair of clusters
    that links join; links inside a cluster go."""
    of = lambda side: cluster.select(F.col("id").alias(side), F.col("cluster").alias(f"c_{side}"))
    met = g.edges.select("src", "dst", F.coalesce(F.col("weight"), F.lit(1.0)).alias("weight")).join(of("src"), "src").join(of("dst"), "dst")
    edges = (met.filter("c_src <> c_dst")
             .groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("weight").alias("weight")))
    zero = [F.lit(0.0).alias(c) for c in ("x", "y", "dx", "dy")]
    vertices = cluster.groupBy(F.col("cluster").alias("id")).agg(F.count(F.lit(1)).alias("members")) \
                      .select("id", F.col("id").cast("string").alias("label"), "members", *zero)
    return Graph(vertices, edges)


def prolong(vertices: DataFrame, cluster: DataFrame, coarse: DataFrame, k: float, params: LayoutParams) -> DataFrame:
    """``vertices`` at the positions of their clusters in ``coarse``, each shifted by up to half of ``k`` along either axis by a
    hash of its id, inside the bounds and on the grid of step eps."""
    shift = lambda axis: (vec.unit_hash(F.lit(params.seed), F.lit(f"prolong {axis}"), F.col("id")) - F.lit(0.5)) * F.lit(float(k))
    at = cluster.join(coarse.select(F.col("id").alias("cluster"), F.col("x").alias("cx"), F.col("y").alias("cy")), "cluster") \
                .select("id", "cx", "cy")
    x, y = (vec.on_grid(F.col(f"c{a}") + shift(a), params.eps) for a in "xy")
    if (b := step.bounds_of(params)) is not None:
        x, y = vec.clamp(x, b[0], b[1]), vec.clamp(y, b[2], b[3])
    label = F.col("label") if "label" in vertices.columns else F.col("id").cast("string").alias("label")
    return vertices.select("id", label).join(at, "id").select("id", "label", x.alias("x"), y.alias("y"),
                                                              F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))


def multilevel_layout(g: Graph, params: LayoutParams, smallest: int = 32, max_levels: int = 40, match_rounds: int = MATCH_ROUNDS,
                      refine: int = 10, cool: float = 0.3) -> layout.LayoutResult:
    """Contract ``g`` until a level has at most ``smallest`` vertices (or contraction stalls), lay that out by ``params`` from
    hash-drawn positions, and unfold: every finer level starts from its clusters' positions and is laid out in
    ``refine`` iterations whose first temperature is ``cool`` times that of ``params``.

    Each level has at most about half the vertices that have links of the one below, so all levels together cost about
    twice the finest one.  Vertices without links keep to themselves on every level.  Ids that occur only in links become
    vertices; duplicate ids are rejected."""
    spark = g.vertices.sparkSession
    work = Scratch(spark)
    full = build.complete_graph(g.vertices, g.edges)
    level = Graph(work.table(full.vertices, "vertices"), work.table(full.edges, "edges"))
    below, n = [], level.vertices.count()
    while n > smallest and len(below) < max_levels:
        cluster = clusters(level, match_rounds, work)
        coarse = contract(level, cluster)
        coarse = Graph(work.table(coarse.vertices, "vertices"), work.table(coarse.edges, "edges"))
        m = coarse.vertices.count()
        if m > 0.9 * n:
            break
        below.append((level, cluster, n))
        level, n = coarse, m
    result = layout.layout_shuffled(Graph(level.vertices.select("id", "label", "x", "y", "dx", "dy"), level.edges), params, complete=False)
    soft = params.but(cf=params.cf * cool, iterations=refine, max_iterations=None)
    for fine, cluster, n in reversed(below):
        start = prolong(fine.vertices, cluster, result.graph.vertices, params.ideal_length(n), params)
        result = layout.layout(Graph(start, fine.edges), soft, complete=False)
    work.drop()
    return result
