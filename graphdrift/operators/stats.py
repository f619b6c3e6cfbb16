"""Vertex statistics for the node table: degree k, module m, clustering coefficient c."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..session import Scratch
from . import build
from .triangles import triangles


def degree(g: Graph) -> DataFrame:
    """(id, in_degree, out_degree, degree) counting every link (self-links count at both ends)."""
    both = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                             F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    ends = g.edges.select(both.alias("e")).select("e.id", "e.i", "e.o")
    d = ends.groupBy("id").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"))
    v = g.vertices.select("id").join(d, "id", "left")
    i = F.coalesce(F.col("in_degree"), F.lit(0).cast("long"))
    o = F.coalesce(F.col("out_degree"), F.lit(0).cast("long"))
    return v.select("id", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree"))


def label_propagation(g: Graph, rounds: int = 5) -> DataFrame:
    """(id, module): synchronous label propagation on the undirected simple graph.

    Start: module = id.  Each round every vertex takes the module held by most of its
    neighbours, ties broken by the smallest module; vertices without neighbours keep
    theirs.  The arg-max is an aggregation of max(struct(count, -module)) per vertex, so a
    hub's candidates are combined map-side and never gathered into one task; the join of links
    and labels is an ordinary shuffle join, which AQE splits at a hub.  Every round's labels
    are a work table, deleted after the next round; the last one is the result.
    """
    spark = g.vertices.sparkSession
    links = Scratch(spark)
    pairs = links.table(build.undirected_pairs(g.edges), "lp_pairs")
    labels, work = g.vertices.select("id", F.col("id").alias("module")), None
    for r in range(1, rounds + 1):
        votes = (pairs.join(labels.select(F.col("id").alias("src"), "module"), "src")
                 .groupBy(F.col("dst").alias("id"), "module").agg(F.count(F.lit(1)).alias("votes")))
        best = votes.groupBy("id").agg(F.max(F.struct(F.col("votes"), (-F.col("module")).alias("neg"))).alias("b"))
        before, work = work, Scratch(spark)
        labels = work.table(labels.join(best, "id", "left").select(
            "id", F.coalesce(-F.col("b.neg"), F.col("module")).alias("module")), f"lp_labels{r}")
        if before is not None:
            before.drop()
    links.drop()
    return labels


def _degrees(pairs: DataFrame) -> DataFrame:
    """(id, deg) of the vertices of linked pairs, each pair once."""
    return pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))


def _oriented(pairs: DataFrame, deg: DataFrame) -> DataFrame:
    of = lambda end: deg.select(F.col("id").alias(end), F.col("deg").alias(f"{end}_deg"))
    lower = F.col("src_deg") <= F.col("dst_deg")                         # of equal degrees the smaller id, src, is lower
    first = lambda a, b: F.when(lower, F.col(a)).otherwise(F.col(b))
    return pairs.join(of("src"), "src").join(of("dst"), "dst").select(
        first("src", "dst").alias("u"), first("dst", "src").alias("v"),
        first("src_deg", "dst_deg").alias("du"), first("dst_deg", "src_deg").alias("dv"))


def oriented_edges(g: Graph) -> DataFrame:
    """(u, v, du, dv): simple undirected graph with each edge oriented from lower to higher
    (degree, id) rank, with both undirected degrees."""
    pairs = build.unordered_pairs(g.edges)
    return _oriented(pairs, _degrees(pairs))


def clustering_coefficient(g: Graph) -> DataFrame:
    """(id, degree, triangles, clustering) with c = 2 t / (d (d - 1)), 0 when d < 2.  Linked pairs, oriented
    edges and lists are work tables that go before it returns; degrees and triangles by vertex are left until
    ``session.clear_work``."""
    work, kept = Scratch(g.vertices.sparkSession), Scratch(g.vertices.sparkSession)
    pairs = work.table(build.unordered_pairs(g.edges), "pairs")
    deg = kept.table(_degrees(pairs), "degrees")
    oriented = work.table(_oriented(pairs, deg), "oriented")
    found = kept.table(triangles(oriented, scratch=work), "triangles")
    work.drop()
    v = g.vertices.select("id").join(deg, "id", "left").join(found, "id", "left")
    d = F.coalesce(F.col("deg"), F.lit(0).cast("long"))
    tr = F.coalesce(F.col("triangles"), F.lit(0).cast("long"))
    c = F.when(d >= 2, F.lit(2.0) * tr / (d * (d - F.lit(1)))).otherwise(F.lit(0.0))
    return v.select("id", d.alias("degree"), tr.alias("triangles"), c.alias("clustering"))
