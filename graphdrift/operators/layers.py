"""Comparison of two layouts (static / functional link layers) over one vertex set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..model import Graph, LayoutParams
from ..session import Scratch
from . import build, forces, ranks


def displacement(layout_a: DataFrame, layout_b: DataFrame) -> DataFrame:
    """(id, ddx, ddy, distance, angle): move of each vertex from layout a to layout b;
    angle in degrees, atan2(ddy, ddx)."""
    a = layout_a.select("id", F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = layout_b.select("id", F.col("x").alias("xb"), F.col("y").alias("yb"))
    j = a.join(b, "id", "inner")
    ddx, ddy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    return j.select("id", ddx.alias("ddx"), ddy.alias("ddy"), vec.length(ddx, ddy).alias("distance"),
                    F.degrees(F.atan2(ddy, ddx)).alias("angle"))


def linked_pairs(*edge_sets: DataFrame) -> DataFrame:
    """Unordered vertex pairs (a < b) linked in any of the given layers."""
    u = None
    for e in edge_sets:
        p = e.filter(F.col("src") != F.col("dst")).select(
            F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        u = p if u is None else u.union(p)
    return u.distinct()


def distance_ratio(layout_a: DataFrame, layout_b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, dist_a, dist_b, ratio, relation) for the given vertex pairs: ratio = dist_b /
    dist_a (null when dist_a = 0); relation longer / shorter / same.  The two layouts are
    joined by id once, then each pair picks up both ends (three joins in all)."""
    both = layout_a.select("id", F.col("x").alias("xa"), F.col("y").alias("ya")).join(
        layout_b.select("id", F.col("x").alias("xb"), F.col("y").alias("yb")), "id", "inner")
    end = lambda tag: both.select(*[F.col(c).alias(f"{c}{tag}") for c in ("xa", "ya", "xb", "yb")],
                                  F.col("id").alias("a" if tag == "1" else "b"))
    j = pairs.join(end("1"), "a").join(end("2"), "b")
    dist_a = vec.length(F.col("xa2") - F.col("xa1"), F.col("ya2") - F.col("ya1"))
    dist_b = vec.length(F.col("xb2") - F.col("xb1"), F.col("yb2") - F.col("yb1"))
    j = j.select("a", "b", dist_a.alias("dist_a"), dist_b.alias("dist_b"))
    ratio = F.when(F.col("dist_a") > 0, F.col("dist_b") / F.col("dist_a"))
    rel = (F.when(F.col("dist_b") > F.col("dist_a"), F.lit("longer"))
           .when(F.col("dist_b") < F.col("dist_a"), F.lit("shorter")).otherwise(F.lit("same")))
    return j.select("a", "b", "dist_a", "dist_b", ratio.alias("ratio"), rel.alias("relation"))


def link_distances(static_layout: DataFrame, functional_edges: DataFrame) -> DataFrame:
    """(src, dst, weight, distance): functional links measured in the static layout."""
    g = Graph(static_layout, functional_edges)
    t = build.triplets(g)
    return t.select("src", "dst", "weight",
                    vec.length(F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y")).alias("distance"))


def distance_vs_strength(static_layout: DataFrame, functional_edges: DataFrame, bins: int = 10) -> DataFrame:
    """(strength_bin, n_links, avg_distance, min_distance, max_distance) per strength bin of
    width 1/bins over weights scaled to [0, 1]; weights outside it count in the first or last bin."""
    d = link_distances(static_layout, functional_edges)
    b = F.greatest(F.lit(0), F.least(F.floor(F.col("weight") * F.lit(bins)), F.lit(bins - 1))).cast("int")
    return d.groupBy(b.alias("strength_bin")).agg(
        F.count(F.lit(1)).alias("n_links"), F.avg("distance").alias("avg_distance"),
        F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))


def distance_strength_corr(static_layout: DataFrame, functional_edges: DataFrame) -> DataFrame:
    d = link_distances(static_layout, functional_edges)
    return d.agg(F.count(F.lit(1)).alias("n_links"), F.corr("weight", "distance").alias("corr"))


def link_ranks(static_layout: DataFrame, functional_edges: DataFrame) -> DataFrame:
    """(src, dst, weight, distance, weight_rank, distance_rank): functional links with their places by strength and by
    distance in the static layout, ties at the mean of their places.  Links without a weight are left out.  The
    links are a work table, left until ``session.clear_work``."""
    work = Scratch(static_layout.sparkSession)
    return ranks.with_ranks(work.table(link_distances(static_layout, functional_edges), "links"), ["weight", "distance"], work)


def distance_strength_rank_corr(static_layout: DataFrame, functional_edges: DataFrame) -> DataFrame:
    """One row (n_links, rank_corr): does distance fall with strength in whatever shape; null if all links are equally
    strong or long.  Leaves a work table as ``link_ranks`` does."""
    work = Scratch(static_layout.sparkSession)
    links = work.table(link_distances(static_layout, functional_edges), "links")
    return ranks.rank_correlation(links, "weight", "distance", work).withColumnRenamed("n", "n_links")


def functional_force(static_layout: DataFrame, functional_edges: DataFrame, k: float,
                     params: LayoutParams) -> DataFrame:
    """Weighted both-ends attraction of the functional links, acting in the static layout."""
    return forces.attraction_both_ends(Graph(static_layout, functional_edges), k, params, weighted=True)


def alignment(layout_a: DataFrame, layout_b: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: n_vertices, mean_displacement, n_pairs, mean_abs_log_ratio."""
    disp = displacement(layout_a, layout_b)
    r = distance_ratio(layout_a, layout_b, pairs).filter(F.col("ratio") > 0)
    pair_stats = r.select(F.struct(F.count(F.lit(1)).alias("n"),
                                   F.avg(F.abs(F.log(F.col("ratio")))).alias("m"))).scalar()
    return disp.agg(F.count(F.lit(1)).alias("n_vertices"), F.avg("distance").alias("mean_displacement")).select(
        "n_vertices", "mean_displacement", pair_stats.getField("n").alias("n_pairs"),
        pair_stats.getField("m").alias("mean_abs_log_ratio"))


def rigid_fit(layout_a: DataFrame, layout_b: DataFrame, reflect: bool = True, scale: bool = False) -> DataFrame:
    """One row: the turn (after a mirroring of y where that fits better, and with a factor if ``scale``) and shift that
    bring layout b closest to layout a over the shared vertices.

    (n, angle in degrees, flipped, factor, ax, ay, bx, by: the centres, rms_before, rms_after).  In the plane the best turn is
    the direction of one complex moment, so one aggregation of centred moments is enough.  A mirror image is taken
    only if it fits better beyond rounding; layouts without extent are only shifted; without shared vertices all but n, angle,
    flipped and factor is null.
    """
    j = layout_a.select("id", F.col("x").alias("xa"), F.col("y").alias("ya")).join(
        layout_b.select("id", F.col("x").alias("xb"), F.col("y").alias("yb")), "id")
    cov = lambda p, q: F.coalesce(F.covar_pop(p, q), F.lit(0.0))
    m = j.agg(F.count(F.lit(1)).alias("n"), F.avg("xa").alias("ax"), F.avg("ya").alias("ay"), F.avg("xb").alias("bx"),
              F.avg("yb").alias("by"), cov("xb", "xa").alias("xx"), cov("xb", "ya").alias("xy"), cov("yb", "xa").alias("yx"),
              cov("yb", "ya").alias("yy"), (cov("xa", "xa") + cov("ya", "ya")).alias("va"),
              (cov("xb", "xb") + cov("yb", "yb")).alias("vb"))
    c = F.col
    turn, mirror = (c("xx") + c("yy"), c("xy") - c("yx")), (c("xx") - c("yy"), c("xy") + c("yx"))
    flipped = (vec.length(*mirror) > vec.length(*turn) * F.lit(1 + 1e-9)) if reflect else F.lit(False)
    m = m.withColumn("flipped", flipped)
    co, si = (F.when(c("flipped"), mirror[i]).otherwise(turn[i]) for i in (0, 1))
    gain = vec.length(co, si)
    factor = F.when(c("vb") > 0, gain / F.when(c("vb") > 0, c("vb"))).otherwise(F.lit(1.0)) if scale else F.lit(1.0)
    m = m.select("*", F.degrees(F.atan2(si, co)).alias("angle"), factor.alias("factor"), gain.alias("gain"))
    before = c("va") + c("vb") - F.lit(2.0) * (c("xx") + c("yy")) + (c("ax") - c("bx")) ** 2 + (c("ay") - c("by")) ** 2
    after = c("va") + c("factor") * c("factor") * c("vb") - F.lit(2.0) * c("factor") * c("gain")
    rms = lambda e: F.when(c("n") > 0, F.sqrt(F.greatest(F.lit(0.0), e)))
    return m.select("n", "angle", "flipped", "factor", "ax", "ay", "bx", "by",
                    rms(before).alias("rms_before"), rms(after).alias("rms_after"))


def aligned(layout_a: DataFrame, layout_b: DataFrame, reflect: bool = True, scale: bool = False) -> DataFrame:
    """Layout b (id, x, y) turned onto layout a by ``rigid_fit``; unchanged where they share no vertex.  ``displacement`` from
    a to the result is what changed between the layers beyond a turn of the whole."""
    fit = rigid_fit(layout_a, layout_b, reflect, scale)
    f = lambda name: F.col("fit").getField(name)
    b = layout_b.select("id", "x", "y", fit.select(F.struct("*")).scalar().alias("fit"))
    px, py = F.col("x") - f("bx"), (F.col("y") - f("by")) * F.when(f("flipped"), F.lit(-1.0)).otherwise(F.lit(1.0))
    co, si = (f("factor") * t(F.radians(f("angle"))) for t in (F.cos, F.sin))
    return b.select("id", F.coalesce(f("ax") + co * px - si * py, F.col("x")).alias("x"),
                    F.coalesce(f("ay") + si * px + co * py, F.col("y")).alias("y"))
