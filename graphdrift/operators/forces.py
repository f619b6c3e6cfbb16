"""Force operators: ideal length, repulsion (all pairs / radius / neighbours), attraction,
gravity, superposition.  All are joins and keyed aggregations over Column arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..model import Graph, LayoutParams
from ..session import Scratch
from . import build
from .blocks import DealtLinks, LinkBlocks
from .multipole import cauchy_repulsion


def ideal_length_frame(vertices: DataFrame, params: LayoutParams) -> DataFrame:
    """One row: n and k = kf * sqrt(area / n)."""
    return vertices.agg(F.count(F.lit(1)).alias("n")).select(
        "n", (F.lit(params.kf) * F.sqrt(F.lit(params.area) / F.col("n"))).alias("k"))


def ideal_length(vertices: DataFrame, params: LayoutParams) -> float:
    """k as a driver scalar (one count job), used as a literal in later plans."""
    return params.ideal_length(vertices.count())


def _zero_filled(vertices: DataFrame, per_id: DataFrame, fx: str = "fx", fy: str = "fy") -> DataFrame:
    return vertices.select("id").join(per_id, "id", "left").select(
        "id", F.coalesce(F.col(fx), F.lit(0.0)).alias("dx"), F.coalesce(F.col(fy), F.lit(0.0)).alias("dy"))


# --------------------------------------------------------------------------- repulsion

def repulsion_all(vertices: DataFrame, k: float, params: LayoutParams, terms: int = 32,
                  scratch: Scratch | None = None) -> DataFrame:
    """Repulsion on every vertex from all others, (id, dx, dy), via the multipole sum:
    O(n) rows, no pair enumeration."""
    raw = cauchy_repulsion(vertices.select("id", "x", "y"), params.eps, terms=terms, scratch=scratch)
    f = params.rep_scale * k * k
    return raw.select("id", (F.col("fx") * F.lit(f)).alias("dx"), (F.col("fy") * F.lit(f)).alias("dy"))


def repulsion_radius(vertices: DataFrame, k: float, params: LayoutParams, radius: float,
                     terms: int = 32, leaf_capacity: int = 256, scratch: Scratch | None = None) -> DataFrame:
    """Repulsion from vertices within ``radius`` only, (id, dx, dy).

    Same tree traversal as the all-pairs sum with the radius as a cut: cell pairs wholly
    inside it are translated, wholly outside dropped, and only pairs straddling it are
    summed pair by pair, so a dense spot inside one radius does not enumerate its pairs.
    Leaves hold up to 256 positions here: a translation costs about as much as a thousand
    direct pairs, so it only pays off between well-filled cells."""
    raw = cauchy_repulsion(vertices.select("id", "x", "y"), params.eps, terms=terms, radius=radius,
                           leaf_capacity=leaf_capacity, scratch=scratch)
    f = params.rep_scale * k * k
    return raw.select("id", (F.col("fx") * F.lit(f)).alias("dx"), (F.col("fy") * F.lit(f)).alias("dy"))


def repulsion_neighbors(g: Graph, k: float, params: LayoutParams) -> DataFrame:
    """Repulsion from linked vertices only (either direction, each neighbour once)."""
    return _zero_filled(g.vertices, _neighbor_rows(g, k, params))


def _neighbor_rows(g: Graph, k: float, params: LayoutParams) -> DataFrame:
    """(id, fx, fy), summed by id; a pair is met once and repels both ends alike."""
    pos = g.vertices.select("id", "x", "y")
    j = (build.unordered_pairs(g.edges).join(pos.select(F.col("id").alias("src"), "x", "y"), "src")
         .join(pos.select(F.col("id").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy")), "dst"))
    fx, fy = vec.repulsion(F.col("ox") - F.col("x"), F.col("oy") - F.col("y"), k, params.rep_scale, params.eps)
    return _both_ends(j.select("src", "dst", fx.alias("mx"), fy.alias("my"))).groupBy("id").agg(
        F.sum("dx").alias("fx"), F.sum("dy").alias("fy"))


def repulsion(g: Graph, k: float, params: LayoutParams) -> DataFrame:
    if params.repulsion == "all":
        return repulsion_all(g.vertices, k, params)
    if params.repulsion == "radius":
        return repulsion_radius(g.vertices, k, params, params.radius)
    if params.repulsion == "neighbors":
        return repulsion_neighbors(g, k, params)
    return g.vertices.select("id", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))


# --------------------------------------------------------------------------- attraction

def attraction_links(g: Graph, k: float, params: LayoutParams, weighted: bool | None = None) -> DataFrame:
    """One row per link: (src, dst, mx, my), the pull added to dst and taken from src."""
    w = params.weighted if weighted is None else weighted
    t = build.triplets(g)
    mx, my = vec.attraction(F.col("src_x") - F.col("dst_x"), F.col("src_y") - F.col("dst_y"), k,
                            params.attr_scale, params.eps, F.col("weight") if w else None)
    return t.select("src", "dst", mx.alias("mx"), my.alias("my"))


def _both_ends(m: DataFrame) -> DataFrame:
    """(id, dx, dy) rows for both ends of every link from one pass over the link table:
    +m for the target, -m for the source."""
    ends = F.explode(F.array(
        F.struct(F.col("dst").alias("id"), F.col("mx").alias("dx"), F.col("my").alias("dy")),
        F.struct(F.col("src").alias("id"), (-F.col("mx")).alias("dx"), (-F.col("my")).alias("dy"))))
    return m.select(ends.alias("e")).select("e.id", "e.dx", "e.dy")


def attraction_dealt(vertices: DataFrame, dealt: LinkBlocks, k: float, params: LayoutParams) -> DataFrame:
    """As ``attraction_links`` over links dealt to blocks: one row per distinct link, with the pull of all its copies."""
    mx, my = vec.attraction(F.col("src_x") - F.col("dst_x"), F.col("src_y") - F.col("dst_y"), k, params.attr_scale,
                            params.eps, F.col("weight") if params.weighted else F.col("copies"))
    return dealt.triplets(vertices).select("src", "dst", mx.alias("mx"), my.alias("my"))


def attraction_both_ends(g: Graph, k: float, params: LayoutParams, weighted: bool | None = None) -> DataFrame:
    per_id = _both_ends(attraction_links(g, k, params, weighted)).groupBy("id").agg(
        F.sum("dx").alias("fx"), F.sum("dy").alias("fy"))
    return _zero_filled(g.vertices, per_id)


def attraction_target_only(g: Graph, k: float, params: LayoutParams, weighted: bool | None = None) -> DataFrame:
    """One message-passing superstep: the pull is delivered to the link target only."""
    m = attraction_links(g, k, params, weighted)
    per_id = m.groupBy(F.col("dst").alias("id")).agg(F.sum("mx").alias("fx"), F.sum("my").alias("fy"))
    return _zero_filled(g.vertices, per_id)


def attraction(g: Graph, k: float, params: LayoutParams) -> DataFrame:
    if params.attraction == "target":
        return attraction_target_only(g, k, params)
    return attraction_both_ends(g, k, params)


# --------------------------------------------------------------------------- gravity, total

def gravity(vertices: DataFrame, params: LayoutParams) -> DataFrame:
    gx, gy = vec.gravity(F.col("x"), F.col("y"), params.gravity, params.eps)
    return vertices.select("id", gx.alias("dx"), gy.alias("dy"))


def _neighbor_rows_dealt(vertices: DataFrame, pairs: LinkBlocks, k: float, params: LayoutParams) -> DataFrame:
    """(id, dx, dy) rows of repulsion from neighbours, pairs dealt to blocks; a pair repels both ends alike."""
    fx, fy = vec.repulsion(F.col("dst_x") - F.col("src_x"), F.col("dst_y") - F.col("src_y"), k, params.rep_scale,
                           params.eps)
    return _both_ends(pairs.triplets(vertices).select("src", "dst", fx.alias("mx"), fy.alias("my")))


def _repulsion_rows(g: Graph, k: float, params: LayoutParams, scratch: Scratch | None,
                    dealt: DealtLinks | None) -> DataFrame | None:
    """Repulsion (id, dx, dy), up to a sum by id; vertices without a contribution may be missing."""
    if params.repulsion == "all":
        return repulsion_all(g.vertices, k, params, scratch=scratch)
    if params.repulsion == "radius":
        return repulsion_radius(g.vertices, k, params, params.radius, scratch=scratch)
    if params.repulsion == "neighbors":
        if dealt is not None:
            return _neighbor_rows_dealt(g.vertices, dealt.pairs, k, params)
        return _neighbor_rows(g, k, params).select("id", F.col("fx").alias("dx"), F.col("fy").alias("dy"))
    return None


def _attraction_rows(g: Graph, k: float, params: LayoutParams, dealt: DealtLinks | None) -> DataFrame:
    """Un-aggregated attraction contributions (id, dx, dy): one row per link end."""
    m = attraction_links(g, k, params) if dealt is None else attraction_dealt(g.vertices, dealt.links, k, params)
    if params.attraction == "target":
        return m.select(F.col("dst").alias("id"), F.col("mx").alias("dx"), F.col("my").alias("dy"))
    return _both_ends(m)


def force_parts(g: Graph, k: float, params: LayoutParams, scratch: Scratch | None = None,
                dealt: DealtLinks | None = None) -> DataFrame:
    """(id, label, x, y, rep_dx, rep_dy, attr_dx, attr_dy, grav_dx, grav_dy).

    Repulsion rows and raw per-link-end attraction rows are unioned and summed by id in
    one aggregation (map-side combine, so a hub's many link ends are pre-summed per
    task), then joined once to the vertices.  With ``dealt`` the links are read from their blocks."""
    zero = F.lit(0.0)
    parts = [_attraction_rows(g, k, params, dealt).select("id", zero.alias("rep_dx"), zero.alias("rep_dy"),
                                                   F.col("dx").alias("attr_dx"), F.col("dy").alias("attr_dy"))]
    rep = _repulsion_rows(g, k, params, scratch, dealt)
    if rep is not None:
        parts.append(rep.select("id", F.col("dx").alias("rep_dx"), F.col("dy").alias("rep_dy"),
                                zero.alias("attr_dx"), zero.alias("attr_dy")))
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = ("rep_dx", "rep_dy", "attr_dx", "attr_dy")
    summed = u.groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
    gx, gy = vec.gravity(F.col("x"), F.col("y"), params.gravity, params.eps)
    v = g.vertices.select("id", "label", "x", "y")
    return (v.join(summed, "id", "left")
            .select("id", "label", "x", "y", *[F.coalesce(F.col(c), zero).alias(c) for c in names],
                    gx.alias("grav_dx"), gy.alias("grav_dy")))


def force_total(g: Graph, k: float, params: LayoutParams) -> DataFrame:
    """(id, dx, dy): repulsion + attraction + gravity."""
    p = force_parts(g, k, params)
    return p.select("id", (F.col("rep_dx") + F.col("attr_dx") + F.col("grav_dx")).alias("dx"),
                    (F.col("rep_dy") + F.col("attr_dy") + F.col("grav_dy")).alias("dy"))
