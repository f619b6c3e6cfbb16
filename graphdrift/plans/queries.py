"""Registered queries: one per operator of the inventory, each over the driver tables.

Each function takes (spark, sf_dir) and returns a DataFrame whose double columns are
rounded to 4 decimals (``r4``) so that results can be compared across engines.
Parameters used here are shared with ``oracle.py`` through the constants below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import on_grid, r4
from ..model import Graph, LayoutParams
from ..operators import blocks, build, coarsen, forces, layers, layout, messages, modules, stats, step
from ..sinks import export
from ..sources import edgelist, views

# Parameters of the registered queries (shared with the oracle).
TRADE = LayoutParams()                                   # 10000 x 10000, rep 0.01, attr 1, centred box
GRAVITY = 5.0
RADIUS = 300.0
SPOT = 1e-6                                              # of the box: how wide the dense spot is
SAMPLE_FRACTION = 0.125
SAMPLE_SEED = 1
SHUFFLE_SEED = 17
LP_ROUNDS = 5
HOPS_FROM = 2
MOVE_ROUNDS = 2
UNIT = LayoutParams(width=1000.0, height=1000.0, rep_scale=0.0001, attr_scale=0.00001, step="unit",
                    bounds="none", iterations=3)
LAYER_ITERATIONS = 2
QUERY_BLOCK = 1 << 10                                    # links to a block, small enough that small tables need a grid
# Layouts of the part-supplier graph, one for each kind of force, step and bounds.
VARIANTS = {
    "layout_all_pairs_supply": TRADE.but(iterations=2),
    "layout_gravity": TRADE.but(iterations=2, gravity=GRAVITY),
    "layout_inverse_corner": TRADE.but(iterations=2, step="inverse_iteration", bounds="corner", repulsion="neighbors"),
    "layout_target_only": TRADE.but(iterations=2, attraction="target", repulsion="neighbors"),
    "layout_neighbors": TRADE.but(iterations=2, repulsion="neighbors"),
    "layout_link_blocks": TRADE.but(iterations=2, repulsion="neighbors", links="blocks", block_links=QUERY_BLOCK),
}
SUPPLY_LAYER = TRADE.but(iterations=1, repulsion="neighbors")
JOB = TRADE.but(iterations=1, weighted=True)


def _r(df: DataFrame, keep: list[str], rnd: list[str]) -> DataFrame:
    return df.select(*keep, *[r4(F.col(c)).alias(c) for c in rnd])


def _k(g: Graph, p: LayoutParams) -> float:
    return forces.ideal_length(g.vertices, p)


# ----------------------------------------------------------------------------- sources

def q_edge_list_parse(spark, d):
    return edgelist.parse_edge_lines(views.edge_lines(spark, d, with_comments=False))


def q_edge_list_comments(spark, d):
    return edgelist.parse_edge_lines(edgelist.drop_comments(views.edge_lines(spark, d, with_comments=True)))


def q_edge_sample(spark, d):
    lines = edgelist.drop_comments(views.edge_lines(spark, d, with_comments=True))
    return edgelist.parse_edge_lines(edgelist.sample_lines(lines, SAMPLE_FRACTION, SAMPLE_SEED))


def q_functional_layer(spark, d):
    return _r(views.trade_functional_edges(spark, d), ["src", "dst"], ["weight"])


# ----------------------------------------------------------------------------- construction

def q_vertices_from_edges(spark, d):
    return build.vertices_from_edges(views.supply_edges(spark, d))


def q_graph_complete(spark, d):
    g = build.complete_graph(views.geo_vertices(spark, d, with_regions=False), views.geo_edges(spark, d))
    return _r(g.vertices, ["id", "label"], ["x", "y", "dx", "dy"])


def _raw_edges(lines):
    parts = F.split(F.col("value"), "\t")
    return lines.select(parts.getItem(0).cast("long").alias("src"), parts.getItem(1).cast("long").alias("dst"),
                        parts.getItem(2).alias("weight"))


def q_graph_convert(spark, d):
    """Converted vertices, with the sum of the converted weights of the links each one starts."""
    g = build.convert(_raw_edges(views.edge_lines(spark, d, with_comments=False)), TRADE.width, TRADE.height)
    w = g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("weight_out"))
    v = g.vertices.join(w, "id", "left").withColumn("weight_out", F.coalesce("weight_out", F.lit(0.0)))
    return _r(v, ["id", "label"], ["x", "y", "dx", "dy", "weight_out"])


def q_positions_shuffle(spark, d):
    v = build.shuffle_positions(views.supply_vertices(spark, d), TRADE.width, TRADE.height, SHUFFLE_SEED)
    return _r(v, ["id", "label"], ["x", "y"])


def q_edges_symmetric(spark, d):
    return build.symmetric_edges(views.trade_edges(spark, d))


def q_graph_size(spark, d):
    return build.graph_size(views.supply(spark, d))


def q_triplets(spark, d):
    return _r(build.triplets(views.trade(spark, d)), ["src", "dst", "src_label", "dst_label"],
              ["weight", "src_x", "src_y", "dst_x", "dst_y"])


def q_attach_displacement(spark, d):
    g = views.supply(spark, d)
    k = _k(g, TRADE)
    pulls = forces.attraction_links(g, k, TRADE).groupBy(F.col("dst").alias("id")).agg(
        F.sum("mx").alias("dx"), F.sum("my").alias("dy"))
    return _r(build.attach_displacement(g.vertices, pulls), ["id", "label"], ["x", "y", "dx", "dy"])


def q_superpose_union(spark, d):
    g = views.trade(spark, d)
    p = TRADE.but(gravity=GRAVITY)
    k = _k(g, p)
    s = build.superpose(forces.attraction_target_only(g, k, p), forces.gravity(g.vertices, p))
    return _r(s, ["id"], ["dx", "dy"])


# ----------------------------------------------------------------------------- forces

def q_ideal_length(spark, d):
    return _r(forces.ideal_length_frame(views.supply_vertices(spark, d), TRADE), ["n"], ["k"])


def q_repulsion_all_pairs(spark, d):
    g = views.supply(spark, d)
    return _r(forces.repulsion_all(g.vertices, _k(g, TRADE), TRADE), ["id"], ["dx", "dy"])


def q_repulsion_dense_spot(spark, d):
    """All suppliers crowded on the grid within 0.01 units of the middle of the 10,000 box (forces in thousands)."""
    g = views.supply(spark, d)
    crowd = lambda c: F.when(F.col("id") % 2 == 1, on_grid(F.col(c) * F.lit(SPOT), TRADE.eps)).otherwise(F.col(c)).alias(c)
    v = g.vertices.select("id", crowd("x"), crowd("y"))
    f = forces.repulsion_all(v, _k(g, TRADE), TRADE)
    return f.select("id", r4(F.col("dx") / 1000.0).alias("kdx"), r4(F.col("dy") / 1000.0).alias("kdy"))


def q_repulsion_neighbors(spark, d):
    g = views.supply(spark, d)
    return _r(forces.repulsion_neighbors(g, _k(g, TRADE), TRADE), ["id"], ["dx", "dy"])


def q_repulsion_radius(spark, d):
    g = views.supply(spark, d)
    return _r(forces.repulsion_radius(g.vertices, _k(g, TRADE), TRADE, RADIUS), ["id"], ["dx", "dy"])


def q_attraction_links(spark, d):
    g = views.supply(spark, d)
    return _r(forces.attraction_links(g, _k(g, TRADE), TRADE), ["src", "dst"], ["mx", "my"])


def q_attraction_dealt(spark, d):
    """Pull of every distinct link, the links read from their blocks."""
    g = views.supply(spark, d)
    pulls = forces.attraction_dealt(g.vertices, blocks.deal(g.edges, QUERY_BLOCK), _k(g, TRADE), TRADE)
    return _r(pulls, ["src", "dst"], ["mx", "my"])


def q_link_blocks(spark, d):
    """Links of each block of the grid and the vertices it needs."""
    return blocks.deal(views.supply_edges(spark, d), QUERY_BLOCK).sizes()


def q_link_routes(spark, d):
    """Blocks that need each vertex: the positions an iteration sends."""
    routes = blocks.deal(views.supply_edges(spark, d), QUERY_BLOCK).routes
    return routes.groupBy("id").agg(F.count(F.lit(1)).alias("n_blocks"))


def q_attraction_both_ends(spark, d):
    g = views.supply(spark, d)
    return _r(forces.attraction_both_ends(g, _k(g, TRADE), TRADE), ["id"], ["dx", "dy"])


def q_attraction_target_only(spark, d):
    g = views.supply(spark, d)
    return _r(forces.attraction_target_only(g, _k(g, TRADE), TRADE), ["id"], ["dx", "dy"])


def q_gravity(spark, d):
    return _r(forces.gravity(views.supply_vertices(spark, d), TRADE.but(gravity=GRAVITY)), ["id"], ["dx", "dy"])


def _trade_total(spark, d):
    g = views.trade(spark, d)
    p = TRADE.but(gravity=GRAVITY)
    return g, p, forces.force_total(g, _k(g, p), p)


def q_force_total(spark, d):
    return _r(_trade_total(spark, d)[2], ["id"], ["dx", "dy"])


# ----------------------------------------------------------------------------- step

def q_cooling_schedule(spark, d):
    """The cooling plan beside the longest step a run of it took at each temperature (after the
    last one there is none)."""
    p = TRADE.but(iterations=3)
    run = layout.layout(views.trade(spark, d), p, report=True).report
    run = run.select((F.col("iteration") - 1).cast("long").alias("iteration"), "max_step")
    plan = step.cooling_schedule(spark, p).join(run, "iteration", "left")
    return _r(plan.withColumn("max_step", F.coalesce("max_step", F.lit(0.0))), ["iteration"], ["temperature", "max_step"])


def q_displacement_length(spark, d):
    return _r(step.displacement_length(_trade_total(spark, d)[2]), ["id"], ["dx", "dy", "length"])


def q_step_temperature_cap(spark, d):
    _, p, tot = _trade_total(spark, d)
    return _r(step.scaled_step(tot, p, 1, p.temperature(0)), ["id"], ["sx", "sy"])


def q_step_inverse_iteration(spark, d):
    _, p, tot = _trade_total(spark, d)
    p = p.but(step="inverse_iteration")
    return _r(step.scaled_step(tot, p, 3, p.temperature(2)), ["id"], ["sx", "sy"])


def _update(spark, d, bounds):
    g, p, tot = _trade_total(spark, d)
    p = p.but(bounds=bounds)
    moved = step.move(g.vertices, step.scaled_step(tot, p, 1, p.temperature(0)), p)
    return _r(moved, ["id", "label"], ["x", "y", "dx", "dy"])


def q_update_clamp_corner(spark, d):
    return _update(spark, d, "corner")


def q_update_clamp_center(spark, d):
    return _update(spark, d, "center")


# ----------------------------------------------------------------------------- layouts

def _layout_vertices(res) -> DataFrame:
    return _r(res.graph.vertices, ["id", "label"], ["x", "y", "dx", "dy"])


def q_layout_fr_1(spark, d):
    return _layout_vertices(layout.layout(views.trade(spark, d), TRADE.but(iterations=1)))


def q_layout_fr_3(spark, d):
    return _layout_vertices(layout.layout(views.trade(spark, d), TRADE.but(iterations=3)))


def q_layout_fr_unit(spark, d):
    return _layout_vertices(layout.layout(views.trade(spark, d, UNIT.width, UNIT.height, bounds=UNIT.bounds), UNIT))


def q_layout_early_stop(spark, d):
    return _layout_vertices(layout.layout(views.trade(spark, d), TRADE.but(max_iterations=2)))


def q_layout_shuffled(spark, d):
    p = TRADE.but(iterations=2, seed=SHUFFLE_SEED)
    return _layout_vertices(layout.layout_shuffled(views.trade(spark, d), p))


def q_layout_radius(spark, d):
    """Two iterations on the part-supplier graph with radius-limited repulsion."""
    p = TRADE.but(iterations=2, repulsion="radius", radius=RADIUS)
    return _layout_vertices(layout.layout(views.supply(spark, d), p))


def _variant(name):
    def run(spark, d):
        return _layout_vertices(layout.layout(views.supply(spark, d), VARIANTS[name]))
    return run


def q_edge_list_layout(spark, d):
    """The edge-list job over derived text: comments dropped, lines converted, laid out, node table."""
    lines = edgelist.drop_comments(views.edge_lines(spark, d, with_comments=True))
    g = build.convert(_raw_edges(lines), JOB.width, JOB.height, JOB.seed, JOB.bounds, JOB.eps)
    v = layout.layout(g, JOB, complete=False).graph.vertices
    return _r(v.select(F.col("label").alias("Id"), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("dx").alias("dX"),
                       F.col("dy").alias("dY")), ["Id"], ["X", "Y", "dX", "dY"])


def q_layout_trace(spark, d):
    res = layout.layout(views.trade(spark, d), TRADE.but(iterations=2), trace=True)
    return _r(res.trace, ["iteration", "phase", "id"], ["x", "y", "dx", "dy"])


def q_layout_report(spark, d):
    res = layout.layout(views.trade(spark, d), TRADE.but(iterations=3), report=True)
    return _r(res.report, ["iteration", "n", "n_edges"], ["temperature", "k", "total_step", "max_step"])


# ----------------------------------------------------------------------------- statistics

def q_degree(spark, d):
    return stats.degree(views.supply(spark, d))


def q_module_label_propagation(spark, d):
    return stats.label_propagation(views.supply(spark, d), LP_ROUNDS)


def q_clustering_coefficient(spark, d):
    return _r(stats.clustering_coefficient(views.trade(spark, d)), ["id", "degree", "triangles"], ["clustering"])


def q_clustering_market(spark, d):
    """Triangles of customers, parts and suppliers that trade with each other."""
    return _r(stats.clustering_coefficient(views.market(spark, d)), ["id", "degree", "triangles"], ["clustering"])


# ----------------------------------------------------------------------------- layers

def _two_layouts(spark, d):
    static = layout.layout(views.trade(spark, d), TRADE.but(iterations=LAYER_ITERATIONS))
    func = layout.layout(views.trade_functional(spark, d), TRADE.but(iterations=LAYER_ITERATIONS, weighted=True))
    return static, func


def q_layer_displacement(spark, d):
    s, f = _two_layouts(spark, d)
    return _r(layers.displacement(s.graph.vertices, f.graph.vertices), ["id"], ["ddx", "ddy", "distance", "angle"])


def q_layer_distance_ratio(spark, d):
    s, f = _two_layouts(spark, d)
    pairs = layers.linked_pairs(s.graph.edges, f.graph.edges)
    r = layers.distance_ratio(s.graph.vertices, f.graph.vertices, pairs)
    return _r(r, ["a", "b", "relation"], ["dist_a", "dist_b", "ratio"])


def q_distance_vs_strength(spark, d):
    s, f = _two_layouts(spark, d)
    r = layers.distance_vs_strength(s.graph.vertices, f.graph.edges)
    return _r(r, ["strength_bin", "n_links"], ["avg_distance", "min_distance", "max_distance"])


def q_distance_strength_corr(spark, d):
    s, f = _two_layouts(spark, d)
    return _r(layers.distance_strength_corr(s.graph.vertices, f.graph.edges), ["n_links"], ["corr"])


def q_link_ranks(spark, d):
    g = views.supply(spark, d)
    return _r(layers.link_ranks(g.vertices, g.edges), ["src", "dst"], ["weight_rank", "distance_rank"])


def q_distance_strength_ranks(spark, d):
    g = views.supply(spark, d)
    return _r(layers.distance_strength_rank_corr(g.vertices, g.edges), ["n_links"], ["rank_corr"])


def _supply_layers(spark, d):
    """Parts and suppliers moved once by all links alike, and by links as strong as the quantity."""
    g = views.supply(spark, d)
    return [layout.layout(g, SUPPLY_LAYER.but(weighted=w)).graph.vertices for w in (False, True)]


def q_layer_rigid_fit(spark, d):
    fit = layers.rigid_fit(*_supply_layers(spark, d))
    return _r(fit, ["n", "flipped"], ["angle", "rms_before", "rms_after"])


def q_layer_turned_displacement(spark, d):
    a, b = _supply_layers(spark, d)
    return _r(layers.displacement(a, layers.aligned(a, b)), ["id"], ["ddx", "ddy", "distance"])


def q_functional_force(spark, d):
    s = layout.layout(views.trade(spark, d), TRADE.but(iterations=LAYER_ITERATIONS))
    fe = views.trade_functional_edges(spark, d)
    return _r(layers.functional_force(s.graph.vertices, fe, s.k, TRADE), ["id"], ["dx", "dy"])


def q_layer_alignment(spark, d):
    s, f = _two_layouts(spark, d)
    pairs = layers.linked_pairs(s.graph.edges, f.graph.edges)
    a = layers.alignment(s.graph.vertices, f.graph.vertices, pairs)
    return _r(a, ["n_vertices", "n_pairs"], ["mean_displacement", "mean_abs_log_ratio"])


# ----------------------------------------------------------------------------- supersteps, levels

def q_shortest_hops(spark, d):
    """Links between the first part and every part and supplier."""
    return messages.shortest_hops(views.supply(spark, d), F.col("id") == HOPS_FROM).vertices


def q_components(spark, d):
    return messages.components(views.geo(spark, d)).vertices


def q_module_moves(spark, d):
    """Parts and suppliers after two rounds of moves by modularity gain."""
    g = views.supply(spark, d)
    member, found = modules.local_moves(modules.symmetric_weights(g.edges), g.vertices, max_rounds=MOVE_ROUNDS)
    return member.select("id", F.col("c").alias("module"), r4(F.lit(found[-1])).alias("modularity"))


def q_coarsen_clusters(spark, d):
    return coarsen.clusters(views.supply(spark, d))


def q_coarsen_links(spark, d):
    g = views.supply(spark, d)
    return _r(coarsen.contract(g, coarsen.clusters(g)).edges, ["src", "dst"], ["weight"])


def q_prolongation(spark, d):
    """Every part and supplier beside the hash-drawn position of its cluster."""
    g = views.supply(spark, d)
    c = coarsen.clusters(g)
    coarse = build.shuffle_positions(coarsen.contract(g, c).vertices, TRADE.width, TRADE.height)
    return _r(coarsen.prolong(g.vertices, c, coarse, _k(g, TRADE), TRADE), ["id", "label"], ["x", "y"])


# ----------------------------------------------------------------------------- sinks

def q_export_edges(spark, d):
    return _r(export.edge_table(views.trade(spark, d)), ["Source", "Target"], ["Weight"])


def q_export_nodes(spark, d):
    t = export.node_table(views.trade(spark, d), LP_ROUNDS)
    return _r(t, ["Id", "k", "m"], ["X", "Y", "dX", "dY", "c"])


def q_export_nodes_prefixed(spark, d):
    return export.with_prefix(q_export_nodes(spark, d), "#")


def q_export_displacements(spark, d):
    g = views.trade(spark, d)
    rep = forces.repulsion_all(g.vertices, _k(g, TRADE), TRADE)
    return _r(export.displacement_table(rep, "rep", 1), ["ID", "label", "iteration"], ["dX", "dY"])


def q_export_layout_nodes(spark, d):
    res = layout.layout(views.trade(spark, d, UNIT.width, UNIT.height, bounds=UNIT.bounds), UNIT)
    return _r(export.layout_nodes(res.graph.vertices), ["label"], ["posX", "posY"])


def q_export_layout_links(spark, d):
    return export.layout_links(views.trade_edges(spark, d))


def q_inspect_links(spark, d):
    return export.inspect_links(views.trade(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
} | {name: _variant(name) for name in VARIANTS}
