"""Invariants and small-graph checks of construction, forces, steps, statistics and layers."""

import contextlib
import io
import itertools

import pytest
from pyspark.sql import functions as F

from graphdrift.model import Graph, LayoutParams
from graphdrift.operators import build, forces, layers, layout, stats, step
from graphdrift.sources import fixtures


def _d(df, key="id", cols=("dx", "dy")):
    return {r[key]: tuple(r[c] for c in cols) for r in df.collect()}


def test_attraction_sums_to_zero_and_target_only_matches_symmetric(spark):
    g = fixtures.house(spark)
    p = LayoutParams(width=1000.0, height=1000.0, rep_scale=1.0)
    both = _d(forces.attraction_both_ends(g, 300.0, p))
    assert sum(v[0] for v in both.values()) == pytest.approx(0.0, abs=1e-6)
    assert sum(v[1] for v in both.values()) == pytest.approx(0.0, abs=1e-6)
    # target-only delivery on the symmetric closure equals both-ends on the links
    sym = Graph(g.vertices, build.symmetric_edges(g.edges))
    tgt = _d(forces.attraction_target_only(sym, 300.0, p))
    for vid in both:
        assert tgt[vid] == pytest.approx(both[vid], abs=1e-6)


def test_neighbor_repulsion_and_gravity(spark):
    g = fixtures.pair(spark)
    p = LayoutParams(rep_scale=1.0, gravity=5.0)
    rep = _d(forces.repulsion_neighbors(g, 400.0, p))
    assert rep[1] == pytest.approx((800.0, 0.0))
    assert rep[2] == pytest.approx((-800.0, 0.0))
    grav = _d(forces.gravity(g.vertices, p))
    # gamma / l * (-p) / l at (100, 100): l^2 = 20000
    assert grav[1] == pytest.approx((-5.0 * 100 / 20000, -5.0 * 100 / 20000))


def test_clamp_keeps_positions_in_bounds(spark):
    g = fixtures.house(spark)
    for bounds, box in (("corner", (0, 50, 0, 50)), ("center", (-25, 25, -25, 25))):
        p = LayoutParams(width=50.0, height=50.0, rep_scale=1.0, bounds=bounds, iterations=3)
        res = layout.layout(g, p)
        for r in res.graph.vertices.collect():
            assert box[0] <= r.x <= box[1] and box[2] <= r.y <= box[3]


def test_centroid_fixed_without_clamp_cap_and_gravity(spark):
    g = fixtures.house(spark)
    p = LayoutParams(width=1000.0, height=1000.0, rep_scale=0.01, step="unit", bounds="none", iterations=2)
    before = g.vertices.agg(F.avg("x"), F.avg("y")).first()
    after = layout.layout(g, p).graph.vertices.agg(F.avg("x"), F.avg("y")).first()
    assert tuple(after) == pytest.approx(tuple(before), abs=p.eps)     # each position moves to the grid


def test_step_modes(spark):
    tot = spark.createDataFrame([(1, 30.0, 40.0), (2, 0.0, 0.0)], "id long, dx double, dy double")
    cap = _d(step.scaled_step(tot, LayoutParams(), 1, 10.0), cols=("sx", "sy"))
    assert cap[1] == pytest.approx((6.0, 8.0)) and cap[2] == (0.0, 0.0)
    inv = _d(step.scaled_step(tot, LayoutParams(step="inverse_iteration"), 4, 10.0), cols=("sx", "sy"))
    assert inv[1] == pytest.approx((75.0, 100.0))
    lens = _d(step.displacement_length(tot), cols=("length",))
    assert lens[1] == (50.0,)


def test_early_stop_follows_full_plan(spark):
    g = fixtures.box(spark)
    p = LayoutParams(width=1000.0, height=1000.0, rep_scale=1.0, iterations=10, max_iterations=2)
    rep = layout.layout(g, p, report=True).report.orderBy("iteration").collect()
    assert [r.iteration for r in rep] == [1, 2]
    assert rep[1].temperature == pytest.approx(p.temperature(1))
    assert all(r.max_step <= r.temperature + 1e-9 for r in rep)


def test_trace_phases(spark):
    g = fixtures.pair(spark)
    res = layout.layout(g, LayoutParams(width=1000.0, height=1000.0, iterations=2), trace=True)
    rows = res.trace.collect()
    assert sorted({(r.iteration, r.phase) for r in rows}) == [(i, ph) for i in (1, 2) for ph in "ABC"]
    assert len(rows) == 12


def test_construction(spark):
    g = fixtures.scratch(spark)
    ids = sorted(r.id for r in build.vertices_from_edges(g.edges).collect())
    assert ids == [2, 3, 5, 7]
    v = g.vertices.filter("id <> 2")
    e = g.edges.unionByName(spark.createDataFrame([(9, 3, 1.0)], "src long, dst long, weight double"))
    full = {r.id: r for r in build.complete_graph(v, e).vertices.collect()}
    assert full[9].label == "NONODE" and (full[9].x, full[9].y) == (0.0, 0.0)
    assert full[2].label == "NONODE" and full[7].label == "b"
    size = build.graph_size(g).first()
    assert (size.n_vertices, size.n_edges) == (4, 4)
    sym = {(r.src, r.dst) for r in build.symmetric_edges(g.edges).collect()}
    assert len(sym) == 8 and (7, 3) in sym
    with pytest.raises(ValueError):
        dup = g.vertices.unionByName(g.vertices.limit(1))
        build.complete_graph(dup, g.edges)
    shuffled = build.shuffle_positions(g.vertices, 1000.0, 1000.0, 5).collect()
    assert all(-500 <= r.x <= 500 and -500 <= r.y <= 500 for r in shuffled)
    assert {r.id: r.x for r in shuffled} == {r.id: r.x for r in build.shuffle_positions(g.vertices, 1000.0, 1000.0, 5).collect()}


def test_degree_and_clustering_on_house(spark):
    g = fixtures.house(spark)
    deg = {r.id: (r.in_degree, r.out_degree, r.degree) for r in stats.degree(g).collect()}
    assert deg[1] == (1, 2, 3) and deg[4] == (1, 3, 4)
    cc = {r.id: (r.degree, r.triangles, r.clustering) for r in stats.clustering_coefficient(g).collect()}
    # undirected house: 1-2,1-3,2-3,3-5,1-4,2-4,3-4,4-5
    adj = {1: {2, 3, 4}, 2: {1, 3, 4}, 3: {1, 2, 4, 5}, 4: {1, 2, 3, 5}, 5: {3, 4}}
    for v, nb in adj.items():
        t = sum(1 for a, b in itertools.combinations(sorted(nb), 2) if b in adj[a])
        d = len(nb)
        assert cc[v] == (d, t, pytest.approx(2 * t / (d * (d - 1))))


def test_label_propagation_two_cliques(spark):
    links = [(a, b) for grp in ((1, 2, 3, 4), (10, 11, 12, 13)) for a, b in itertools.combinations(grp, 2)]
    links.append((4, 10))
    verts = sorted({x for l in links for x in l})
    g = fixtures.make_graph(spark, [(i, str(i), float(i), 0.0) for i in verts], links)
    mods = {r.id: r.module for r in stats.label_propagation(g, 5).collect()}
    assert len({mods[i] for i in (1, 2, 3)}) == 1 and len({mods[i] for i in (11, 12, 13)}) == 1
    assert mods[1] != mods[12]


def test_layer_measures(spark):
    g = fixtures.scratch(spark)
    other = g.vertices.select("id", "label", (F.col("x") * 2).alias("x"), (F.col("y") * 2).alias("y"), "dx", "dy")
    pairs = layers.linked_pairs(g.edges)
    same = layers.distance_ratio(g.vertices, g.vertices, pairs).collect()
    assert all(r.ratio == pytest.approx(1.0) and r.relation == "same" for r in same)
    dbl = layers.distance_ratio(g.vertices, other, pairs).collect()
    assert all(r.ratio == pytest.approx(2.0) and r.relation == "longer" for r in dbl)
    disp = {r.id: r for r in layers.displacement(g.vertices, other).collect()}
    assert disp[7].distance == pytest.approx(2 ** 0.5) and disp[7].angle == pytest.approx(45.0)
    al = layers.alignment(g.vertices, other, pairs).first()
    assert al.mean_abs_log_ratio == pytest.approx(0.6931, abs=1e-4) and al.n_vertices == 4
    fe = spark.createDataFrame(fixtures.FUNCTIONAL_LAYER, "src long, dst long, weight double")
    corr = layers.distance_strength_corr(g.vertices, fe).first()
    assert corr.n_links == 10 and -1.0 <= corr.corr <= 1.0
    bins = layers.distance_vs_strength(g.vertices, fe).collect()
    assert sum(r.n_links for r in bins) == 10
    ff = _d(layers.functional_force(g.vertices, fe, 2.0, LayoutParams()))
    assert sum(v[0] for v in ff.values()) == pytest.approx(0.0, abs=1e-9)


def test_layout_completes_missing_endpoints(spark):
    g = fixtures.pair(spark)
    extra = spark.createDataFrame([(1, 9, 1.0)], "src long, dst long, weight double")
    res = layout.layout(Graph(g.vertices, g.edges.unionByName(extra)), LayoutParams(iterations=1))
    rows = {r.id: r for r in res.graph.vertices.collect()}
    assert set(rows) == {1, 2, 9} and rows[9].label == "NONODE"
    with pytest.raises(ValueError):
        layout.layout(Graph(g.vertices.unionByName(g.vertices), g.edges), LayoutParams(iterations=1))


def test_linked_pairs_are_made_distinct_before_they_are_turned(spark):
    """Copies, turned copies, self-links and null ends: each pair is held once, and turned only afterwards."""
    rows = [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (4, None), (5, 2)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    assert sorted(map(tuple, build.unordered_pairs(edges).collect())) == [(1, 2), (2, 5)]
    both = build.undirected_pairs(edges)
    assert sorted(map(tuple, both.collect())) == [(1, 2), (2, 1), (2, 5), (5, 2)]
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        both.explain()
    text = out.getvalue()                                   # the plan's last operator comes first
    assert text.index("Generate") < text.index("HashAggregate") < text.index("Exchange")
