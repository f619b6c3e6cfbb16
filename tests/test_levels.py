"""General supersteps against plain graph walks; contraction and the multilevel layout."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdrift.model import Graph, LayoutParams
from graphdrift.operators import build, coarsen, forces, layout, messages
from graphdrift.session import Scratch


def _graph(spark, n, links, positions=False):
    v = spark.createDataFrame([(i, f"v{i}", float(i % 7), float(i % 5), 0.0, 0.0) for i in range(n)],
                              "id long, label string, x double, y double, dx double, dy double").repartition(3)
    if positions:
        v = build.shuffle_positions(v, 1000.0, 1000.0, 3)
    e = spark.createDataFrame([(a, b, w) for a, b, w in links], "src long, dst long, weight double").repartition(3)
    return Graph(v, e)


def _random(seed, n=60, m=70):
    rnd = random.Random(seed)
    links = [(rnd.randrange(n), rnd.randrange(n), rnd.choice([1.0, 2.0, 2.0, 0.5])) for _ in range(m)]
    links += [(n - 1, i, 1.0) for i in range(10, 20)] + [links[0], (3, 3, 1.0), (5, 999, 1.0)]     # hub, parallel, self, unknown id
    return links


def _hops(n, links, start, directed):
    out, queue = {start: 0}, deque([start])
    near = {i: set() for i in range(n)}
    for a, b, _ in links:
        if a < n and b < n:
            near[a].add(b)
            if not directed:
                near[b].add(a)
    while queue:
        a = queue.popleft()
        for b in near[a] - out.keys():
            out[b] = out[a] + 1
            queue.append(b)
    return {i: out.get(i) for i in range(n)}


@pytest.mark.parametrize("directed", [False, True])
def test_hops_and_halting(spark, directed):
    links = _random(1)
    run = messages.shortest_hops(_graph(spark, 60, links), F.col("id") == 59, directed)
    want = _hops(60, links, 59, directed)
    assert {r.id: r.hops for r in run.vertices.collect()} == want
    far = max(x for x in want.values() if x is not None)
    assert run.settled and run.steps == far
    assert run.active == [sum(x == s for x in want.values()) for s in range(1, far + 1)]      # only the front is active
    cut = messages.shortest_hops(_graph(spark, 60, links), F.col("id") == 59, directed, max_steps=1)
    assert not cut.settled and {r.id: r.hops for r in cut.vertices.collect()} == {i: x if x is not None and x <= 1 else None for i, x in want.items()}


def test_components_of_chain_star_and_singles(spark):
    links = [(i, i + 1, 1.0) for i in range(0, 9)] + [(30, i, 1.0) for i in range(20, 30)] + [(12, 12, 1.0)]
    run = messages.components(_graph(spark, 40, links))
    want = {i: 0 if i <= 9 else 20 if 20 <= i <= 30 else i for i in range(40)}
    assert {r.id: r.component for r in run.vertices.collect()} == want and run.settled
    none = messages.components(_graph(spark, 3, [(0, 900, 1.0)]))
    assert none.settled and none.steps == 0 and {r.component for r in none.vertices.collect()} == {0, 1, 2}


def test_one_superstep_is_the_target_only_attraction(spark):
    g = _graph(spark, 60, _random(2)[:-1], positions=True)
    k, p = 12.0, LayoutParams(attraction="target", attr_scale=0.5)
    dx, dy = F.col("src_x") - F.col("dst_x"), F.col("src_y") - F.col("dst_y")
    length = F.greatest(F.lit(p.eps), F.sqrt(dx * dx + dy * dy))
    pull = F.lit(p.attr_scale) * length / F.lit(k)
    run = messages.supersteps(g, {"x": F.col("x"), "y": F.col("y"), "fx": F.lit(0.0), "fy": F.lit(0.0)},
                              lambda m: F.struct(F.sum(m.fx).alias("fx"), F.sum(m.fy).alias("fy")),
                              {"fx": F.col("msg.fx"), "fy": F.col("msg.fy")},
                              to_dst=F.struct((pull * dx).alias("fx"), (pull * dy).alias("fy")), direction="out", max_steps=1)
    got = {r.id: (r.fx, r.fy) for r in run.vertices.collect()}
    for r in forces.attraction_target_only(g, k, p).collect():
        assert got[r.id] == pytest.approx((r.dx, r.dy), rel=1e-9, abs=1e-9)


def test_directions_and_checks(spark):
    """A token walks down a chain; who may send decides where it stops."""
    g = _graph(spark, 6, [(i, i + 1, 1.0) for i in range(5)])
    def walk(direction):
        return messages.supersteps(g, {"t": F.when(F.col("id") == 0, F.lit(1)).otherwise(F.lit(0))}, F.max, {"t": F.col("msg")},
                                   to_dst=F.when((F.col("src_t") == 1) & (F.col("dst_t") == 0), F.lit(1)), direction=direction)
    assert [walk(d).steps for d in ("out", "either", "in", "both")] == [5, 5, 1, 1]
    for bad in ({"direction": "up", "to_dst": F.lit(1)}, {"direction": "out"}):
        with pytest.raises(ValueError):
            messages.supersteps(g, {"t": F.lit(0)}, F.max, {"t": F.col("msg")}, **bad)
    with pytest.raises(ValueError):
        messages.supersteps(g, {"t": F.lit(0)}, F.max, {"u": F.col("msg")}, to_dst=F.lit(1))


def test_matching_is_mutual_and_contraction_keeps_weight(spark):
    links = [x for x in _random(4) if x[1] != 999] + [(40, i, 1.0) for i in range(41, 58)]
    g = _graph(spark, 60, links)
    cluster = {r.id: r.cluster for r in coarsen.clusters(g).collect()}
    linked = {i for a, b, _ in links if a != b for i in (a, b)}
    groups = {}
    for i, c in cluster.items():
        groups.setdefault(c, set()).add(i)
    assert set(cluster) == set(range(60)) and all(c in m for c, m in groups.items())
    near = {(a, b) for a, b, _ in links} | {(b, a) for a, b, _ in links}
    for m in groups.values():                             # every member is linked to another member
        assert len(m) == 1 or all(any((i, j) in near for j in m if j != i) for i in m)
    assert len(groups) <= (60 - len(linked)) + 0.62 * len(linked)
    coarse = coarsen.contract(g, coarsen.clusters(g))
    got = {(r.src, r.dst): r.weight for r in coarse.edges.collect()}
    want = {}
    for a, b, w in links:
        x, y = sorted((cluster[a], cluster[b]))
        if x != y:
            want[x, y] = want.get((x, y), 0.0) + w
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)
    assert {r.id: r.members for r in coarse.vertices.collect()} == {c: len(m) for c, m in groups.items()}


def _stress(v, hops):
    p = {r.id: (r.x, r.y) for r in v.collect()}
    ids = sorted(p)
    d = np.array([[np.hypot(p[a][0] - p[b][0], p[a][1] - p[b][1]) for b in ids] for a in ids])
    h = np.array([[hops[a][b] for b in ids] for a in ids], float)
    off = ~np.eye(len(ids), dtype=bool)
    scale = (d[off] / h[off]).sum() / (d[off] ** 2 / h[off] ** 2).sum()
    return ((scale * d[off] / h[off] - 1.0) ** 2).mean()


def test_multilevel_unfolds_what_a_flat_run_does_not(spark):
    """A closed chain: from drawn positions a few flat rounds leave it knotted."""
    n = 48
    links = [(i, (i + 1) % n, 1.0) for i in range(n)]
    hops = {a: {b: min((a - b) % n, (b - a) % n) for b in range(n)} for a in range(n)}
    p = LayoutParams(width=1000.0, height=1000.0, rep_scale=1.0, iterations=10)
    g = _graph(spark, n, links)
    flat = _stress(layout.layout_shuffled(g, p).graph.vertices, hops)
    deep = coarsen.multilevel_layout(g, p, smallest=8, refine=4).graph.vertices
    assert {r.id for r in deep.collect()} == set(range(n))
    assert deep.filter("abs(x) > 500 or abs(y) > 500").count() == 0
    assert _stress(deep, hops) < 0.75 * flat


def test_multilevel_of_odd_graphs(spark):
    p = LayoutParams(iterations=1)
    lonely = coarsen.multilevel_layout(_graph(spark, 5, []), p, smallest=2, refine=1).graph.vertices
    assert lonely.count() == 5
    known = coarsen.multilevel_layout(_graph(spark, 2, [(0, 7, 1.0), (7, 8, None)]), p, smallest=1, refine=1).graph.vertices
    assert {r.id for r in known.collect()} == {0, 1, 7, 8}
