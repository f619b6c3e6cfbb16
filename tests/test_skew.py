"""A hub holding a third of all links and a third of the vertices piled on one spot."""

import itertools
import random

import numpy as np
import pytest

from graphdrift.model import LayoutParams
from graphdrift.operators import forces, layout, stats
from graphdrift.sources import fixtures


@pytest.fixture(scope="module")
def hub_graph(spark):
    rnd = random.Random(5)
    n = 240
    links = set()
    while len(links) < 400:
        a, b = rnd.randrange(1, n), rnd.randrange(1, n)
        if a != b:
            links.add((a, b))
    links |= {(0, v) for v in range(1, 201)}            # the hub: 200 of 600 links
    verts = []
    for v in range(n):
        if v % 3 == 0:
            verts.append((v, str(v), 500.0, 500.0))       # a third of the vertices on one spot
        else:
            verts.append((v, str(v), float(rnd.randrange(0, 1000)), float(rnd.randrange(0, 1000))))
    return fixtures.make_graph(spark, verts, sorted(links)), verts, sorted(links)


def test_hub_degree_triangles_modules(spark, hub_graph):
    g, verts, links = hub_graph
    adj = {v[0]: set() for v in verts}
    for a, b in links:
        adj[a].add(b)
        adj[b].add(a)
    deg = {r.id: r.degree for r in stats.degree(g).collect()}
    assert deg[0] == 200
    cc = {r.id: (r.degree, r.triangles) for r in stats.clustering_coefficient(g).collect()}
    for v, nb in adj.items():
        t = sum(1 for a, b in itertools.combinations(sorted(nb), 2) if b in adj[a])
        assert cc[v] == (len(nb), t)
    mods = {r.id: r.module for r in stats.label_propagation(g, 3).collect()}
    assert set(mods) == set(adj)


def test_pile_and_hub_forces(spark, hub_graph):
    g, verts, _ = hub_graph
    p = LayoutParams(width=1000.0, height=1000.0, rep_scale=1.0)
    got = forces.repulsion_all(g.vertices, 10.0, p).toPandas().sort_values("id")
    xs = np.array([v[2] for v in verts])
    ys = np.array([v[3] for v in verts])
    dx = xs[:, None] - xs[None, :]
    dy = ys[:, None] - ys[None, :]
    l2 = np.maximum(p.eps ** 2, dx * dx + dy * dy)
    ex = 100.0 * (dx / l2).sum(1)
    assert np.allclose(got.dx.to_numpy(), ex, rtol=1e-8, atol=1e-8)
    res = layout.layout(g, p.but(iterations=2))
    assert res.graph.vertices.count() == len(verts)
