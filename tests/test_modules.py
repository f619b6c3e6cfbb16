"""Modules by modularity: gains, monotone levels, two-sided graphs, odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from graphdrift.model import Graph
from graphdrift.operators import modules


def _graph(spark, n, links):
    v = spark.createDataFrame([(i, 0.0, 0.0) for i in range(n)], "id long, x double, y double").repartition(3)
    return Graph(v, spark.createDataFrame(links, "src long, dst long, weight double").repartition(3))


def _q(links, of):
    a, k = {}, {}
    for s, d, w in links:
        w = 1.0 if w is None else w
        if s != d and w > 0 and s in of and d in of:
            for x, y in ((s, d), (d, s)):
                a[x, y] = a.get((x, y), 0.0) + w
                k[x] = k.get(x, 0.0) + w
    m2 = sum(k.values())
    total = {}
    for x, y in k.items():
        total[of[x]] = total.get(of[x], 0.0) + y
    return sum(w for (x, y), w in a.items() if of[x] == of[y]) / m2 - sum(t * t for t in total.values()) / m2 ** 2


def test_cliques_are_found_and_levels_rise(spark):
    rnd, size, links = random.Random(2), 6, []
    for c in range(5):
        links += [(c * size + i, c * size + j, 1.0) for i in range(size) for j in range(i)]
        links.append((c * size, ((c + 1) % 5) * size + 1, 1.0))
    links += [(3, 3, 9.0), (0, 77, 5.0), (1, 2, None)]
    rnd.shuffle(links)
    got = modules.modules(_graph(spark, 31, links), seed=1)
    of = {r.id: r.module for r in got.members.collect()}
    assert of == {i: i // size * size if i < 30 else 30 for i in range(31)}
    q = got.members.select("modularity").distinct().collect()
    assert len(q) == 1 and q[0][0] == pytest.approx(got.levels[-1]) == pytest.approx(_q(links, of))
    assert all(a < b for a, b in zip(got.levels, got.levels[1:]))


def test_two_sided_graph_settles(spark):
    rnd = random.Random(3)
    links = [(i, 40 + rnd.choice([i // 10 * 3, i // 10 * 3 + 1, i // 10 * 3 + 2, rnd.randrange(12)]), 1.0) for i in range(40) for _ in range(3)]
    g = _graph(spark, 52, links)
    pairs = modules.symmetric_weights(g.edges)
    member, found = modules.local_moves(pairs, g.vertices, seed=5, max_rounds=40)
    of = {r.id: r.c for r in member.collect()}
    assert len(found) < 40 and all(a < b for a, b in zip(found, found[1:]))
    assert found[-1] == pytest.approx(_q(links, of)) and found[-1] > 0.2
    again, same = modules.local_moves(pairs, g.vertices, seed=5, max_rounds=40)
    assert same == found and {r.id: r.c for r in again.collect()} == of


def test_graphs_without_links(spark):
    got = modules.modules(_graph(spark, 4, [(1, 1, 1.0), (2, 3, 0.0)]))
    assert got.levels == [0.0] and {r.id: r.module for r in got.members.collect()} == {i: i for i in range(4)}


def test_pairs_are_made_once_and_a_hub_is_dealt_in_parts(spark, monkeypatch):
    rnd = random.Random(9)
    links = [(0, v, 1.0) for v in range(1, 60)] + [(rnd.randrange(60), rnd.randrange(60), 1.0) for _ in range(120)]
    g, rows = _graph(spark, 60, links), lambda m: {r.id: r.c for r in m.collect()}
    member, found = modules.local_moves(modules.symmetric_weights(g.edges), g.vertices, seed=3, max_rounds=4)
    want, written = rows(member), []
    table = modules.Scratch.table
    monkeypatch.setattr(modules.Scratch, "table", lambda self, df, name, *a: written.append(name) or table(self, df, name, *a))
    monkeypatch.setattr(modules, "_PART", 7)
    member, again = modules.local_moves(modules.symmetric_weights(g.edges), g.vertices, seed=3, max_rounds=4)
    assert rows(member) == want and again == pytest.approx(found)
    assert written.count("pairs") == 1
    hub = {r.u: r.parts for r in modules.hubs(modules.symmetric_weights(g.edges)).collect()}
    assert hub[0] >= 9
