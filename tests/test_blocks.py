"""Links dealt to a grid of blocks: same pulls and layouts as the joins, bounded blocks, links that stay in place."""

import contextlib
import io
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphdrift.model import Graph, LayoutParams
from graphdrift.operators import blocks, forces, layout


def _graph(spark, n=80, others=400, hub=200):
    """A third of the links at one hub, copies of links, links from a vertex to itself, null weights."""
    rnd = random.Random(8)
    links = [(rnd.randrange(n), rnd.randrange(n), rnd.choice([None, 0.5, 2.0])) for _ in range(others)]
    links += [(0, v % n, 1.0) for v in range(hub)] + links[:40] + [(5, 5, 3.0)]
    verts = [(v, str(v), rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for v in range(n)]
    e = spark.createDataFrame(links, "src long, dst long, weight double").repartition(3)
    return Graph(spark.createDataFrame(verts, "id long, label string, x double, y double"), e), links


@pytest.fixture(scope="module")
def graph(spark):
    return _graph(spark)


def _sums(links):
    ends = forces._both_ends(links).groupBy("id").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
    return {r.id: (r.dx, r.dy) for r in ends.collect()}


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("block_links", [1 << 17, 25])
def test_pulls_equal_those_of_the_joins(spark, graph, weighted, block_links):
    g, _ = graph
    p = LayoutParams(weighted=weighted)
    want = _sums(forces.attraction_links(g, 3.0, p))
    dealt = blocks.deal(g.edges, block_links)
    got = _sums(forces.attraction_dealt(g.vertices, dealt, 3.0, p))
    dealt.drop()
    assert got.keys() == want.keys()
    for v, xy in want.items():
        assert got[v] == pytest.approx(xy, rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("kind", [{"repulsion": "neighbors"}, {"repulsion": "neighbors", "attraction": "target"},
                                  {"repulsion": "none", "weighted": True}])
def test_layout_equals_that_of_the_joins(spark, graph, kind):
    g, _ = graph
    p = LayoutParams(width=200.0, height=200.0, iterations=2, rep_scale=1.0, **kind)
    places = lambda p: {r.id: (r.x, r.y) for r in layout.layout(g, p).graph.vertices.collect()}
    want, got = places(p), places(p.but(links="blocks", block_links=30))
    assert got.keys() == want.keys()
    for v, xy in want.items():
        assert got[v] == pytest.approx(xy, abs=1e-3)


def test_every_link_lies_in_one_block_of_bounded_size(spark):
    """A hub with a third of 9,000 distinct links."""
    rnd = random.Random(3)
    links = {(0, v) for v in range(1, 3001)}
    while len(links) < 9000:
        links.add((rnd.randrange(1, 3000), rnd.randrange(1, 3000)))
    dealt = blocks.deal(spark.createDataFrame(sorted(links), "src long, dst long"), 250)
    rows = dealt.links.select("block", "src", "dst", "s", "t", "copies", "weight").collect()
    lists = {}
    for r in dealt.routes.collect():
        lists.setdefault(r.block, {})[r.at] = r.id
    dealt.drop()
    assert sorted((r.src, r.dst) for r in rows) == sorted(links)
    assert all(r.copies == 1 and r.weight == 1.0 for r in rows)
    assert all((lists[r.block][r.s], lists[r.block][r.t]) == (r.src, r.dst) for r in rows)
    assert all(sorted(at) == list(range(len(at))) for at in lists.values())
    q = blocks.grid_side(9000, 250)
    assert q == 6
    assert max(Counter(r.block for r in rows).values()) <= 2 * 250       # parts are drawn, so a block may pass the mean
    needed = Counter(v for at in lists.values() for v in at.values())
    assert needed.pop(0) <= 3000 / 250 + 2 * q                           # the hub: its links / block_links, one row of the grid
    assert sum(needed.values()) / len(needed) <= 2 * q - 1


def test_an_iteration_moves_no_links(spark, graph):
    """The links are read from where they are kept."""
    g, _ = graph
    dealt = blocks.deal(g.edges, 25)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        pulls = forces._both_ends(forces.attraction_dealt(g.vertices, dealt, 3.0, LayoutParams()))
        total = pulls.groupBy("id").agg(F.sum("dx"))
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            total.explain()
        plan = buf.getvalue().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        dealt.drop()
    moved, kept_at = [], None                                            # exchanges outside the plans of the kept tables
    for line in plan:
        at = len(line) - len(line.lstrip(" :+-"))
        if kept_at is None or at <= kept_at:
            kept_at = at if "InMemoryRelation" in line else None
            moved += re.findall(r"Exchange hashpartitioning\((\w+)#", line)
    # the sums by id, the positions to their blocks, the positions by id: neither links nor routes
    assert moved == ["id", "block", "id"]


def test_empty_null_and_unknown_ends(spark):
    none = blocks.deal(spark.createDataFrame([], "src long, dst long, weight double"))
    verts = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "id long, x double, y double")
    assert none.triplets(verts).count() == 0 and none.sizes().count() == 0
    none.drop()
    odd = blocks.deal(spark.createDataFrame([(1, None), (None, 2), (1, 9), (1, 2), (1, 2)], "src long, dst long"))
    assert [tuple(r) for r in odd.triplets(verts).collect()] == [(1, 2, 2, 2.0, 0.0, 0.0, 3.0, 4.0)]
    odd.drop()


def test_dealing_leaves_the_kept_tables_only(spark, graph):
    dealt = blocks.deal(graph[0].edges, 25)
    folder = dealt.work.folder.removeprefix("file:")
    left = sorted(name.split("-")[0] for name in os.listdir(folder))
    dealt.drop()
    assert left == ["placed", "routes"]


def test_unknown_kind_of_links_is_refused():
    for bad in ({"links": "grid"}, {"links": "blocks", "block_links": 0}):
        with pytest.raises(ValueError):
            LayoutParams(**bad)
