"""Triangles by blocks, ranks with ties, turns between layouts: brute force and odd inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdrift.model import Graph
from graphdrift.operators import layers, ranks, stats, triangles
from graphdrift.session import Scratch


def _graph(spark, links):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, weight double").repartition(3)
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Graph(v.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), e)


def _brute(links):
    adj = {}
    for a, b in links:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    return {v: t for v, nb in adj.items() if (t := sum(y in adj[x] for x, y in itertools.combinations(nb, 2)))}


@pytest.mark.parametrize("block_links", [1 << 19, 60])
def test_triangles_equal_brute_force(spark, block_links):
    rnd = random.Random(block_links)
    links = [(rnd.randrange(60) * 10 ** 12, rnd.randrange(60) * 10 ** 12) for _ in range(400)]
    links += [(0, v * 10 ** 12) for v in range(1, 200)]                  # a hub: a third of the links, most of them bare
    oriented = stats.oriented_edges(_graph(spark, links))
    got = triangles.triangles(oriented, block_links)
    assert {r.id: r.triangles for r in got.collect()} == _brute(links)


def test_wedges_are_met_in_slices(monkeypatch):
    import pandas as pd

    rnd = random.Random(4)
    links = {tuple(sorted(rnd.sample(range(30), 2))) for _ in range(200)}
    pdf = pd.DataFrame([(r, a, b) for a, b in links for r in range(3)], columns=["role", "a", "b"])
    monkeypatch.setattr(triangles, "_WEDGES", 7)
    got = triangles.block_counts(pdf)
    assert dict(zip(got["id"], got["triangles"])) == _brute(links)


def test_each_triangle_is_in_one_block_of_bounded_size(spark):
    links = spark.createDataFrame([(a, b) for a, b in itertools.combinations(range(40), 2)], "u long, v long")
    rows = triangles.dealt(links, 4)
    assert rows.count() == 780 * 12
    assert triangles.colours(10 ** 6, 0, 10 ** 4) == 18 and triangles.colours(0, 0, 10) == 1
    m, d, r = 10 ** 8, 10 ** 7, 10 ** 5
    q = triangles.colours(m, d, r)
    assert 3 * m / q ** 2 + 2 * d / q <= r < 3 * m / (q - 1) ** 2 + 2 * d / (q - 1)


@pytest.mark.parametrize("by_lists", [True, False])
def test_both_ways_of_dealing_equal_brute_force(spark, monkeypatch, by_lists):
    """Lists longer than a row, ids of both signs, blocks of a few links."""
    rnd = random.Random(6)
    ids = [rnd.randrange(-2 ** 62, 2 ** 62) for _ in range(50)]
    links = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(500)]
    monkeypatch.setattr(triangles, "_LIST", 3)
    if by_lists:
        monkeypatch.setattr(triangles, "dealt", None)
        monkeypatch.setattr(triangles, "colours", lambda *a: 10 ** 6)
    else:
        monkeypatch.setattr(triangles, "list_counts", None)
        monkeypatch.setattr(triangles, "colours", lambda *a: 1)
        monkeypatch.setattr(triangles, "sent", None)
        spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.id: r.triangles for r in triangles.triangles(stats.oriented_edges(_graph(spark, links)), 20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == _brute(links)


def test_links_of_a_sparse_graph_are_not_dealt_to_every_colour(spark):
    """Of 3,000 links in triangles of three, blocks of 30 links: a list goes where it is asked for, once."""
    links = [(3 * t + a, 3 * t + b) for t in range(1000) for a, b in ((0, 1), (1, 2), (0, 2))]
    oriented = stats.oriented_edges(_graph(spark, links))
    text = triangles.triangles(oriented, 30)._jdf.queryExecution().toString()
    assert "MapInArrow" in text and "FlatMapGroupsInPandas" not in text
    kept = triangles.lists(oriented.select("u", "v"), 100, 0, 2)
    assert triangles.sent(kept, 100).count() == 3000          # two lists of a triangle stay, one of them also goes to the other's block


def test_triangles_leave_degrees_and_counts_only(spark):
    from test_plans import _tables

    before = _tables(spark)
    stats.clustering_coefficient(_graph(spark, [(0, 1), (1, 2), (0, 2)])).count()
    assert _tables(spark) - before == 1


def test_no_links_no_triangles(spark):
    empty = spark.createDataFrame([], "u long, v long, du long, dv long")
    assert triangles.triangles(empty).count() == 0


def test_ranks_with_ties(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([0.0, -0.0, 1.5, 2.0, float(rnd.randrange(40))]), rnd.random() if i % 3 else 0.5) for i in range(300)]
    odd = [(300, None, 1.0), (301, float("nan"), 1.0), (302, 1.0, None)]
    df = spark.createDataFrame(rows + odd, "id long, a double, b double").repartition(5)
    got = {r.id: (r.a_rank, r.b_rank) for r in ranks.with_ranks(df, ["a", "b"], Scratch(spark)).collect()}

    def places(v):
        return [np.mean([i + 1 for i, s in enumerate(sorted(v)) if s == x]) for x in v]

    ra, rb = places([r[1] for r in rows]), places([r[2] for r in rows])
    assert got == {r[0]: (x, y) for r, x, y in zip(rows, ra, rb)}
    c = ranks.rank_correlation(df, "a", "b", Scratch(spark)).first()
    assert c.n == 300 and c.rank_corr == pytest.approx(np.corrcoef(ra, rb)[0, 1])


def test_rank_dependence_of_odd_columns(spark):
    alike = spark.range(50).select(F.lit(2.0).alias("a"), F.col("id").cast("double").alias("b"))
    c = ranks.rank_correlation(alike, "a", "b", Scratch(spark)).first()
    assert c.n == 50 and c.rank_corr is None
    monotone = spark.range(50).select(F.col("id").cast("double").alias("a"), (-F.exp(F.col("id") / 5)).alias("b"))
    assert ranks.rank_correlation(monotone, "a", "b", Scratch(spark)).first().rank_corr == pytest.approx(-1.0)
    none = ranks.rank_correlation(alike.filter("b < 0"), "a", "b", Scratch(spark)).first()
    assert none.n == 0 and none.rank_corr is None


def _layout(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")


@pytest.mark.parametrize("flip", [False, True])
def test_a_turned_copy_aligns_to_nothing(spark, flip):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(50, 2)) * 100
    t = np.radians(130)
    b = (a * [1, -1 if flip else 1]) @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]) * 2.5 + [300, -40]
    la, lb = _layout(spark, a), _layout(spark, b)
    fit = layers.rigid_fit(la, lb, scale=True).first()
    assert fit.n == 50 and fit.flipped is flip and fit.factor == pytest.approx(0.4) and fit.rms_before > 100
    moved = layers.displacement(la, layers.aligned(la, lb, scale=True)).agg(F.max("distance")).first()[0]
    assert moved == pytest.approx(0.0, abs=1e-9)
    if flip:
        assert not layers.rigid_fit(la, lb, reflect=False).first().flipped


def test_fit_is_the_best_turn(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 2)), rng.normal(size=(40, 2)) + 5
    fit = layers.rigid_fit(_layout(spark, a), _layout(spark, b)).first()
    ca, cb = a - a.mean(0), b - b.mean(0)
    best = min(np.sqrt((((cb * [1, f]) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) - ca) ** 2).sum(1).mean())
               for t in np.linspace(0, 2 * np.pi, 20001) for f in (1, -1))
    assert fit.rms_after == pytest.approx(best, rel=1e-6)
    assert fit.rms_before == pytest.approx(np.sqrt(((a - b) ** 2).sum(1).mean()))


def test_fit_of_odd_layouts(spark):
    one, other = _layout(spark, [(1, 2)]), _layout(spark, [(5, 5)])
    got = layers.aligned(one, other, scale=True).first()
    assert (got.x, got.y) == (1.0, 2.0)
    far = other.select((F.col("id") + 9).alias("id"), "x", "y")
    kept = layers.aligned(one, far).first()
    assert (kept.x, kept.y) == (5.0, 5.0) and layers.rigid_fit(one, far).first().rms_after is None
