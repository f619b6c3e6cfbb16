"""The multipole repulsion against brute force, and the grid range join against brute force."""

import numpy as np
import pytest

from graphdrift.model import LayoutParams
from graphdrift.operators import forces, multipole
from graphdrift.operators.multipole import cauchy_repulsion
from graphdrift.session import Scratch


def brute(xs, ys, eps):
    dx = xs[:, None] - xs[None, :]
    dy = ys[:, None] - ys[None, :]
    l2 = np.maximum(eps * eps, dx * dx + dy * dy)
    return (dx / l2).sum(1), (dy / l2).sum(1)


def _frame(spark, xs, ys):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys))],
                                 "id long, x double, y double")


@pytest.mark.parametrize("depth", [None, 2, 3])
def test_cauchy_matches_brute_force(spark, depth):
    rng = np.random.default_rng(7)
    n = 400
    xs, ys = rng.uniform(-5000, 5000, n), rng.uniform(-5000, 5000, n)
    xs[:60], ys[:60] = rng.normal(1000, 3, 60), rng.normal(-2000, 3, 60)    # dense spot
    xs[60:70], ys[60:70] = 4000.0, 4000.0                                   # pile of coincident vertices
    xs[70], ys[70] = 4000.0 + 5e-5, 4000.0                                  # inside the eps floor
    out = cauchy_repulsion(_frame(spark, xs, ys), 1e-4, depth=depth).toPandas().sort_values("id")
    bx, by = brute(xs, ys, 1e-4)
    scale = np.max(np.abs(bx) + np.abs(by))
    err = np.max(np.abs(out.fx.to_numpy() - bx) + np.abs(out.fy.to_numpy() - by))
    assert err / scale < 1e-9


def test_cauchy_small_and_degenerate(spark):
    one = cauchy_repulsion(_frame(spark, np.array([1.0]), np.array([2.0])), 1e-4).collect()
    assert [(r.fx, r.fy) for r in one] == [(0.0, 0.0)]
    same = cauchy_repulsion(_frame(spark, np.array([3.0] * 5), np.array([3.0] * 5)), 1e-4).collect()
    assert all(r.fx == 0.0 and r.fy == 0.0 for r in same)


def test_total_repulsion_vanishes(spark):
    rng = np.random.default_rng(3)
    xs, ys = rng.uniform(0, 1000, 300), rng.uniform(0, 1000, 300)
    out = cauchy_repulsion(_frame(spark, xs, ys), 1e-4).toPandas()
    assert abs(out.fx.sum()) < 1e-6 and abs(out.fy.sum()) < 1e-6


def test_radius_join_matches_brute_force_and_all_pairs(spark):
    rng = np.random.default_rng(11)
    n = 300
    xs, ys = rng.uniform(0, 2000, n).round(0), rng.uniform(0, 2000, n).round(0)
    v = spark.createDataFrame([(i, "v", float(x), float(y), 0.0, 0.0) for i, (x, y) in enumerate(zip(xs, ys))],
                              "id long, label string, x double, y double, dx double, dy double")
    p = LayoutParams(rep_scale=1.0)
    k = 10.0
    for radius in (150.0, 5000.0):
        got = forces.repulsion_radius(v, k, p, radius).toPandas().sort_values("id")
        dx = xs[:, None] - xs[None, :]
        dy = ys[:, None] - ys[None, :]
        d2 = dx * dx + dy * dy
        l2 = np.maximum(p.eps ** 2, d2)
        mask = (d2 <= radius * radius)
        ex = (k * k * dx / l2 * mask).sum(1)
        ey = (k * k * dy / l2 * mask).sum(1)
        assert np.allclose(got.dx.to_numpy(), ex, rtol=1e-9, atol=1e-9)
        assert np.allclose(got.dy.to_numpy(), ey, rtol=1e-9, atol=1e-9)
    # a radius beyond the diagonal equals all pairs
    allp = forces.repulsion_all(v, k, p).toPandas().sort_values("id")
    assert np.allclose(allp.dx.to_numpy(), ex, rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("radius", [40.0, 900.0])
def test_radius_cut_with_dense_spot(spark, radius):
    rng = np.random.default_rng(21)
    n = 500
    xs, ys = rng.uniform(0, 3000, n), rng.uniform(0, 3000, n)
    xs[:200], ys[:200] = rng.uniform(1000, 1030, 200), rng.uniform(1000, 1030, 200)   # 40 % in one radius cell
    xs[200:210], ys[200:210] = 2500.0, 2500.0
    out = cauchy_repulsion(_frame(spark, xs, ys), 1e-4, radius=radius).toPandas().sort_values("id")
    dx = xs[:, None] - xs[None, :]
    dy = ys[:, None] - ys[None, :]
    d2 = dx * dx + dy * dy
    l2 = np.maximum(1e-8, d2)
    m = d2 <= radius * radius
    bx, by = (dx / l2 * m).sum(1), (dy / l2 * m).sum(1)
    scale = np.max(np.abs(bx) + np.abs(by))
    err = np.max(np.abs(out.fx.to_numpy() - bx) + np.abs(out.fy.to_numpy() - by))
    assert err / scale < 1e-9


def test_cluster_within_eps(spark):
    rng = np.random.default_rng(4)
    xs, ys = 100.0 + rng.uniform(0, 5e-5, 100), 200.0 + rng.uniform(0, 5e-5, 100)
    out = cauchy_repulsion(_frame(spark, xs, ys), 1e-4).toPandas().sort_values("id")
    bx, by = brute(xs, ys, 1e-4)
    assert np.allclose(out.fx.to_numpy(), bx, rtol=1e-9, atol=1e-6)
    assert np.allclose(out.fy.to_numpy(), by, rtol=1e-9, atol=1e-6)


def _spot(rng, spread, crowded, eps=1e-4):
    """``spread`` positions over a 10,000 box, ``crowded`` on the grid within 0.01 units."""
    xs = np.concatenate([rng.uniform(-5000, 5000, spread), 1234.0 + rng.integers(0, 100, crowded) * eps])
    ys = np.concatenate([rng.uniform(-5000, 5000, spread), -777.0 + rng.integers(0, 100, crowded) * eps])
    return xs, ys


def test_tiny_dense_spot_matches_brute_force(spark):
    xs, ys = _spot(np.random.default_rng(5), 400, 200)
    out = cauchy_repulsion(_frame(spark, xs, ys), 1e-4, leaf_capacity=16).toPandas().sort_values("id")
    bx, by = brute(xs, ys, 1e-4)
    for part in (slice(0, 400), slice(400, None)):         # each against its own scale
        scale = np.max(np.abs(bx[part]) + np.abs(by[part]))
        err = np.abs(out.fx.to_numpy() - bx) + np.abs(out.fy.to_numpy() - by)
        assert np.max(err[part]) / scale < 1e-9


def test_tree_is_deep_only_at_the_dense_spot(spark):
    """About 20 levels lie between the box and the spot; sparse cells are not taken down with it."""
    xs, ys = _spot(np.random.default_rng(6), 3000, 200)
    scratch, span = Scratch(spark), 10001.0
    rows = sorted({(float(x), float(y)) for x, y in zip(xs, ys)})
    pos = scratch.table(spark.createDataFrame([(x, y, 1, (x + 5000) / span, (y + 5000) / span) for x, y in rows],
                                              "x double, y double, q long, nx double, ny double"), "p")
    levels, ended, _ = multipole.traverse(pos, 0, 24, 64, None, lambda lvl: lvl >= 2, scratch)
    on_level = {lvl: here.count() for lvl, here, _ in levels}
    pairs = {lvl: p.count() for lvl, _, p in levels}
    assert levels[-1][0] >= 18 and on_level[0] == len(rows) == ended.count()
    for lvl in range(8, levels[-1][0] + 1):               # only the spot and what lies beside it
        assert on_level[lvl] <= 200 + 64 and pairs[lvl] < 400
    # moments: one row per active cell, whatever the depth
    top = 2
    moments = multipole._moments(ended, top, 4)
    cells = sum(here.select("ix", "iy").distinct().count() for lvl, here, _ in levels if lvl >= top)
    assert moments.count() == cells
    scratch.drop()


def test_upward_pass_is_narrow_and_right(spark):
    """Evenly spread points: rows before the shuffle stay near 4/3 of the lowest cells, and every level's
    moments are those of its points."""
    rng = np.random.default_rng(2)
    n, depth, terms = 4000, 5, 6
    nx, ny = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    pos = spark.createDataFrame([(float(a), float(b), 1 + i % 3, depth) for i, (a, b) in enumerate(zip(nx, ny))],
                                "nx double, ny double, q long, depth int").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        got = multipole._moments(pos, 2, terms)
        plan = got._jdf.queryExecution().analyzed().toString()
        assert "RepartitionByExpression" in plan
        out = got.toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    leaves = len(out[out.lvl == depth])
    assert len(out) <= 4 / 3 * leaves + depth
    q = 1 + np.arange(n) % 3
    for r in out.sample(60, random_state=1).itertuples():
        h = 0.5 ** r.lvl
        own = (np.floor(nx / h) == r.ix) & (np.floor(ny / h) == r.iy)
        u = (nx[own] / h - r.ix - 0.5) + 1j * (ny[own] / h - r.iy - 0.5)
        for k in range(terms):
            assert abs((q[own] * u ** k).sum() - complex(getattr(r, f"ar{k}"), getattr(r, f"ai{k}"))) < 1e-9


def test_positions_of_a_cell_go_once_to_a_block_of_targets(spark, monkeypatch):
    """Direct sums of 400 positions in 64 cells of one block, all cells with all: 400 positions are shuffled, not 64 times 400."""
    rng = np.random.default_rng(5)
    xs, ys = rng.uniform(0, 8, 400).round(1), rng.uniform(0, 8, 400).round(1)
    spots = sorted({(x, y) for x, y in zip(xs, ys)})
    rows = [(6, int(min(x, 7.9)), int(min(y, 7.9)), float(x), float(y), 1 + i % 3) for i, (x, y) in enumerate(spots)]
    pos = spark.createDataFrame(rows + [(6, None, None, None, None, 1)], "lvl int, ix long, iy long, x double, y double, q long")
    cells = sorted({r[1:3] for r in rows})
    pairs = spark.createDataFrame([(6, *t, *s) for t in cells for s in cells] + [(6, None, None, None, None)],
                                  "lvl int, tx long, ty long, sx long, sy long")
    monkeypatch.setattr(multipole, "_PAIRS", 50)
    for radius in (None, 2.0):
        out = multipole._direct(pos, pairs, 1e-4, radius)
        got = out.groupBy("x", "y").sum("fx", "fy").toPandas().sort_values(["x", "y"]).to_numpy()
        p, q = np.array(spots), np.array([r[5] for r in rows])
        d = p[:, None] - p[None, :]
        d2 = (d ** 2).sum(2)
        w = np.where(d2 <= (radius or 1e9) ** 2, q / np.maximum(d2, 1e-8), 0.0)
        assert np.allclose(got, np.column_stack([p, (w[:, :, None] * d).sum(1)]), rtol=1e-9, atol=1e-9)
        text = out._jdf.queryExecution().toString()
        assert "CoGroupsInPandas" in text
