"""Hand-checkable values of the first layout step on the demo graphs."""

import math

import pytest
from pyspark.sql import functions as F

from graphdrift.model import LayoutParams
from graphdrift.operators import forces, layout, step
from graphdrift.sources import fixtures

P = LayoutParams(width=1000.0, height=1000.0, kf=0.8, rep_scale=1.0, attr_scale=1.0, gravity=0.0,
                 eps=1e-4, cf=0.1, iterations=20)

GOLD = {
    "pair": (565.6854, "center", {
        1: ((1600, 0), (-70.7107, 0), (200, 100)),
        2: ((-1600, 0), (70.7107, 0), (-200, 100))}),
    "box": (400.0, "center", {
        1: ((1200, 1200), (-100, -100), (170.7107, 170.7107)),
        2: ((-1200, 1200), (100, -100), (-170.7107, 170.7107)),
        3: ((-1200, -1200), (100, 100), (-170.7107, -170.7107)),
        4: ((1200, -1200), (-100, 100), (170.7107, -170.7107))}),
    "house": (357.7709, "corner", {
        1: ((209.5584, -815.6720), (316.0278, 1801.1444), (227.0589, 138.2353)),
        2: ((801.1762, -395.3554), (-2546.4819, 1760.2704), (521.2281, 161.6035)),
        3: ((-1139.6397, 22.1833), (1651.9928, 1643.2911), (59.4033, 225.5795)),
        4: ((-198.7427, 680.0884), (1435.3348, -5469.2819), (155.0005, 733.1756)),
        5: ((327.6479, 508.7557), (-856.8735, 264.5761), (343.5241, 482.5256))}),
}


def _rows(df, cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(GOLD))
def test_first_step(spark, name):
    k_gold, bounds, per = GOLD[name]
    g = getattr(fixtures, name)(spark)
    p = P.but(bounds=bounds)
    k = forces.ideal_length(g.vertices, p)
    assert k == pytest.approx(k_gold, abs=1e-4)
    rep = _rows(forces.repulsion_all(g.vertices, k, p), ["dx", "dy"])
    att = _rows(forces.attraction_both_ends(g, k, p), ["dx", "dy"])
    res = layout.layout(g, p.but(iterations=1))
    new = _rows(res.graph.vertices, ["x", "y"])
    for vid, (r, a, xy) in per.items():
        assert rep[vid] == pytest.approx(r, abs=1e-3)
        assert att[vid] == pytest.approx(a, abs=1e-3)
        assert new[vid] == pytest.approx(xy, abs=1e-3)


def test_printed_single_operator_values(spark):
    from graphdrift.functions import vec
    df = spark.createDataFrame([(200.0, 0.0, 0.0, 0.0)], "dx double, dy double, z double, w double")
    # repulsion on (100,100) from (-100,100), k = 400, scale 1 -> (800, 0)
    rx, ry = vec.repulsion(F.col("dx"), F.col("dy"), 400.0, 1.0, 1e-4)
    # link of length 200, magnitude l^2 / k = 100
    ax, ay = vec.attraction(F.col("dx"), F.col("dy"), 400.0, 1.0, 1e-4)
    # area 10000^2, n = 5, scale 0.01 -> (640, 0)
    k5 = LayoutParams().ideal_length(5)
    sx, sy = vec.repulsion(F.col("dx"), F.col("dy"), k5, 0.01, 1e-4)
    # link of length 0 -> (0, 0); gravity with gamma 0 -> (0, 0)
    zx, zy = vec.attraction(F.col("z"), F.col("w"), 400.0, 1.0, 1e-4)
    gx, gy = vec.gravity(F.lit(-100.0), F.lit(100.0), 0.0, 1e-4)
    r = df.select(rx.alias("rx"), ry.alias("ry"), vec.length(ax, ay).alias("al"), sx.alias("sx"),
                  zx.alias("zx"), zy.alias("zy"), gx.alias("gx"), gy.alias("gy")).first()
    assert (r.rx, r.ry) == pytest.approx((800.0, 0.0))
    assert r.al == pytest.approx(100.0)
    assert r.sx == pytest.approx(640.0)
    assert (r.zx, r.zy, r.gx, r.gy) == (0.0, 0.0, 0.0, 0.0) or all(abs(v) == 0 for v in (r.zx, r.zy, r.gx, r.gy))
    # cooling after t = 1 of 20 iterations, area 10000^2
    assert LayoutParams().temperature(1) == pytest.approx(950.0)
    sched = {r.iteration: r.temperature for r in step.cooling_schedule(spark, LayoutParams()).collect()}
    assert sched[1] == pytest.approx(950.0) and sched[0] == pytest.approx(1000.0) and sched[20] == 0.0
    assert math.isclose(k5, 0.8 * math.sqrt(1e8 / 5))
