"""Start positions, the position grid, and layouts that do not depend on the order of sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdrift.model import Graph, LayoutParams
from graphdrift.operators import build, layout
from graphdrift.operators.multipole import traverse
from graphdrift.session import Scratch


@pytest.mark.parametrize("bounds,low", [("center", -500.0), ("corner", 0.0), ("none", 0.0)])
def test_start_positions_lie_in_the_box(spark, bounds, low):
    x, y = build.start_position(F.col("id"), 1000.0, 1000.0, 3, bounds)
    p = spark.range(0, 2000).select(x.alias("x"), y.alias("y")).toPandas()
    for c in (p.x, p.y):
        assert low <= c.min() < low + 20 and low + 980 < c.max() <= low + 1000
    assert abs(np.corrcoef(p.x, p.y)[0, 1]) < 0.1


def test_start_positions_are_distinct_for_any_id(spark):
    n = 2_000_000
    x, y = build.start_position(F.col("id"), 10000.0, 10000.0, 0)
    assert spark.range(n).select(x.alias("x"), y.alias("y")).distinct().count() > 0.99 * n
    far = spark.range(1 << 62, (1 << 62) + 50).unionByName(spark.range(-(1 << 62), -(1 << 62) + 50))
    assert far.select(x.alias("x"), y.alias("y")).distinct().count() == 100
    small = spark.range(10).select(build.start_position(F.col("id"), 0.5, 0.5, 0)[0].alias("x")).collect()
    assert all(abs(r.x) <= 0.25 for r in small)


def _graph(spark, piled):
    x, y = build.start_position(F.col("id"), 10000.0, 10000.0, 7)
    if piled:
        x, y = (F.when(F.col("id") % 3 == 0, F.lit(5000.0)).otherwise(c) for c in (x, y))
    v = spark.range(90).select("id", F.col("id").cast("string").alias("label"), x.alias("x"), y.alias("y"),
                               F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    e = spark.range(300).select((F.col("id") * 7 % 90).alias("src"), (F.col("id") * F.col("id") * 3 % 90).alias("dst"),
                                F.lit(1.0).alias("weight"))
    return Graph(v, e)


@pytest.mark.parametrize("piled", [False, True])
def test_layout_is_the_same_for_any_partitioning(spark, piled):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("1", "5", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            v = layout.layout(_graph(spark, piled), LayoutParams(iterations=3)).graph.vertices
            got.append(sorted((r.id, round(r.x, 4), round(r.y, 4)) for r in v.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1] == got[2]


def test_deepest_cell_is_bounded(spark):
    """Points crowded on the grid within a few steps of each other, in a wide area: where the tree can
    go no deeper a cell is under 8 steps wide and holds at most 81 of them."""
    eps, span = 1e-4, 10000.0
    side = np.arange(40) * eps
    pts = [(float(a), float(b)) for a in side for b in side] + [(span * (1 - 1e-9), span * (1 - 1e-9))]
    depth = int(np.floor(np.log2(span / (4 * eps))))
    scratch = Scratch(spark)
    df = scratch.table(spark.createDataFrame([(a, b, 1, a / span, b / span) for a, b in pts],
                                             "x double, y double, q long, nx double, ny double"), "p")
    levels, ended, _ = traverse(df, 0, depth, 4, None, lambda lvl: lvl >= 2, scratch)
    assert levels[-1][0] == depth and ended.count() == len(pts)
    assert levels[-1][1].groupBy("ix", "iy").count().agg(F.max("count")).first()[0] <= 81
    scratch.drop()
