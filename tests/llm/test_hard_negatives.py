"""Hard negatives against brute force: ties, nulls, negative and huge scores, odd dimensions, many small groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdrift.llm import common, hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, id string, vector int, score int, block int"


def _table(spark, rows):
    return common.staged(spark.createDataFrame([(i, v, k, "x", 1, 2, 3) for i, v, k in rows], SCHEMA).repartition(5), "t-vectors")


def _brute(rows, every=10, k=5, low=80, high=100):
    clean = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows
             if i is not None and v is not None and g is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, g in {(i, tuple(x), g) for i, x, g in clean if i % every == 0}:
        score = lambda w: sum(x * y for x, y in zip(v, w))  # noqa: E731,B023
        pos = sorted((-score(w), i) for i, w, h in clean if h == g and i != a and len(w) == len(v))[:k]
        neg = sorted((-score(w), i) for i, w, h in clean if h != g and len(w) == len(v))
        for p, i in pos:
            best = [(n, j) for n, j in neg if low * -p <= 100 * -n <= high * -p][:k]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(best)]
    return sorted(out)


def _mined(df, every=10, **how):
    got = H.mine(H.integer_vectors(df), F.col("id") % every == 0, **how)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def _clustered(rng, n, dim, labels):
    centre = rng.normal(0, 1, (8, dim))
    c = rng.integers(0, 8, n)
    v = centre[c] + rng.normal(0, 0.2, (n, dim))
    return [(i, v[i].tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"group_bytes": 500, "block_rows": 4, "batch_rows": 7}, {"low_share": 50, "high_share": 95}])
def test_mined_are_those_of_brute_force(spark, how):
    rng = np.random.default_rng(3)
    rows = _clustered(rng, 300, 6, 3)
    rows += [(1000 + i, rng.integers(-2, 3, 6).astype(float).tolist(), int(rng.integers(0, 3))) for i in range(80)]      # many ties
    rows += [(2000, None, 1), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2020, [math.nan] * 6, 1), (2030, [math.inf] + [0.0] * 5, 2),
             (2040, [1.0] * 6, None), (None, [1.0] * 6, 1), (2050, [0.0] * 6, 0), (2060, [1.0, 2.0], 1), (2061, [1.0, 2.0], 1),
             (2062, [1.0, 1.5], 2), (2070, [], 1), (2080, [5.0] * 6, 77)]
    rows += [(1005, rows[305][1], rows[305][2]), (20, rows[20][1], rows[20][2])]                                        # repeated rows
    share = {k: v for k, v in how.items() if k.endswith("share")}
    want = _brute(rows, low=share.get("low_share", 80), high=share.get("high_share", 100))
    assert _mined(_table(spark, rows), **how) == want and len(want) > 100


def test_huge_components_are_exact(spark):
    rows = [(i, [float(3 * 10 ** 5 + i), float(-i * 10 ** 5), 7.0 * i], i % 2) for i in range(30)]
    assert _mined(_table(spark, rows)) == _brute(rows)


def test_empty_and_lonely(spark):
    assert _mined(_table(spark, [])) == []
    assert _mined(_table(spark, [(10, [1.0, 0.0], 1)])) == []
    assert _mined(_table(spark, [(10, [1.0, 0.0], 1), (11, [1.0, 0.0], 2)])) == []


def test_tree_spans_with_short_edges():
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (60, 5))
    order, parent, edge = H.spanning_tree(v)
    assert sorted(order.tolist()) == list(range(60)) and parent[0] == -1 and (parent[1:] < np.arange(1, 60)).all()
    d = np.linalg.norm(v[order][1:] - v[order][parent[1:]], axis=1)
    assert np.allclose(edge[1:], d) and (edge[1:] >= d).all()
    full = np.linalg.norm(v[:, None] - v[None], axis=2)
    inside, total = {0}, 0.0
    while len(inside) < 60:                               # Prim on the whole matrix
        w, j = min((full[i, j], j) for i in inside for j in range(60) if j not in inside)
        total += w
        inside.add(j)
    assert edge.sum() == pytest.approx(total)


def test_bounds_spare_most_scores_where_vectors_cluster():
    rng = np.random.default_rng(8)
    centre = rng.normal(0, 1, (20, 16))
    c = rng.integers(0, 20, 4000)
    v = np.floor(256 * (centre[c] + rng.normal(0, 0.02, (4000, 16))))
    at = np.flatnonzero(np.arange(4000) % 40 == 0)
    order, parent, edge = H.spanning_tree(v[at])
    at = at[order]
    row = {"ids": at.astype(np.int64).tobytes(), "labels": (c[at] % 5).astype(np.int64).tobytes(), "vectors": v[at].tobytes(),
           "parents": parent.tobytes(), "edges": edge.tobytes()}
    seen = H.Positives([H.Block(row)], 5)
    scored = sum(seen.see(np.arange(lo, lo + 500), (c % 5)[lo:lo + 500], v[lo:lo + 500]) for lo in range(0, 4000, 500))
    assert scored < 0.35 * 100 * 4000
    ids, found, score = (x for x in next(seen.rows()))
    for a in at.tolist():
        own = np.flatnonzero((c % 5 == c[a] % 5) & (np.arange(4000) != a))
        s = v[own] @ v[a]
        assert found[ids == a].tolist() == own[np.lexsort((own, -s))[:5]].tolist()
