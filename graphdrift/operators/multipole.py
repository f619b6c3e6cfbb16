"""Repulsion sums without enumerating pairs: a 2-D fast multipole method on DataFrames.

The repulsion on vertex i is  sum_j (p_i - p_j) / max(eps, |p_i - p_j|)^2  over all j, or
over the j within a radius.  With positions as complex numbers z,
(p_i - p_j)/|p_i - p_j|^2 = conj(1 / (z_i - z_j)), so away from the eps floor the force
is the conjugate of the Cauchy sum  sum_j 1 / (z_i - z_j):

* positions are grouped by exact (x, y) first: a pile of coincident vertices is one
  row with a count (they exert no force on each other);
* a dual-tree traversal refines a table of open cell pairs level by level with keyed
  joins on parent cells: pairs wholly beyond the radius are dropped, pairs wholly
  inside it and well separated are translated (multipole -> local, Arrow-batched numpy
  matrix products), pairs of few positions are summed exactly between distinct positions,
  with the eps floor, met by blocks of target cells in numpy, and only the rest are refined;
* so the tree is adaptive: a level holds only the cells of pairs left open above it, that is, what
  lies in or beside a spot too dense for direct sums.  Where a dense spot meets a sparse
  neighbour, the neighbour's few positions follow it down as cells of their own, so both sides of a pair
  are always of one level;
* moments come up the tree in Morton order: positions are range-partitioned by it, every Arrow batch
  sums its own cells level by level, each from its children, and only the cells that several batches share
  meet in the shuffle: about one wide row per active cell.

No cross join and no per-group pair lists: every join is an equi-join on cell keys.
Series are scaled to the cell width of their level, so values stay in [-1, 1]-ish
ranges at any depth; 32 terms keep the relative error near 1e-13.  A pair of cells is summed directly
once it has at most ``leaf_capacity`` squared pairs of positions.
"""

from __future__ import annotations

import functools
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

# The Arrow-batch kernels below run in Python workers; ship this module's code with
# them instead of requiring the package on every worker's import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BITS = 3      # translations are summed in blocks of 8 x 8 target cells


def offsets_col(offsets) -> Column:
    """explode() of a literal array of (ox, oy) structs, built as one SQL expression."""
    items = ", ".join(f"named_struct('ox', {a}, 'oy', {b})" for a, b in offsets)
    return F.expr(f"explode(array({items}))")


def _sum_by(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Keyed sums of many columns, keeping the column names."""
    return df.groupBy(*keys).sum(*names).toDF(*keys, *names)


def _re(p, k):
    return f"{p}r{k}"


def _im(p, k):
    return f"{p}i{k}"


def _names(p, terms):
    return [_re(p, k) for k in range(terms)] + [_im(p, k) for k in range(terms)]


def _schema(keys, p, terms):
    return ", ".join([f"{k} long" for k in keys] + [f"{c} double" for c in _names(p, terms)])


@functools.lru_cache(maxsize=None)
def _child_shift(terms: int) -> dict[int, np.ndarray]:
    """Local-expansion shift from a cell to each child quadrant (one matrix per quadrant).

    Child centre minus parent centre is delta = ((qx - 1/2)/2, (qy - 1/2)/2) in parent
    widths:  B'_j = sum_{m >= j} C(m,j) 2^-j delta^(m-j) B_m.
    """
    out = {}
    for qx in (0, 1):
        for qy in (0, 1):
            delta = complex((qx - 0.5) / 2.0, (qy - 0.5) / 2.0)
            mat = np.zeros((terms, terms), dtype=complex)
            for j in range(terms):
                for m in range(j, terms):
                    mat[j, m] = math.comb(m, j) * 0.5 ** j * delta ** (m - j)
            out[qx * 2 + qy] = mat
    return out


@functools.lru_cache(maxsize=None)
def _m2l_binomials(terms: int) -> np.ndarray:
    """C(k + l, l) for l, k < terms, with the (-1)^l sign folded in (row l)."""
    return np.array([[(-1) ** l * math.comb(k + l, l) for k in range(terms)] for l in range(terms)], dtype=float)


def _complex_block(pdf: pd.DataFrame, p: str, terms: int) -> np.ndarray:
    re = pdf[[_re(p, k) for k in range(terms)]].to_numpy(dtype=float)
    im = pdf[[_im(p, k) for k in range(terms)]].to_numpy(dtype=float)
    return re + 1j * im


def _complex_frame(keys: dict, vals: np.ndarray, p: str, terms: int) -> pd.DataFrame:
    cols = dict(keys)
    for k in range(terms):
        cols[_re(p, k)] = vals[:, k].real
    for k in range(terms):
        cols[_im(p, k)] = vals[:, k].imag
    return pd.DataFrame(cols)


@functools.lru_cache(maxsize=None)
def _parent_shift(terms: int) -> dict[int, np.ndarray]:
    """Multipole shift from each child quadrant to its parent (one matrix per quadrant): with delta the child's
    centre minus the parent's, in parent widths,  A'_m = sum_{k <= m} C(m,k) 2^-k delta^(m-k) A_k."""
    out = {}
    for qx in (0, 1):
        for qy in (0, 1):
            delta = complex((qx - 0.5) / 2.0, (qy - 0.5) / 2.0)
            out[qx * 2 + qy] = np.array([[math.comb(m, k) * 0.5 ** k * delta ** (m - k) if k <= m else 0.0
                                          for k in range(terms)] for m in range(terms)], dtype=complex)
    return out


def _morton(nx: Column, ny: Column) -> Column:
    """Place of a position (both coordinates in [0, 1)) on the Z-order curve of 2^30 cells a side."""
    def spread(c: Column) -> Column:
        v = F.least(F.lit((1 << 30) - 1), F.floor(c * F.lit(float(1 << 30)))).cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                            (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v
    return F.shiftleft(spread(nx), 1).bitwiseOR(spread(ny))


def _cell(c: Column, level: int) -> Column:
    side = 2 ** level
    return F.least(F.lit(side - 1), F.floor(c * F.lit(float(side)))).cast("long")


def _moments(pos: DataFrame, top: int, terms: int) -> DataFrame:
    """Multipoles (lvl, ix, iy, a*) of every cell at the levels top..depth of each position (nx, ny, q,
    depth): the cells of its way down the tree.

    In Morton order a cell's positions lie together, so a batch holds most of its cells whole.  From the deepest
    level up, a level's cells are the positions that end there (P2M) and the cells below, shifted (M2M)."""
    parts = int(pos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (pos.filter(F.col("depth") >= top).select("nx", "ny", "q", "depth", _morton(F.col("nx"), F.col("ny")).alias("z"))
            .repartitionByRange(parts, "z").sortWithinPartitions("z"))
    mats = _parent_shift(terms)

    def up(batches):
        for pdf in batches:
            nx, ny, q, depth = (pdf[c].to_numpy() for c in ("nx", "ny", "q", "depth"))
            cx = cy = np.zeros(0, np.int64)
            vals = np.zeros((0, terms), dtype=complex)
            for lvl in range(int(depth.max(initial=-1)), top - 1, -1):
                moved = np.empty_like(vals)
                for quad, mat in mats.items():
                    sel = (cx % 2) * 2 + cy % 2 == quad
                    moved[sel] = vals[sel] @ mat.T
                here = depth == lvl
                side = 2 ** lvl
                px = np.minimum(side - 1, np.floor(nx[here] * side)).astype(np.int64)
                py = np.minimum(side - 1, np.floor(ny[here] * side)).astype(np.int64)
                u = (nx[here] * side - (px + 0.5)) + 1j * (ny[here] * side - (py + 0.5))
                own = np.cumprod(np.column_stack([np.ones_like(u)] + [u] * (terms - 1)), axis=1) * q[here].astype(float)[:, None]
                keys = np.concatenate((cx >> 1, px)) * (1 << 31) + np.concatenate((cy >> 1, py))
                uniq, inv = np.unique(keys, return_inverse=True)
                vals = np.zeros((len(uniq), terms), dtype=complex)
                np.add.at(vals, inv, np.concatenate((moved, own)))
                cx, cy = uniq >> 31, uniq & ((1 << 31) - 1)
                if len(uniq):
                    yield _complex_frame({"lvl": np.full(len(uniq), lvl), "ix": cx, "iy": cy}, vals, "a", terms)

    per_batch = rows.mapInPandas(up, "lvl int, " + _schema(["ix", "iy"], "a", terms))
    return _sum_by(per_batch, ["lvl", "ix", "iy"], _names("a", terms))


def _m2l(pairs: DataFrame, cells: DataFrame, level: int, terms: int) -> DataFrame:
    """Local expansions at target cells from the multipoles of well-separated source cells.

    ``pairs`` holds (tx, ty, sx, sy) at this level, far ones only.  With D = (c_T - c_S) / h:
    B_l = (1/h) sum_k (-1)^l C(k+l, l) D^-(k+l+1) A_k.

    Pairs stay narrow: they meet by blocks of neighbouring target cells, and a source cell's
    moments go once to each block that needs them (about three), not once per pair.  A
    block's sums per target leave it as one row each, so no wide row is summed after a shuffle.
    A block has at most 4^BLOCK_BITS targets, each with a number of far pairs that does not
    grow with the data.
    """
    inv_h = float(2 ** level)
    binom = _m2l_binomials(terms)
    block = [F.shiftright("tx", BLOCK_BITS).alias("bx"), F.shiftright("ty", BLOCK_BITS).alias("by")]
    narrow = pairs.select(*block, "tx", "ty", "sx", "sy")
    wanted = narrow.select(F.col("bx").alias("cx"), F.col("by").alias("cy"), F.col("sx").alias("ix"),
                           F.col("sy").alias("iy")).distinct()
    moments = wanted.join(cells.select("ix", "iy", *_names("a", terms)), ["ix", "iy"], "inner")

    def translate(p, s):
        p = p.sort_values(["tx", "ty"])
        tx, ty, sx, sy = (p[c].to_numpy() for c in ("tx", "ty", "sx", "sy"))
        have = s["ix"].to_numpy() * (1 << 31) + s["iy"].to_numpy()
        order = np.argsort(have)
        a = _complex_block(s, "a", terms)[order[np.searchsorted(have, sx * (1 << 31) + sy, sorter=order)]]
        inv = 1.0 / ((tx - sx).astype(float) + 1j * (ty - sy).astype(float))
        pw = np.cumprod(np.repeat(inv[:, None], 2 * terms, axis=1), axis=1)   # pw[:, n] = D^-(n+1)
        out = np.empty_like(a)
        for l in range(terms):
            out[:, l] = (a * pw[:, l:l + terms]) @ binom[l]
        first = np.flatnonzero(np.r_[True, (np.diff(tx) != 0) | (np.diff(ty) != 0)])
        return _complex_frame({"ix": tx[first], "iy": ty[first]}, np.add.reduceat(out, first) * inv_h, "b", terms)

    return (narrow.groupBy("bx", "by").cogroup(moments.groupBy("cx", "cy"))
            .applyInPandas(translate, _schema(["ix", "iy"], "b", terms)))


def _l2l(parent_local: DataFrame, child_cells: DataFrame, terms: int) -> DataFrame:
    """Shift parent local expansions to each (non-empty) child centre."""
    mats = _child_shift(terms)
    kids = child_cells.select("ix", "iy", (F.col("ix") / 2).cast("long").alias("px"),
                              (F.col("iy") / 2).cast("long").alias("py"))
    par = parent_local.withColumnRenamed("ix", "px").withColumnRenamed("iy", "py")
    j = kids.join(par, ["px", "py"], "inner").select("ix", "iy", *_names("b", terms))

    def down(batches):
        for pdf in batches:
            b = _complex_block(pdf, "b", terms)
            quad = (pdf["ix"].to_numpy() % 2) * 2 + (pdf["iy"].to_numpy() % 2)
            out = np.empty_like(b)
            for q, mat in mats.items():
                sel = quad == q
                if sel.any():
                    out[sel] = b[sel] @ mat.T
            yield _complex_frame({"ix": pdf["ix"], "iy": pdf["iy"]}, out, "b", terms)

    return j.mapInPandas(down, _schema(["ix", "iy"], "b", terms))


def _add_locals(a: DataFrame, b: DataFrame, terms: int) -> DataFrame:
    return _sum_by(a.unionByName(b), ["ix", "iy"], _names("b", terms))


def _pair_classes(level: int, radius_n: float | None) -> tuple[Column, Column]:
    """(keep, far) for cell pairs at ``level``: keep = some point pair may lie within the
    radius; far = every point pair lies within it and the cells are well separated."""
    h = 1.0 / (2 ** level)
    ax = F.abs(F.col("tx") - F.col("sx")).cast("double")
    ay = F.abs(F.col("ty") - F.col("sy")).cast("double")
    separated = F.greatest(ax, ay) >= 2
    if radius_n is None:
        return F.lit(True), separated
    r2 = radius_n * radius_n
    gx = F.greatest(ax - 1.0, F.lit(0.0))
    gy = F.greatest(ay - 1.0, F.lit(0.0))
    min_d2 = (gx * gx + gy * gy) * (h * h)
    max_d2 = ((ax + 1.0) * (ax + 1.0) + (ay + 1.0) * (ay + 1.0)) * (h * h)
    keep = min_d2 <= F.lit(r2 * (1.0 + 1e-9))
    inside = max_d2 <= F.lit(r2 * (1.0 - 1e-9))
    return keep, separated & inside


def _refine(open_pairs: DataFrame, child_cells: DataFrame) -> DataFrame:
    """Children of every open cell pair, for non-empty children only (two keyed joins), with how many
    positions each has (tm, sm)."""
    kids = child_cells.select("ix", "iy", "m", (F.col("ix") / 2).cast("long").alias("px"),
                              (F.col("iy") / 2).cast("long").alias("py"))
    t = kids.select(F.col("ix").alias("tx"), F.col("iy").alias("ty"), F.col("m").alias("tm"), F.col("px").alias("ptx"),
                    F.col("py").alias("pty"))
    s_ = kids.select(F.col("ix").alias("sx"), F.col("iy").alias("sy"), F.col("m").alias("sm"), F.col("px").alias("psx"),
                     F.col("py").alias("psy"))
    o = open_pairs.select(F.col("tx").alias("ptx"), F.col("ty").alias("pty"),
                          F.col("sx").alias("psx"), F.col("sy").alias("psy"))
    return o.join(t, ["ptx", "pty"], "inner").join(s_, ["psx", "psy"], "inner").select("tx", "ty", "tm", "sx", "sy", "sm")


def _first_pairs(cells: DataFrame, level: int) -> DataFrame:
    """Candidate pairs of the level the traversal starts at: cells at most 3 apart (at level 0 the root pair,
    taken from the data: literal keys would let the optimizer turn the next equi-joins into a cartesian product)."""
    t = cells.select(F.col("ix").alias("tx"), F.col("iy").alias("ty"), F.col("m").alias("tm"))
    if level == 0:
        return t.select("*", F.col("tx").alias("sx"), F.col("ty").alias("sy"), F.col("tm").alias("sm"))
    reach = [(a, b) for a in range(-3, 4) for b in range(-3, 4)]
    src = cells.select(F.col("ix").alias("sx"), F.col("iy").alias("sy"), F.col("m").alias("sm"), offsets_col(reach).alias("o"))
    src = src.select("sx", "sy", "sm", (F.col("sx") - F.col("o.ox")).alias("tx"), (F.col("sy") - F.col("o.oy")).alias("ty"))
    return src.join(t, ["tx", "ty"]).select("tx", "ty", "tm", "sx", "sy", "sm")


#: What becomes of a pair of cells.
FAR, DIRECT, OPEN = 1, 2, 3


def traverse(pos: DataFrame, first: int, max_depth: int, leaf_capacity: int, radius_n: float | None, translates,
             scratch: Scratch) -> tuple[list[tuple[int, DataFrame, DataFrame]], DataFrame, list[int]]:
    """Walk the pairs of cells down from level ``first``.

    Returns, for each level reached, (level, its positions with their cells ix, iy, its pairs with ``kind`` FAR or
    DIRECT or OPEN), all positions (nx, ny, q, depth, ix, iy) with the last level they were on, and the levels with
    FAR pairs.  Levels hold narrow rows only; both tables of a level are work tables."""
    here, levels, ended, open_pairs, with_far = pos, [], [], None, []
    for lvl in range(first, max_depth + 1):
        here = here.select("x", "y", "q", "nx", "ny", _cell(F.col("nx"), lvl).alias("ix"), _cell(F.col("ny"), lvl).alias("iy"))
        if lvl > first:
            active = open_pairs.select(F.explode(F.array(F.struct(F.col("tx").alias("px"), F.col("ty").alias("py")),
                                                         F.struct(F.col("sx").alias("px"), F.col("sy").alias("py")))).alias("c")) \
                               .select("c.px", "c.py").distinct()
            parents = [(F.col("ix") / 2).cast("long").alias("px"), (F.col("iy") / 2).cast("long").alias("py")]
            split = scratch.table(here.select("*", *parents).join(active.withColumn("on", F.lit(True)), ["px", "py"], "left")
                                  .select("x", "y", "q", "nx", "ny", "ix", "iy", "px", "py", F.coalesce("on", F.lit(False)).alias("on")),
                                  "positions")
            ended.append(split.filter("not on").select("x", "y", "q", "nx", "ny", F.lit(lvl - 1).alias("depth"),
                                                       F.col("px").alias("ix"), F.col("py").alias("iy")))
            here = split.filter("on").drop("px", "py", "on")
        cells = here.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("m"))
        cand = _first_pairs(cells, lvl) if lvl == first else _refine(open_pairs, cells)
        keep, far = _pair_classes(lvl, radius_n)
        few = F.col("tm") * F.col("sm") <= leaf_capacity * leaf_capacity
        kind = F.when(few if lvl < max_depth else F.lit(True), DIRECT).otherwise(OPEN)
        if translates(lvl):
            kind = F.when(far, FAR).otherwise(kind)
        pairs = scratch.table(cand.filter(keep).select("tx", "ty", "sx", "sy", kind.alias("kind")), "pairs")
        levels.append((lvl, here, pairs))
        open_pairs = pairs.filter(F.col("kind") == OPEN)
        kinds = {r["kind"] for r in pairs.select("kind").distinct().collect()}
        if FAR in kinds:
            with_far.append(lvl)
        if OPEN not in kinds:
            break
    ended.append(here.select("x", "y", "q", "nx", "ny", F.lit(lvl).alias("depth"), "ix", "iy"))
    return levels, scratch.table(_union(ended), "ended"), with_far


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def cauchy_repulsion(points: DataFrame, eps: float, terms: int = 32, leaf_capacity: int = 64,
                     depth: int | None = None, radius: float | None = None,
                     scratch: Scratch | None = None) -> DataFrame:
    """(id, fx, fy) = sum over j != i with |p_i - p_j| <= radius (all j when radius is None)
    of (p_i - p_j) / max(eps, |p_i - p_j|)^2, exactly up to the series truncation.

    Dual-tree traversal over an adaptive quadtree of non-empty cells, level by level:
    a cell pair entirely beyond the radius is dropped; entirely inside and well separated,
    it is handled by one multipole-to-local translation; with at most ``leaf_capacity`` squared pairs of
    positions it is summed exactly; otherwise it is refined into its child pairs.  The rule is the same
    for every number of points.  A pile of vertices on one spot is one weighted row.  Where the tree is as deep as ``eps``
    allows (or ``depth``, if given), all that is left is summed: a cell is then under 8 eps wide, so of points on
    the grid of step eps it holds at most 81 positions.  Distinct positions, each level's positions and cell pairs, the
    moments and the local expansions are work tables in ``scratch``, which the caller may drop
    once the result is written (without one they stay until ``session.clear_work``).
    """
    scratch = scratch or Scratch(points.sparkSession)
    bb = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                    F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    zero = points.select("id", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    if bb is None or not bb["n"] or bb["n"] <= 1:
        return zero
    x0, y0 = float(bb["x0"]), float(bb["y0"])
    span = max(float(bb["x1"]) - x0, float(bb["y1"]) - y0)
    if span <= 0.0:
        return zero
    span = span * (1.0 + 1e-9)
    radius_n = None if radius is None else float(radius) / span
    # cells of the deepest level must stay wider than eps, so translated pairs never need the floor
    max_depth = max(2, min(30, int(math.floor(math.log2(span / (4.0 * eps))))))
    pos = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("q"))
    pos = scratch.table(pos, "positions")
    pos_norm = pos.select("x", "y", "q", ((F.col("x") - F.lit(x0)) / F.lit(span)).alias("nx"),
                          ((F.col("y") - F.lit(y0)) / F.lit(span)).alias("ny"))
    if depth is not None:
        max_depth = depth

    # Levels where a translation can occur: l >= 2 and, with a radius, cells small enough
    # (width <= radius / sqrt(10)) to lie wholly inside it while being well separated.
    # Translated pairs are at least one cell width apart, so cells narrower than eps
    # (a cluster within a few eps) never translate: the eps floor applies there.
    def translates(lvl: int) -> bool:
        return (lvl >= 2 and span / 2 ** lvl >= eps
                and (radius_n is None or (1.0 / 2 ** lvl) * math.sqrt(10.0) <= radius_n))

    # Traversal starts at the deepest level whose cells reach at most 3 cells out.
    if radius_n is None or radius_n >= 3.0:
        first = 0
    else:
        first = max(0, min(max_depth, math.ceil(math.log2(3.0 / radius_n)) - 1))
    levels, ended, with_far = traverse(pos_norm, first, max_depth, leaf_capacity, radius_n, translates, scratch)
    tag = lambda df, lvl: df.select(F.lit(lvl).alias("lvl"), "*")
    direct = _union([tag(pairs.filter(F.col("kind") == DIRECT).drop("kind"), lvl) for lvl, _, pairs in levels])
    parts = [_direct(_union([tag(here, lvl) for lvl, here, _ in levels]), direct, eps, radius)]
    if with_far:
        moments = scratch.table(_moments(ended, with_far[0], terms), "moments", partition_by="lvl")
        local, locals_ = None, []
        for lvl, here, pairs in levels:
            if lvl < with_far[0]:
                continue
            grown = None if local is None else _l2l(local, here.select("ix", "iy").distinct(), terms)
            if lvl in with_far:
                m2l = _m2l(pairs.filter(F.col("kind") == FAR), moments.filter(F.col("lvl") == lvl).drop("lvl"), lvl, terms)
                grown = m2l if grown is None else _add_locals(grown, m2l, terms)
            # materialised per level: keeps every job's plan one level deep
            local = scratch.table(grown, "local")
            locals_.append(tag(local, lvl))
        parts.append(_far_field(ended, _union(locals_), span, terms))
    per_pos = parts[0]
    for p in parts[1:]:
        per_pos = per_pos.unionByName(p)
    per_pos = per_pos.groupBy("x", "y").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    return points.select("id", "x", "y").join(per_pos, ["x", "y"], "left").select(
        "id", F.coalesce(F.col("fx"), F.lit(0.0)).alias("fx"), F.coalesce(F.col("fy"), F.lit(0.0)).alias("fy"))


_PAIRS = 1 << 18     # of positions, summed together


def _direct(pos: DataFrame, pairs: DataFrame, eps: float, radius: float | None) -> DataFrame:
    """Exact sums between the distinct positions of cell pairs (lvl, tx, ty, sx, sy): (x, y, fx, fy), one row for
    each position and level.

    As in ``_m2l`` the pairs meet by blocks of neighbouring target cells: a cell's positions go once to each block that
    needs them, not once per pair, and pairs of positions exist only as numpy blocks of bounded size."""
    pairs = pairs.dropna(subset=["tx", "ty", "sx", "sy"]).select(
        "lvl", F.shiftright("tx", BLOCK_BITS).alias("bx"), F.shiftright("ty", BLOCK_BITS).alias("by"), "tx", "ty", "sx", "sy")
    cell = lambda end: F.struct(F.col(f"{end}x").alias("ix"), F.col(f"{end}y").alias("iy"))
    wanted = pairs.select("lvl", "bx", "by", F.explode(F.array(cell("t"), cell("s"))).alias("c")).select(
        "lvl", F.col("bx").alias("cx"), F.col("by").alias("cy"), "c.ix", "c.iy").distinct()
    places = wanted.join(pos.select("lvl", "ix", "iy", "x", "y", "q"), ["lvl", "ix", "iy"], "inner").select(
        F.col("lvl").alias("cl"), "cx", "cy", "ix", "iy", "x", "y", "q")
    most = math.inf if radius is None else float(radius) ** 2

    def summed(p, s):
        out = [np.zeros((0, 4))]
        if len(p) and len(s):
            of = lambda f, a, b: f[a].to_numpy() * (1 << 31) + f[b].to_numpy()
            s = s.assign(cell=of(s, "ix", "iy")).sort_values("cell")
            cells, (x, y, q) = s["cell"].to_numpy(), (s[c].to_numpy(dtype=float) for c in ("x", "y", "q"))
            target, source = of(p, "tx", "ty"), of(p, "sx", "sy")
            order = np.argsort(target, kind="stable")
            target, source = target[order], source[order]
            lo, hi = np.searchsorted(cells, source), np.searchsorted(cells, source, "right")
            cuts = np.flatnonzero(np.r_[True, np.diff(target) != 0, True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                size = hi[a:b] - lo[a:b]
                at = np.repeat(lo[a:b] - np.cumsum(size) + size, size) + np.arange(size.sum())
                sx, sy, sq = x[at], y[at], q[at]
                t0, t1 = np.searchsorted(cells, target[a]), np.searchsorted(cells, target[a], "right")
                wide = max(1, _PAIRS // max(t1 - t0, 1))
                for i in range(t0, t1, _PAIRS):
                    tx, ty = x[i:min(i + _PAIRS, t1)], y[i:min(i + _PAIRS, t1)]
                    f = np.zeros((2, len(tx)))
                    for j in range(0, len(at), wide):
                        ddx, ddy = tx[:, None] - sx[None, j:j + wide], ty[:, None] - sy[None, j:j + wide]
                        d2 = ddx * ddx + ddy * ddy
                        w = np.where(d2 <= most, sq[None, j:j + wide] / np.maximum(d2, float(eps) ** 2), 0.0)
                        f += np.einsum("ij,ij->i", w, ddx), np.einsum("ij,ij->i", w, ddy)
                    out.append(np.column_stack([tx, ty, *f]))
        return pd.DataFrame(np.concatenate(out), columns=["x", "y", "fx", "fy"])

    return (pairs.groupBy("lvl", "bx", "by").cogroup(places.groupBy("cl", "cx", "cy"))
            .applyInPandas(summed, "x double, y double, fx double, fy double"))


def _far_field(ended: DataFrame, local: DataFrame, span: float, terms: int) -> DataFrame:
    """Evaluate the local expansion (lvl, ix, iy, b*) of each position's last cell at it (x, y, fx, fy)."""
    # far field at each position: sum_m B_m v^m, v = (z - c) / h of its cell; scaled back by 1/span
    inv_span = 1.0 / span
    side = F.pow(F.lit(2.0), F.col("lvl"))
    far_in = ended.withColumnRenamed("depth", "lvl").join(local, ["lvl", "ix", "iy"], "inner").select(
        "x", "y",
        (F.col("nx") * side - (F.col("ix").cast("double") + F.lit(0.5))).alias("vx"),
        (F.col("ny") * side - (F.col("iy").cast("double") + F.lit(0.5))).alias("vy"),
        *_names("b", terms))

    def evaluate(batches):
        for pdf in batches:
            b = _complex_block(pdf, "b", terms)
            v = pdf["vx"].to_numpy() + 1j * pdf["vy"].to_numpy()
            acc = np.zeros(len(pdf), dtype=complex)
            for m in range(terms - 1, -1, -1):          # Horner
                acc = acc * v + b[:, m]
            yield pd.DataFrame({"x": pdf["x"], "y": pdf["y"],
                                "fx": acc.real * inv_span, "fy": -acc.imag * inv_span})

    return far_in.mapInPandas(evaluate, "x double, y double, fx double, fy double")
