"""Iterative force-directed layout (Fruchterman-Reingold) as a Spark job.

Every iteration is one logical plan: repulsion + attraction + gravity (keyed on id) ->
step scaling -> move + clamp.  The iteration's frame is written as a work table in the
checkpoint folder (``spark.checkpoint.dir``): that cuts the lineage, so a lost executor
re-reads the last iteration instead of recomputing from the start, and keeps the plan size
constant.  The links join the vertices in an ordinary shuffle join, so the links of a hub are
split at runtime by AQE; with ``links="blocks"`` they are dealt to blocks once and stay there.  A work table is deleted once the next iteration is written (kept for a
trace).  Loop variables (iteration, temperature, k) enter the plan as literals when the plan is
built, never read lazily.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..model import Graph, LayoutParams, VERTEX_COLUMNS
from ..session import Scratch
from . import blocks, build, forces, step


@dataclass(frozen=True)
class LayoutResult:
    graph: Graph
    k: float
    trace: DataFrame | None = None      # iteration, phase, id, x, y, dx, dy
    report: DataFrame | None = None     # iteration, temperature, k, n, n_edges, total_step, max_step


def _normalise(vertices: DataFrame) -> DataFrame:
    cols = []
    for c in VERTEX_COLUMNS:
        if c in vertices.columns:
            cols.append(F.col(c))
        elif c == "label":
            cols.append(F.col("id").cast("string").alias("label"))
        else:
            cols.append(F.lit(0.0).alias(c))
    return vertices.select(*cols)


def iteration_frame(g: Graph, k: float, params: LayoutParams, iteration: int, temperature: float,
                    scratch: Scratch | None = None, dealt: blocks.DealtLinks | None = None) -> DataFrame:
    """All columns of one iteration: forces by kind, applied step, new position."""
    p = forces.force_parts(g, k, params, scratch, dealt)
    tot_x = F.col("rep_dx") + F.col("attr_dx") + F.col("grav_dx")
    tot_y = F.col("rep_dy") + F.col("attr_dy") + F.col("grav_dy")
    p = p.select("*", tot_x.alias("dx"), tot_y.alias("dy"))
    p = p.select("*", step.step_factor(params, iteration, temperature).alias("factor"))
    p = p.select("*", (F.col("dx") * F.col("factor")).alias("sx"), (F.col("dy") * F.col("factor")).alias("sy"))
    nx, ny = step.new_position(F.col("sx"), F.col("sy"), params)
    return p.select("*", nx.alias("nx"), ny.alias("ny"))


def layout(g: Graph, params: LayoutParams, trace: bool = False, report: bool = False,
           k: float | None = None, complete: bool = True) -> LayoutResult:
    """Run ``params.rounds`` iterations.  Ids that occur only in edges first get the default vertex
    record, and duplicate vertex ids are rejected; with ``complete=False`` (a graph known to be
    complete) both checks are left out and links to unknown ids do not act."""
    spark = g.vertices.sparkSession
    kept = Scratch(spark)
    edges = kept.table(g.edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "edges")
    vertices = build.complete_graph(g.vertices, edges).vertices if complete else g.vertices
    before, work = None, Scratch(spark)
    cur = work.table(_normalise(vertices), "vertices")
    n = cur.count()
    if k is None:
        k = params.ideal_length(n)
    n_edges = edges.count() if report else 0
    dealt = blocks.deal_for_layout(edges, params.repulsion, params.block_links) if params.links == "blocks" else None
    traces, reports = [], []
    for it in range(1, params.rounds + 1):
        temp = params.temperature(it - 1)
        before, work = work, Scratch(spark)
        inner = Scratch(spark)
        frame = work.table(iteration_frame(Graph(cur, edges), k, params, it, temp, inner, dealt), f"iter{it}")
        inner.drop()
        if not (trace and it > 1):
            before.drop()
        cur = frame.select("id", "label", F.col("nx").alias("x"), F.col("ny").alias("y"),
                           (-F.col("sx")).alias("dx"), (-F.col("sy")).alias("dy"))
        if trace:
            lit_it = F.lit(it).cast("int").alias("iteration")
            traces.append(frame.select(lit_it, F.lit("A").alias("phase"), "id", "x", "y",
                                       F.col("rep_dx").alias("dx"), F.col("rep_dy").alias("dy")))
            traces.append(frame.select(lit_it, F.lit("B").alias("phase"), "id", "x", "y",
                                       (F.col("rep_dx") + F.col("attr_dx")).alias("dx"),
                                       (F.col("rep_dy") + F.col("attr_dy")).alias("dy")))
            traces.append(frame.select(lit_it, F.lit("C").alias("phase"), "id",
                                       F.col("nx").alias("x"), F.col("ny").alias("y"),
                                       (-F.col("sx")).alias("dx"), (-F.col("sy")).alias("dy")))
        if report:
            slen = vec.length(F.col("sx"), F.col("sy"))
            total, most = frame.agg(F.sum(slen), F.max(slen)).first()
            reports.append((it, float(temp), float(k), n, n_edges, total, most))
    if dealt is not None:
        dealt.drop()
    tr = _union_all(traces) if traces else None
    rp = spark.createDataFrame(reports, REPORT) if report else None
    return LayoutResult(Graph(cur, edges), k, tr, rp)


REPORT = "iteration int, temperature double, k double, n long, n_edges long, total_step double, max_step double"


def _union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def layout_shuffled(g: Graph, params: LayoutParams, **kw) -> LayoutResult:
    v = build.shuffle_positions(g.vertices, params.width, params.height, params.seed, params.bounds, params.eps)
    return layout(Graph(v, g.edges), params, **kw)
