"""The whole job: edge-list folder -> graph -> layout -> node, link and displacement tables.

    python -m graphdrift.job IN OUT [--iterations N] [--fraction F] [--seed S] [--repulsion KIND] [--radius R]

``IN`` and ``OUT`` are paths Spark can reach; the session and ``spark.checkpoint.dir`` come from
spark-submit (a local session is made only when none is running).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .model import LayoutParams
from .operators import build, layout
from .session import Scratch, build_session
from .sinks import export
from .sources import edgelist


def run(spark: SparkSession, source: str, target: str, params: LayoutParams, fraction: float | None = None,
        fmt: str = "csv") -> dict[str, DataFrame]:
    """Load, convert and lay out the links of ``source``; write ``nodes``, ``links``, ``displacements``
    and ``report`` below ``target``; returns the tables as written, for reading back."""
    scratch = Scratch(spark)
    raw = scratch.table(edgelist.read_edge_list(spark, source, fraction, params.seed), "raw")
    g = build.convert(raw, params.width, params.height, params.seed, params.bounds, params.eps)
    res = layout.layout(g, params, report=True, complete=False)      # vertices come from the links
    out = {"nodes": export.node_table(res.graph), "links": export.edge_table(res.graph),
           "displacements": export.displacement_table(res.graph.vertices, "step", params.rounds)
           .drop("label", "iteration"), "report": res.report}
    for name, table in out.items():
        export.write_table(table, f"{target}/{name}", fmt=fmt)
    scratch.drop()
    if fmt == "csv":
        return {n: spark.read.option("header", True).option("sep", "\t").csv(f"{target}/{n}") for n in out}
    return {n: spark.read.format(fmt).load(f"{target}/{n}") for n in out}


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--iterations", type=int, default=20)
    p.add_argument("--fraction", type=float)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--repulsion", default="all")
    p.add_argument("--radius", type=float)
    p.add_argument("--format", default="csv")
    a = p.parse_args()
    spark = SparkSession.getActiveSession() or build_session()
    params = LayoutParams(iterations=a.iterations, seed=a.seed, repulsion=a.repulsion, radius=a.radius)
    run(spark, a.source, a.target, params, a.fraction, a.format)


if __name__ == "__main__":
    main()
