"""In-memory demo graphs (used by tests)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import EDGE_SCHEMA, VERTEX_SCHEMA, Graph

# Fixed demo graphs: vertices (id, label, x, y), links (src, dst[, weight]).
PAIR = ([(1, "a", 100.0, 100.0), (2, "b", -100.0, 100.0)], [(1, 2)])
BOX = ([(3, "a", -100.0, -100.0), (1, "b", 100.0, 100.0), (2, "c", -100.0, 100.0), (4, "d", 100.0, -100.0)],
       [(1, 2), (2, 3), (3, 4), (4, 1)])
HOUSE = ([(1, "a", 180.0, 50.0), (2, "b", 600.0, 100.0), (3, "c", 30.0, 130.0), (4, "d", 130.0, 830.0),
          (5, "e", 400.0, 400.0)],
         [(1, 2), (1, 3), (2, 3), (3, 5), (4, 1), (4, 2), (4, 3), (5, 4)])
SCRATCH = ([(3, "a", 0.0, 0.0), (7, "b", 1.0, 1.0), (5, "c", 3.0, 3.0), (2, "d", 4.0, 4.0)],
           [(3, 7, 1.0), (5, 3, 1.0), (2, 5, 0.5), (5, 7, 0.75)])
FUNCTIONAL_LAYER = [(3, 7, 1.0), (5, 3, 1.0), (3, 5, 0.5), (5, 2, 0.15), (3, 2, 0.1), (5, 7, 0.25), (2, 5, 0.2),
                    (7, 5, 0.25), (2, 7, 0.3), (2, 3, 0.15)]


def make_graph(spark: SparkSession, vertices, links) -> Graph:
    v = spark.createDataFrame([(i, lab, x, y, 0.0, 0.0) for i, lab, x, y in vertices], VERTEX_SCHEMA)
    rows = [(s, t, 1.0) if len(l) == 2 else (s, t, float(l[2])) for l in links for s, t in [l[:2]]]
    e = spark.createDataFrame(rows, EDGE_SCHEMA)
    return Graph(v, e)


def pair(spark):
    return make_graph(spark, *PAIR)


def box(spark):
    return make_graph(spark, *BOX)


def house(spark):
    return make_graph(spark, *HOUSE)


def scratch(spark):
    return make_graph(spark, *SCRATCH)
