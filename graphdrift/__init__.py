"""graphdrift: force-directed graph layout and layer analysis on PySpark DataFrames.

    from graphdrift import Graph, LayoutParams, layout
    res = layout(Graph(vertices, edges), LayoutParams(iterations=20))
    res.graph.vertices      # id, label, x, y, dx, dy
"""

from .model import EDGE_SCHEMA, VERTEX_SCHEMA, Graph, LayoutParams
from .operators.layout import LayoutResult, layout

__all__ = ["EDGE_SCHEMA", "VERTEX_SCHEMA", "Graph", "LayoutParams", "LayoutResult", "layout"]
