"""Graph construction and reshaping (vertices from edges, completion, positions, triplets)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..model import DEFAULT_LABEL, Graph, check_columns

# Fixed value: the attribute given to vertices known only from their links.
EDGE_VERTEX_LABEL = "defaultProperty"


def vertex_ids(edges: DataFrame) -> DataFrame:
    """Distinct ids of both endpoints (one pass over the links, one shuffle)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def vertices_from_edges(edges: DataFrame, label: str = EDGE_VERTEX_LABEL) -> DataFrame:
    """Every endpoint id once, with a constant attribute."""
    return vertex_ids(edges).select("id", F.lit(label).alias("label"))


def duplicate_ids(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("id").count().filter(F.col("count") > 1)


def complete_graph(vertices: DataFrame, edges: DataFrame, default_label: str = DEFAULT_LABEL,
                   validate: bool = True) -> Graph:
    """Vertices for every id of the edges: ids only in edges get the default record,
    isolated vertices stay.  ``validate`` rejects duplicate vertex ids (one keyed count)."""
    check_columns(vertices, ["id"], "vertices")
    if validate and duplicate_ids(vertices).limit(1).count() > 0:
        raise ValueError("vertex ids are not unique")
    ids = vertex_ids(edges)
    v = vertices.join(ids, "id", "full_outer")
    cols = [F.col("id")]
    cols.append(F.coalesce(F.col("label"), F.lit(default_label)).alias("label")
                if "label" in vertices.columns else F.lit(default_label).alias("label"))
    for c in ("x", "y", "dx", "dy"):
        cols.append(F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in vertices.columns else F.lit(0.0).alias(c))
    return Graph(v.select(*cols), edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))


def start_box(width: float, height: float, bounds: str) -> tuple[float, float]:
    """Lowest corner of the area start positions are drawn in: that of the bounds."""
    return (-width / 2, -height / 2) if bounds == "center" else (0.0, 0.0)


def start_position(id_col, width: float, height: float, seed: int = 0, bounds: str = "center", eps: float = 1e-4):
    """(x, y) drawn evenly from the box of the bounds by a hash of (seed, axis, id), on the grid of
    step ``eps``.  The axes are independent; any 64-bit id and any positive size will do."""
    x0, y0 = start_box(width, height, bounds)
    draw = lambda axis, size: vec.unit_hash(F.lit(seed), F.lit(axis), id_col) * F.lit(float(size))
    return (vec.on_grid(F.lit(x0) + draw("x", width), eps), vec.on_grid(F.lit(y0) + draw("y", height), eps))


def shuffle_positions(vertices: DataFrame, width: float, height: float, seed: int = 0, bounds: str = "center",
                      eps: float = 1e-4) -> DataFrame:
    """Re-draw every position in the box of the bounds as a function of (id, seed); label and
    displacement are kept.  Partition-independent, so recomputation after an executor loss gives
    the same positions."""
    keep = [c for c in vertices.columns if c not in ("x", "y")]
    x, y = start_position(F.col("id"), width, height, seed, bounds, eps)
    return vertices.select(*keep, x.alias("x"), y.alias("y"))


def convert(raw_edges: DataFrame, width: float, height: float, seed: int = 0, bounds: str = "center",
            eps: float = 1e-4) -> Graph:
    """Normalise a raw edge table: label = id as text, start position, zero displacement,
    weight text -> double (ANSI cast fails the job on bad input)."""
    edges = raw_edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    x, y = start_position(F.col("id"), width, height, seed, bounds, eps)
    v = vertex_ids(edges).select("id", F.col("id").cast("string").alias("label"), x.alias("x"), y.alias("y"),
                                 F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    return Graph(v, edges)


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Each link both ways, once per ordered pair, weight 1.0."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(ends.alias("e")).select("e.src", "e.dst").distinct().select(
        "src", "dst", F.lit(1.0).alias("weight"))


def unordered_pairs(edges: DataFrame) -> DataFrame:
    """Simple undirected graph, each pair once as src < dst, self-links dropped."""
    return edges.filter(F.col("src") != F.col("dst")).select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """Simple undirected graph as ordered pairs both ways, self-links dropped.  Both ways are made after the
    copies are gone, so that step holds each pair once."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return unordered_pairs(edges).select(ends.alias("e")).select("e.src", "e.dst")


def graph_size(g: Graph) -> DataFrame:
    """One row: n_vertices, n_edges (two partial counts, the edge count as a scalar subquery)."""
    n_edges = g.edges.select(F.count(F.lit(1))).scalar()
    return g.vertices.agg(F.count(F.lit(1)).alias("n_vertices")).select(
        "n_vertices", n_edges.alias("n_edges"))


def triplets(g: Graph) -> DataFrame:
    """Edge with both endpoint records (two equi-joins on id; AQE picks broadcast when
    the vertex side turns out small, and splits a hot src/dst partition otherwise)."""
    v = g.vertices
    s = v.select(F.col("id").alias("src"), F.col("label").alias("src_label"),
                 F.col("x").alias("src_x"), F.col("y").alias("src_y"))
    t = v.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"),
                 F.col("x").alias("dst_x"), F.col("y").alias("dst_y"))
    return g.edges.join(s, "src", "inner").join(t, "dst", "inner")


def attach_displacement(vertices: DataFrame, disp: DataFrame) -> DataFrame:
    """Per-vertex result joined back by id; vertices without a result keep label and
    position and get (0, 0)."""
    d = disp.select("id", F.col("dx").alias("_ddx"), F.col("dy").alias("_ddy"))
    keep = [c for c in vertices.columns if c not in ("dx", "dy")]
    return vertices.join(d, "id", "left").select(
        *keep, F.coalesce(F.col("_ddx"), F.lit(0.0)).alias("dx"), F.coalesce(F.col("_ddy"), F.lit(0.0)).alias("dy"))


def superpose(*parts: DataFrame) -> DataFrame:
    """Union of per-vertex contributions (id, dx, dy) followed by a keyed sum."""
    u = parts[0].select("id", "dx", "dy")
    for p in parts[1:]:
        u = u.unionByName(p.select("id", "dx", "dy"))
    return u.groupBy("id").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
