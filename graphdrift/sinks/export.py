"""Node / edge / displacement tables and their writers (distributed writes, no collect)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import build, stats
from ..session import Scratch

# Export headers and the readable link format.
EDGE_HEADER = ("Source", "Target", "Weight")
NODE_HEADER = ("Id", "X", "Y", "dX", "dY", "k", "m", "c")
DISPLACEMENT_HEADER = ("ID", "dX", "dY")
LAYOUT_NODE_HEADER = ("label", "posX", "posY")
LAYOUT_LINK_HEADER = ("SOURCE", "TARGET", "WEIGHT")
LINK_TEXT = "%s (%s,%s), linkTo( %s )=%s"
LINK_WORD = " linkTo( "


def edge_table(g: Graph, weight_name: str = EDGE_HEADER[2]) -> DataFrame:
    """Source, Target (endpoint labels), Weight."""
    t = build.triplets(g)
    source, target, _ = EDGE_HEADER
    return t.select(F.col("src_label").alias(source), F.col("dst_label").alias(target),
                    F.col("weight").alias(weight_name))


def node_table(g: Graph, lp_rounds: int = 5, modules: DataFrame | None = None) -> DataFrame:
    """Id (label), X, Y, dX, dY, k (degree), m (module), c (clustering coefficient).  The links are
    written once as a work table and read by all three statistics."""
    g = Graph(g.vertices, Scratch(g.vertices.sparkSession).table(g.edges.select("src", "dst"), "links"))
    deg = stats.degree(g).select("id", F.col("degree").alias("k"))
    mod = (modules if modules is not None else stats.label_propagation(g, lp_rounds)).select(
        "id", F.col("module").alias("m"))
    cc = stats.clustering_coefficient(g).select("id", F.col("clustering").alias("c"))
    v = g.vertices.join(deg, "id", "left").join(mod, "id", "left").join(cc, "id", "left")
    src = ("label", "x", "y", "dx", "dy", "k", "m", "c")
    return v.select(*[F.col(a).alias(b) for a, b in zip(src, NODE_HEADER)])


def with_prefix(df: DataFrame, prefix: str = "#") -> DataFrame:
    """Prefix the first header field ('#' for plotting tools, '' for graph editors)."""
    first = df.columns[0]
    return df.withColumnRenamed(first, prefix + first)


def displacement_table(disp: DataFrame, label: str, iteration: int) -> DataFrame:
    """ID, dX, dY tagged with a label and an iteration (partition columns of the sink)."""
    return disp.select(*[F.col(a).alias(b) for a, b in zip(("id", "dx", "dy"), DISPLACEMENT_HEADER)],
                       F.lit(label).alias("label"), F.lit(iteration).cast("int").alias("iteration"))


def layout_nodes(vertices: DataFrame) -> DataFrame:
    return vertices.select(*[F.col(a).alias(b) for a, b in zip(("label", "x", "y"), LAYOUT_NODE_HEADER)])


def layout_links(edges: DataFrame) -> DataFrame:
    s, t, w = LAYOUT_LINK_HEADER
    return edges.select(F.col("src").alias(s), F.col("dst").alias(t), F.lit(1.0).alias(w))


def inspect_links(g: Graph, with_positions: bool = False) -> DataFrame:
    """Readable link lines 'a (x,y), linkTo( b )=w'; the label-only form omits numbers."""
    t = build.triplets(g)
    if with_positions:
        text = F.format_string(LINK_TEXT, "src_label", "src_x", "src_y", "dst_label", "weight")
    else:
        text = F.concat(F.col("src_label"), F.lit(LINK_WORD), F.col("dst_label"), F.lit(" )"))
    return t.select(text.alias("line"))


def write_table(df: DataFrame, path: str, fmt: str = "csv", header: bool = True, sep: str = "\t",
                partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", header).option("sep", sep).csv(path)
    else:
        w.format(fmt).save(path)
