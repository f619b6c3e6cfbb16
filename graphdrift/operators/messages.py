"""Supersteps on a property graph: messages along links, merged per vertex, until none is sent.

A superstep is one plan: the links that an active vertex may send along are joined with the attributes of
their ends, the caller's Columns make the messages, a keyed aggregation (combined before the shuffle, so a
hub's messages never meet in one task) merges them, and the caller's Columns update the vertices that got
one.  Those are the active vertices of the next superstep: the joins shrink with them, and the run halts when
no message was sent.  Attributes and the active ids are work tables, one pair per superstep, the older one
deleted; the links are written once, by source and by target only where the direction needs it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..session import Scratch

DIRECTIONS = ("out", "in", "either", "both")


@dataclass(frozen=True)
class Supersteps:
    """``vertices``: id and the attributes; ``steps``: supersteps that sent a message; ``active``: how many
    vertices got one in each; ``settled``: whether the run halted by itself."""

    vertices: DataFrame
    steps: int
    active: list[int]
    settled: bool


def _awake(edges: DataFrame, active: DataFrame | None, direction: str) -> DataFrame:
    """Links along which an active end may send (all ends are active before the first superstep)."""
    if active is None:
        return edges
    src = active.select(F.col("id").alias("src"), F.lit(True).alias("src_on"))
    dst = active.select(F.col("id").alias("dst"), F.lit(True).alias("dst_on"))
    if direction in ("out", "both"):
        edges = edges.join(src.drop("src_on"), "src", "left_semi")
    if direction in ("in", "both"):
        edges = edges.join(dst.drop("dst_on"), "dst", "left_semi")
    if direction == "either":
        edges = edges.join(src, "src", "left").join(dst, "dst", "left").filter("src_on or dst_on").drop("src_on", "dst_on")
    return edges


def supersteps(g: Graph, initial: dict[str, Column], merge: Callable[[Column], Column], update: dict[str, Column],
               to_dst: Column | None = None, to_src: Column | None = None, direction: str = "either",
               max_steps: int = 100) -> Supersteps:
    """Run message passing on ``g``.

    ``initial``: attributes as Columns over the vertex columns.  ``to_dst`` / ``to_src``: the message along a link to
    its target / source, as a Column over ``src_<attribute>``, ``dst_<attribute>``, ``src``, ``dst`` and the other link
    columns; null sends none.  ``merge``: an aggregate of a vertex's messages, given their Column.  ``update``: new
    values of attributes over the old ones and ``msg``, the merged message; attributes not named stay.
    ``direction``: which end must have got a message in the last superstep for the link to send: ``out`` its source,
    ``in`` its target, ``either`` or ``both``.

    Parallel links send each; a self-link sends to its vertex; links to unknown ids send nothing; vertices without links
    keep their initial attributes.  A graph without vertices or links gives the initial attributes, settled.
    Vertex ids are taken to be unique (``build.complete_graph`` checks that).
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction: one of {DIRECTIONS}, not {direction}")
    if to_dst is None and to_src is None:
        raise ValueError("give to_dst or to_src")
    names = list(initial)
    if missing := [c for c in update if c not in names]:
        raise ValueError(f"update of unknown attributes {missing}")
    spark = g.vertices.sparkSession
    links, work, before = Scratch(spark), Scratch(spark), None
    edges = links.table(g.edges, "links")
    state = work.table(g.vertices.select("id", *[c.alias(n) for n, c in initial.items()]), "state")
    active, counts, settled = None, [], False
    while len(counts) < max_steps:
        ends = {side: state.select(F.col("id").alias(side), *[F.col(n).alias(f"{side}_{n}") for n in names])
                for side in ("src", "dst")}
        met = _awake(edges, active, direction).join(ends["src"], "src").join(ends["dst"], "dst")
        sent = [F.struct(F.col(to).alias("id"), m.alias("msg")) for to, m in (("dst", to_dst), ("src", to_src)) if m is not None]
        sent = met.select(F.explode(F.array(*sent)).alias("m")).select("m.id", "m.msg").filter("msg is not null")
        before, work = work, Scratch(spark)
        got = work.table(sent.groupBy("id").agg(merge(F.col("msg")).alias("msg")), "messages")
        n = got.count()
        if not n:
            work.drop()
            work, settled = before, True
            break
        counts.append(n)
        new = [F.when(F.col("told"), update[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in names]
        state = work.table(state.join(got.withColumn("told", F.lit(True)), "id", "left")
                           .withColumn("told", F.coalesce("told", F.lit(False))).select("id", *new), "state")
        active = got.select("id")
        before.drop()
    links.drop()
    return Supersteps(state, len(counts), counts, settled)


def shortest_hops(g: Graph, is_source: Column, directed: bool = False, max_steps: int = 100) -> Supersteps:
    """Attribute ``hops``: fewest links from any vertex where ``is_source`` (a Column over the vertex columns) holds,
    null where none leads; either way along a link unless ``directed``."""
    near = lambda a, b: F.when(F.col(f"{b}_hops").isNull() | (F.col(f"{a}_hops") + 1 < F.col(f"{b}_hops")), F.col(f"{a}_hops") + 1)
    return supersteps(g, {"hops": F.when(is_source, F.lit(0).cast("long"))}, F.min, {"hops": F.col("msg")},
                      to_dst=near("src", "dst"), to_src=None if directed else near("dst", "src"),
                      direction="out" if directed else "either", max_steps=max_steps)


def components(g: Graph, max_steps: int = 100) -> Supersteps:
    """Attribute ``component``: the smallest id that links lead to, either way along them."""
    lower = lambda a, b: F.when(F.col(f"{a}_component") < F.col(f"{b}_component"), F.col(f"{a}_component"))
    return supersteps(g, {"component": F.col("id")}, F.min, {"component": F.col("msg")},
                      to_dst=lower("src", "dst"), to_src=lower("dst", "src"), direction="either", max_steps=max_steps)
