"""Modules by modularity: local moves with gains, contraction, levels.

With A the symmetric weights (a link counts at both its ends), k the weighted degrees and 2m their sum, the modularity of a
partition is  Q = sum over modules of A_cc / 2m - (K_c / 2m)^2.  In a round a vertex compares the modules of its
neighbours by  w(v, d) - k_v K_d / 2m  (K_d without v itself) and moves to the best one if that beats its own.  Only the half
of the vertices drawn by a hash of (seed, round, id) may move, so the two sides of a two-sided graph do not swap for ever; a
round counts only if it raises Q, so Q never falls, and a level ends when neither half of the vertices raises it.  Then every module
becomes one vertex and the next level moves whole modules.

Every choice is an aggregation (max of a struct).  A vertex's links are dealt by its id, those of a hub also by a hash of the
module they lead to, so no task gets more than about ``_PART`` of one vertex's links besides those into one module.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..model import Graph
from ..session import Scratch


_PART = 1 << 20                                          # links of one vertex that are dealt together


def symmetric_weights(edges: DataFrame) -> DataFrame:
    """(u, v, w): summed positive weights both ways (a null weight counts 1); self-links are left out.  Both ways are
    made after the sums, so that step holds each pair once."""
    rows = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"),
                                             F.coalesce(F.col("weight"), F.lit(1.0)).alias("w")).filter("w > 0")
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                             F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    return rows.groupBy("a", "b").agg(F.sum("w").alias("w")).select(ends, "w").select("e.u", "e.v", "w")


def modularity(pairs: DataFrame, member: DataFrame, two_m: float) -> float:
    """Q of ``member`` (id, c, k).  Of the two ways of a pair one is looked at, for both."""
    of = lambda side: member.select(F.col("id").alias(side), F.col("c").alias(f"c{side}"))
    both = F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(F.col("w") * 2.0)
    one = pairs.filter("u <= v").select("u", "v", both.alias("w"))
    inside = one.join(of("u"), "u").join(of("v"), "v").filter("cu = cv").agg(F.sum("w")).first()[0] or 0.0
    total = member.groupBy("c").agg(F.sum("k").alias("whole")).agg(F.sum(F.col("whole") * F.col("whole"))).first()[0] or 0.0
    return inside / two_m - total / (two_m * two_m)


def hubs(pairs: DataFrame) -> DataFrame:
    """(u, parts) of the vertices whose links are dealt in several parts: at most one for ``_PART`` links of the graph."""
    n = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") > _PART).select("u", F.ceil(F.col("n") / F.lit(_PART)).cast("int").alias("parts"))


def moved(pairs: DataFrame, member: DataFrame, two_m: float, seed: int, turn: int, hub: DataFrame | None = None) -> DataFrame:
    """``member`` (id, c, k) after one round of moves of the half of the vertices whose turn it is.  A link is shuffled
    twice: to the module at its far end, with that module's weight, and to its own end."""
    hub = hubs(pairs) if hub is None else hub
    whole = member.groupBy("c").agg(F.sum("k").alias("whole"))
    known = member.join(whole, "c").select("id", "c", "k", "whole")
    to = pairs.filter("u <> v").join(known.select(F.col("id").alias("v"), F.col("c").alias("d"), "whole"), "v")
    stay = known.select(F.col("id").alias("u"), F.col("c").alias("d"), F.lit(0.0).alias("w"), "whole")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    to = to.select("u", "d", "w", "whole").unionByName(stay).join(hub, "u", "left").select(
        "u", F.pmod(F.xxhash64("d"), parts).cast("int").alias("part"), "d", "w", "whole")
    own = member.select(F.col("id").alias("u"), "c", "k").join(hub, "u", "left").select(
        "u", "c", "k", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    to = to.repartition("u", "part").groupBy("u", "part", "d").agg(F.sum("w").alias("w"), F.max("whole").alias("whole")).join(
        own, ["u", "part"])
    at_home = F.col("d") == F.col("c")
    gain = F.col("w") - F.col("k") * (F.col("whole") - F.when(at_home, F.col("k")).otherwise(0.0)) / F.lit(float(two_m))
    rank = F.struct(gain.alias("gain"), at_home.alias("home"), vec.unit_hash(F.lit(seed), F.lit("tie"), F.col("d")).alias("tie"),
                    F.col("d"))
    best = to.groupBy("u", "part").agg(F.max(rank).alias("b")).groupBy("u").agg(F.max("b").alias("b")).select(
        F.col("u").alias("id"), F.col("b.d").alias("d"))
    turns = vec.unit_hash(F.lit(seed), F.lit(turn // 2), F.col("id")) < 0.5
    may = turns if turn % 2 == 0 else ~turns
    return member.join(best, "id").select("id", F.when(may, F.col("d")).otherwise(F.col("c")).alias("c"), "k")


def local_moves(pairs: DataFrame, vertices: DataFrame, seed: int = 0, max_rounds: int = 20,
                scratch: Scratch | None = None) -> tuple[DataFrame, list[float]]:
    """((id, c, k), Q after each round that counted, the start first) of one level: every vertex (id) starts alone.
    ``scratch`` is that of the caller's work table of pairs; without one the pairs, which every round reads, are
    written to one first and dropped at the end."""
    links = None
    if scratch is None:
        scratch, links = Scratch(pairs.sparkSession), Scratch(pairs.sparkSession)
        pairs = links.table(pairs, "pairs")
    member, found = _rounds(pairs, vertices, seed, max_rounds, scratch)
    if links is not None:
        links.drop()
    return member, found


def _rounds(pairs: DataFrame, vertices: DataFrame, seed: int, max_rounds: int, scratch: Scratch) -> tuple[DataFrame, list[float]]:
    degree = pairs.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("k"))
    member = scratch.table(vertices.select("id").join(degree, "id", "left")
                           .select("id", F.col("id").alias("c"), F.coalesce("k", F.lit(0.0)).alias("k")), "modules")
    two_m = float(pairs.agg(F.sum("w")).first()[0] or 0.0)
    if two_m <= 0.0:
        return member, [0.0]
    hub = scratch.table(hubs(pairs), "hubs")              # few rows, their number known before the joins
    found, idle = [modularity(pairs, member, two_m)], 0
    for turn in range(max_rounds):
        new = scratch.table(moved(pairs, member, two_m, seed, turn, hub), "modules")
        q = modularity(pairs, new, two_m)
        if q > found[-1]:
            member, idle = new, 0
            found.append(q)
        else:
            idle += 1
            if idle == 2:
                break
    return member, found


@dataclass(frozen=True)
class Modules:
    """``members``: id, module (the smallest id in it), modularity (of the whole partition); ``levels``: Q after each level."""

    members: DataFrame
    levels: list[float]


def modules(g: Graph, seed: int = 0, max_rounds: int = 20, max_levels: int = 20) -> Modules:
    """Modules of the undirected graph with summed positive weights.  Vertices without such links are alone; a graph without
    links has modularity 0; ties go by a hash of (seed, module).  The result is a work table (``session.clear_work``)."""
    spark = g.vertices.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    pairs = scratch.table(symmetric_weights(g.edges), "pairs")
    vertices = scratch.table(g.vertices.select("id").distinct(), "ids")
    pairs = scratch.table(pairs.join(vertices.withColumnRenamed("id", "u"), "u", "left_semi")
                          .join(vertices.withColumnRenamed("id", "v"), "v", "left_semi"), "pairs")
    where, levels = vertices.select("id", F.col("id").alias("c")), []
    for _ in range(max_levels):
        member, found = local_moves(pairs, vertices, seed, max_rounds, scratch)
        if levels and found[-1] <= levels[-1]:
            break
        levels.append(found[-1])
        step = member.select(F.col("id").alias("c"), F.col("c").alias("next"))
        where = scratch.table(where.join(step, "c").select("id", F.col("next").alias("c")), "where")
        if len(found) == 1:
            break
        of = lambda side: member.select(F.col("id").alias(side), F.col("c").alias(f"c{side}"))
        pairs = scratch.table(pairs.join(of("u"), "u").join(of("v"), "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v"))
                              .agg(F.sum("w").alias("w")), "pairs")
        vertices = scratch.table(member.select(F.col("c").alias("id")).distinct(), "ids")
    name = where.groupBy("c").agg(F.min("id").alias("module"))
    out = kept.table(where.join(name, "c").select("id", "module", F.lit(levels[-1]).alias("modularity")), "modules")
    scratch.drop()
    return Modules(out, levels)
