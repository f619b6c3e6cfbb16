"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Vectors are split into ranges of norms within a factor of ``RANGE``; in a range the largest inner
product is, but for that factor, the nearest direction.  Directions are projected onto a few random
axes, shifted, and ordered along a Hilbert curve; this is done for several independent projections.
Spark range-partitions each curve of each range by its key.  A query takes a place on the curves of
every range and meets all vectors within a window of it; the windows of all ranges and curves are merged
and reranked by the exact inner product.  A few long vectors so crowd no others together.

The window is a share of the rows of a range, so recall does not fall as the table grows; its cost is that
share of an exhaustive search.  Rows deal out as (range and curve, block of places), and a task meets one
block of vectors with the queries whose windows touch it, or a slice of them where they are many.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_count, staged
from .hilbert import hilbert_key

RANGE = math.sqrt(2.0)   # norms of one range lie within this factor
SPAN = 512               # queries scored at a time


class Curves:
    """Keys of points on ``count`` shifted Hilbert curves; fixed by the seed, not fitted."""

    def __init__(self, dim: int, count: int, axes: int, bits: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bits, self.axes = bits, min(axes, dim)
        self.plane = [np.linalg.qr(rng.normal(size=(dim, self.axes)))[0] for _ in range(count)]
        self.shift = rng.uniform(0.0, 0.5, (count, self.axes))
        self.scale = math.sqrt(dim) / 4.0             # four deviations of a random direction

    def keys(self, curve: int, points: np.ndarray) -> np.ndarray:
        u = ((points @ self.plane[curve]) * self.scale + 1.0) / 2.0
        u = (u + self.shift[curve]) / 1.5
        cells = np.clip(u * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
        return (hilbert_key(cells, self.bits) ^ np.uint64(1 << 63)).view(np.int64)     # signed order


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): finite, non-zero vectors of the length most of them have."""
    v = F.col(vector_col).cast("array<double>")
    good = (v.isNotNull() & (F.size(v) > 0)
            & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists(v, lambda x: x != 0.0) & F.col(id_col).isNotNull())
    rows = table.filter(good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (dims[0]["d"] if dims else 0))


def dealt(queries: DataFrame, vectors: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both with a column ``slice``: where more than ``most`` queries (curve, block) meet one block of
    vectors (c, b), they are dealt into slices by kind, and the block's vectors go to every slice."""
    crowded = (queries.groupBy("curve", "block").count().filter(F.col("count") > most)
               .select("curve", "block", F.ceil(F.col("count") / most).cast("int").alias("slices")))
    crowded = staged(crowded, "ann-crowded")                # its size is known before the joins; mostly empty
    slices = F.coalesce("slices", F.lit(1))
    mine = queries.join(crowded, ["curve", "block"], "left") \
                  .withColumn("slice", F.pmod(F.xxhash64("kind"), slices).cast("int")).drop("slices")
    all_ = vectors.join(crowded.select(F.col("curve").alias("c"), F.col("block").alias("b"), "slices"), ["c", "b"], "left") \
                  .withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("slices")
    return mine, all_


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
            query_step: int = 20, curves: int = 12, axes: int = 8, bits: int = 8, window_share: float = 0.06,
            block_rows: int = 2048, seed: int = 11, query_rows: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row whose id is divisible by ``query_step``
    the ``k`` nearest found among all other rows, ties to the smaller id.

    Rows with a null id, and vectors that are null, empty, zero, not finite or of another length
    than most take no part.  Equal vectors are searched once, with the k + 1 smallest ids standing
    for all; repeated rows count once; an empty table gives no rows.
    """
    spark, n = table.sparkSession, shuffle_count(table.sparkSession)
    rows = usable_vectors(table, id_col, vector_col).distinct()
    rows = rows.withColumn("kind", F.md5(F.col("v").cast("string").cast("binary")))
    asks = F.col("vec_id") % query_step == 0
    smallest = Window.partitionBy("kind").orderBy("vec_id")
    ids = (rows.select("kind", "vec_id").withColumn("r", F.row_number().over(smallest)).filter(F.col("r") <= k + 1)
           .groupBy("kind").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    kinds = staged(rows.groupBy("kind").agg(F.any_value("v").alias("v"), F.max(asks).alias("asks"))
                   .join(ids, "kind"), "ann-kinds")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    norm = F.least(F.greatest(norm, F.lit(sys.float_info.min)), F.lit(sys.float_info.max))
    top = kinds.agg(F.max(norm).alias("m"), F.max(F.size("v")).alias("d")).first()
    longest, dim = top["m"] or 1.0, top["d"] or 1
    below = (F.lit(math.log(longest)) - F.log(norm)) / math.log(RANGE)
    kinds = kinds.withColumn("range", F.greatest(F.floor(below), F.lit(0)).cast("int"))
    ranges = sorted(r["range"] for r in kinds.select("range").distinct().collect())

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = Curves(dim, curves, axes, bits, seed)
        for b in batches:
            if not len(b):
                continue
            v = np.stack(b["v"].to_numpy()).astype(np.float64)
            point = v / np.abs(v).max(axis=1, keepdims=True)
            point /= np.linalg.norm(point, axis=1, keepdims=True)
            ask = np.tile(np.flatnonzero(b["asks"].to_numpy(bool)), len(ranges))
            asked = np.repeat(ranges, len(ask) // len(ranges)) * curves
            raw = np.array([x.tobytes() for x in v], object)
            for c in range(curves):
                key = made.keys(c, point)
                yield pd.DataFrame({"curve": b["range"] * curves + c, "key": key, "query": False, "kind": b["kind"],
                                    "ids": b["ids"], "v": raw})
                if len(ask):
                    yield pd.DataFrame({"curve": asked + c, "key": key[ask], "query": True,
                                        "kind": b["kind"].to_numpy()[ask], "ids": None, "v": raw[ask]})

    placed = "curve int, key long, query boolean, kind string, ids array<long>, v binary"
    line = (kinds.mapInPandas(order, placed).repartitionByRange(n, "curve", "key", "kind")
            .sortWithinPartitions("curve", "key", "kind", "query"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), {}
        for b in batches:
            stored, place = ~b["query"].to_numpy(bool), np.zeros(len(b), np.int64)
            for c, rows_of in b.groupby("curve").indices.items():
                ends = at.get(c, 0) + np.cumsum(stored[rows_of])
                place[rows_of], at[c] = ends - stored[rows_of], ends[-1]     # vectors before this one
            yield b.assign(part=part, place=place)

    line = staged(line.mapInPandas(count, placed + ", part int, place long"), "ann-line")
    sizes = sorted((r["curve"], r["part"], r["count"]) for r in line.groupBy("curve", "part").agg(
        F.count_if(~F.col("query")).alias("count")).collect())
    offset, total = {}, {}                                # a number per curve and range partition, not per row
    for c, p, m in sizes:
        offset[c, p] = total.get(c, 0)
        total[c] = total.get(c, 0) + m
    starts = spark.createDataFrame([(c, p, o, total[c], math.ceil(window_share * total[c]) + k)
                                    for (c, p), o in offset.items()],
                                   "curve int, part int, start long, total long, window long")
    line = line.join(F.broadcast(starts), ["curve", "part"]).withColumn("place", F.col("start") + F.col("place"))
    line = line.filter((F.col("window") < F.col("total")) | (F.col("curve") % curves == 0))   # a window over all: one curve is enough
    block = F.floor(F.col("place") / block_rows)
    vectors = line.filter(~F.col("query")).select(F.col("curve").alias("c"), block.alias("b"), F.col("place").alias("at"),
                                                  F.col("ids").alias("members"), F.col("v").alias("w"))
    reach = F.sequence(F.floor(F.greatest(F.col("place") - F.col("window"), F.lit(0)) / block_rows),
                       F.floor((F.least(F.col("place") + F.col("window"), F.col("total")) - 1) / block_rows))
    queries = line.filter("query").select("curve", F.explode(reach).alias("block"), "place", "window", "kind", "v")
    found = "kind string, ids array<long>, scores array<double>"

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not len(q) or not len(c):
            return pd.DataFrame(out, columns=["kind", "ids", "scores"])
        b = np.frombuffer(b"".join(c["w"]), np.float64).reshape(len(c), -1)
        members, most = c["members"].tolist(), min(k + 1, len(c))
        largest = np.linalg.norm(b, axis=1).max()
        for at in range(0, len(q), SPAN):
            some = q.iloc[at:at + SPAN]
            a = np.frombuffer(b"".join(some["v"]), np.float64).reshape(len(some), -1)
            score = a @ b.T
            off = c["at"].to_numpy() - some["place"].to_numpy()[:, None]
            reach = some["window"].to_numpy()[:, None]
            score[(off < -reach) | (off >= reach)] = -np.inf
            cut = np.partition(score, len(c) - most, axis=1)[:, len(c) - most]
            noise = 4 * a.shape[1] * sys.float_info.epsilon * largest * np.linalg.norm(a, axis=1)
            near_cut = (score > -np.inf) & (score >= (cut - noise)[:, None])     # all that tie with the last wanted
            for i, kind in enumerate(some["kind"]):
                near = np.flatnonzero(near_cut[i]).tolist()
                if near:
                    exact = (b[near] * a[i]).sum(axis=1).tolist()
                    each = sorted((-s, int(v)) for s, j in zip(exact, near, strict=True) for v in members[j])[:k + 1]
                    out.append((kind, [v for _, v in each], [-s for s, _ in each]))
        return pd.DataFrame(out, columns=["kind", "ids", "scores"])

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        best = {}
        for ids_, scores in zip(f["ids"], f["scores"], strict=True):
            best.update(zip(ids_.tolist(), scores.tolist(), strict=True))
        each = sorted((-s, v) for v, s in best.items())[:k + 1]
        return pd.DataFrame([(f["kind"].iloc[0], [v for _, v in each], [-s for s, _ in each])],
                            columns=["kind", "ids", "scores"])

    queries, vectors = dealt(queries, vectors, query_rows)
    near = (queries.groupBy("curve", "block", "slice").cogroup(vectors.groupBy("c", "b", "slice")).applyInPandas(meet, found)
            .groupBy("kind").applyInPandas(merge, found))
    answer = (rows.filter(asks).select(F.col("vec_id").alias("query_id"), "kind").join(near, "kind")
              .select("query_id", F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id")),
                                          1, k).alias("near")))
    return answer.select("query_id", F.posexplode("near").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.ids").alias("vec_id"),
        F.col("x.scores").alias("score"))
