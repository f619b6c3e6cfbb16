"""Triangles without wedge rows: lists of neighbours sent to blocks, intersected there.

Links are oriented from lower to higher rank (degree, id).  The links are dealt to blocks by a hash of their lower
end u, whole lists at a time; a vertex v sends its own list once to every block in which some u points at v, and the
block counts, for each link u-v, the w in both lists.  So d+(v) ids go to at most min(d-(v), blocks) places, packed in
as few bytes as the span of the ids takes; what is shuffled grows with the links as long as degrees do not, and no row
per wedge exists.  A block keeps its links sorted (``block_links`` of them on average) and reads the lists sent to it
batch by batch; wedges exist only as numpy index arrays of bounded size, and a block returns one count per vertex.

Where many lists are long the blocks of three colours ship less, and the smaller is taken (both are counted first).
Every vertex has one of q colours (a hash of its id); a triangle u < v < w lies in exactly one block, that of its three
colours in that order.  A link is sent to the blocks where it can be u-v, u-w or v-w, 3 q of them, so 3 m q rows are
shuffled.  q grows with the root of the links and, where one vertex ends a large share of them, with its links: a block
holds about 3 m / q^2 + 2 D / q rows for m links and D links into one vertex, and q is the smallest with which that is
at most ``block_links``.

Ends of degree 1 are in no triangle; their links are not dealt.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

BLOCK_LINKS = 1 << 19
_WEDGES = 1 << 20                                        # looked at together inside a task
_FIRST_OUTER, _OUTER, _FAR = 0, 1, 2                     # a link as u-v, u-w, v-w
_HELD, _SENT = 0, 1                                      # a list in the block of its vertex, and in one that asks for it
_LIST = 1 << 12                                          # ids to a row; a longer list is several rows


def colours(n_links: int, most_into_one: int, block_links: int = BLOCK_LINKS) -> int:
    """The smallest q with 3 m / q^2 + 2 D / q <= block_links."""
    d = 2.0 * most_into_one
    return max(1, math.ceil((d + math.sqrt(d * d + 12.0 * n_links * block_links)) / (2.0 * block_links)))


def dealt(links: DataFrame, q: int) -> DataFrame:
    """(block, role, a, b): each oriented link (u, v) once for every block and role it can have there."""
    colour = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(q))
    at = lambda i, j, k: (i * F.lit(q) + j) * F.lit(q) + k
    i, j, k = F.col("i"), F.col("j"), F.col("k")
    places = F.array(*[F.struct(at(*p).alias("block"), F.lit(role).alias("role"))
                       for role, p in ((_FIRST_OUTER, (i, j, k)), (_OUTER, (i, k, j)), (_FAR, (k, i, j)))])
    every = links.select("u", "v", colour("u").alias("i"), colour("v").alias("j"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q - 1).cast("long"))).alias("k"))
    return every.select(F.explode(places).alias("p"), F.col("u").alias("a"), F.col("v").alias("b")).select(
        "p.block", "p.role", "a", "b")


def _lists(a: np.ndarray, b: np.ndarray, n: int):
    """Links sorted by (a, b) as one key each, and where each vertex's list starts."""
    key = np.sort(a * n + b)
    return key, np.searchsorted(key, np.arange(n + 1) * n)


def _has(key: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(key, wanted)
    return (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == wanted)


def _meet(u, v, of, key, start, n, probe, probed, count) -> None:
    """For links (u, v): members w of the list of ``of`` in (key, start) such that (probe, w) is in ``probed``.
    Wedges are made for as many links at a time as give about _WEDGES of them."""
    size = start[of + 1] - start[of]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(of):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + _WEDGES, "right")))
        s = size[lo:hi]
        link = np.repeat(np.arange(lo, hi), s)
        w = key[np.repeat(start[of[lo:hi]], s) + np.arange(len(link)) - np.repeat(ends[lo:hi] - s - base, s)] % n
        hit = _has(probed, probe[link] * n + w)
        link, w = link[hit], w[hit]
        for corner in (u[link], v[link], w):
            count += np.bincount(corner, minlength=n)
        lo = hi


def block_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, triangles) of one block: each u-v link meets the shorter of u's and v's lists."""
    ids, code = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
    n, m = len(ids), len(pdf)
    a, b, role = code[:m].astype(np.int64), code[m:].astype(np.int64), pdf["role"].to_numpy()
    pick = lambda r: (a[role == r], b[role == r])
    u, v = pick(_FIRST_OUTER)
    near, near_start = _lists(*pick(_OUTER), n)
    far, far_start = _lists(*pick(_FAR), n)
    count = np.zeros(n, np.int64)
    if len(u) and len(near) and len(far):
        by_u = near_start[u + 1] - near_start[u] <= far_start[v + 1] - far_start[v]
        _meet(u[by_u], v[by_u], u[by_u], near, near_start, n, v[by_u], far, count)
        by_v = ~by_u
        _meet(u[by_v], v[by_v], v[by_v], far, far_start, n, u[by_v], near, count)
    some = count > 0
    return pd.DataFrame({"id": ids[some], "triangles": count[some]})


def packed(batches, low: int, width: int):
    """The ids of ``list`` less ``low`` in ``width`` bytes each, as one value a row."""
    for batch in batches:
        ids = batch.column("list")
        at = np.asarray(ids.offsets).astype(np.int64)
        raw = (ids.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]] - np.int64(low)).astype("<i8")
        raw = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8)[:, :width])
        offsets = pa.py_buffer(((at - at[0]) * width).astype(np.int32))
        value = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("blocks"), pa.array(np.diff(at)), value],
                                         ["id", "blocks", "n", "list"])


def _unpacked(value: pa.Array, low: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, how many each row has)."""
    at = np.frombuffer(value.buffers()[1], np.int32)[value.offset:value.offset + len(value) + 1].astype(np.int64)
    raw = np.frombuffer(value.buffers()[2] or b"", np.uint8)[at[0]:at[-1]].reshape(-1, width)
    ids = np.zeros((len(raw), 8), np.uint8)
    ids[:, :width] = raw
    return ids.view("<i8").ravel() + np.int64(low), np.diff(at) // width


class _Block:
    """The links (u, v) of one block, and the triangles found in it so far."""

    def __init__(self, u: np.ndarray, v: np.ndarray):
        self.ids, code = np.unique(np.concatenate([u, v]), return_inverse=True)
        self.n, code = len(self.ids), code.astype(np.int64)
        u, v = code[:len(u)], code[len(u):]
        self.near, self.near_start = _lists(u, v, self.n)
        self.into, self.into_start = _lists(v, u, self.n)
        self.count = np.zeros(self.n, np.int64)

    def meet(self, v: np.ndarray, w: np.ndarray) -> None:
        """Links (v, w) of lists that were sent here: each u pointing at v meets the shorter of the two lists."""
        code = np.minimum(np.searchsorted(self.ids, w), self.n - 1)
        known = self.ids[code] == w                      # any other w is in no list here
        v, w = np.searchsorted(self.ids, v[known]), code[known]
        far, far_start = _lists(v, w, self.n)
        asked = np.unique(v)
        size = self.into_start[asked + 1] - self.into_start[asked]
        v = np.repeat(asked, size)
        u = self.into[np.repeat(self.into_start[asked], size) + np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)] % self.n
        by_u = self.near_start[u + 1] - self.near_start[u] <= far_start[v + 1] - far_start[v]
        _meet(u[by_u], v[by_u], u[by_u], self.near, self.near_start, self.n, v[by_u], far, self.count)
        by_v = ~by_u
        _meet(u[by_v], v[by_v], v[by_v], far, far_start, self.n, u[by_v], self.near, self.count)

    def found(self) -> pa.RecordBatch:
        some = self.count > 0
        return pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array(self.count[some])], ["id", "triangles"])


def list_counts(batches, low: int, width: int):
    """(id, triangles) of the blocks in ``batches`` (block, role, id, list), sorted by block and role."""
    at, links, block = None, [], None
    for batch in batches:
        number, role, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "role", "id"))
        to, size = _unpacked(batch.column("list"), low, width)
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(role) != 0)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(number)]):
            if lo == hi:
                continue
            if number[lo] != at:
                if block is not None:
                    yield block.found()
                at, links, block = number[lo], [], None
            these = np.repeat(ids[lo:hi], size[lo:hi]), to[ends[lo]:ends[hi]]
            if role[lo] == _HELD:
                links.append(these)
                continue
            if block is None:
                block = _Block(*(np.concatenate(x) for x in zip(*links)))
                links = []
            block.meet(*these)
    if block is not None:
        yield block.found()


def lists(links: DataFrame, blocks: int, low: int, width: int) -> DataFrame:
    """(id, blocks, n, list): the ids each u points at, and the blocks in which some vertex points at u."""
    number = F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")
    asked = links.groupBy(F.col("v").alias("id")).agg(F.collect_set(number).alias("blocks"))
    own = links.groupBy(F.col("u").alias("id")).agg(F.collect_list("v").alias("ids")).join(asked, "id", "left")
    of = F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(_LIST)), lambda i: F.slice("ids", i, F.lit(_LIST)))
    rows = own.select("id", F.coalesce("blocks", F.array().cast("array<int>")).alias("blocks"), F.explode(of).alias("list"))
    return rows.mapInArrow(functools.partial(packed, low=low, width=width), "id long, blocks array<int>, n long, list binary")


def sent(kept: DataFrame, blocks: int) -> DataFrame:
    """(block, role, id, list): every list in the block of its vertex and in those that ask for it."""
    place = lambda block, role: F.struct(block.alias("block"), F.lit(role).alias("role"))
    own = F.array(place(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), _HELD))
    every = F.concat(own, F.transform("blocks", lambda b: place(b, _SENT)))
    return kept.select(F.explode(every).alias("p"), "id", "list").select("p.block", "p.role", "id", "list")


def triangles(oriented: DataFrame, block_links: int = BLOCK_LINKS, scratch: Scratch | None = None) -> DataFrame:
    """(id, triangles) of vertices in any, from links (u, v, du, dv) oriented by rank, each once.  The lists are a
    work table in ``scratch`` (without one it stays until ``session.clear_work``)."""
    spark = oriented.sparkSession
    links = oriented.filter(F.col("du") >= 2).select("u", "v")
    into = links.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("low"), F.max("u").alias("high"))
    size = into.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m"), F.coalesce(F.max("n"), F.lit(0)).alias("d"),
                    F.coalesce(F.min(F.least("low", "v")), F.lit(0)).alias("low"),
                    F.coalesce(F.max(F.greatest("high", "v")), F.lit(0)).alias("high")).first()
    blocks = max(math.ceil(size.m / block_links), int(spark.conf.get("spark.sql.shuffle.partitions")))
    width = min(8, max(1, ((size.high - size.low).bit_length() + 7) // 8))
    kept = (scratch or Scratch(spark)).table(lists(links, blocks, size.low, width), "lists")
    moved = kept.agg(F.coalesce(F.sum(F.col("n") * F.size("blocks")), F.lit(0))).first()[0]
    q = colours(size.m, size.d, block_links)
    if moved <= 3 * size.m * q:
        rows = sent(kept, blocks).repartition("block").sortWithinPartitions("block", "role")
        counts = rows.mapInArrow(functools.partial(list_counts, low=size.low, width=width), "id long, triangles long")
    else:
        counts = dealt(links, q).groupBy("block").applyInPandas(block_counts, "id long, triangles long")
    return counts.groupBy("id").agg(F.sum("triangles").alias("triangles"))
