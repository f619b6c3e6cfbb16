"""Hard negatives of anchor vectors by spanning-tree bounds.

Vectors are integer (floor of ``scale`` times each component) and scores integer inner products, so every score is
exact.  Anchors are sorted by label and direction, cut into blocks, and the anchors of a block are joined
by a minimum spanning tree.  A score at a parent anchor bounds the score at its child: they differ by
at most the length of the edge times the norm of the candidate.  Each candidate is scored exactly at the root;
down the tree it carries an interval, and is scored again only where the interval overlaps what the
anchor still looks for: at least its k-th best positive so far, or a window of scores that hard negatives may have.

The candidates are never shuffled: a pass broadcasts one group of blocks (at most ``group_bytes``, whatever the
number of anchors), every task scans its own candidates and returns the best few per anchor, and Spark merges
those by rank.  The first round of passes finds the positives, the second the negatives in their windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

EXACT = float(1 << 53)                            # integers below this are exact in double precision
LIMIT = (1 << 63) - 1
BLOCK = "block long, ids binary, labels binary, vectors binary, parents binary, edges binary"


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    label: Column | None = None, scale: float = 256.0) -> DataFrame:
    """(id, label, vector) of the rows that take part: those with an id, a label and a vector without null or
    non-finite components; ``vector`` holds floor(scale * component), in double precision."""
    v = F.col(vector_col)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("id"),
                    (F.col(label_col) if label is None else label).cast("long").alias("label"), whole.alias("vector")))


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree: ``order`` lists vectors parents first, from the one
    nearest to the mean; ``parent`` (a place in ``order``, -1 for the root) and ``edge`` (its length) go by place."""
    n = len(vectors)
    square = (vectors * vectors).sum(axis=1)
    mean = vectors.mean(axis=0)
    at = int(np.argmin(square - 2.0 * (vectors @ mean)))
    order, parent = np.empty(n, np.int64), np.full(n, -1)
    place, near = np.zeros(n, np.int64), np.full(n, np.inf)
    open_ = np.ones(n, bool)
    for i in range(n):
        order[i] = at
        parent[i] = place[at] if i else -1
        open_[at] = False
        d = square + square[at] - 2.0 * (vectors @ vectors[at])
        closer = open_ & (d < near)
        near[closer], place[closer] = d[closer], i
        at = int(np.argmin(np.where(open_, near, np.inf)))
    edge = np.zeros(n)
    for i in range(1, n):                         # from the difference itself, a little too long
        diff = vectors[order[i]] - vectors[order[parent[i]]]
        edge[i] = np.sqrt(float(diff @ diff)) * (1.0 + 1e-9)
    return order, parent, edge


def anchor_blocks(anchors: DataFrame, block_rows: int = 1024) -> DataFrame:
    """Rows of BLOCK: anchors near each other (label, then a fixed direction) with their spanning tree."""
    n = max(anchors.count(), 1)
    along = F.aggregate(F.transform("vector", lambda x, i: x * F.when(i % 3 == 0, 1.0).otherwise(-0.5)), F.lit(0.0),
                        lambda a, x: a + x)
    dealt = (anchors.withColumn("along", along).repartitionByRange(-(-n // block_rows), "label", "along", "id")
             .sortWithinPartitions("label", "along", "id"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = [], [], []

        def block() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):              # vectors of another length score nothing with these
                at = np.flatnonzero(sizes == dim)
                v = np.array([vectors[i] for i in at]).reshape(len(at), dim)
                order, parent, edge = spanning_tree(v)
                at = at[order]
                cells = [np.array([ids[i] for i in at], np.int64), np.array([labels[i] for i in at], np.int64), v[order], parent, edge]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[at[0]]], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
                    names=["block", "ids", "labels", "vectors", "parents", "edges"])

        for b in batches:
            for i, k, v in zip(*(b.column(c).to_pylist() for c in ("id", "label", "vector")), strict=True):
                ids.append(i), labels.append(k), vectors.append(v)
                if len(ids) == block_rows:
                    yield from block()
                    ids, labels, vectors = [], [], []
        if ids:
            yield from block()

    return staged(dealt.select("id", "label", "vector").mapInArrow(pack, BLOCK), "anchor-blocks")


class Block:
    """A block of anchors: numbers by place in the order of its tree."""

    def __init__(self, row):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"]).reshape(n, -1)
        self.parents, self.edges = np.frombuffer(row["parents"], np.int64), np.frombuffer(row["edges"])
        self.length = np.sqrt((self.vectors * self.vectors).sum(axis=1)).max(initial=0.0)


def inner(candidates: np.ndarray, anchor: np.ndarray, small: bool) -> np.ndarray:
    """Exact integer inner products: in double precision where no sum can pass 2 ** 53, else in whole numbers
    of any size (cut to the range of a long)."""
    if small:
        return (candidates @ anchor).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(c, anchor, strict=True)) for c in candidates]
    return np.array([max(-LIMIT, min(LIMIT, s)) for s in whole], np.int64)


def walk(block: Block, candidates: np.ndarray, norms: np.ndarray, wanted, take) -> int:
    """Down the tree of ``block``.  ``wanted(i, low, high)``: which candidates anchor i still needs, given
    bounds of their scores; ``take(i, which, scores)`` gets the exact scores of those.  Returns how many were scored."""
    n, m = len(block.ids), len(candidates)
    reach = float(norms.max(initial=0.0)) * float(block.length)
    small = reach < EXACT
    slack = 1.0 + reach * 1e-12                  # rounding of the intervals, far above it
    middle, spread = np.empty((n, m)), np.empty((n, m))
    scored = 0
    for i in range(n):
        p = block.parents[i]
        if p < 0:
            which = np.arange(m)
        else:
            middle[i] = middle[p]
            np.multiply(norms, block.edges[i], out=spread[i])
            spread[i] += spread[p]
            which = np.flatnonzero(wanted(i, middle[i] - spread[i] - slack, middle[i] + spread[i] + slack))
        if small and 2 * len(which) > m:             # most of them: without copying rows
            s = inner(candidates, block.vectors[i], True)[which]
        else:
            s = inner(candidates[which], block.vectors[i], small)
        middle[i, which], spread[i, which] = s, 0.0
        scored += len(which)
        if len(which):
            take(i, which, s)
    return scored


def _candidates(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of at most ``rows`` candidates of one dimension."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            part = b.slice(lo, rows)
            ids, labels = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
            lists = part.column("vector")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                yield ids[at], labels[at], flat[starts[at][:, None] + np.arange(dim)]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(ids) > 4 * k:                          # cut first, keeping every tie at the cut
        at = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Positives:
    """The best ``k`` candidates of each anchor's label, as far as a task has seen."""

    schema = "anchor_id long, candidate_id long, score long"

    def __init__(self, blocks: list[Block], k: int):
        self.blocks, self.k = blocks, k
        self.held = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(b.ids) for b in blocks]

    def see(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> int:
        scored = 0
        for block, held in zip(self.blocks, self.held, strict=True):
            if block.vectors.shape[1] != vectors.shape[1]:
                continue
            own = np.isin(labels, block.labels)
            who, kind, v = ids[own], labels[own], vectors[own]
            if not len(who):
                continue

            def wanted(i, low, high, block=block, held=held, who=who, kind=kind):
                ok = (kind == block.labels[i]) & (who != block.ids[i])
                return ok & (high >= held[i][1][-1]) if len(held[i][1]) == self.k else ok

            def take(i, which, s, block=block, held=held, who=who, kind=kind):
                ok = (kind[which] == block.labels[i]) & (who[which] != block.ids[i])
                x = np.concatenate((held[i][0], who[which[ok]]))
                y = np.concatenate((held[i][1], s[ok]))
                at = _best(x, y, self.k)
                held[i] = x[at], y[at]

            scored += walk(block, v, np.sqrt((v * v).sum(axis=1)), wanted, take)
        return scored

    def rows(self) -> Iterator[tuple[np.ndarray, ...]]:
        for block, held in zip(self.blocks, self.held, strict=True):
            n = [len(h[0]) for h in held]
            yield np.repeat(block.ids, n), np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


class Negatives:
    """The best ``k`` candidates of another label in each score window of each anchor, as far as a task has seen.
    ``windows``: anchor -> (lows, highs, positive scores) of windows of whole scores, both ends included."""

    schema = "anchor_id long, positive_score long, candidate_id long, score long"

    def __init__(self, blocks: list[Block], k: int, windows: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.blocks, self.k = blocks, k
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.windows = [[windows.get(int(i), none) for i in b.ids] for b in blocks]
        self.held = [[[none[:2]] * len(w[0]) for w in ws] for ws in self.windows]

    def see(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> int:
        scored, norms = 0, np.sqrt((vectors * vectors).sum(axis=1))
        for block, windows, held in zip(self.blocks, self.windows, self.held, strict=True):
            if block.vectors.shape[1] != vectors.shape[1]:
                continue

            def floors(i, windows=windows, held=held):
                return [max(low, h[1][-1]) if len(h[1]) == self.k else low for low, h in zip(windows[i][0].tolist(), held[i], strict=True)]

            def wanted(i, low, high, block=block, windows=windows, floors=floors):
                lows, highs = floors(i), windows[i][1]
                if not lows:
                    return np.zeros(len(low), bool)
                return (labels != block.labels[i]) & (high >= min(lows)) & (low <= highs.max())

            def take(i, which, s, block=block, windows=windows, held=held, floors=floors):
                lows, highs = floors(i), windows[i][1]
                if not lows:
                    return
                ok = (labels[which] != block.labels[i]) & (s >= min(lows)) & (s <= highs.max())
                who, s = ids[which[ok]], s[ok]
                for j, (low, top) in enumerate(zip(lows, highs.tolist(), strict=True)):
                    into = (s >= low) & (s <= top)
                    if into.any():
                        x, y = np.concatenate((held[i][j][0], who[into])), np.concatenate((held[i][j][1], s[into]))
                        at = _best(x, y, self.k)
                        held[i][j] = x[at], y[at]

            scored += walk(block, vectors, norms, wanted, take)
        return scored

    def rows(self) -> Iterator[tuple[np.ndarray, ...]]:
        for block, windows, held in zip(self.blocks, self.windows, self.held, strict=True):
            flat = [(a, p, h) for a, w, hs in zip(block.ids.tolist(), windows, held, strict=True)
                    for p, h in zip(w[2].tolist(), hs, strict=True) if len(h[0])]
            if flat:
                n = [len(h[0]) for _, _, h in flat]
                yield (np.repeat([a for a, _, _ in flat], n), np.repeat([p for _, p, _ in flat], n),
                       np.concatenate([h[0] for _, _, h in flat]), np.concatenate([h[1] for _, _, h in flat]))


def _groups(blocks: DataFrame, group_bytes: int) -> Iterator[list]:
    """Blocks, collected a bounded group at a time (only their numbers and sizes are collected at once)."""
    sizes = blocks.select("block", (F.octet_length("vectors") + F.octet_length("ids")).alias("n")).orderBy("block").collect()
    at = 0
    while at < len(sizes):
        end, n = at, 0
        while end < len(sizes) and (end == at or n + sizes[end]["n"] <= group_bytes):
            n += sizes[end]["n"]
            end += 1
        yield blocks.filter(F.col("block").between(sizes[at]["block"], sizes[end - 1]["block"])).collect()
        at = end


def _pass(candidates: DataFrame, make, schema: str, batch_rows: int) -> DataFrame:
    """One scan of all candidates by the collector that ``make()`` builds in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = make()
        for ids, labels, vectors in _candidates(batches, batch_rows):
            seen.see(ids, labels, vectors)
        names = [c.split()[0] for c in schema.split(", ")]
        for cols in seen.rows():
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64), pa.int64()) for c in cols], names=names)

    return candidates.mapInArrow(run, schema)


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each key with their rank, from 1."""
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("candidate_id"))
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _windows(best: DataFrame, low_share: int, high_share: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Anchor -> the whole scores s with low_share * p <= 100 * s <= high_share * p, for each of its positive scores p."""
    scores = best.select("anchor_id", "score").distinct().orderBy("anchor_id", "score").toArrow().to_pydict()
    out: dict[int, list] = {}
    for a, p in zip(scores["anchor_id"], scores["score"], strict=True):
        low, high = -(-low_share * p // 100), high_share * p // 100
        if low <= high:
            out.setdefault(a, []).append((low, high, p))
    return {a: tuple(np.array(x, np.int64) for x in zip(*w, strict=True)) for a, w in out.items()}


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low_share: int = 80,
         high_share: int = 100, group_bytes: int = 16 << 20, block_rows: int = 1024, batch_rows: int = 2048) -> DataFrame:
    """``vectors``: (id, label, vector) as from ``integer_vectors``; ``anchor``: which rows are anchors.

    One row per anchor, positive and hard negative: anchor_id, positive_id, rank (from 1 for each positive),
    negative_id, positive_score, negative_score.  An anchor's positives are the first ``positives`` other rows of its
    label, by higher score, then smaller id (all, if fewer); a positive's negatives are the first ``negatives`` rows
    of another label with low_share * positive_score <= 100 * negative_score <= high_share * positive_score.

    A positive without such rows has none (a positive of negative score never has any).  Rows of another
    dimension than the anchor's take no part for it.  Repeated rows count each, but none as a positive of its own
    id; an id that comes with several vectors is one anchor, by the smallest label and vector.  Components beyond
    the range of a long, and scores beyond it, count as its ends.  An empty table gives no rows.
    """
    sc = vectors.sparkSession.sparkContext
    candidates = staged(vectors.select("id", "label", "vector"), "mining-vectors")
    one = candidates.filter(anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
    blocks = anchor_blocks(one.select("id", "r.label", "r.vector"), block_rows)
    out = None
    for group in _groups(blocks, group_bytes):
        sent = sc.broadcast([r.asDict() for r in group])
        first = _pass(candidates, lambda sent=sent: Positives([Block(r) for r in sent.value], positives),
                      Positives.schema, batch_rows)
        best = staged(_ranked(first, ["anchor_id"], positives), "mining-positives")
        wide = sc.broadcast(_windows(best, low_share, high_share))      # of a group's anchors only: bounded
        second = _pass(candidates, lambda sent=sent, wide=wide: Negatives([Block(r) for r in sent.value], negatives, wide.value),
                       Negatives.schema, batch_rows)
        found = staged(_ranked(second, ["anchor_id", "positive_score"], negatives), "mining-negatives")
        pairs = (best.select("anchor_id", F.col("candidate_id").alias("positive_id"), F.col("score").alias("positive_score"))
                 .join(found.select("anchor_id", "positive_score", "rank", F.col("candidate_id").alias("negative_id"),
                                    F.col("score").alias("negative_score")), ["anchor_id", "positive_score"])
                 .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        out = pairs if out is None else out.unionByName(pairs)
        sent.unpersist(), wide.unpersist()
    if out is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                                        "positive_score long, negative_score long")
    return out
