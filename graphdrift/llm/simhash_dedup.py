"""SimHash near-duplicates: exact Hamming links by a hierarchical index in Gray order.

Two 64-bit fingerprints at most ``max_bits`` apart agree in at least one of ``max_bits + 1`` bit
blocks.  For each block the fingerprint is rotated so that the block leads; in Gray order of the
rotated value all fingerprints that agree in the block are neighbours, and so a group with a shared
root.  Spark shuffles (block, value) groups of distinct fingerprints; inside a group runs of the
Gray order are factored into nodes that hold the bits all members share, and pairs of nodes are
dropped as soon as their shared bits differ in more than ``max_bits`` places.  Only a spanning
forest of the links leaves a group.

Groups of more than ``group_rows`` fingerprints are dealt out as pairs of chunks, so that every
link is still found and no task holds more than two chunks of a group at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, free_name, shuffle_count, staged
from .components import connected_components

BITS = 64
SEED = 42
SPAN = 1 << 16          # shingles hashed at a time


def fingerprint(text: str | None, shingle: int = 4, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text: a bit is 1 if set in over half of the shingle hashes."""
    words = (text or "").encode("utf-8", "replace").lower().split()     # bytes: ASCII case and ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    h64, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SPAN):
        part = zip(starts[at:at + SPAN].tolist(), ends[at:at + SPAN].tolist(), strict=True)
        h = np.array([h64(joined[s:e], seed) for s, e in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, row_key (a hash of id and text), fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "row_key": b["row_key"], "fp": fp.view(np.int64)})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"),
                      F.col(text_col).alias("text"))
    return src.mapInPandas(run, "doc_id long, row_key long, fp long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(offset from the top, size) of the max_bits + 1 blocks."""
    n = max_bits + 1
    sizes = [BITS // n + (i < BITS % n) for i in range(n)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def _gray_rank(col):
    """Position of a code word in the reflected Gray sequence."""
    for step in (1, 2, 4, 8, 16, 32):
        col = col.bitwiseXOR(F.shiftrightunsigned(col, step))
    return col


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; label[x] is the smallest index known of x's class."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


class GrayIndex:
    """Nodes over Gray-ordered fingerprints of one or more groups: level 0 the fingerprints, each
    level above joins up to ``fan`` neighbours and keeps which bits they share."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, fan: int = 8):
        n = len(codes)
        self.label = np.arange(n)
        self.levels = [(codes, codes, np.arange(n), np.ones(n, np.int64))]
        self.groups = group
        while True:
            start = np.concatenate(([True], group[1:] != group[:-1]))
            if start.all():
                break
            first = np.maximum.accumulate(np.where(start, np.arange(len(group)), 0))
            heads = np.flatnonzero((np.arange(len(group)) - first) % fan == 0)
            ands, ors, _, _ = self.levels[-1]
            count = np.diff(np.append(heads, len(group)))
            self.levels.append((np.bitwise_and.reduceat(ands, heads), np.bitwise_or.reduceat(ors, heads),
                                heads, count))
            group = group[heads]

    def _uniform(self) -> list[np.ndarray]:
        """Per level the class shared by all members of a node, or -1."""
        lo = hi = self.label
        out = [lo]
        for _, _, heads, _ in self.levels[1:]:
            lo, hi = np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads)
            out.append(np.where(lo == hi, lo, -1))
        return out

    def link(self, max_bits: int, block: int = 1 << 18) -> np.ndarray:
        """Classes of fingerprints linked within their group by steps of at most max_bits."""
        codes = self.levels[0][0]
        near = np.flatnonzero((self.groups[1:] == self.groups[:-1])
                              & (np.bitwise_count(codes[1:] ^ codes[:-1]) <= max_bits))
        union(self.label, near, near + 1)
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack, same, found = [(top, roots, roots)], self._uniform(), 0
        while stack:
            level, a, b = stack.pop()
            whole = same[level]
            keep = ~((whole[a] >= 0) & (whole[a] == whole[b]))          # already one class
            a, b = a[keep], b[keep]
            if level == 0:
                union(self.label, a, b)
                found += len(a)
                if found > 4 * block:
                    same, found = self._uniform(), 0
                continue
            _, _, heads, count = self.levels[level]
            size = count[a] * count[b]
            if size.sum() > block and len(a) > 1:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            cb = np.repeat(count[b], size)
            ca, cc = np.repeat(heads[a], size) + k // cb, np.repeat(heads[b], size) + k % cb
            ordered = np.repeat(a != b, size) | (ca <= cc) if level > 1 else np.repeat(a != b, size) | (ca < cc)
            ca, cc = ca[ordered], cc[ordered]
            ands, ors, _, _ = self.levels[level - 1]
            shared = ~((ors[ca] ^ ands[ca]) | (ors[cc] ^ ands[cc]))
            near = np.bitwise_count((ands[ca] ^ ands[cc]) & shared) <= max_bits
            stack.append((level - 1, ca[near], cc[near]))
        return self.label


def links(fps: DataFrame, max_bits: int = 4, group_rows: int = 50_000, batch_rows: int = 200_000) -> DataFrame:
    """(u, v): a spanning forest, group by group, of all pairs of the distinct fingerprints ``fp``
    that differ in 1 to ``max_bits`` bits."""
    spark = fps.sparkSession
    fp = F.col("fp")
    alts = []
    for i, (off, size) in enumerate(_blocks(max_bits)):
        turned = F.shiftleft(fp, off).bitwiseOR(F.shiftrightunsigned(fp, BITS - off)) if off else fp
        alts.append(F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(turned, BITS - size).alias("value"),
                             turned.alias("code")))
    rows = fps.select("fp", F.explode(F.array(*alts)).alias("r")).select("fp", "r.i", "r.value", "r.code")
    big = (rows.groupBy("i", "value").count().filter(F.col("count") > group_rows)
           .select("i", "value", F.ceil(F.col("count") / group_rows).cast("int").alias("chunks")))
    rows = rows.join(big, ["i", "value"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    part = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                       lambda j: F.least(j, mine) * F.col("chunks") + F.greatest(j, mine))
    rows = rows.withColumn("part", F.explode(part))
    order = _gray_rank(F.col("code")).bitwiseXOR(F.lit(-(1 << 63)))      # unsigned order as signed
    rows = (rows.select("fp", "i", "value", "part", "code", order.alias("gray"))
            .repartition(shuffle_count(spark), "i", "value", "part").sortWithinPartitions("i", "value", "part", "gray"))

    def solve(b: pd.DataFrame) -> pd.DataFrame:
        key = b[["i", "value", "part"]].to_numpy()
        group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(axis=1))))
        fp = b["fp"].to_numpy()
        label = GrayIndex(b["code"].to_numpy().view(np.uint64), group).link(max_bits)
        hung = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": fp[hung], "v": fp[label[hung]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for b in batches:
            held.append(b[["fp", "i", "value", "part", "code"]])
            n += len(b)
            if n >= batch_rows:                                         # cut where a group ends
                all_rows = pd.concat(held, ignore_index=True)
                key = all_rows[["i", "value", "part"]].to_numpy()
                cut = n - int((key == key[-1]).all(axis=1).sum())
                if cut:
                    yield solve(all_rows.iloc[:cut])
                held, n = [all_rows.iloc[cut:]], n - cut
        if n:
            yield solve(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(run, "u long, v long")


def _members(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int,
             group_rows: int = 50_000) -> DataFrame:
    """One row per document: doc_id, row_key, fp, component_id, root (the smallest fingerprint of the
    component as a signed long, never null)."""
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    tree = staged(connected_components(links(low.select("fp"), max_bits, group_rows)), "simhash-tree")
    member = low.join(tree.select(F.col("node").alias("fp"), "root"), "fp", "left") \
                .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = member.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = member.join(lowest, "root").select("fp", "component_id", "root")
    return fps.join(classes, "fp").select("doc_id", "row_key", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4, group_rows: int = 50_000) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    reachable over links of at most ``max_bits`` differing bits), and row_key.

    Null and blank texts have fingerprint zero and link like any other; texts of fewer words than a
    shingle hash as one whole.  Repeated rows and equal fingerprints are one class.  Null ids count
    only if a component has no other id (component_id is then null).  An empty table gives no rows.
    """
    found = _members(docs, id_col, text_col, shingle, max_bits, group_rows)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each component, the smallest id (of equal ids, the smallest row
    key; a null id only if there is no other); all columns as they were.  Components without an id
    are told apart by their root.  Rows alike in id and text are not told apart."""
    found = _members(docs, id_col, text_col, shingle, max_bits).select("doc_id", "row_key", "root")
    found = staged(found, "simhash-found")
    rank = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("row_key").alias("k"))
    best = found.groupBy("root").agg(F.min(rank).alias("best"))
    d, k = free_name(docs, "__d"), free_name(docs, "__k")
    out = (found.join(best, "root").filter(rank != F.col("best"))
           .select(F.col("doc_id").alias(d), F.col("row_key").alias(k)).distinct())
    out = staged(out, "simhash-gone")       # its size is known before the join: texts are shuffled only if it is large
    mine = F.xxhash64(docs[id_col], docs[text_col])
    return docs.join(out, docs[id_col].cast("long").eqNullSafe(F.col(d)) & (mine == F.col(k)), "left_anti")
