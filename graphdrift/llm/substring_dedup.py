"""Substring deduplication over word windows behind a count-min prefilter.

First pass: every task counts its windows in partition sketches (two rows of cells with counts 0, 1,
2 or more, sent as sorted cell numbers); Spark merges them cell block by cell block.  A merged count
is never too low, so a window whose estimate is below two in either row occurs once and is done with.
Second pass: only windows estimated repeated are grouped exactly, on 96 bits of the hash of their
word sequence, which finds the smallest document each starts in.

The merged sketch is broadcast as one bit a cell.  Its size follows the input up to ``max_cells`` cells
a row (128 MB for both rows at the default), and stays there: beyond that the estimates let more windows through
and the second pass groups more, but still nothing is lost.  It is kept as compressed blocks, and a task
unpacks one block (1 MB at most at the default) at a time, for the windows whose cells lie in it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import key_exchange as X
from .common import compressed, keyed, plain, shuffle_count, staged
from .vocab import Memo

ROWS = 2                                  # sketch rows
BLOCKS = 64                               # cell blocks a row is merged in
CHUNK_WINDOWS = 1_000_000                 # windows a task holds at a time
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
FOUND = "_d long, _k long, runs binary"


class WindowHasher:
    """128-bit hashes of the word windows of texts."""

    def __init__(self, words: int):
        self.words = words
        self.memo = Memo(lambda w: xxhash.xxh3_128_digest(w))
        with np.errstate(over="ignore"):
            self.powers = [np.cumprod(np.full(words, f, np.uint64)) for f in FACTORS]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, hash, index of the text, first word) of all windows."""
        memo = self.memo
        parts = [b"".join([memo[w] for w in t.encode("utf-8", "replace").split()]) for t in texts]
        n = np.array([len(p) // 16 for p in parts], np.int64)
        h = np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)
        del parts
        total = len(h) - self.words + 1
        if total <= 0:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none
        out = []
        for col, powers in zip((0, 1), self.powers, strict=True):
            w, acc = np.ascontiguousarray(h[:, col]), np.zeros(total, np.uint64)
            for j in range(self.words):
                acc += w[j:j + total] * powers[j]
            out.append(acc)
        text = np.repeat(np.arange(len(texts)), n)[:total]
        start = np.arange(total) - (np.cumsum(n) - n)[text]
        inside = start + self.words <= n[text]
        return out[0][inside], out[1][inside], text[inside], start[inside]


def _text_runs(batches: Iterator[pd.DataFrame], limit_bytes: int = 6 * CHUNK_WINDOWS) -> Iterator[pd.DataFrame]:
    """Rows of about CHUNK_WINDOWS windows at a time."""
    held, size = [], 0
    for b in batches:
        length = b["text"].str.len().to_numpy()
        cuts = np.flatnonzero(np.diff((size + np.cumsum(length)) // limit_bytes, prepend=size // limit_bytes)) + 1
        at = 0
        for c in [*cuts.tolist(), len(b)]:
            if c > at:
                held.append(b.iloc[at:c])
            if c in cuts and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            at = c
        size = (size + int(length.sum())) % limit_bytes
    if held:
        yield pd.concat(held, ignore_index=True)


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _coded(cells: np.ndarray) -> bytes:
    """Sorted cell numbers as differences, low and high bytes apart."""
    step = np.diff(cells, prepend=0).astype("<u4")
    return zlib.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _decoded(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64))


def counted_twice(blocks: list[bytes], cells: np.ndarray, bits: int) -> np.ndarray:
    """Whether each cell is set in a sketch row, of which one block is unpacked at a time."""
    width = bits - (BLOCKS - 1).bit_length()            # log2 of a block's cells
    block = (cells >> width).astype(np.uint8)
    order = np.argsort(block, kind="stable")
    ends = np.cumsum(np.bincount(block, minlength=BLOCKS)).tolist()
    out = np.zeros(len(cells), bool)
    for raw, lo, hi in zip(blocks, [0, *ends], ends, strict=False):
        if raw and hi > lo:
            packed = np.frombuffer(zstandard.decompress(raw), np.uint8)
            c = cells[order[lo:hi]] & ((1 << width) - 1)
            out[order[lo:hi]] = (packed[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def merged_sketch(rows: DataFrame, words: int, bits: int) -> list[list[bytes]]:
    """For each sketch row its blocks: the packed bits of the cells counted twice or more, compressed (a
    block without windows is empty)."""
    block_cells = (1 << bits) // BLOCKS

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WindowHasher(words)
        for b in _text_runs(batches):
            h1, h2, _, _ = hasher(b["text"].tolist())
            out = []
            for r, h in enumerate((h1, h2)):
                cells = np.sort(_cells(h, bits))
                again = np.unique(cells[1:][cells[1:] == cells[:-1]])
                once = cells[np.concatenate(([True], cells[1:] != cells[:-1]))] if len(cells) else cells
                for block in np.unique(once // block_cells).tolist():
                    lo, hi = block * block_cells, (block + 1) * block_cells
                    part = [x[np.searchsorted(x, lo):np.searchsorted(x, hi)] - lo for x in (once, again)]
                    out.append((r, block, _coded(part[0]), _coded(part[1])))
            yield pd.DataFrame(out, columns=["r", "block", "seen", "again"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=1)
        key, seen, twice = None, None, None
        for b in batches:
            for r in b.itertuples(index=False):
                if (r.r, r.block) != key:
                    if key:
                        yield pd.DataFrame([(*key, squeeze.compress(np.packbits(twice).tobytes()))],
                                           columns=["r", "block", "bits"])
                    key = (r.r, r.block)
                    seen, twice = np.zeros(block_cells, bool), np.zeros(block_cells, bool)
                cells = _decoded(r.seen)
                twice[cells] |= seen[cells]
                seen[cells] = True
                twice[_decoded(r.again)] = True
        if key:
            yield pd.DataFrame([(*key, squeeze.compress(np.packbits(twice).tobytes()))], columns=["r", "block", "bits"])

    parts = rows.select("text").mapInPandas(sketch, "r int, block int, seen binary, again binary")
    merged = (parts.repartition(shuffle_count(rows.sparkSession), "r", "block").sortWithinPartitions("r", "block")
              .mapInPandas(merge, "r int, block int, bits binary"))
    out = [[b""] * BLOCKS for _ in range(ROWS)]
    for r in merged.toLocalIterator(prefetchPartitions=False):      # a fixed number of blocks of bounded size
        out[r["r"]][r["block"]] = bytes(r["bits"])
    return out


def sketch_bits(rows: DataFrame, max_cells: int) -> int:
    """log2 of the cells in a row: at least four for each window, as far as ``max_cells`` goes."""
    windows = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    return int(np.clip(np.ceil(np.log2(4 * windows + 1)), 16, np.log2(max_cells)))


def repeated_starts(rows: DataFrame, words: int, max_cells: int) -> DataFrame:
    """(_d, _k, runs): first and last window, as packed 32-bit numbers, of each run of windows of a
    document that also start in a document with a smaller id."""
    spark = rows.sparkSession
    bits = sketch_bits(rows, max_cells)
    sketch = spark.sparkContext.broadcast(merged_sketch(rows, words, bits))
    shards = 4 * shuffle_count(spark)

    def estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WindowHasher(words)
        base = TaskContext.get().partitionId() << 32
        for i, b in enumerate(_text_runs(batches)):
            h1, h2, text, start = hasher(b["text"].tolist())
            for r in range(ROWS):                       # the second row is asked for what the first lets through
                maybe = counted_twice(sketch.value[r], _cells((h1, h2)[r], bits), bits)
                h1, h2, text, start = h1[maybe], h2[maybe], text[maybe], start[maybe]
            h2 = h2.astype(np.uint32)
            d, k = b["_d"].to_numpy(np.int64), b["_k"].to_numpy(np.int64)
            entry, heads = X.sorted_keys(h1, h2, shards)
            low = np.full(len(heads), np.iinfo(np.int64).max)
            np.minimum.at(low, entry, d[text])
            packet = X.pack_arrays(d, k, X.squeezed(text), X.squeezed(start), X.narrow(entry))
            chunk = base + i
            yield pd.DataFrame([(chunk, 0, -1, packet), *X.key_rows(chunk, h1[heads], h2[heads], low, shards)],
                               columns=["chunk", "kind", "shard", "payload"])

    def decide(a: np.ndarray, b: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        heads = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        least = np.repeat(np.minimum.reduceat(low, heads), np.diff(np.append(heads, len(low))))
        told = least < low                              # another chunk has a smaller document
        return told, [least[told]]

    def finish(packet: bytes, entries: np.ndarray, answers: list[np.ndarray]) -> pd.DataFrame:
        d, k, text, start, entry = X.unpack_arrays(packet)
        text, start, entry = X.unsqueezed(text), X.unsqueezed(start), entry.astype(np.int64)
        least = np.full(int(entry.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, entry, d[text])
        if len(entries):
            least[entries] = answers[0]
        gone = d[text] > least[entry]
        text, start = text[gone], start[gone]           # by text and place, as they were read
        head = np.concatenate(([True], (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1))) \
            if len(text) else np.zeros(0, bool)
        begin = np.flatnonzero(head)
        pairs = np.stack((start[begin], start[np.append(begin[1:], len(start)) - 1]), axis=1).astype("<u4") \
            if len(text) else np.zeros((0, 2), "<u4")
        which, first = np.unique(text[begin], return_index=True)
        runs = [p.tobytes() for p in np.split(pairs, first[1:])] if len(which) else []
        return pd.DataFrame({"_d": d[which], "_k": k[which], "runs": runs})

    found = X.exchange(rows.mapInPandas(estimated, X.SCHEMA), decide, finish, FOUND)
    found = staged(found.groupBy("_d", "_k").agg(F.max("runs").alias("runs")), "repeated-runs")   # repeated rows agree
    sketch.destroy()
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 13,
                   max_cells: int = 1 << 29, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with ``with_text``, the kept
    words joined by one space.

    Words are runs of bytes other than space and \\t..\\r, unchanged.  Removed is each word covered by
    a window of ``words`` words whose sequence also starts in a document with a smaller id, judged on
    the input.  A null text has no words.  A null id counts as larger than all; rows with equal ids are
    not smaller than each other.  Texts with fewer words than a window stay whole; an empty table
    gives no rows; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    runs = repeated_starts(rows.select("_d", "_k", "text"), words, max_cells)
    joined = compressed(rows).join(runs, ["_d", "_k"], "left").select("doc_id", "z", "runs")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, z, r in zip(b["doc_id"], b["z"], b["runs"], strict=True):
                w = plain(z).split()
                n, gone = len(w), 0
                if r is not None:
                    edge = np.zeros(n + 1, np.int64)
                    for first, last in np.frombuffer(r, "<u4").reshape(-1, 2).tolist():
                        edge[first] += 1
                        edge[last + words] -= 1
                    keep = np.cumsum(edge[:n]) == 0
                    w = [x for x, k in zip(w, keep.tolist(), strict=True) if k]
                    gone = n - len(w)
                kept = b" ".join(w)
                out.append((None if pd.isna(i) else int(i), n, gone, hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8") if with_text else None))
            f = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
            f["doc_id"] = pd.array(f["doc_id"].tolist(), dtype="Int64")
            yield f

    out = joined.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


