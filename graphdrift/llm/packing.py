"""Order-preserving packing of token streams into fixed windows.

Documents keep the order of their input partition.  Windows are cut at document or sentence ends
(inside a sentence only where no such place lies within a window) so that padding plus truncation
penalties are smallest.  A window that is not full is padded to its width, unless its length is a
power of two.  With f(j) the least cost up to place j, f(j) = penalty(j) + min over places i at most
a window back of f(i) + width - (j - i); f(i) + i does not depend on j, so a monotone queue gives
the minimum in constant time; the few places an unpadded length before j are found for all j at once.

Every input partition is packed by itself as one long stream, a horizon at a time: a horizon's last
windows are left open and planned again with what follows, so memory is bounded by the horizon
and the longest document, nothing is shuffled, and only a partition's last window can end early.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import added_tokens, packed_ids_with_added, rank_path, token_bytes

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")
IN_SENTENCE, IN_DOCUMENT, PER_WINDOW = 64.0, 8.0, 4.0     # penalties, in padded tokens


def _unpadded(pos: np.ndarray, sizes: list[int]) -> tuple[list[int], list[int]]:
    """Places one of the rising ``sizes`` before each place: where those of place j end in the list, and the list."""
    found = []
    for size in sizes:
        before = np.searchsorted(pos, pos - size)
        to = np.flatnonzero(pos[before] == pos - size)
        found.append((to, before[to]))
    to, before = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.cumsum(np.bincount(to, minlength=len(pos))).tolist(), before[np.argsort(to, kind="stable")].tolist()


def plan_cuts(places: np.ndarray, penalty: np.ndarray, width: int) -> list[int]:
    """Places (the last one always) at which windows end.  ``places`` rise, the first is above 0
    and no two neighbours (0 included) are further apart than ``width``."""
    pos, pen = [0, *places.tolist()], [0.0, *penalty.tolist()]
    ends, backs = _unpadded(np.concatenate(([0], places)), [1 << k for k in range(width.bit_length())])
    f, back = [0.0] * len(pos), [0] * len(pos)
    queue = deque([0])                                    # f(i) + pos(i) rises from head to tail
    for j in range(1, len(pos)):
        p = pos[j]
        while p - pos[queue[0]] > width:
            queue.popleft()
        best = queue[0]
        cost = f[best] + width - (p - pos[best])
        for i in backs[ends[j - 1]:ends[j]]:
            if f[i] < cost:
                cost, best = f[i], i
        f[j], back[j] = cost + pen[j] + PER_WINDOW, best
        g = f[j] + p
        while queue and f[queue[-1]] + pos[queue[-1]] >= g:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(pos) - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def _places(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, width: int, gap: int, last_is_doc_end: bool):
    """Candidate places up to ``total`` and their penalties."""
    keep = np.zeros(len(sentence_ends), bool)
    if len(sentence_ends):                                # one per run of ``gap`` tokens
        keep[np.concatenate(([True], np.diff(sentence_ends // gap) > 0))] = True
    pos = np.union1d(doc_ends, sentence_ends[keep])
    pos = np.union1d(pos, [total])
    step = np.diff(np.concatenate(([0], pos)))
    wide = np.flatnonzero(step > width)                   # no place within a window: cut anywhere
    forced = [np.arange((pos[w - 1] if w else 0) + width, pos[w], width) for w in wide]
    forced = np.concatenate(forced) if forced else np.zeros(0, np.int64)
    pos = np.union1d(pos, forced)
    pen = np.full(len(pos), IN_DOCUMENT)
    pen[np.isin(pos, forced)] = IN_SENTENCE
    pen[np.isin(pos, doc_ends)] = 0.0
    if not last_is_doc_end:
        pen[-1] = 0.0                                     # not a cut: planned again
    return pos, pen


class Packer:
    """Packs one partition's documents; ``add`` and ``close`` return finished pieces."""

    def __init__(self, base: int, width: int, sentence_id: np.ndarray, horizon: int, gap: int):
        self.width, self.sentence_id, self.horizon, self.gap = width, sentence_id, horizon, gap
        self.sequence = base
        self.ids: list[np.ndarray] = []                   # open tokens
        self.docs: list[list] = []                        # [doc_id, ids done before, open ids, all ids]
        self.open = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        out, done = [], 0
        while True:
            take = min(len(ids) - done, self.horizon - self.open)
            if take == 0:
                out += self._pack(False)
                continue
            if done and self.docs:                        # rest of a document begun before
                self.docs[-1][2] += take
            else:
                self.docs.append([doc_id, 0, take, len(ids)])
            self.ids.append(ids[done:done + take])
            self.open += take
            done += take
            if done == len(ids):
                return out

    def close(self) -> list[tuple]:
        return self._pack(True) if self.open else []

    def _pack(self, last: bool) -> list[tuple]:
        ids = np.concatenate(self.ids)
        total = len(ids)
        lengths = np.array([d[2] for d in self.docs], np.int64)
        ends = np.cumsum(lengths)
        whole = self.docs[-1][1] + self.docs[-1][2] == self.docs[-1][3]
        marks = np.flatnonzero(self.sentence_id[ids]) + 1
        pos, pen = _places(total, ends if whole else ends[:-1], marks, self.width, self.gap, whole)
        cuts = np.array(plan_cuts(pos, pen, self.width), np.int64)
        if not last:
            cuts = cuts[cuts <= total - 2 * self.width]
        if not len(cuts):
            raise ValueError("the horizon must hold several windows")
        stop = int(cuts[-1])
        edges = np.union1d(np.concatenate(([0], cuts)), ends[ends < stop])
        lo, hi = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, lo, side="right")
        window = np.searchsorted(cuts, lo, side="right")
        window_start = np.concatenate(([0], cuts))[window]
        doc_start = ends[doc] - lengths[doc]
        out = []
        for a, b, d, w, ws, ds in zip(lo.tolist(), hi.tolist(), doc.tolist(), window.tolist(),
                                      window_start.tolist(), doc_start.tolist(), strict=True):
            doc_id, before, _, size = self.docs[d]
            raw = ids[a:b].tobytes()
            out.append((doc_id, before + a - ds, b - a, zlib.crc32(raw), size, self.sequence + w, a - ws, raw))
        self.sequence += len(cuts)
        left = [[i, before + max(0, stop - (e - n)), int(min(n, e - stop)), size]
                for (i, before, n, size), e in zip(self.docs, ends.tolist(), strict=True) if e > stop]
        self.docs, self.ids, self.open = left, [ids[stop:]] if stop < total else [], total - stop
        return out


def pack(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
         width: int = 2048, end_id: int = 1, horizon_windows: int = 128, sentence_gap: int = 16,
         with_ids: bool = True, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start (ids of the document before it), length,
    ids_crc32, doc_tokens, sequence_id, offset (place in the sequence), and ids (little-endian
    unsigned 32-bit) if ``with_ids``.

    A document is its ids by ``vocabulary`` (a rank file) and ``end_id``; a null or empty text is
    ``end_id`` alone.  Each occurrence of an ``added`` token (content -> id) in a text is that one id.  Texts of any length are taken whole; every id lies in exactly one piece.
    Repeated rows are packed each by itself; null ids stay null; an empty table gives no rows.
    Sequence ids are unique, not dense: the input partition is in their upper half.
    """

    extra = added or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = token_bytes(vocabulary)
        ends = np.zeros(max(len(tokens) - 1, end_id, *extra.values()) + 1, bool)
        ends[:len(tokens)] = [any(c in b".!?\n" for c in t) for t in tokens]
        packer = Packer(TaskContext.get().partitionId() << 32, width, ends, horizon_windows * width, sentence_gap)
        tail = np.array([end_id], "<u4").tobytes()

        def frame(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            out = dict(zip("doc_id start length ids_crc32 doc_tokens sequence_id offset ids".split(), cols, strict=True))
            out["doc_id"] = pd.array(out["doc_id"], dtype="Int64")
            if not with_ids:
                out["ids"] = [None] * len(rows)
            return pd.DataFrame(out)

        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                ids = np.frombuffer(packed_ids_with_added(t or "", vocabulary, pattern, extra) + tail, "<u4")
                rows += packer.add(None if pd.isna(i) else int(i), ids)
            yield frame(rows)
        yield frame(packer.close())

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = src.mapInPandas(run, SCHEMA)
    return out if with_ids else out.drop("ids")


def default_vocabulary() -> str:
    return rank_path("byte_bpe_50k.tiktoken")


def default_added() -> dict[str, int]:
    return added_tokens(rank_path("byte_bpe_50k.json"))
