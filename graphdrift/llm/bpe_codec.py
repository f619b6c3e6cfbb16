"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts are cut into chunks that overlap by ``overlap`` characters and every chunk is pre-tokenised by
itself, so the chunks of a long text run in parallel.  A chunk may begin inside a pre-token, so its
first boundaries can be wrong; as a match depends only on what follows its start, two chunks agree
for good from the first boundary they share.  Stitching walks the chunks of a text in order, follows
a chunk to the first boundary it shares with the next one, and goes on there.  If two chunks share no
boundary in the overlap (one pre-token longer than it), the text from the last sure boundary on is
pre-tokenised again.  Only then the pieces are encoded.  Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_count
from .vocab import Memo, encoding, rank_path, token_bytes

MARGIN = 8      # a match that ends this near the end of a chunk may depend on what follows
SCHEMA = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded binary")


@lru_cache(maxsize=8)
def _compiled(pattern: str):
    return regex.compile(pattern)


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk that can be relied on, and the end of the last one."""
    out, sure = [0], len(text) if last else len(text) - MARGIN
    for m in _compiled(pattern).finditer(text):
        if m.end() > sure:
            break
        out.append(m.end())
    return out


@lru_cache(maxsize=4)
def _piece(path: str, pattern: str) -> Memo:
    enc, tokens = encoding(path, pattern), token_bytes(path)

    def make(piece: str) -> tuple[bytes, bytes, bytes]:
        ids = enc.encode_ordinary(piece)
        return (",".join(map(str, ids)).encode(), np.array(ids, "<u4").tobytes(), b"".join([tokens[i] for i in ids]))

    return Memo(make, 200_000)


class Writer:
    """Digests of one text's ids and decoded bytes, fed piece by piece."""

    def __init__(self, path: str, pattern: str, keep: bool):
        self.memo, self.keep = _piece(path, pattern), keep
        self.ids, self.raw, self.n = hashlib.sha256(), hashlib.sha256(), 0
        self.out_ids: list[bytes] = []
        self.out_raw: list[bytes] = []

    def add(self, pieces: list[str]) -> None:
        got = [self.memo[p] for p in pieces]
        if not got:
            return
        decimal = b",".join([g[0] for g in got])
        self.ids.update(b"," + decimal if self.n else decimal)
        self.n += decimal.count(b",") + 1
        raw = b"".join([g[2] for g in got])
        self.raw.update(raw)
        if self.keep:
            self.out_ids.append(b"".join([g[1] for g in got]))
            self.out_raw.append(raw)

    def row(self, doc_id) -> tuple:
        kept = (b"".join(self.out_ids), b"".join(self.out_raw)) if self.keep else (None, None)
        return (doc_id, self.n, self.ids.hexdigest(), self.raw.hexdigest(), *kept)


class Stitcher:
    """Takes the chunks of one text in order and hands sure pieces to a Writer."""

    def __init__(self, writer: Writer, pattern: str):
        self.writer, self.pattern = writer, pattern
        self.at = 0                       # up to here all is written
        self.start, self.text = 0, ""     # the chunk followed now
        self.bounds: list[int] = [0]      # its boundaries in the text, from ``at`` on
        self.rejoined = 0                 # chunks joined without a shared boundary

    def _write(self, cuts: list[int]) -> None:
        """Pieces between neighbouring cuts; the first is ``at``."""
        s = self.start
        self.writer.add([self.text[a - s:b - s] for a, b in zip(cuts, cuts[1:])])
        self.at = cuts[-1]

    def chunk(self, start: int, text: str, bounds: list[int], last: bool) -> None:
        there = [start + b for b in bounds]
        if start or self.text:
            known = set(there)
            shared = next((b for b in self.bounds if b in known), None)
            if shared is None:            # go on serially from the last sure boundary
                self.rejoined += 1
                end = self.bounds[-1]
                self._write(self.bounds)
                text = self.text[end - self.start:] + text[self.start + len(self.text) - start:]
                start, there = end, [end + b for b in boundaries(text, self.pattern, last)]
            else:
                self._write([b for b in self.bounds if b <= shared])
                there = [b for b in there if b >= shared]
        self.start, self.text, self.bounds = start, text, there
        if last:
            self._write(there)


def _chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """(start, chunk, whether it is the last); neighbours share ``overlap`` characters."""
    for at in range(0, max(len(text) - overlap, 1), size):
        yield at, text[at:at + size + overlap], at + size + overlap >= len(text)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  chunk_chars: int = 1 << 14, overlap: int = 256, spread_chars: int = 1 << 17,
                  keep: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes), and with ``keep`` the ids (little-endian unsigned
    32-bit) and the decoded bytes.

    Texts of up to ``spread_chars`` characters are cut, stitched and encoded in one task; the chunks
    of longer ones are dealt to all tasks and meet again, in order, by text.  Null and empty texts
    have no tokens; repeated rows each get a row; null ids stay null; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short, long = (rows.filter(F.length("text") <= spread_chars), rows.filter(F.length("text") > spread_chars))
    columns = "doc_id n_tokens ids_sha256 decoded_sha256 ids decoded".split()

    def frame(out):
        f = pd.DataFrame(out, columns=columns)
        f["doc_id"] = pd.array([None if pd.isna(i) else int(i) for i in f["doc_id"]], dtype="Int64")
        return f

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                w = Writer(vocabulary, pattern, keep)
                if t:
                    s = Stitcher(w, pattern)
                    for start, chunk, last in _chunks(t, chunk_chars, overlap):
                        s.chunk(start, chunk, boundaries(chunk, pattern, last), last)
                out.append(w.row(i))
            yield frame(out)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, k, t in zip(b["doc_id"], b["row_key"], b["text"], strict=True):
                part = [(i, k, *c) for c in _chunks(t, chunk_chars, overlap)]
                f = pd.DataFrame(part, columns="doc_id row_key start chunk last".split())
                f["doc_id"] = pd.array([None if pd.isna(i) else int(i)] * len(f), dtype="Int64")
                yield f

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["bounds"] = [np.array(boundaries(t, pattern, last), "<i4").tobytes()
                           for t, last in zip(b["chunk"], b["last"], strict=True)]
            b["doc_id"] = pd.array([None if pd.isna(i) else int(i) for i in b["doc_id"]], dtype="Int64")
            yield b

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = None
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.start == 0:
                    s = Stitcher(Writer(vocabulary, pattern, keep), pattern)
                s.chunk(r.start, r.chunk, np.frombuffer(r.bounds, "<i4").tolist(), r.last)
                if r.last:
                    out.append(s.writer.row(r.doc_id))
            yield frame(out)

    n = shuffle_count(docs.sparkSession)
    parts = "doc_id long, row_key long, start long, chunk string, last boolean"
    spread = (long.select("doc_id", F.monotonically_increasing_id().alias("row_key"), "text").mapInPandas(cut, parts)
              .repartition(n, "row_key", "start").mapInPandas(pretokenise, parts + ", bounds binary")
              .repartition(n, "row_key").sortWithinPartitions("row_key", "start").mapInPandas(stitch, SCHEMA))
    out = short.mapInPandas(whole, SCHEMA).unionByName(spread)
    return out if keep else out.drop("ids", "decoded")


def default_vocabulary() -> str:
    return rank_path("byte_bpe_multi_50k.tiktoken")
