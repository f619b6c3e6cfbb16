"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z only) and cut into words (ASCII letters and digits, and everything beyond
ASCII).  The windows of ``size`` words of all benchmark items, and shorter items as one window each, become
a sorted set of 64-bit hashes behind a bitmap.  Documents are scanned where they lie: numpy hashes all
their word windows from the UTF-8 bytes, the bitmap and the set keep the few that may match, and each of
those is verified word for word before it counts.  Nothing is shuffled.

The set is broadcast only while the benchmark holds at most ``max_words`` words (measured first).  A larger
one is never collected: its windows stay a table, and the windows of the documents meet it in a join by
hash, are verified there, and go back to their document by its key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, keyed, staged, text_or_empty

# A-Z to lower case, every other ASCII byte that is no letter or digit to a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32
             for c in range(256))
WORD_CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"                    # of either case
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SLICE = 1 << 20                                   # bytes hashed at a time
FACTOR, NEXT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte, and which folded bytes belong to words."""
    rng = np.random.Generator(np.random.PCG64(77))
    number = rng.integers(1, 1 << 63, 256, np.uint64)
    fold = np.frombuffer(FOLD, np.uint8)
    inside = fold != 32
    return np.where(inside, number[fold], np.uint64(0)), inside


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _stretch(n: int) -> int:
    """``n`` rounded up so that few different power tables are made."""
    return max(SLICE, 1 << (n - 1).bit_length())


def _slices(data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about SLICE bytes that cut no word."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + SLICE, n)
        while end < n and inside[data[end]] and inside[data[end - 1]]:
            rest = np.flatnonzero(~inside[data[end:end + SLICE]])
            end = end + int(rest[0]) if len(rest) else min(end + SLICE, n)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of the words of texts that lie one behind another in ``data``; a new text
    begins at each of ``breaks``, and no word crosses one."""
    number, inside = _tables()
    starts, hashes = [], []
    for lo, hi in _slices(data, inside):
        b = data[lo:hi]
        word = inside[b]
        new = word.copy()
        new[1:] &= ~word[:-1]
        here = breaks[np.searchsorted(breaks, lo):np.searchsorted(breaks, hi)] - lo
        new[here] = word[here]
        at = np.flatnonzero(new)
        if not len(at):
            continue
        up, down = _powers(FACTOR, _stretch(hi - lo))
        total = np.cumsum(number[b] * up[:hi - lo])
        before = np.where(at > 0, total[at - 1], np.uint64(0))
        ends = np.append(total[at[1:] - 1], total[-1])
        starts.append(at + lo)
        hashes.append(_mixed((ends - before) * down[at]))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by its first one."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(NEXT, _stretch(n + 1))
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(words * up[:n], out=total[1:])
    return _mixed((total[size:] - total[:-size]) * down[:n - size + 1] + np.uint64(size))


def fold_words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class WindowSet:
    """The windows of a bounded benchmark: sorted hashes, which items hold each, and the items' words."""

    def __init__(self, items: list, texts: list[bytes], size: int):
        self.size, self.items, self.texts = size, items, [b" ".join(fold_words(t)) for t in texts]
        hashes, item, first, length = [], [], [], []
        for i, text in enumerate(self.texts):
            if not text:
                continue
            words = word_hashes(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))[1]
            n = min(size, len(words))
            h = window_hashes(words, n)
            hashes.append(h)
            item.append(np.full(len(h), i, np.int32))
            first.append(np.arange(len(h), dtype=np.int32))
            length.append(np.full(len(h), n, np.int16))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        h = join(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.item, self.first, self.length = (
            x[order] for x in (h, join(item, np.int32), join(first, np.int32), join(length, np.int16)))
        self.sizes = sorted({int(x) for x in np.unique(self.length)})
        self.bits = max(16, 3 + int(len(h)).bit_length())
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self._cell(self.hashes)] = True
        self.known: dict[bytes, tuple] = {}

    def _cell(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Which windows may be in the set (their places)."""
        at = np.flatnonzero(self.bitmap[self._cell(h)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[place] == h[at]]

    def holders(self, window: list[bytes], h: np.uint64) -> tuple:
        """Items with exactly this window, none if only its hash is in the set."""
        text = b" ".join(window)
        if text not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            lo, hi = np.searchsorted(self.hashes, [h], "left")[0], np.searchsorted(self.hashes, [h], "right")[0]
            n = len(window)
            self.known[text] = tuple(sorted({int(i) for i, f, k in zip(self.item[lo:hi], self.first[lo:hi],
                                                                      self.length[lo:hi], strict=True)
                                             if k == n and self.texts[i].split(b" ")[f:f + n] == window}))
        return self.known[text]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of true entries."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _scan(raws: list[bytes], windows: WindowSet) -> Iterator[tuple]:
    """(words, hit words, items, byte spans of hit runs of words) of each text, in their order."""
    sizes = np.array([len(r) for r in raws], np.int64)
    breaks = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(raws), np.uint8)
    start, h = word_hashes(data, breaks)
    text_of = np.searchsorted(breaks + sizes, start, side="right")
    lo = np.searchsorted(text_of, np.arange(len(raws)), side="left")
    hi = np.searchsorted(text_of, np.arange(len(raws)), side="right")
    found: dict[int, list] = {}
    for n in windows.sizes:
        w = window_hashes(h, n)
        at = windows.maybe(w)
        for i in at[text_of[at] == text_of[at + n - 1]].tolist():
            found.setdefault(int(text_of[i]), []).append((i, n, w[i]))
    for t, raw in enumerate(raws):
        n_words = int(hi[t] - lo[t])
        if t not in found:
            yield n_words, 0, [], []
            continue
        words, first = fold_words(raw), int(lo[t])
        hit, items = np.zeros(n_words, bool), set()
        for i, n, code in found[t]:
            got = windows.holders(words[i - first:i - first + n], code)
            if got:
                hit[i - first:i - first + n] = True
                items.update(got)
        runs = _runs(hit)
        begin = start[lo[t]:hi[t]] - breaks[t]
        spans = [(int(begin[a]), int(begin[z - 1]) + len(words[z - 1])) for a, z in runs]
        yield n_words, int(hit.sum()), [windows.items[i] for i in sorted(items)], spans


def _blocks(raws: list[bytes], limit: int) -> Iterator[list[bytes]]:
    held, size = [], 0
    for r in raws:
        held.append(r)
        size += len(r)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, text) of the items that have words; equal rows once."""
    return (benchmark.select(F.col(item_col).cast("string").alias("item"), text_or_empty(F.col(text_col)).alias("text"))
            .distinct().filter(F.col("text").rlike(WORD_CHAR)))


def window_set(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = 10,
               max_words: int = 2_000_000) -> WindowSet | None:
    """The set to broadcast, or None if the benchmark holds more than ``max_words`` words (then nothing
    of it is collected)."""
    items = staged(_items(benchmark, item_col, text_col), "benchmark-items")
    total = items.agg(F.sum(F.octet_length("text")), F.sum(F.size(F.split("text", NOT_WORD)))).first()
    if (total[1] or 0) > max_words or (total[0] or 0) > 16 * max_words:
        return None
    held = items.toArrow().sort_by([("item", "ascending"), ("text", "ascending")])
    return WindowSet(held.column("item").to_pylist(), [t.encode() for t in held.column("text").to_pylist()], size)


RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<begin: long, end: long>>"


def find_overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", size: int = 10,
                 max_words: int = 2_000_000, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, row_key (a hash of id and text), n_words, n_hit (words inside any occurrence
    of a window), items (the distinct item ids whose windows occur, as strings, sorted) and spans (begin and
    end byte, in UTF-8, of each maximal run of hit words).

    A null, empty or wordless text has no words and no hits.  Whole texts of any length are read.  Items
    without words match nothing; rows of one item id are one item; windows of an item without id hit words
    but name no item.  Repeated rows each get a row; an empty benchmark hits nothing; an empty table gives no
    rows; other columns are not read.
    """
    windows = window_set(benchmark, item_col, item_text_col, size, max_words)
    if windows is None:
        return _find_by_join(docs, benchmark, id_col, text_col, item_col, item_text_col, size, block_bytes)
    sent = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [t.encode("utf-8", "replace") if t else b"" for t in b.column("text").to_pylist()]
            rows = [r for part in _blocks(raws, block_bytes) for r in _scan(part, sent.value)]
            yield _answer(b.columns[:2], rows)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"),
                      F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"doc_id long, row_key long, {RESULT}")


def _answer(keys: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    names = [sorted({i for i in r[2] if i is not None}) for r in rows]
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array(names, pa.list_(pa.string())),
         pa.array([[{"begin": a, "end": z} for a, z in r[3]] for r in rows], pa.list_(span))],
        names=["doc_id", "row_key", "n_words", "n_hit", "items", "spans"])


def _window_table(items: DataFrame, size: int) -> DataFrame:
    """(h, n, window, item) of all items, distinct."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, text in zip(b["item"], b["text"], strict=True):
                w = fold_words(text.encode())
                n = min(size, len(w))
                h = window_hashes(word_hashes(np.frombuffer(b" ".join(w), np.uint8), np.zeros(1, np.int64))[1], n)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n, "item": item,
                                    "window": [b" ".join(w[i:i + n]) for i in range(len(h))]})

    return items.mapInPandas(cut, "h long, n int, item string, window binary").distinct()


def _find_by_join(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str,
                  item_text_col: str, size: int, block_bytes: int) -> DataFrame:
    """``find_overlap`` for a benchmark of any size: windows of documents and items meet by hash."""
    items = _items(benchmark, item_col, item_text_col)
    table = staged(_window_table(items, size), "benchmark-windows")
    distinct = table.select("h", "n", "window").distinct()
    lengths = sorted(r[0] for r in table.select("n").distinct().collect())          # at most ``size`` numbers
    rows = keyed(docs, id_col, text_col)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, k, t in zip(b["_d"], b["_k"], b["text"], strict=True):
                _, h = word_hashes(np.frombuffer(t.encode("utf-8", "replace"), np.uint8), np.zeros(1, np.int64))
                for n in lengths:
                    w = window_hashes(h, n)
                    for lo in range(0, len(w), 1 << 18):
                        part = w[lo:lo + (1 << 18)]
                        yield pd.DataFrame({"_d": d, "_k": k, "h": part.view(np.int64), "n": n,
                                            "at": np.arange(lo, lo + len(part))})

    # distinct on the right: a window meets one row (a few, if hashes collide), whatever its items
    own = rows.mapInPandas(cut, "_d long, _k long, h long, n int, at long")
    places = (own.join(distinct, ["h", "n"]).groupBy("_d", "_k")
              .agg(F.collect_set(F.struct("at", "n", "window")).alias("places")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], []
            for t, places_ in zip(b.column("text").to_pylist(), b.column("places").to_pylist(), strict=True):
                raw = t.encode("utf-8", "replace")
                start, h = word_hashes(np.frombuffer(raw, np.uint8), np.zeros(1, np.int64))
                hit, words, windows = np.zeros(len(h), bool), fold_words(raw) if places_ else [], set()
                for p in places_ or ():
                    if b" ".join(words[p["at"]:p["at"] + p["n"]]) == p["window"]:
                        hit[p["at"]:p["at"] + p["n"]] = True
                        windows.add(p["window"])
                spans = [(int(start[a]), int(start[z - 1]) + len(words[z - 1])) for a, z in _runs(hit)]
                out.append((len(h), int(hit.sum()), [], spans))
                held.append(sorted(windows))
            told = _answer(b.columns[:2], out)
            yield pa.RecordBatch.from_arrays([*told.columns, b.column("_d"), pa.array(held, pa.list_(pa.binary()))],
                                             names=[*told.schema.names, "_d", "windows"])

    joined = rows.join(places, ["_d", "_k"], "left").select("doc_id", F.col("_k").alias("row_key"), "text", "places", "_d")
    found = staged(joined.mapInArrow(verify, f"doc_id long, row_key long, {RESULT}, _d long, windows array<binary>"),
                   "benchmark-hits")
    named = (found.select("_d", "row_key", F.explode("windows").alias("window")).distinct()
             .join(table.select("window", "item"), "window").filter("item is not null").select("_d", "row_key", "item")
             .distinct().groupBy("_d", "row_key").agg(F.sort_array(F.collect_list("item")).alias("items")))
    return (found.drop("items").join(named, ["_d", "row_key"], "left")
            .select("doc_id", "row_key", "n_words", "n_hit",
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id",
                   text_col: str = "text", **how) -> DataFrame:
    """``docs``, all columns as they were, without the documents that hold a window (``remove="documents"``), or with
    the runs of hit words cut out of their texts (``remove="spans"``; a character in the way stays whole).
    Documents without a hit stay as they are, null texts included."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove}")
    hit = find_overlap(docs, benchmark, id_col, text_col, **how).filter("n_hit > 0")
    names = [f"c{i}" for i in range(len(docs.columns))]                  # by place: any column names may be there
    here = docs.toDF(*names)
    at = dict(zip(docs.columns, names, strict=True))
    i, t = F.col(at[id_col]), F.col(at[text_col])
    # a written table: its size is known before the join, so texts are shuffled only if it is large
    gone = staged(hit.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.col("row_key").alias("_k"), "spans")
                  .dropDuplicates(["_d", "_k"]), "benchmark-gone")
    own = here.withColumns({"_d": F.coalesce(i.cast("long"), F.lit(NO_ID)), "_k": F.xxhash64(i, t)})
    if remove == "documents":
        return own.join(gone, ["_d", "_k"], "left_anti").select(*names).toDF(*docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, runs in zip(texts, spans, strict=True):
            if runs is not None and len(runs):
                raw, edges = text.encode("utf-8", "replace"), [0]
                for r in runs:
                    edges += [r["begin"], r["end"]]
                edges.append(len(raw))
                text = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "replace")
            out.append(text)
        return pd.Series(out, dtype=object)

    joined = own.join(gone, ["_d", "_k"], "left")
    return joined.withColumn(at[text_col], F.when(F.col("spans").isNull(), t).otherwise(cut(t, "spans"))) \
                 .select(*names).toDF(*docs.columns)
