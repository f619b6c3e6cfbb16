"""Removal of long byte strings that occur more than once, by a sparse suffix sort.

Every string of ``length`` bytes is anchored at the least hashed gram (``length // 2`` bytes) it holds, so
equal strings have their anchors at the same place, and about one byte in a hundred is an anchor.
Grams met only once are dropped (an exchange of gram hashes decides).  Around each anchor that is
left, the suffix from it and the reversed bytes before it are sorted with all others of the same gram
by deep-shallow sorting: multikey quicksort down to a shallow depth, blind tries for the groups that
share a longer prefix.  Sorted order and common prefixes give, from the bytes themselves, how far
right and left each anchor's surroundings occur elsewhere in a string of at least ``length`` bytes.

Equal surroundings (told by a 64-bit hash beside the gram's) are combined before the sort, and a
gram all of whose surroundings are alike needs none.  A gram with more than ``group_rows`` different
surroundings is dealt out as pairs of chunks, which lose no pair of strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import key_exchange as X
from .common import NO_ID, compressed, free_name, keyed, plain, shuffle_count, staged
from .deep_shallow import deep_shallow_sort

CHUNK_BYTES = 16 << 20
SEGMENT = 1 << 20                        # bytes of one text hashed at a time; places fit in 24 bits
PLACE = np.uint64((1 << 24) - 1)
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class Anchors:
    """Places and hashes of the anchor grams of a text."""

    def __init__(self, length: int):
        self.length, self.gram = length, length // 2
        self.window = length - self.gram + 1
        n = SEGMENT + length + 1
        rng = np.random.Generator(np.random.PCG64(20_001))
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)
        powers, back = np.full(n, FACTOR, np.uint64), np.full(n, INVERSE, np.uint64)
        powers[0] = back[0] = 1
        self.powers, self.back = np.cumprod(powers), np.cumprod(back)

    def _segment(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k, w = len(b), self.gram, self.window
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.table[b] * self.powers[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * self.back[:n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        m = len(h)
        rank = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        rank[:m] = (h & ~PLACE) | np.arange(m, dtype=np.uint64)
        block = rank.reshape(-1, w)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:m - w + 1], ahead[w - 1:m]) & PLACE
        place = least[np.concatenate(([True], least[1:] != least[:-1]))].astype(np.int64)
        return place, h[place]

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(raw) < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        b, parts = np.frombuffer(raw, np.uint8), []
        for at in range(0, len(b) - self.length + 1, SEGMENT):
            place, h = self._segment(b[at:at + SEGMENT + self.length - 1])
            parts.append((place + at, h))
        place, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = np.concatenate(([True], place[1:] != place[:-1]))
        return place[keep], h[keep]


def _byte_runs(batches: Iterator[pd.DataFrame], limit: int = CHUNK_BYTES) -> Iterator[list[tuple[int, int, bytes]]]:
    held, size = [], 0
    for b in batches:
        for d, k, t in zip(b["_d"], b["_k"], b["text"], strict=True):
            raw = t.encode("utf-8", "replace")
            held.append((d, k, raw))
            size += len(raw)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


#: What a shard says of the surroundings of an anchor: met more than once; others of its gram differ;
#: this is the one whose bytes stand for all that are alike.
TWICE, SEVERAL, FIRST = 1, 2, 4
ANCHORS = "_d long, _k long, sure binary, places binary, grams binary, kinds binary, codes binary, parts binary"


def repeated_anchors(rows: DataFrame, length: int, group_rows: int) -> DataFrame:
    """One row per text with a repeated gram: ``sure``, spans (begin, end) of the bytes around
    anchors whose whole surroundings are met twice; and the anchors to be sorted, those whose gram has
    several surroundings: place, gram, surroundings, code, and into how many chunks the gram's
    surroundings are dealt."""
    shards = 4 * shuffle_count(rows.sparkSession)
    reach = length - length // 2

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors, base = Anchors(length), TaskContext.get().partitionId() << 32
        for i, run in enumerate(_byte_runs(batches)):
            got = [anchors(raw) for _, _, raw in run]
            place, h = (np.concatenate(x) for x in zip(*got, strict=True))
            around = np.array([xxhash.xxh3_64_intdigest(raw[max(0, p - reach):p + length], min(p, reach))
                               for (_, _, raw), (at, _) in zip(run, got, strict=True) for p in at.tolist()], np.uint64)
            d, k, size = (np.array(x, np.int64) for x in zip(*[(r[0], r[1], len(r[2])) for r in run], strict=True))
            entry, heads = X.sorted_keys(h, around, shards)
            count = np.bincount(entry, minlength=len(heads))
            packet = X.pack_arrays(d, k, size, X.narrow(np.array([len(g[0]) for g in got])), X.squeezed(place),
                                   X.narrow(entry))
            chunk = base + i
            yield pd.DataFrame([(chunk, 0, -1, packet), *X.key_rows(chunk, h[heads], around[heads], count, shards)],
                               columns=["chunk", "kind", "shard", "payload"])

    def decide(gram: np.ndarray, kind: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        new_gram = np.concatenate(([True], gram[1:] != gram[:-1]))
        new_kind = new_gram | np.concatenate(([True], kind[1:] != kind[:-1]))
        which_gram, which_kind = np.cumsum(new_gram) - 1, np.cumsum(new_kind) - 1
        kinds = np.bincount(which_gram, weights=new_kind).astype(np.int64)[which_gram]
        times = np.bincount(which_kind, weights=count)[which_kind]
        code = TWICE * (times > 1) + SEVERAL * (kinds > 1) + FIRST * new_kind
        told = (times > 1) | (kinds > 1)
        parts = -(-kinds // group_rows)
        return told, [gram[told], kind[told], code[told].astype(np.uint8), parts[told].astype("<u4")]

    def finish(packet: bytes, entries: np.ndarray, answers: list[np.ndarray]) -> pd.DataFrame:
        d, k, size, per_text, place, entry = X.unpack_arrays(packet)
        entry = entry.astype(np.int64)
        row = np.full(int(entry.max(initial=-1)) + 1, -1)
        row[entries] = np.arange(len(entries))
        row = row[entry]                                # of every anchor, -1 if not answered
        text, place = np.repeat(np.arange(len(d)), per_text), X.unsqueezed(place)
        met, at = np.unique(row, return_index=True)     # first anchor of each entry
        first = np.zeros(len(row), bool)
        first[at[met >= 0]] = True
        text, place, first, row = (x[row >= 0] for x in (text, place, first, row))
        gram, kind, code, parts = (x[row] for x in answers) if len(row) else [np.zeros(0, "<u8")] * 4
        code = np.where(first, code, code.astype(np.uint8) & ~np.uint8(FIRST)).astype(np.uint8)
        begin, end = np.maximum(place - reach, 0), np.minimum(place + length, size[text])
        sure = (code & TWICE > 0) & (end - begin >= length)
        sort = (code & SEVERAL > 0) & ((code & FIRST > 0) | (code & TWICE == 0))
        which = np.unique(text)

        def cut(x: np.ndarray, of: np.ndarray, kind_: str) -> list[bytes]:
            ends = np.searchsorted(of, which, side="right")
            return [x[a:z].astype(kind_).tobytes() for a, z in zip(np.append(0, ends[:-1]), ends, strict=True)] \
                if len(which) else []

        return pd.DataFrame({"_d": d[which], "_k": k[which],
                             "sure": cut(np.stack((begin, end), axis=1)[sure], text[sure], "<u4"),
                             "places": cut(place[sort], text[sort], "<u4"), "grams": cut(gram[sort], text[sort], "<u8"),
                             "kinds": cut(kind[sort], text[sort], "<u8"), "codes": cut(code[sort], text[sort], "u1"),
                             "parts": cut(parts[sort], text[sort], "<u4")})

    found = X.exchange(rows.mapInPandas(find, X.SCHEMA), decide, finish, ANCHORS)
    # repeated rows: the first one read stands for surroundings, and so has the most of them
    most = F.max(F.struct(F.octet_length("codes").alias("n"), "codes", "sure", "places", "grams", "kinds", "parts"))
    return found.groupBy("_d", "_k").agg(most.alias("m")).select("_d", "_k", "m.sure", "m.places", "m.grams", "m.kinds",
                                                                 "m.codes", "m.parts")


def reaches(left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For different surroundings of one gram (``left`` reversed, ``right`` from the anchor on): how
    far left and right of the anchor the strings of ``length`` bytes reach that occur in another of
    them too; (-1, -1) if there is none.

    ``right`` is sorted and cut into the intervals of its common-prefix tree.  Members of an
    interval of depth d share d bytes to the right; those whose nearest neighbour in the order of
    ``left`` shares at least length - d bytes are in a repeated string.
    """
    m = len(left)
    far_left, far_right = np.full(m, -1), np.full(m, -1)
    if m < 2:
        return far_left, far_right
    by_right, lcp_right = deep_shallow_sort(right)
    by_left, lcp_left = deep_shallow_sort(left)
    lcp_left = np.append(lcp_left, 0)                    # a bound behind the last pair of neighbours
    rank = np.empty(m, np.int64)
    rank[by_left] = np.arange(m)
    most_left = max(map(len, left))

    def interval(lo: int, hi: int, depth: int) -> None:
        if depth + most_left < length:
            return
        at = np.sort(rank[by_right[lo:hi]])
        shared = np.minimum.reduceat(lcp_left, np.stack((at[:-1] + 1, at[1:] + 1)).T.ravel())[::2]
        best = np.maximum(np.append(shared, 0), np.insert(shared, 0, 0))
        ok = best + depth >= length
        who = by_left[at[ok]]
        far_left[who] = np.maximum(far_left[who], best[ok])
        far_right[who] = np.maximum(far_right[who], depth)

    stack = [(0, 0)]                                     # (depth, first member) of the open intervals
    for i in range(1, m + 1):
        depth, lo = (int(lcp_right[i]) if i < m else -1), i - 1
        while stack and stack[-1][0] > depth:
            d, lo = stack.pop()
            if d:
                interval(lo, i, d)
        if not stack or stack[-1][0] < depth:
            stack.append((depth, lo))
    return far_left, far_right


def repeated_spans(rows: DataFrame, length: int, group_rows: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with compressed texts, and (_d, _k, spans): packed pairs of 32-bit numbers, begin and
    end of repeated bytes."""
    n = shuffle_count(rows.sparkSession)
    reach = length - length // 2
    anchors = staged(repeated_anchors(rows.select("_d", "_k", "text"), length, group_rows), "suffix-anchors")
    texts = compressed(rows)

    def surround(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, k, z, places, grams, kinds, codes, parts in b.itertuples(index=False):
                raw, at = plain(z), np.frombuffer(places, "<u4").astype(np.int64)
                kind, parts = np.frombuffer(kinds, "<u8"), np.frombuffer(parts, "<u4").astype(np.int64)
                f = pd.DataFrame({"gram": np.frombuffer(grams, "<i8"), "kind": kind.view(np.int64), "place": at})
                f["_d"], f["_k"] = d, k
                f["twice"] = (np.frombuffer(codes, np.uint8) & TWICE) > 0
                f["around"] = [raw[max(0, p - reach):p + length] for p in at.tolist()]
                mine = (kind % parts.astype(np.uint64)).astype(np.int64)
                every = [[min(j, m) * c + max(j, m) for j in range(c)]
                         for m, c in zip(mine.tolist(), parts.tolist(), strict=True)]
                f["part"] = every
                yield f.explode("part")

    schema = "gram long, kind long, place long, _d long, _k long, twice boolean, around binary, part long"
    wanted = anchors.filter(F.octet_length("places") > 0)
    met = texts.select("_d", "_k", "z").join(wanted, ["_d", "_k"]).select(
        "_d", "_k", "z", "places", "grams", "kinds", "codes", "parts").mapInPandas(surround, schema)

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        f = f[~f["kind"].duplicated()]                  # a chunk's own share of a group comes in every pair
        place = f["place"].to_numpy()
        before = np.minimum(place, reach).tolist()
        left = [a[:n][::-1] for a, n in zip(f["around"], before, strict=True)]
        right = [a[n:] for a, n in zip(f["around"], before, strict=True)]
        l, r = reaches(left, right, length)
        ok = (l >= 0) & ~f["twice"].to_numpy(bool)
        pairs = np.stack((place - l, place + r), axis=1)[ok].astype("<u4")
        return pd.DataFrame({"_d": f["_d"].to_numpy()[ok], "_k": f["_k"].to_numpy()[ok],
                             "span": [p.tobytes() for p in pairs]})

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            f = pd.concat([*held, b], ignore_index=True) if held else b.reset_index(drop=True)
            key = f[["gram", "part"]].to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            out = [solve(f.iloc[a:z]) for a, z in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True)]
            held = [f.iloc[heads[-1]:]]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield solve(held[0])

    solved = (met.repartition(n, "gram", "part").sortWithinPartitions("gram", "part")
              .mapInPandas(groups, "_d long, _k long, span binary"))
    sure = anchors.filter(F.octet_length("sure") > 0).select("_d", "_k", F.col("sure").alias("span"))
    return texts, solved.unionByName(sure).groupBy("_d", "_k").agg(F.collect_list("span").alias("spans"))


def _spans(packed: list[bytes] | None) -> list[list[int]]:
    """Maximal runs (begin, end) of the packed, possibly overlapping spans."""
    runs: list[list[int]] = []
    if packed is not None and len(packed):
        pairs = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2)
        for a, z in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], z)
            else:
                runs.append([a, z])
    return runs


def _without(raw: bytes, runs: list[list[int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join([raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   group_rows: int = 4096, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    and, with ``with_text``, the remaining bytes and the removed runs (begin, end).

    Texts are UTF-8 bytes, null as empty.  Removed is each byte covered by a string of ``length``
    bytes that also starts anywhere else, in the same document or another, overlaps included,
    judged on the input; strings do not cross documents.  Texts below ``length`` bytes stay whole.
    Every copy of a repeated row loses the same bytes.  An empty table gives no rows; other columns
    are not read.
    """
    texts, spans = repeated_spans(keyed(docs, id_col, text_col), length, group_rows)
    joined = texts.join(spans, ["_d", "_k"], "left").select("doc_id", "z", "spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, z, s in zip(b["doc_id"], b["z"], b["spans"], strict=True):
                raw, runs = plain(z), _spans(s)
                kept = _without(raw, runs)
                out.append((None if pd.isna(i) else int(i), len(raw), len(raw) - len(kept), len(runs),
                            hashlib.sha256(kept).hexdigest(), kept if with_text else None,
                            [{"begin": x, "end": y} for x, y in runs] if with_text else None))
            f = pd.DataFrame(out, columns="doc_id n_bytes n_removed n_spans kept_sha256 kept removed".split())
            f["doc_id"] = pd.array(f["doc_id"].tolist(), dtype="Int64")
            yield f

    out = joined.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                  "kept binary, removed array<struct<begin: long, end: long>>")
    return out if with_text else out.drop("kept", "removed")


def stripped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
             group_rows: int = 4096) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text and every other column as it was.  Of a
    character that is cut in two what is left goes too; texts that lose nothing stay as they are,
    null included."""
    _, spans = repeated_spans(keyed(docs, id_col, text_col), length, group_rows)
    d, k, s = (free_name(docs, x) for x in ("__d", "__k", "__spans"))
    own = docs.withColumns({d: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), k: F.xxhash64(id_col, text_col)})
    # a table: its size is known before the join, so texts are shuffled only if it is large
    spans = staged(spans.select(F.col("_d").alias(d), F.col("_k").alias(k), F.col("spans").alias(s)), "suffix-spans")
    joined = own.join(spans, [d, k], "left").drop(d, k)
    names = list(docs.columns)
    at = names.index(text_col)

    def cut(batches):
        for b in batches:
            texts, spans_ = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            new = [t if s is None else _without(t.encode("utf-8", "replace"), _spans(s)).decode("utf-8", "ignore")
                   for t, s in zip(texts, spans_, strict=True)]
            cols = b.columns[:-1]
            cols[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(cut, docs.schema)
