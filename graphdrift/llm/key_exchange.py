"""Which keys of a chunk of documents occur elsewhere: the exchange behind both substring operators.

A chunk is a bounded run of documents read by one task.  Its distinct keys (sorted by shard and key,
each with one value) travel to the key's shard; a packet with everything else about the chunk travels
beside them, spread evenly.  A shard compares the entries of all chunks and answers those that matter;
the answers meet the chunk's packet again in a second shuffle.  A key that a third of all documents
hold reaches its shard once per chunk, never once per occurrence.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_count

#: chunk, kind (0 packet, 1 keys or their answers), shard, payload
SCHEMA = "chunk long, kind int, shard int, payload binary"


def shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return (a & np.uint64(0xFFFFFFFF)) % np.uint64(shards)


def sorted_keys(a: np.ndarray, b: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each key, first index of each entry): entries are the distinct keys (a, b) in the
    order of (shard, a, b)."""
    order = np.lexsort((b, a, shard_of(a, shards)))
    x, y = a[order], b[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(a) else np.zeros(0, bool)
    entry = np.empty(len(a), np.int64)
    entry[order] = np.cumsum(new) - 1
    return entry, order[new]


def key_rows(chunk: int, a: np.ndarray, b: np.ndarray, value: np.ndarray, shards: int) -> list[tuple]:
    """Rows of a chunk's entries, in their order."""
    shard = shard_of(a, shards).astype(np.int64)
    heads = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(a) else np.zeros(0, np.int64)
    stops = np.append(heads[1:], len(a))
    return [(chunk, 1, int(shard[i]), pack_arrays(a[i:j], b[i:j], narrow(value[i:j])))
            for i, j in zip(heads.tolist(), stops.tolist(), strict=True)]


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type, if none is negative."""
    if len(x) and x.min() >= 0:
        return x.astype(np.min_scalar_type(int(x.max())))
    return x.astype(np.int64)


def exchange(rows: DataFrame, decide: Callable[..., tuple[np.ndarray, list[np.ndarray]]],
             finish: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``decide(a, b, value)``: for a shard's entries sorted by (a, b, chunk), which of them get an
    answer, and the answers as arrays.  ``finish(packet, entries, answers)``: result rows of one
    chunk, given which of its entries were answered and how."""
    n = shuffle_count(rows.sparkSession)
    place = F.when(F.col("kind") == 0, F.xxhash64("chunk")).otherwise(F.xxhash64("shard"))
    asked = (rows.withColumn("place", place).repartition(n, "place")
             .sortWithinPartitions("kind", "shard", "chunk").drop("place"))

    def answer(shard: int, chunks: list[int], held: list[list[np.ndarray]]) -> pd.DataFrame:
        size = [len(h[0]) for h in held]
        a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        value = np.concatenate([h[2].astype(np.int64) for h in held])
        order = np.lexsort((b, a))                      # stable: equal keys stay in the order of chunks
        told, answers = decide(a[order], b[order], value[order])
        at = order[told]
        back = np.argsort(at, kind="stable")
        at, answers = at[back], [x[back] for x in answers]
        ends = np.cumsum(size)
        cuts = np.searchsorted(at, ends)
        out, lo = [], 0
        for i, hi in enumerate(cuts.tolist()):
            own = (at[lo:hi] - (ends[i] - size[i])).astype("<u4")
            out.append(pack_arrays(np.array([size[i]], "<u4"), own, *[x[lo:hi] for x in answers]))
            lo = hi
        return pd.DataFrame({"chunk": chunks, "kind": 1, "shard": shard, "payload": out})

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, chunks, held = -1, [], []
        for b in batches:
            yield b[b["kind"] == 0]
            for r in b[b["kind"] == 1].itertuples(index=False):
                if r.shard != shard and held:
                    yield answer(shard, chunks, held)
                    chunks, held = [], []
                shard = r.shard
                chunks.append(r.chunk)
                held.append(unpack_arrays(r.payload))
        if held:
            yield answer(shard, chunks, held)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packet, told, before = None, [], 0

        def close() -> pd.DataFrame | None:
            if packet is None:
                return None
            entries, *answers = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0, int),)
            return finish(packet, entries, answers)

        for b in batches:
            for r in b.itertuples(index=False):
                if r.kind == 0:
                    if (f := close()) is not None:
                        yield f
                    packet, told, before = r.payload, [], 0
                else:
                    size, own, *answers = unpack_arrays(r.payload)
                    told.append([own.astype(np.int64) + before, *answers])
                    before += int(size[0])
        if (f := close()) is not None:
            yield f

    answered = asked.mapInPandas(resolve, SCHEMA)
    return (answered.repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "shard")
            .mapInPandas(gather, schema))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of any kinds as one value, each under its length and type."""
    out = [np.array([len(arrays)], "<i8").tobytes()]
    for x in arrays:
        out += [np.array([x.nbytes], "<i8").tobytes(), x.dtype.str.encode().ljust(8), x.tobytes()]
    return b"".join(out)


def unpack_arrays(raw: bytes) -> list[np.ndarray]:
    at, out = 8, []
    for _ in range(int(np.frombuffer(raw, "<i8", 1)[0])):
        size = int(np.frombuffer(raw, "<i8", 1, at)[0])
        kind = raw[at + 8:at + 16].strip().decode()
        out.append(np.frombuffer(raw[at + 16:at + 16 + size], kind))
        at += 16 + size
    return out


def squeezed(x: np.ndarray) -> np.ndarray:
    """Slowly rising 32-bit numbers as compressed differences (as bytes)."""
    step = np.diff(x.astype(np.int64), prepend=0).astype("<i4")
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T)
    return np.frombuffer(zlib.compress(planes.tobytes(), 1), np.uint8)


def unsqueezed(x: np.ndarray) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(x.tobytes()), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").reshape(-1).astype(np.int64))
