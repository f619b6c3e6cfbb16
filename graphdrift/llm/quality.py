"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight vector over hashed text features; ordered thresholds turn a document's
score s into P(grade <= j) = sigmoid(threshold_j - s).  Weights are fitted by follow-the-regularised-
leader steps with an L1 penalty (most words get weight zero), on ``parts`` shards of a bounded sample whose states
are averaged after every round: each shard gives its non-zero buckets as rows, Spark sums them by bucket, and the
sum (at most one small row per bucket) goes back as one broadcast that is destroyed after its round.  The expected
grade ranks documents, the tail probability selects them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .vocab import Memo

BUCKETS = 1 << 18
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
MARKS = re.compile(r"[^\w\s]{2,}|[|]")


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def _word_bucket(token: str) -> int:
    return _bucket("w:" + (token.lower().strip(EDGE) or token))


def _level(x: float) -> int:
    """A share as one of eight steps, finer near zero."""
    return int(np.searchsorted((0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7), x, side="right"))


def features(text: str, memo: Memo) -> np.ndarray:
    """Distinct buckets of the words of a text and of its shape."""
    words = text.split()
    got = {memo[w] for w in set(words)}
    n = max(len(text), 1)
    upper = sum(map(str.isupper, words)) / max(len(words), 1)
    shape = {"upper": upper, "digit": len(re.findall(r"\d", text)) / n, "bang": text.count("!") / n,
             "bar": text.count("|") / n, "line": text.count("\n") / n, "url": text.count("http") / max(len(words), 1),
             "alike": 1.0 - len(set(words)) / max(len(words), 1)}
    got |= {_bucket(f"s:{k}:{_level(v)}") for k, v in shape.items()}
    marks = Counter(MARKS.findall(text))                   # runs of punctuation, by how common they are
    got |= {_bucket(f"m:{m[:4]}:{_level(c / max(len(words), 1))}") for m, c in marks.items()}
    got.add(_bucket(f"s:words:{len(words).bit_length()}"))
    return np.fromiter(sorted(got), np.int64, len(got))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by bucket and rising thresholds; grades are 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: float) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - score, -40, 40)))


class _Ftrl:
    """State of the fit: per bucket z and n, thresholds as the first and log steps."""

    def __init__(self, z: np.ndarray, n: np.ndarray, cuts: np.ndarray, alpha: float, l1: float, l2: float):
        self.z, self.n, self.cuts, self.alpha, self.l1, self.l2 = z, n, cuts, alpha, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0,
                        -(z - np.sign(z) * self.l1) / ((1.0 + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def thresholds(self) -> np.ndarray:
        return np.cumsum(np.concatenate((self.cuts[:1], np.exp(self.cuts[1:]))))

    def step(self, at: np.ndarray, grade: int, rate: float) -> None:
        w, theta = self.weights(at), self.thresholds()
        below = 1.0 / (1.0 + np.exp(np.clip(w.sum() - theta, -40, 40)))       # P(grade <= j)
        lo, hi = (below[grade - 1] if grade else 0.0), (below[grade] if grade < len(theta) else 1.0)
        g = 1.0 - lo - hi                                   # d(-log p) / d score
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        p = max(hi - lo, 1e-9)
        slope = np.zeros(len(theta))
        if grade < len(theta):
            slope[grade] -= hi * (1.0 - hi) / p
        if grade:
            slope[grade - 1] += lo * (1.0 - lo) / p
        by_cut = np.cumsum(slope[::-1])[::-1]
        by_cut[1:] *= np.exp(self.cuts[1:])
        self.cuts -= rate * np.clip(by_cut, -5.0, 5.0)


def train(rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", grades: int = 3,
          max_rows: int = 20_000, parts: int = 8, rounds: int = 8, alpha: float = 0.5, l1: float = 2.0,
          l2: float = 1.0) -> OrdinalModel:
    """Fit on about ``max_rows`` rated rows chosen by a hash of the id (the documented bound of the
    sample; the texts are whole).  Rows without id, text or a grade in 0 .. grades - 1 are left out."""
    rows = rated.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(grade_col).cast("int").alias("g"))
    rows = rows.filter(F.col("i").isNotNull() & F.col("t").isNotNull() & F.col("g").between(0, grades - 1))
    size = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("i")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("i")), F.lit(parts)).cast("int")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(_word_bucket)
        for b in batches:
            yield pd.DataFrame({"part": b["part"], "i": b["i"], "g": b["g"],
                                "at": [features(t, memo).astype("<i4").tobytes() for t in b["t"]]})

    sample = staged(rows.filter(draw < max_rows / max(size, 1)).select(part.alias("part"), F.xxhash64("i").alias("i"),
                                                                     "g", "t")
                    .mapInPandas(extract, "part int, i long, g int, at binary"), "quality-sample")
    cuts = np.concatenate(([-3.0], np.zeros(grades - 2)))
    state = (np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.float32), cuts)
    context = rated.sparkSession.sparkContext

    def one_round(sent, r: int) -> pa.Table:
        def fit(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values(["i", "g"])
            m = _Ftrl(*_dense(sent.value), alpha, l1, l2)
            order = np.random.Generator(np.random.PCG64(r)).permutation(len(f))
            at = [np.frombuffer(x, "<i4") for x in f["at"]]
            grade = f["g"].to_numpy()
            for j in order.tolist():
                m.step(at[j], int(grade[j]), 0.05 / (1 + r))
            return _rows(m, len(f))

        return (sample.groupBy("part").applyInPandas(fit, "bucket int, z long, n long")
                .groupBy("bucket").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toArrow())

    for r in range(rounds):
        sent = context.broadcast(state)
        got = _state(one_round(sent, r), grades - 1)
        sent.destroy()
        if got is None:
            break
        state = got
    m = _Ftrl(*_dense(state), alpha, l1, l2)
    return OrdinalModel(m.weights(slice(None)).astype(np.float32), m.thresholds())


UNIT = float(1 << 24)                   # shards are summed in whole 2^-24, so their order does not matter


def _dense(state: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, n, cuts) of a state (buckets, z, n, cuts) with one entry per bucket."""
    at, z, n, cuts = state
    out = np.zeros(BUCKETS), np.zeros(BUCKETS), cuts.copy()
    out[0][at], out[1][at] = z, n
    return out


def _rows(m: _Ftrl, size: int) -> pd.DataFrame:
    """A shard's non-zero buckets times its size; behind them its cuts, and the size itself (bucket -1)."""
    at = np.flatnonzero(m.n)
    whole = lambda x: np.rint(np.asarray(x) * (size * UNIT)).astype(np.int64)
    k = len(m.cuts)
    return pd.DataFrame({"bucket": np.concatenate((at, BUCKETS + np.arange(k), [-1])).astype(np.int32),
                         "z": np.concatenate((whole(m.z[at]), whole(m.cuts), [size])),
                         "n": np.concatenate((whole(m.n[at]), np.zeros(k + 1, np.int64)))})


def _state(summed: pa.Table, cuts: int) -> tuple | None:
    """The mean state of summed shard rows (None if there are none), by rising bucket."""
    bucket, z, n = (summed.column(c).to_numpy() for c in ("bucket", "z", "n"))
    if not len(bucket):
        return None
    order = np.argsort(bucket)
    bucket, z, n = bucket[order], z[order], n[order]
    total = float(z[0]) * UNIT                               # bucket -1 comes first, the cuts last
    body = slice(1, len(bucket) - cuts)
    return (bucket[body].astype(np.int32), (z[body] / total).astype(np.float32), (n[body] / total).astype(np.float32),
            z[len(bucket) - cuts:] / total)


def grade(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text",
          target: int = 2, select_at: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_grade, p_at_least (one probability per grade above 0),
    p_tail (probability of grade ``target`` or better) and kept (p_tail >= ``select_at``).

    A null or empty text has grade 0 for certain and is not kept.  Whole texts of any length are
    read; repeated rows each get a row; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, w = Memo(_word_bucket), model.weights
        for b in batches:
            tails = [model.at_least(float(w[features(t, memo)].sum(dtype=np.float64))) if t and t.strip()
                     else np.zeros(len(model.thresholds)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "expected_grade": [float(p.sum()) for p in tails],
                                "p_at_least": [p.tolist() for p in tails],
                                "p_tail": [float(p[target - 1]) for p in tails],
                                "kept": [bool(p[target - 1] >= select_at) for p in tails]})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, "doc_id long, expected_grade double, p_at_least array<double>, p_tail double, "
                                "kept boolean")


def graded_labels(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 of low quality, 2 good."""
    return labels.filter("quality is not null and toxic is not null").select(
        "doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))
