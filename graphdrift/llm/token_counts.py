"""Token counts under a unigram model, by dynamic programming shared over a trie.

The distinct pre-tokens of a task are inserted into a trie.  A node stands for a prefix and holds the
best unigram score of a segmentation of that prefix and its number of tokens; it is computed once, from
its ancestors, when the node is made, so pre-tokens with a common prefix share that work.  The node
a pre-token ends at is terminal and gives its count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import Memo, cut_pieces, rank_path, ranks

CLOSE = 1e-9            # scores this near are equal; then fewer tokens win


def unigram_scores(vocabulary: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probability of every token.  A rank file holds no counts: the r-th most frequent token
    is taken to have a share in proportion to 1 / r (nothing is trained)."""
    whole = math.log(sum(1.0 / (r + 1) for r in vocabulary.values()))
    return {t: -math.log(r + 1) - whole for t, r in vocabulary.items()}


class ScoreTrie:
    """Trie of pre-tokens with the forward score and token count of every prefix.  Holds at most
    about ``limit`` nodes: beyond that it starts anew, which changes no result."""

    def __init__(self, scores: dict[bytes, float], limit: int = 1_000_000):
        self.back: list[dict[int, int]] = [{}]          # tokens read backwards
        self.value: list[float | None] = [None]
        for token, s in scores.items():
            at = 0
            for c in reversed(token):
                nxt = self.back[at].get(c)
                if nxt is None:
                    nxt = self.back[at][c] = len(self.back)
                    self.back.append({})
                    self.value.append(None)
                at = nxt
            self.value[at] = s
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.kids: dict[int, int] = {}                  # node * 256 + byte -> node
        self.score, self.count = [0.0], [0]

    def __call__(self, pre: bytes) -> tuple[int, float]:
        """(tokens, score) of the best segmentation of ``pre``."""
        if len(self.score) > self.limit:
            self._clear()
        kids, score, count, back, value = self.kids, self.score, self.count, self.back, self.value
        path, node = [0], 0
        for i, c in enumerate(pre):
            key = node * 256 + c
            nxt = kids.get(key)
            if nxt is None:
                best, fewest, at, j = -math.inf, 0, 0, i
                while j >= 0:
                    at = back[at].get(pre[j])
                    if at is None:
                        break
                    s = value[at]
                    if s is not None:
                        s += score[path[j]]
                        n = count[path[j]] + 1
                        if s > best + CLOSE or (s > best - CLOSE and n < fewest):
                            best, fewest = s, n
                    j -= 1
                if best == -math.inf:
                    raise ValueError(f"byte {c} is no token")
                nxt = kids[key] = len(score)
                score.append(best)
                count.append(fewest)
            node = nxt
            path.append(node)
        return count[node], score[node]


@lru_cache(maxsize=4)
def _pieces(path: str, pattern: str) -> Memo:
    trie, pre = ScoreTrie(unigram_scores(ranks(path))), regex.compile(pattern)

    def make(piece: str) -> tuple[int, int, float]:
        got = [trie(p.encode("utf-8", "replace")) for p in pre.findall(piece)]
        return len(got), sum(n for n, _ in got), math.fsum(s for _, s in got)

    return Memo(make)


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_pretokens, n_tokens, log_prob (of the best
    segmentation, rounded to 6 places).

    Null and empty texts have no tokens and log_prob 0; whole texts of any length are read; repeated
    rows each get a row; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _pieces(vocabulary, pattern)
        for b in batches:
            out = []
            for t in b["text"]:
                got = [memo[p] for p in cut_pieces(t)]
                out.append((len(t.encode("utf-8", "replace")), sum([g[0] for g in got]), sum([g[1] for g in got]),
                            round(math.fsum([g[2] for g in got]), 6)))
            cols = np.array(out, dtype=object).reshape(len(b), 4).T
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": cols[0].astype(np.int64),
                                "n_pretokens": cols[1].astype(np.int64), "n_tokens": cols[2].astype(np.int64),
                                "log_prob": cols[3].astype(np.float64)})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.mapInPandas(run, "doc_id long, n_bytes long, n_pretokens long, n_tokens long, log_prob double")


def default_vocabulary() -> str:
    return rank_path("byte_bpe_50k.tiktoken")
