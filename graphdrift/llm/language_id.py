"""Language identification of mixed-language text.

A word's script narrows the languages it can be in; scores of the word and its letter n-grams under
each language (counts learnt from labelled documents, hashed into tables of a fixed size) rank them;
Viterbi over the words of a text, with a penalty for switching language, labels its spans.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 15
SWITCH = 10.0           # score a change of language costs
FLOOR = -6.0            # no word speaks against a language by more
SHARE = 0.01            # of a language's letters: less in a script, and the script is not the language's

# First code point, one past the last, script (Unicode blocks).
SCRIPTS = [
    (0x0041, 0x0250, "latin"), (0x0370, 0x0400, "greek"), (0x0400, 0x0530, "cyrillic"),
    (0x0531, 0x0590, "armenian"), (0x0590, 0x0600, "hebrew"), (0x0600, 0x0780, "arabic"),
    (0x0900, 0x0980, "devanagari"), (0x0980, 0x0A00, "bengali"), (0x0B80, 0x0C00, "tamil"),
    (0x0E00, 0x0E80, "thai"), (0x10A0, 0x1100, "georgian"), (0x1100, 0x1200, "hangul"),
    (0x1E00, 0x1F00, "latin"), (0x1F00, 0x2000, "greek"), (0x3040, 0x3100, "kana"),
    (0x3400, 0xA000, "han"), (0xAC00, 0xD7B0, "hangul"), (0xF900, 0xFB00, "han"),
    (0x20000, 0x30000, "han"),
]
_STARTS = [s for s, _, _ in SCRIPTS]


def script_of(letter: str) -> str:
    c = ord(letter)
    i = bisect_right(_STARTS, c) - 1
    return SCRIPTS[i][2] if i >= 0 and c < SCRIPTS[i][1] else "other"


def clean_word(token: str) -> str:
    """The letters of a token, lower-cased."""
    w = token.lower()
    return w if w.isalpha() else "".join(filter(str.isalpha, w))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of the words and of their letter pairs and triples, ends marked."""
    marked = [f"^{w}$" for w in words]
    n = np.fromiter(map(len, marked), np.int64, len(marked))
    c = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), n)
    buckets = [np.fromiter((zlib.crc32(m.encode("utf-8", "replace")) % BUCKETS for m in marked), np.int64, len(marked))]
    owners = [np.arange(len(words))]
    for size in (2, 3):
        if len(c) < size:
            continue
        h = np.full(len(c) - size + 1, size, np.uint64)
        for i in range(size):
            h = (h ^ c[i:len(c) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = owner[:len(h)] == owner[size - 1:]
        buckets.append((h[whole] % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[:len(h)][whole])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """``langs`` sorted; ``logp`` (bucket, language); ``scripts``: script -> which languages use it;
    ``prior``: index of the most frequent language.  Its size is languages x BUCKETS."""

    langs: list[str]
    logp: np.ndarray
    scripts: dict[str, np.ndarray]
    prior: int

    def score(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: score per language, letters, whether any language is possible."""
        n = len(self.langs)
        words = [clean_word(t) for t in tokens]
        letters = np.fromiter(map(len, words), np.int64, len(words))
        bucket, owner = word_features(words)
        count = np.bincount(owner, minlength=len(words))[:, None]
        mean = np.column_stack([np.bincount(owner, weights=self.logp[bucket, i], minlength=len(words)) for i in range(n)])
        none = np.zeros(n, bool)
        fits = np.array([self.scripts.get(script_of(w[0]), none) if w else none for w in words]).reshape(len(words), n)
        sure = fits.any(axis=1)
        score = np.where(fits, 3.0 * mean / count, -np.inf)
        score -= np.where(sure, score.max(axis=1), 0.0)[:, None]
        return (np.where(sure[:, None], np.maximum(score, FLOOR), 0.0).astype(np.float32), letters, sure)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_language: int = 4000) -> Model:
    """Counts over the whole texts of about ``docs_per_language`` labelled documents of each
    language, chosen by a hash of the id (the documented bound of the fit); documents that are
    held out, unlabelled or without id are not used."""
    usable = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")) \
                 .filter(F.col("i").isNotNull() & F.col("t").isNotNull() & F.col("lang").isNotNull()
                         & ~held_out(F.col("i")))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    n = len(langs)
    if not n:
        return Model([], np.zeros((BUCKETS, 0), np.float32), {}, 0)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(docs_per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("i")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.filter(draw < share[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                words: Counter = Counter()
                for t in part["t"]:
                    words.update(t.split())
                clean: Counter = Counter()
                for token, times in words.items():
                    if w := clean_word(token):
                        clean[w] += times
                if not clean:
                    continue
                bucket, owner = word_features(list(clean))
                times = np.fromiter(clean.values(), np.int64, len(clean))
                table = np.bincount(bucket, weights=times[owner], minlength=BUCKETS).astype(np.int64)
                at = np.flatnonzero(table)
                yield pd.DataFrame({"lang": lang, "script": None, "bucket": at, "n": table[at]})
                letters: Counter = Counter()
                for w, c in clean.items():
                    letters[script_of(w[0])] += c * len(w)
                yield pd.DataFrame([(lang, s, -1, c) for s, c in letters.items()],
                                   columns=["lang", "script", "bucket", "n"])

    counts = (sample.select("t", "lang").mapInPandas(count, "lang string, script string, bucket int, n long")
              .groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toPandas())
    at = {k: i for i, k in enumerate(langs)}
    table = np.full((BUCKETS, n), 0.5)
    scripts: dict[str, np.ndarray] = {}
    by_script = counts[counts["bucket"] < 0]
    rest = counts[counts["bucket"] >= 0]
    np.add.at(table, (rest["bucket"].to_numpy(int), rest["lang"].map(at).to_numpy(int)), rest["n"].to_numpy(float))
    whole = by_script.groupby("lang")["n"].sum()
    for lang, script, c in zip(by_script["lang"], by_script["script"], by_script["n"], strict=True):
        scripts.setdefault(script, np.zeros(n, bool))[at[lang]] |= c >= SHARE * whole[lang]
    prior = max(range(n), key=lambda i: (sizes[langs[i]], -i))
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32), scripts, prior)


def viterbi(score: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word.  ``score`` (word, language) holds all texts one after another,
    longest first; all texts take their t-th step at once."""
    n, k = score.shape
    stay, came = np.zeros((n, k), bool), np.zeros(n, np.int16)
    best = score[starts].astype(np.float64)
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")    # texts with more than t words
    for t in range(1, longest):
        m = active[t]
        v, at = best[:m], starts[:m] + t
        top = v.argmax(axis=1)
        moved = v[np.arange(m), top][:, None] - switch
        stay[at], came[at] = v >= moved, top
        best[:m] = np.maximum(v, moved) + score[at]
    path = np.zeros(n, np.int16)
    state = best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        path[at] = state[:m]
        if t:
            state[:m] = np.where(stay[at, state[:m]], state[:m], came[at])
    return path


def _solve(texts: list[str], model: Model, table: Words, spans: bool) -> list[tuple]:
    """(lang_pred, score, spans) of non-empty texts, longest (in words) first."""
    lengths = np.array([len(t) for t in texts])
    table.learn({w for t in texts for w in t})
    ids = np.array([table[w] for t in texts for w in t], np.int64)
    starts = np.cumsum(lengths) - lengths
    path = viterbi(table.scores[ids], starts, lengths)
    letters, sure = table.letters[ids], table.sure[ids]
    votes = np.zeros((len(texts), len(model.langs)))
    text_of = np.repeat(np.arange(len(texts)), lengths)
    np.add.at(votes, (text_of, path), np.where(sure, letters, 0))
    votes[:, model.prior] += 1e-9
    all_letters = np.maximum(np.add.reduceat(letters, starts), 1)
    pick = votes.argmax(axis=1)
    score = np.clip(votes[np.arange(len(texts)), pick] / all_letters, 0.0, 1.0)
    out = []
    for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        found = None
        if spans:
            p = path[s:s + n]
            at = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1, [n]))
            found = [{"first_word": int(a), "n_words": int(b - a), "lang": model.langs[p[a]]}
                     for a, b in zip(at[:-1], at[1:], strict=True)]
        out.append((model.langs[pick[i]], float(round(score[i], 6)), found))
    return out


class Words(dict):
    """Row of every distinct word in score tables; emptied between batches once it holds ``limit``."""

    def __init__(self, model: Model, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.scores = np.zeros((0, len(model.langs)), np.float32)
        self.letters, self.sure = np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, words: set[str]) -> None:
        """Scores for those of ``words`` (all of one batch) that are not known yet."""
        if len(self) > self.limit:
            self.clear()
            self.scores, self.letters, self.sure = self.scores[:0], self.letters[:0], self.sure[:0]
        new = sorted(words - self.keys())
        if new:
            got = self.model.score(new)
            self.update(zip(new, range(len(self.letters), len(self.letters) + len(new))))
            self.scores, self.letters, self.sure = (
                np.concatenate(x) for x in zip((self.scores, self.letters, self.sure), got, strict=True))


def _labels(texts: pd.Series, model: Model, table: Words, spans: bool, batch_words: int,
            batch_chars: int = 1 << 20) -> list[tuple]:
    """(lang_pred, score, spans) of any texts, longest first.  At most ``batch_chars`` characters (or one
    text) are split into words at a time and ``batch_words`` words solved at a time, so memory does
    not grow with the number of texts."""
    rows: list[tuple] = [(UNKNOWN, 0.0, None)] * len(texts)
    texts = texts.tolist()
    order = sorted((i for i, t in enumerate(texts) if t and model.langs and any(map(str.isalpha, t))),
                   key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        end, n = at, 0
        while end < len(order) and (end == at or n + len(texts[order[end]]) <= batch_chars):
            n += len(texts[order[end]])
            end += 1
        words = sorted(((i, texts[i].split()) for i in order[at:end]), key=lambda w: -len(w[1]))
        at, lo = end, 0
        while lo < len(words):
            hi, n = lo, 0
            while hi < len(words) and (hi == lo or n + len(words[hi][1]) <= batch_words):
                n += len(words[hi][1])
                hi += 1
            part = words[lo:hi]
            for (i, _), r in zip(part, _solve([w for _, w in part], model, table, spans), strict=True):
                rows[i] = r
            lo = hi
    return rows


SPANS = "array<struct<first_word: int, n_words: int, lang: string>>"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True,
             batch_words: int = 400_000) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (share of the letters that the path gives to
    lang_pred), n_spans, row_key (a hash of id and text) and, with ``spans``, the labelled spans (first word, number of words, lang;
    words are runs of anything but white space).

    A null text, a text without any letter, and every text if nothing was learnt get ``und`` and
    score 0.  A text whose letters are all in scripts no learnt language uses gets the most frequent
    language and score 0.  Ties go to the language first in alphabetical order.  Whole texts of any
    length are read; repeated rows each get a row; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Words(model)
        for b in batches:
            rows = _labels(b["text"], model, table, True, batch_words)
            yield pd.DataFrame({"doc_id": b["doc_id"], "row_key": b["row_key"], "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows],
                                "n_spans": [len(r[2] or ()) for r in rows],
                                "spans": [r[2] if spans else None for r in rows]})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("row_key"),
                      F.col(text_col).alias("text"))
    out = src.mapInPandas(run, f"doc_id long, row_key long, lang_pred string, score double, n_spans int, spans {SPANS}")
    return out if spans else out.drop("spans")


def in_known_language(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.2,
                      batch_words: int = 400_000) -> DataFrame:
    """``docs`` without those labelled ``und`` or with a score below ``min_score`` (most letters in
    scripts that no learnt language uses, or spread over many languages); all columns as they were.
    Judged in one pass over the rows: nothing is joined or shuffled."""

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = Words(model)
        for texts in batches:
            found = _labels(texts, model, table, False, batch_words)
            yield pd.Series([lang != UNKNOWN and score >= min_score for lang, score, _ in found], dtype=bool)

    return docs.filter(known(F.col(text_col)))
