"""Spelling variants of a corpus's words by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced character turns one into the other.  The shorter
word (of equally long ones, either) contributes two disjoint chunks, its halves; the other one contributes
its positional grams.  One edit preserves one of the halves, and moves it by at most one place:
an edit behind the first half leaves that half where it was, an edit before the second half leaves that
half as far from the end as it was.  So of the positional grams only those within a shift of one of a half's
place are sent, each under the length of the word it would be a half of; an equi-join by (length, half,
characters) loses no near pair, and the remainders of the two words are verified (edit distance one).

Few words share a half.  Where a half is so common that its chunks times grams exceed ``pair_limit``, its rows
are not joined: the remainders are cut in halves again by the same rule, under a longer key, until
every key is rare (a remainder of one character bounds its group by the alphabet).  Nothing is dropped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged
from .vocab import Memo

LETTERS = "A-Za-zÀ-ÿ"
_FOLD = str.maketrans(UPPER, LOWER)
SLICE = 1 << 20                                   # characters cut into words at a time


def _runs(text: str, run: re.Pattern, letter: re.Pattern) -> Iterator[list[str]]:
    """The runs of a text, a slice (that cuts no run) at a time."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text) and letter.match(text, end - 1):
            end = letter.match(text, end - 1).end()
        yield run.findall(text, at, end)
        at = end


def _known(run: str) -> tuple[str, bytes]:
    low = run.lower() if run.isascii() else run.translate(_FOLD)
    return low, low.encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = 97, min_length: int = 5,
                min_count: int = 3, flush: int = 200_000) -> DataFrame:
    """(word, n): the maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z in lower case) of at least
    ``min_length`` characters that occur at least ``min_count`` times in all texts.

    With ``slip``, let h be the crc32 of "<id>:<run>" (a null id is empty); where ``slip`` divides h, the run
    has lost its character h % length.  Null texts have no words; repeated rows count each."""
    run, letter = re.compile(f"[{LETTERS}]{{{min_length},}}"), re.compile(f"[{LETTERS}]+")

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                          names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Memo(_known), Counter()
        for b in batches:
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist(), strict=True):
                if not t:
                    continue
                own: Counter = Counter()
                for part in _runs(t, run, letter):
                    own.update(part)
                if slip is None:
                    for r, c in own.items():
                        total[known[r][0]] += c
                else:
                    head = zlib.crc32(f"{i or ''}:".encode())
                    for r, c in own.items():
                        low, raw = known[r]
                        h = zlib.crc32(raw, head)
                        if h % slip == 0:
                            k = h % len(low)
                            low = low[:k] + low[k + 1:]
                        total[low] += c
                if len(total) > flush:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    src = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    return (src.mapInArrow(count, "word string, n long").filter(F.char_length("word") >= min_length)
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def _half(length: Column, side: str, chars: Column) -> Column:
    """Key of a half: below the key so far, the length of what was cut, which half, and its characters."""
    return F.concat_ws("|", F.col("key"), F.concat(length.cast("string"), F.lit(side)), chars)


def _cut(rows: DataFrame, lengths: list[Column]) -> DataFrame:
    """Rows (key, rest, word, n) cut in halves as parts of words as long as each of ``lengths``: the half
    goes to the key, what is left stays to be compared."""
    size = F.char_length("rest")
    out = []
    for whole in lengths:
        first = F.floor(whole / 2).cast("int")
        tail = size - (whole - first)               # where the second half begins, as far from the end
        for side, chars, rest in (("P", F.substring(F.col("rest"), F.lit(1), first), F.substring(F.col("rest"), first + 1, size)),
                                  ("S", F.substring(F.col("rest"), tail + 1, size), F.substring(F.col("rest"), F.lit(1), tail))):
            out.append(F.when(whole >= 1, F.struct(_half(whole, side, chars).alias("key"), rest.alias("rest"))))
    return (rows.select(F.explode(F.array(*out)).alias("h"), "word", "n").filter("h is not null")
            .select("h.key", "h.rest", "word", "n"))


def near_pairs(words: DataFrame, pair_limit: int = 250_000) -> DataFrame:
    """(word, n, near, near_n): every two words at edit distance one, once in each direction."""
    whole = words.select(F.lit("").alias("key"), F.col("word").alias("rest"), "word", "n")
    chunks, grams, found = whole, whole, None
    while True:
        size = F.char_length("rest")
        chunks = staged(_cut(chunks, [size]), "spelling-chunks")
        grams = staged(_cut(grams, [size, size - 1]), "spelling-grams")
        count = (chunks.select("key", size.alias("left"), F.lit(1).alias("c"), F.lit(0).alias("g"))
                 .unionByName(grams.select("key", F.lit(0).alias("left"), F.lit(0).alias("c"), F.lit(1).alias("g")))
                 .groupBy("key").agg(F.sum("c").alias("c"), F.sum("g").alias("g"), F.max("left").alias("left")))
        hot = staged(count.filter((F.col("c") * F.col("g") > pair_limit) & (F.col("left") >= 2)).select("key"), "spelling-hot")
        crowded = not hot.isEmpty()
        a, b = chunks, grams
        if crowded:
            a, b = (x.join(hot, "key", "left_anti") for x in (a, b))
        a = a.select("key", F.col("rest").alias("ra"), F.col("word").alias("a"), F.col("n").alias("na"))
        b = b.select("key", F.col("rest").alias("rb"), F.col("word").alias("b"), F.col("n").alias("nb"))
        met = (a.join(b, "key").filter(((F.char_length("ra") < F.char_length("rb")) | (F.col("a") < F.col("b")))
                                       & (F.levenshtein("ra", "rb", 1) == 1)).select("a", "na", "b", "nb"))
        found = met if found is None else found.unionByName(met)
        if not crowded:
            break
        chunks, grams = (x.join(hot, "key", "left_semi") for x in (chunks, grams))
    once = staged(found.distinct(), "spelling-pairs")
    names = ["word", "n", "near", "near_n"]
    return once.toDF(*names).unionByName(once.select("b", "nb", "a", "na").toDF(*names))


def roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root) of every word of ``links`` (word, form; without cycles): forms followed to the last, by
    doubling the way that each row has gone."""
    cur = staged(links.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        far = staged(cur.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                            F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moved = not far.filter("moved").isEmpty()
        cur = far.drop("moved")
        if not moved:
            return cur
    raise RuntimeError(f"forms not followed to their end after {max_rounds} rounds")


def spelling_variants(words: DataFrame, factor: int = 2, pair_limit: int = 250_000) -> DataFrame:
    """One row per word of ``words`` (word, n; each word once): word, form (its near word of largest n, of equal
    ones the first in code-point order, if that n is at least ``factor`` times its own; else null), root (forms
    followed to the last, the word itself if it has none), n, n_near (its near words) and form_n.

    An empty table gives no rows; rows with a null word or n are left out; other columns are not read.  A word
    near to a great many is counted by partial sums, in no single task."""
    words = staged(words.select("word", F.col("n").cast("long").alias("n")).filter("word is not null and n is not null"),
                   "spelling-words")
    near = near_pairs(words, pair_limit)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    good = -F.col("best.minus") >= factor * F.col("n")
    rows = staged(words.join(best, "word", "left")
                  .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                          F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n")),
                  "spelling-forms")
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
