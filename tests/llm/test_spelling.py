"""Spelling variants against brute force: word counts, near pairs (common halves included), forms, roots."""

import random
import re
import zlib
from collections import Counter

import pytest

from graphdrift.llm import common, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def _counts(rows, slip, min_length, min_count):
    total = Counter()
    for i, t in rows:
        for r in RUN.findall(t or ""):
            r = _lower(r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if slip and h % slip == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            total[r] += 1
    return {w: n for w, n in total.items() if len(w) >= min_length and n >= min_count}


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _want(counts):
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        r = w
        while form[r] is not None:
            r = form[r]
        out.append((w, form[w], r, counts[w], len(near[w]), None if form[w] is None else counts[form[w]]))
    return out


def _sorted(rows):
    return sorted(rows, key=repr)


def _variants(rnd, n, alphabet, lengths):
    words = {"".join(rnd.choice(alphabet) for _ in range(rnd.choice(lengths))) for _ in range(n)}
    for w in list(words):
        i = rnd.randrange(len(w) + 1)
        words |= {w[:i] + w[i + 1:], w[:i] + rnd.choice(alphabet) + w[i:], w[:i] + rnd.choice(alphabet) + w[i + 1:], w + w[-1:]}
    return sorted(w for w in words if w)


@pytest.mark.parametrize("pair_limit", [250_000, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_forms_of_random_words(spark, pair_limit, seed):
    rnd = random.Random(seed)
    words = _variants(rnd, 60, "abé" if seed == 1 else "abcÀÿo", [5, 6, 7, 11] if seed == 1 else [1, 2, 3, 5, 9])
    counts = {w: rnd.choice([3, 3, 4, 6, 8, 16, 33]) for w in words}
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()] + [(None, 4, "x"), ("null", None, "x")],
                               "word string, n long, near string").repartition(3)
    got = spelling.spelling_variants(df, pair_limit=pair_limit).collect()
    assert _sorted(tuple(r) for r in got) == _sorted(_want(counts))


def test_common_halves_are_cut_again(spark):
    """Hundreds of words share their first half; every pair is found and no key has all of them."""
    rnd = random.Random(5)
    words = sorted({"prefixes" + "".join(rnd.choice("abcd") for _ in range(8)) for _ in range(300)})
    counts = {w: 3 + i % 5 for i, w in enumerate(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {frozenset((r.word, r.near)) for r in spelling.near_pairs(df, pair_limit=500).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if _near(a, b)}


@pytest.mark.parametrize("slip", [97, 3, None])
def test_word_counts(spark, slip, monkeypatch):
    rnd = random.Random(7)
    words = ["Alpha", "alpha", "beta", "gammaé", "GAMMAÉ", "×÷×÷×", "naïvely", "日本語日本", "delta1delta", "abcdef", "Straße", "ſtrange"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80))) + rnd.choice([".", "\n", "-x", ""]) for _ in range(60)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, None), (None, None), (2, ""), (5, texts[5]), (5, texts[5]),
                                                                    (80, "longword" * 300 + " " + "alpha " * 2000)]
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, n int, word string").repartition(4)
    monkeypatch.setattr(spelling, "SLICE", 64)
    want = _counts(rows, slip, 5, 3)
    got = {r.word: r.n for r in spelling.word_counts(df, slip=slip, flush=5).collect()}
    assert got == want and want
    parts = [p for part in spelling._runs(rows[-1][1], RUN, RUN) for p in part]
    assert parts == RUN.findall(rows[-1][1])


def test_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.word_counts(none).count() == 0
    assert spelling.spelling_variants(spelling.word_counts(none)).count() == 0
    chain = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "cccccc": 5}
    df = spark.createDataFrame(list(chain.items()), "word string, n int")
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(df).collect()}
    assert got["aaaaa"] == ("aaaab", "bbbbb") and got["abbbb"] == ("bbbbb", "bbbbb") and got["bbbbb"] == (None, "bbbbb")
    assert got["cccccc"] == (None, "cccccc")


def test_whole_query_on_documents(spark):
    from graphdrift.llm.queries import op13_spelling
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in common.load(spark, sf, "documents").select("doc_id", "text").collect()]
    got = op13_spelling(spark, sf).collect()
    assert _sorted(tuple(r) for r in got) == _sorted(_want(_counts(rows, 97, 5, 3))) and got
