"""Benchmark decontamination against brute force, by broadcast and by join, and what it takes out of texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphdrift.llm import common, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, spans string, row_key int, n_hit int, c0 string, _d int, _k int, items int"


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _words(t):
    return WORD.findall(_lower(t))


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcdeéñ日本0189") for _ in range(rnd.randint(1, 4))) for _ in range(40)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    tests = [prose(30), prose(10), prose(11), prose(9), prose(3), "Zz", "ABC DEF", "", None, "?!", prose(60)]
    tests += [tests[0], tests[0] + " tail", "Ä ö 1", "x" * 3000]
    items = [(100 + i if i != 4 else None, t) for i, t in enumerate(tests)] + [(100, tests[1]), (9, tests[0])]
    texts = [None, "", " ", "?!,.", tests[0], f"{prose(5)}, {tests[0].upper()}! {prose(9)}", f"a {tests[4]} b {tests[4]}",
             f"{prose(40)}\n{tests[10]}\n{prose(30)}; {tests[2]}", tests[1].replace(" ", "--"), f"x{tests[1]}",
             " ".join(tests[10].split()[5:14]), " ".join(tests[10].split()[5:15]), "abc\x00def", "zZ", "zz" * 5, "ä ö 1", "Ä Ö 1",
             f"{tests[6]} zz", f"end {'x' * 3000} x", "x" * 2999, f"{prose(3000)} {tests[0]} {prose(20)}"]
    texts += [prose(rnd.randint(1, 60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, texts[5]), (None, None), (7, texts[4])]
    docs = common.staged(spark.createDataFrame([(i, t, "s", 1, 2, "c", 3, 4, 5) for i, t in rows], SCHEMA).repartition(4), "t-docs")
    bench = common.staged(spark.createDataFrame(items, "item_id long, text string").repartition(3), "t-bench")
    return rows, items, docs, bench


def _want(rows, items, size):
    win = {}
    for i, t in items:
        w = _words(t)
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            win.setdefault(tuple(w[j:j + n]), set()).add(i)
    out = []
    for d, t in rows:
        w = _words(t)
        hit, names = [False] * len(w), set()
        for n in {len(k) for k in win}:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in win:
                    hit[j:j + n] = [True] * n
                    names |= win[tuple(w[j:j + n])]
        out.append((d, len(w), sum(hit), tuple(sorted(str(x) for x in names if x is not None)), hit))
    return out


@pytest.mark.parametrize("size", [10, 4])
@pytest.mark.parametrize("how", [{}, {"block_bytes": 50}, {"max_words": 3}])
def test_overlap_is_that_of_brute_force(tables, size, how, monkeypatch):
    rows, items, docs, bench = tables
    want = sorted((w[:4] for w in _want(rows, items, size)), key=repr)
    got = decontaminate.find_overlap(docs, bench, size=size, **how).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in got), key=repr) == want
    text = {(i, t) for i, t in rows}
    for r in got:                                          # spans hold exactly the hit words
        for d, t in text:
            if d == r.doc_id and r.spans and sum(1 for i, _ in text if i == d) == 1:
                raw = t.encode()
                inside = [w for s in r.spans for w in _words(raw[s.begin:s.end].decode())]
                assert len(inside) == r.n_hit


def test_words_cross_slices(monkeypatch):
    import numpy as np
    rnd = random.Random(3)
    raw = " ".join("".join(rnd.choice("abé日") for _ in range(rnd.randint(1, 30))) for _ in range(400)).encode()
    data, none = np.frombuffer(raw, np.uint8), np.zeros(1, np.int64)
    whole = decontaminate.word_hashes(data, none)
    monkeypatch.setattr(decontaminate, "SLICE", 64)
    parts = decontaminate.word_hashes(data, none)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_empty_tables(tables, spark):
    rows, _, docs, bench = tables
    assert decontaminate.find_overlap(docs.limit(0), bench).count() == 0
    for how in ({}, {"max_words": -1}):
        got = decontaminate.find_overlap(docs, bench.limit(0), **how).collect()
        assert len(got) == len(rows) and all(r.n_hit == 0 and r.items == [] and r.spans == [] for r in got)


def test_collided_hashes_are_told_apart(tables, monkeypatch):
    """All windows share a hash: only the words decide."""
    import numpy as np
    rows, items, docs, bench = tables
    texts = [t for _, t in items if _words(t)]
    monkeypatch.setattr(decontaminate, "_mixed", lambda h: np.zeros_like(h))
    windows = decontaminate.WindowSet([str(i) for i in range(len(texts))], [t.encode() for t in texts], 4)
    raws = [(t or "").encode() for _, t in rows[:20]]
    got = [r[:2] for r in decontaminate._scan(raws, windows)]
    assert got == [w[1:3] for w in _want(rows[:20], items, 4)]


def test_what_is_taken_out(tables):
    rows, items, docs, bench = tables
    want = {(d, t): w for (d, t), w in zip(rows, _want(rows, items, 10), strict=True)}
    left = decontaminate.decontaminated(docs, bench, "documents")
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted((k for k in rows if not want[k][2]), key=repr)
    cut = decontaminate.decontaminated(docs, bench, "spans")
    assert cut.columns == docs.columns and cut.filter("c0 <> 'c' or spans <> 's' or _k <> 4").count() == 0
    left = sorted(((r.doc_id, tuple(_words(r.text))) for r in cut.collect()), key=repr)
    assert left == sorted(((d, tuple(x for x, h in zip(_words(t), want[d, t][4]) if not h)) for d, t in rows), key=repr)
    same = [k for k in rows if not want[k][2]]
    assert {(r.doc_id, r.text) for r in cut.collect()} >= set(same)
    with pytest.raises(ValueError):
        decontaminate.decontaminated(docs, bench, "lines")


def test_nothing_is_shuffled_below_the_bound(tables):
    _, _, docs, bench = tables
    plan = decontaminate.find_overlap(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
