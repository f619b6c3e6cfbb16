"""The corpus operators against brute force on small tables with nulls, empty, long and repeated texts,
ties, null ids, extra columns with clashing names, several input partitions, and empty tables."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import regex
import xxhash
import zstandard
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

import corpus_pipeline
from graphdrift.llm import (bpe_codec, common, components, deep_shallow, exact_dedup, hilbert, language_id, nearest,
                            packing, quality, simhash_dedup, substring_dedup, suffix_dedup, token_counts, vocab)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d long, _k string, kind int, place int"


def _texts():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdeghiklmnorstu") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared, long_ = prose(120), prose(6000)
    near = prose(200)
    out = [None, "", "   \n\t ", "word", "Word", "ÄÖ a", "äö A", long_, long_.upper(), "1234 !!! 77", "é" * 700,
           "ab" * 900, "x" * 2000, "x" * 2000 + " tail", "naïve\x1c café　日本語 text  two   spaces \n\n end "]
    for i in range(6):
        out.append(f"{prose(30)} {shared} {prose(30 + i)}")
    for i in range(4):
        w = near.split()
        w[17 * i + 3] = "changed"
        out.append(" ".join(w))
    out += [prose(n) for n in (3, 12, 13, 14, 80, 400)]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    out = [(100 + 3 * i, t) for i, t in enumerate(texts)]
    out += [(1, texts[7]), (1, texts[7]), (2, texts[16]), (None, texts[17]), (None, "only here " * 60), (None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en", "s", 0, 5, "clash", 1, 2) for i, t in rows]
    return common.staged(spark.createDataFrame(full, SCHEMA).repartition(5, "text", "doc_id"), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return common.staged(spark.createDataFrame([], SCHEMA), "test-none")


def _sorted(rows_):
    return sorted(rows_, key=repr)


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _path(spark, df):
    path = common.work_path(spark, "test-source")
    df.write.parquet(path)
    return path


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, rows, none, weak):
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256_digest
    got = exact_dedup.exact_dedup(spark, _path(spark, docs), digest=digest, max_files_per_trigger=2).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[_lower(t)].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert _sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == _sorted(want)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_dedup(spark, _path(spark, none)).count() == 0
    stay = exact_dedup.kept_documents(spark, docs)
    assert stay.columns == docs.columns
    assert _sorted((r.doc_id, r.text is None) for r in stay.select("doc_id", "text").collect() if _lower(r.text)) == \
        _sorted((max((i for i in ids if i is not None), default=None), False) for t, ids in groups.items() if t)
    assert exact_dedup.kept_documents(spark, none).count() == 0


def test_exact_dedup_takes_only_new_files(spark, docs):
    path, state = _path(spark, docs), common.work_path(spark, "test-state")
    first = exact_dedup.run_state(spark, path, checkpoint=state).agg(F.sum("group_size")).first()[0]
    docs.limit(3).write.mode("append").parquet(path)
    again = exact_dedup.run_state(spark, path, checkpoint=state).agg(F.sum("group_size")).first()[0]
    assert (first, again) == (docs.count(), docs.count() + 3)


def _fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", _lower(t))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(n, linked):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, rows, none):
    fp = [_fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4]
    root = _classes(len(fp), pairs)
    low = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None)
           for r in set(root)}
    want = [(rows[i][0], f"{fp[i]:016x}", low[root[i]]) for i in range(len(rows))]
    got = simhash_dedup.near_duplicates(docs, group_rows=3).collect()
    assert _sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == _sorted(want)
    assert simhash_dedup.near_duplicates(none).count() == 0
    one = simhash_dedup.one_of_each(docs.filter("doc_id is not null"))
    assert sorted(r.doc_id for r in one.dropDuplicates(["doc_id"]).collect()) == sorted(x for x in low.values() if x is not None)


def test_simhash_keeps_one_of_each_component_without_ids(spark):
    rnd = random.Random(21)
    prose = lambda n: [f"{rnd.getrandbits(40):x}" for _ in range(n)]
    base = [prose(400) for _ in range(12)]
    near = [[*w[:200], "changed", *w[201:]] for w in base]
    text = lambda w: " ".join(w)
    rows_ = [(None, text(w)) for w in base] + [(None, text(w)) for w in near[:6]]       # components without an id
    rows_ += [(7, text(near[6])), (9, text(near[6])), (None, text(near[7])), (8, text(near[7])), (None, None), (None, " ")]
    fp = [_fingerprint(t) for _, t in rows_]
    root = _classes(len(rows_), [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in simhash_dedup.one_of_each(df).collect()]
    assert len(set(kept)) == len(kept) == len(set(root)) >= 12
    assert {root[rows_.index(r)] for r in kept} == set(root)
    for r in kept:
        ids = [i for (i, _), c in zip(rows_, root, strict=True) if c == root[rows_.index(r)] and i is not None]
        assert r[0] == min(ids, default=None)


@pytest.mark.parametrize("group_rows", [50_000, 40])
def test_gray_index_links_every_pair(spark, group_rows):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 40, np.uint64)
    codes = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                b ^= 1 << bit
            codes.add(b)
    codes = sorted(codes)
    arr = np.array(codes, np.uint64)
    pairs = [(int(i), int(j)) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4) if j < i]
    want = _classes(len(codes), pairs)
    df = spark.createDataFrame([(int(c),) for c in arr.view(np.int64)], "fp long")
    root = {r.node: r.root for r in components.connected_components(simhash_dedup.links(df, 4, group_rows, 500)).collect()}
    signed = [int(c) for c in arr.view(np.int64)]
    got = [root.get(c, c) for c in signed]
    assert len(set(want)) == len(set(got))
    assert len(set(zip(want, got, strict=True))) == len(set(got))


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(200, 260)] + [(1, i) for i in range(2, 90)] + [(300, 300), (7, 95), (95, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 200 for i in range(201, 261)) and all(got[i] == 1 for i in [*range(2, 90), 95]) and 300 not in got
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_substring_dedup(docs, rows, none):
    first = {}
    big = 1 << 62
    split = [(big if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - 12):
            first[tuple(w[j:j + 13])] = min(i, first.get(tuple(w[j:j + 13]), i))
    want = []
    for (i, w), (d, _) in zip(split, rows, strict=True):
        keep = [True] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < i:
                keep[j:j + 13] = [False] * 13
        k = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        want.append((d, len(w), len(w) - sum(keep), hashlib.sha256(k.encode()).hexdigest()))
    got = substring_dedup.remove_repeats(docs).collect()
    assert _sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == _sorted(want)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    crowded = substring_dedup.remove_repeats(docs, max_cells=1 << 16).collect()
    assert _sorted((r.doc_id, r.n_removed) for r in crowded) == _sorted(w[:1] + w[2:3] for w in want)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_sketch_is_unpacked_block_by_block(spark):
    bits, rng = 29, np.random.default_rng(3)
    bytes_of_block = (1 << bits) // substring_dedup.BLOCKS // 8
    plain = [np.zeros(bytes_of_block, np.uint8) if i % 5 else rng.integers(0, 256, bytes_of_block, np.uint8)
             for i in range(substring_dedup.BLOCKS)]
    blocks = [zstandard.compress(b.tobytes(), 1) if i % 3 else b"" for i, b in enumerate(plain)]
    cells = np.sort(rng.integers(0, 1 << bits, 5000))[rng.permutation(5000)]
    want = [bool(blocks[c // 8 // bytes_of_block] and
                 plain[c // 8 // bytes_of_block][c // 8 % bytes_of_block] >> (7 - c % 8) & 1) for c in cells.tolist()]
    tracemalloc.start()
    try:
        got = substring_dedup.counted_twice(blocks, cells, bits)
        assert tracemalloc.get_traced_memory()[1] < 4 << 20             # the row itself has 64 MB
    finally:
        tracemalloc.stop()
    assert got.tolist() == want and any(want)
    assert not len(substring_dedup.counted_twice(blocks, cells[:0], bits))
    rows = spark.createDataFrame([(" ".join(map(str, range(k, k + 20))),) for k in (0, 0, 50)], "text string")
    sketch = substring_dedup.merged_sketch(rows, 13, 16)
    h, _, text, _ = substring_dedup.WindowHasher(13)([r.text for r in rows.collect()])
    twice = substring_dedup.counted_twice(sketch[0], substring_dedup._cells(h, 16), 16)
    assert [len(r) for r in sketch] == [substring_dedup.BLOCKS] * substring_dedup.ROWS
    assert twice[text < 2].all() and not twice[text == 2].all()


@pytest.mark.parametrize("length,group_rows", [(400, 4096), (60, 2)])
def test_suffix_dedup(docs, rows, none, length, group_rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[j:j + length] for b in raw for j in range(len(b) - length + 1))
    want = []
    for b, (i, _) in zip(raw, rows, strict=True):
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j:j + length]] > 1:
                gone[j:j + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(docs, length=length, group_rows=group_rows).collect()
    assert _sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _sorted(want)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.remove_repeats(none).count() == 0
    out = suffix_dedup.stripped(docs, length=length)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.filter("_k <> 'clash' or kind <> 1").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_reaches_of_random_groups(seed):
    """Far right and left of each member: the longest pair of sides shared with one other member."""
    rnd = random.Random(seed)
    for _ in range(60):
        length, m = rnd.randint(4, 14), rnd.randint(1, 24)
        side = lambda: bytes(rnd.choice(b"ab" if rnd.random() < 0.9 else b"abc") for _ in range(rnd.randint(0, length)))  # noqa: E731,B023
        both = list({(side(), side()) for _ in range(m)})
        share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        got_l, got_r = suffix_dedup.reaches([a for a, _ in both], [b for _, b in both], length)
        for i, (a, b) in enumerate(both):
            pairs = [(share(a, x), share(b, y)) for j, (x, y) in enumerate(both) if j != i]
            pairs = [p for p in pairs if p[1] > 0 and sum(p) >= length]
            want = (max(p[0] for p in pairs), max(p[1] for p in pairs)) if pairs else (-1, -1)
            assert (got_l[i], got_r[i]) == want


def test_long_texts_cross_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    rnd = random.Random(2)
    t = bytes(rnd.randrange(97, 100) for _ in range(5000))
    parts = suffix_dedup.Anchors(60)(t)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 20)
    assert np.array_equal(parts[0], suffix_dedup.Anchors(60)(t)[0])


def test_deep_shallow_sort():
    rnd = random.Random(4)
    base = bytes(rnd.randrange(256) for _ in range(300))
    strings = [base[:rnd.randrange(301)] + bytes(rnd.randrange(3) for _ in range(rnd.randrange(5))) for _ in range(400)]
    strings += [b"", b"", base, base, *[bytes(rnd.randrange(4) for _ in range(rnd.randrange(9))) for _ in range(300)]]
    order, lcp = deep_shallow.deep_shallow_sort(strings)
    got = [strings[i] for i in order]
    assert got == sorted(strings) and sorted(order.tolist()) == list(range(len(strings)))
    for a, b, n in zip(got, got[1:], lcp[1:].tolist()):
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


def test_token_counts(docs, rows, none):
    path = token_counts.default_vocabulary()
    score = token_counts.unigram_scores(vocab.ranks(path))
    longest = max(map(len, score))

    def best(p):
        f = [(0.0, 0)]
        for j in range(1, len(p) + 1):
            got = None
            for i in range(j - 1, max(-1, j - longest - 1), -1):
                if (s := score.get(p[i:j])) is not None:
                    c = (f[i][0] + s, f[i][1] + 1)
                    if got is None or c[0] > got[0] + 1e-9 or (c[0] > got[0] - 1e-9 and c[1] < got[1]):
                        got = c
            f.append(got)
        return f[-1]
    memo = {}
    want = []
    for i, t in rows:
        pre = regex.findall(PATTERN, t or "")
        got = [memo.setdefault(p, None) or memo.__setitem__(p, best(p.encode())) or memo[p] for p in pre]
        want.append((i, len((t or "").encode()), len(pre), sum(g[1] for g in got)))
    got = token_counts.token_counts(docs, path, PATTERN).collect()
    assert _sorted((r.doc_id, r.n_bytes, r.n_pretokens, r.n_tokens) for r in got) == _sorted(want)
    assert token_counts.token_counts(none, path, PATTERN).count() == 0
    tiny = token_counts.ScoreTrie(token_counts.unigram_scores({bytes([b]): b for b in range(256)}), limit=3)
    assert [tiny(b"abcab")[0], tiny(b"abd")[0], tiny(b"")[0]] == [5, 3, 0]


def test_packing(docs, rows, none):
    path = packing.default_vocabulary()
    enc = vocab.encoding(path, PATTERN)
    pieces = packing.pack(docs, path, PATTERN, width=64, horizon_windows=8).toPandas()
    docs_ids = collections.Counter((i, tuple([*enc.encode_ordinary(t or ""), 1])) for i, t in rows)
    # every sequence is gapless and within the width; every document comes back whole, in order
    for _, g in pieces.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 64
    back, cur = collections.Counter(), []
    pieces = pieces.sort_values(["sequence_id", "offset"])
    for r in pieces.itertuples():
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == len(cur) and len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        cur += ids.tolist()
        if len(cur) == r.doc_tokens:
            back[None if math.isnan(float(r.doc_id if r.doc_id is not None and r.doc_id == r.doc_id else "nan")) else int(r.doc_id), tuple(cur)] += 1
            cur = []
    assert back == docs_ids and not cur
    lengths = pieces.groupby("sequence_id").length.sum()
    pad = sum(0 if n & (n - 1) == 0 else 64 - n for n in lengths)
    assert pad < 0.15 * lengths.sum()
    assert packing.pack(none, path, PATTERN).count() == 0


def test_packing_ids_are_those_of_the_tokenizer_file(spark):
    """Whole ids, added tokens included, against the tokenizers library on the JSON."""
    import tokenizers
    from public_tokenizers import path as file
    lib = tokenizers.Tokenizer.from_file(file("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = ["", None, end, f"a{end}b", f"{end}{end} x", f" one {end}  two\n{end}\n", "<|endoftext|", "x <|endo", "<|ENDOFTEXT|>",
             f"ä{end}日本 {end[:-1]} {end}"] + [t for t in _texts() if t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pieces = packing.pack(df, packing.default_vocabulary(), PATTERN, width=64, horizon_windows=8, added=packing.default_added())
    got = collections.defaultdict(list)
    for r in pieces.orderBy("doc_id", "start").collect():
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    for i, t in enumerate(texts):
        assert got[i] == [*lib.encode(t or "", add_special_tokens=False).ids, 1], t
    assert got[2] == [50256, 1]


def test_packing_looks_only_at_unpadded_lengths_that_end_at_a_place():
    rng = random.Random(4)
    for _ in range(50):
        pos = [0, *sorted(rng.sample(range(1, 400), rng.randint(1, 120)))]
        sizes = [1 << k for k in range(7)]
        ends, backs = packing._unpadded(np.array(pos), sizes)
        for j in range(1, len(pos)):
            assert backs[ends[j - 1]:ends[j]] == [pos.index(pos[j] - n) for n in sizes if pos[j] - n in pos]
        assert ends[0] == 0


def test_packing_ids_of_odd_spaces_are_those_of_the_whole_text():
    for path in (packing.default_vocabulary(),):
        enc = vocab.encoding(path, PATTERN)
        for text in ("", " ", "a", " a", "a  b", "a b ", "  a\n b", "a b a b", "\u00e9 \u00a0x 12 345", "x\t y"):
            assert vocab.packed_ids(text, path, PATTERN) == np.array(enc.encode_ordinary(text), "<u4").tobytes()


def test_packing_plan_is_the_cheapest():
    rnd = random.Random(6)
    for _ in range(60):
        width = rnd.choice([8, 10, 16])
        pos = sorted(rnd.sample(range(1, 60), rnd.randint(8, 40)))
        pos = [p for p in pos if p] + [60]
        if max(np.diff([0, *pos])) > width:
            continue
        pen = [float(rnd.choice([0, 3, 9])) for _ in pos]

        def cost(cuts):
            c = 0.0
            for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
                n = b - a
                c += packing.PER_WINDOW + (0 if n & (n - 1) == 0 else width - n) + pen[pos.index(b)]
            return c
        best = {0: 0.0}
        for j, p in enumerate(pos):
            best[p] = min(best[q] + (0 if (p - q) & (p - q - 1) == 0 else width - p + q) + packing.PER_WINDOW + pen[j]
                          for q in best if p - q <= width)
        assert cost(packing.plan_cuts(np.array(pos), np.array(pen), width)) == pytest.approx(best[60])


@pytest.mark.parametrize("chunk,overlap,spread", [(1 << 14, 256, 1 << 17), (40, 24, 100), (30, 10, 0)])
def test_bpe_codec(docs, rows, none, chunk, overlap, spread):
    path = bpe_codec.default_vocabulary()
    enc = vocab.encoding(path, PATTERN)
    got = bpe_codec.encode_decode(docs, path, PATTERN, chunk_chars=chunk, overlap=overlap, spread_chars=spread).collect()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (t or "").encode()))
    assert _sorted((r.doc_id, r.n_tokens, r.ids_sha256, bytes(r.decoded)) for r in got) == _sorted(want)
    assert all(hashlib.sha256(r.decoded).hexdigest() == r.decoded_sha256 and len(r.ids) == 4 * r.n_tokens for r in got)
    assert bpe_codec.encode_decode(none, path, PATTERN).count() == 0


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(4)] * 3), axis=-1).reshape(-1, 3)
    key = hilbert.hilbert_key(grid, 2)
    assert sorted(key.tolist()) == list(range(64))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_nearest(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6)) * rng.uniform(0.5, 2.0, (300, 1))
    v[100:200] = v[7]                                       # a third alike
    rows_ = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, v[20].tolist()), (1000, None), (1020, [0.0] * 6),
             (1040, [float("nan")] * 6), (1060, [float("inf")] + [1.0] * 5), (1080, [1.0] * 5), (None, v[3].tolist()),
             (1100, [None] * 6), (1120, [])]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(4)
    got = nearest.nearest(df, k=20, window_share=1.0, block_rows=64).toPandas()
    assert sorted(set(got.query_id)) == list(range(0, 300, 20))
    for q, g in got.groupby("query_id"):
        s = (v * v[q]).sum(axis=1)
        s[q] = -np.inf
        order = np.lexsort((np.arange(300), -s))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and g.vec_id.tolist() == order.tolist()
        assert np.allclose(g.score, s[order], atol=1e-12)
    few = nearest.nearest(df.filter("vec_id in (0, 1, 2)"), k=20).toPandas()
    assert few[few.query_id == 0].vec_id.nunique() == 2
    assert nearest.nearest(df.limit(0)).count() == 0


def _recall(spark, v, k=20, **how):
    rows_ = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(4)
    got = nearest.nearest(df, k=k, **how).toPandas().groupby("query_id").vec_id.apply(set)
    asked = np.arange(0, len(v), 20)
    s = v[asked] @ v.T
    s[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-s, axis=1)[:, :k]
    return np.mean([len(got[q] & set(b.tolist())) / k for q, b in zip(asked.tolist(), best, strict=True)])


@pytest.mark.parametrize("norms", ["one", "some"])
def test_nearest_finds_beside_long_vectors(spark, norms):
    rng = np.random.default_rng(17)
    v = rng.normal(size=(2000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= np.where(np.arange(2000) == 5, 1000.0, 1.0)[:, None] if norms == "one" else 1.0 + rng.pareto(1.0, (2000, 1))
    assert _recall(spark, v) >= 0.9                         # the window of production


def test_nearest_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(23)
    signs = 1.0 - 2.0 * (np.arange(512)[:, None] >> np.arange(9) & 1)         # 512 vectors alike in score
    v = np.column_stack((np.ones(512), signs))
    ids = rng.permutation(np.arange(1, 2000)[np.arange(1, 2000) % 20 != 0])[:512]
    rows_ = [(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)] + [(0, [1.0] + [0.0] * 9)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(4)
    got = nearest.nearest(df, k=20, window_share=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == sorted(ids.tolist())[:20] and {r.score for r in got} == {1.0}


def test_nearest_deals_crowded_blocks(spark):
    queries = spark.range(3000).select(F.lit(1).alias("curve"), F.when(F.col("id") < 2950, 0).otherwise(1).cast("long").alias("block"),
                                       F.md5(F.col("id").cast("string")).alias("kind"))
    vectors = spark.range(40).select(F.lit(1).alias("c"), (F.col("id") % 2).alias("b"), F.col("id").alias("at"))
    q, v = nearest.dealt(queries, vectors, 100)
    held = {(r.block, r.slice): r["count"] for r in q.groupBy("block", "slice").count().collect()}
    assert sum(held.values()) == 3000 and max(held.values()) < 200 and held[1, 0] == 50
    met = q.join(v, (q.block == v.b) & (q.slice == v.slice)).groupBy("kind").agg(F.countDistinct("at").alias("n"), F.count("at").alias("m"))
    assert [tuple(r) for r in met.select("n", "m").distinct().collect()] == [(20, 20)]


@pytest.mark.parametrize("n", [500, 6000])
def test_nearest_recall_at_the_production_window(spark, n):
    v = np.random.default_rng(29).normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    whole = _recall(spark, v)
    assert whole >= 0.9
    assert _recall(spark, v, query_rows=20) == whole          # dealt into slices: the same answers


def test_language_spans_and_edge_cases(spark, docs, none):
    rnd = random.Random(1)
    make = {"aa": "tho ent ing the wan", "bb": "szy prz ska ego nie", "gr": "και του την στο για"}
    prose = lambda k, n: " ".join(rnd.choice(make[k].split()) + rnd.choice(make[k].split()) for _ in range(n))
    rows_ = [(i, prose(k, 30), k) for i in range(120) for k in [rnd.choice(list(make))]]
    train = spark.createDataFrame(rows_ + [(500, None, "aa"), (501, "zz", None), (None, "zz", "aa")], "doc_id long, text string, lang string")
    m = language_id.train(train)
    assert m.langs == ["aa", "bb", "gr"]
    mixed = f"{prose('aa', 20)} {prose('gr', 15)} {prose('bb', 25)}"
    test = spark.createDataFrame([(1, mixed), (2, None), (3, "123 !!"), (4, ""), (5, "привет мир"), (6, prose("bb", 5000))],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(test, m, batch_words=50).collect()}
    spans = [(s.first_word, s.n_words, s.lang) for s in got[1].spans]
    assert [s[2] for s in spans] == ["aa", "gr", "bb"] and all(abs(a[0] - b) <= 2 for a, b in zip(spans, (0, 20, 35)))
    assert {i: got[i].lang_pred for i in (2, 3, 4, 6)} == {2: "und", 3: "und", 4: "und", 6: "bb"}
    assert got[5].lang_pred in m.langs and got[5].score == 0.0
    right = language_id.identify(train.filter(language_id.held_out(F.col("doc_id"))), m).join(train.drop("text"), "doc_id")
    assert right.filter("lang_pred = lang").count() >= 0.95 * right.count() > 0
    kept = language_id.in_known_language(test, m)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 6]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert language_id.in_known_language(docs, m).columns == docs.columns
    assert language_id.in_known_language(none, m).count() == 0
    empty = language_id.train(none)
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(none, m).count() == 0


def test_language_memory_does_not_follow_the_batch(spark):
    """Python memory held while one long batch of texts is labelled, against one ten times as long."""
    import tracemalloc

    import pandas as pd
    rnd = random.Random(4)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(500)]
    train = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=50)), "aa") for i in range(40)],
                                  "doc_id long, text string, lang string")
    m = language_id.train(train)

    def peak(n):
        texts = pd.Series([" ".join(rnd.choices(words, k=150)) for _ in range(n)])
        table = language_id.Words(m)
        tracemalloc.start()
        got = language_id._labels(texts, m, table, False, 20_000, batch_chars=1 << 17)
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {g[0] for g in got} == {"aa"}
        return top - 400 * n                              # the rows of the answer themselves
    assert peak(6000) < 1.5 * peak(600)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(9)
    lengths = np.array([7, 6, 6, 1])
    score = -rng.uniform(0, 5, (lengths.sum(), 3)).astype(np.float32)
    starts = np.cumsum(lengths) - lengths
    path = language_id.viterbi(score, starts, lengths, 1.7)
    import itertools
    for s, n in zip(starts, lengths):
        value = lambda p: sum(score[s + i, x] for i, x in enumerate(p)) - 1.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731,B023
        assert value(path[s:s + n].tolist()) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(n)))), abs=1e-5)


def test_quality(spark, none):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    def doc(g):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        if g == 0:
            w[rnd.randrange(len(w))] = "vile"
        if g == 1:
            w = [x.upper() + "!!" for x in w]
        return " ".join(w)
    rows_ = [(i, doc(i % 3), i % 3) for i in range(900)]
    df = spark.createDataFrame(rows_ + [(2000, None, 1), (2001, "a b", None), (None, "a", 2), (2002, "x", 9)],
                               "doc_id long, text string, grade int").repartition(4)
    m = quality.train(df.filter("doc_id < 600 or doc_id >= 2000 or doc_id is null"))
    assert m.thresholds[0] < m.thresholds[1]
    got = quality.grade(df, m).join(df.drop("text"), "doc_id").filter("doc_id between 600 and 899").toPandas()
    assert (got.kept == (got.grade == 2)).mean() > 0.95
    assert got[got.grade == 0].expected_grade.mean() < got[got.grade == 1].expected_grade.mean() < got[got.grade == 2].expected_grade.mean()
    odd = {r.doc_id: r for r in quality.grade(spark.createDataFrame([(1, None), (2, ""), (3, "fine text")], "doc_id long, text string"), m).collect()}
    assert not odd[1].kept and odd[1].expected_grade == 0.0 and not odd[2].kept
    assert quality.grade(none, m).count() == 0
    labels = quality.graded_labels(spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int"))
    assert {r.doc_id: r.grade for r in labels.collect()} == {1: 2, 2: 1, 3: 0}


def _loss(score, cuts, grade):
    theta = np.cumsum(np.concatenate((cuts[:1], np.exp(cuts[1:]))))
    below = np.concatenate(([0.0], 1 / (1 + np.exp(score - theta)), [1.0]))
    return -math.log(below[grade + 1] - below[grade])


def test_quality_step_follows_the_gradient_of_the_likelihood():
    rng = np.random.default_rng(5)
    for grade in (0, 1, 2, 3):
        z, n, cuts = rng.normal(0, 5, 50), rng.uniform(0, 9, 50), np.array([-1.0, 0.2, -0.4])
        m = quality._Ftrl(z.copy(), n.copy(), cuts.copy(), 0.5, 1.0, 1.0)
        at = np.array([3, 7, 20, 41])
        w = m.weights(at)
        score, h = w.sum(), 1e-5
        g = (_loss(score + h, cuts, grade) - _loss(score - h, cuts, grade)) / (2 * h)
        by_cut = [(_loss(score, cuts + h * e, grade) - _loss(score, cuts - h * e, grade)) / (2 * h) for e in np.eye(3)]
        m.step(at, grade, 0.01)
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / 0.5
        assert np.allclose(m.z[at] - z[at], g - sigma * w, atol=1e-6) and np.allclose(m.n[at] - n[at], g * g, atol=1e-6)
        assert np.allclose(m.cuts - cuts, -0.01 * np.array(by_cut), atol=1e-8)
        rest = np.setdiff1d(np.arange(50), at)
        assert np.array_equal(m.z[rest], z[rest])


def test_quality_fit_reaches_the_likelihood_of_a_direct_optimiser(spark):
    rnd = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta"]
    rows_ = []
    for i in range(400):
        own = rnd.sample(words, rnd.randint(1, 3))
        pull = 1.5 * ("alpha" in own) - 1.5 * ("beta" in own) + rnd.gauss(0, 1.2)
        rows_.append((i, " ".join(own), 0 if pull < -1 else 1 if pull < 1 else 2))
    df = spark.createDataFrame(rows_, "doc_id long, text string, grade int")
    m = quality.train(df, parts=2, rounds=16, l1=0.0, l2=0.0)
    memo = vocab.Memo(quality._word_bucket)
    at = [quality.features(t, memo) for _, t, _ in rows_]
    grades = np.array([g for _, _, g in rows_])
    used, inverse = np.unique(np.concatenate(at), return_inverse=True)
    x = np.zeros((len(rows_), len(used)))
    x[np.repeat(np.arange(len(at)), [len(a) for a in at]), inverse] = 1.0
    def loss(w, theta):
        below = 1 / (1 + np.exp((x @ w)[:, None] - theta))
        p = np.column_stack([below[:, 0], below[:, 1] - below[:, 0], 1 - below[:, 1]])
        return -np.log(p[np.arange(len(p)), grades]).mean()
    w, cuts = np.zeros(len(used)), np.array([-1.0, 0.0])
    for _ in range(4000):                                 # plain full gradient descent
        theta = np.cumsum([cuts[0], np.exp(cuts[1])])
        below = np.column_stack([np.zeros(len(x)), 1 / (1 + np.exp((x @ w)[:, None] - theta)), np.ones(len(x))])
        hi, lo = (below[np.arange(len(x)), grades + i] for i in (1, 0))
        gw = x.T @ (1 - lo - hi) / len(x)
        slope = np.array([(-(hi * (1 - hi) / (hi - lo))[grades == j].sum() + (lo * (1 - lo) / (hi - lo))[grades == j + 1].sum())
                          for j in (0, 1)]) / len(x)
        w -= 0.5 * gw
        cuts -= 0.5 * np.array([slope.sum(), slope[1] * np.exp(cuts[1])])
    best = loss(w, np.cumsum([cuts[0], np.exp(cuts[1])]))
    base = loss(np.zeros(len(used)), np.array([math.log(q / (1 - q)) for q in (np.mean(grades < 1), np.mean(grades < 2))]))
    got = loss(m.weights[used].astype(float), m.thresholds)
    assert best < base - 0.05 and got < best + 0.1 * (base - best)


def test_filtering_stages_keep_any_column_names(spark):
    rows_ = [(i, f"{'one two three four five six seven ' * 3} {i % 3} {'pad ' * 150}", i, "a", 2.0, i, i, True, "x")
             for i in range(9)] + [(None, None, 1, None, None, None, None, None, None)]
    df = common.staged(spark.createDataFrame(rows_, "doc_id long, text string, __d long, __k string, __spans double, __file int, "
                                             "__row int, _metadata boolean, _Spans string").repartition(3), "test-clash")
    rest = [c for c in df.columns if c != "text"]
    before = {r.doc_id: r for r in df.select(rest).collect()}
    for stage in (lambda d: exact_dedup.kept_documents(spark, d), simhash_dedup.one_of_each,
                  lambda d: suffix_dedup.stripped(d, length=60)):
        out = stage(df)
        assert out.columns == df.columns and dict(out.dtypes) == dict(df.dtypes)
        got = {r.doc_id: r for r in out.select(rest).collect()}
        assert got and all(r == before[i] for i, r in got.items())
    path = _path(spark, df)
    assert exact_dedup.exact_dedup(spark, path).filter("kept").count() == 4


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.load(spark, sf, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf), "stage")
        assert docs.columns == columns, name
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < len(texts) < n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    enc = vocab.encoding(packing.default_vocabulary(), PATTERN)
    assert pieces.length.sum() == sum(len(enc.encode_ordinary(t)) + 1 for t in texts.values())
    assert set(pieces.doc_id) == set(texts)
