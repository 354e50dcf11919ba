"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd input."""

import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from irloom.llm import bpe, langid, licenses, minhash, ngram, packing, quality, topk, toxicity, vectors
from irloom.llm.common import crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, row int, v string"


def documents(spark, rows):
    """(id, text, lang) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), 1, 2, "x") for i, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice(["an", "er", "to", "is", "ol", "qu"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]


@pytest.fixture(scope="module")
def odd(spark, words):
    rng = random.Random(4)
    base = [" ".join(rng.choices(words, k=rng.randint(20, 120))) for _ in range(30)]
    near = []
    for t in base[:10]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    texts = [None, "", "   \n\t ", "one", "two words", base[0], base[0], "12 34 !!", "a" * 5000, " ".join(words * 40), *base, *near]
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(texts)]
    return rows + [rows[5]]  # one row twice


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, []).limit(0)


def test_bpe_round_trip(spark, odd, empty):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, odd + [(900, "日本語 😀 <|endoftext|> --==--", None), (901, "-" * 3000, None)])
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = bpe.encode(docs)
    for r in got.collect():
        assert list(r.ids) == reference.encode_ordinary(text[r.doc_id])
    assert all(bytes(r.decoded).decode() == text[r.doc_id] for r in bpe.decode(got).collect())
    for r in bpe.encode(docs, digest=True).collect():
        ids = reference.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert bpe.encode(empty).count() == 0


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = [*odd[:-1], (900, "a <|endoftext|> b", "en"), (901, "x<|startoftext|>Y, <|EndOfText|> <|endoftext|>", "en"), odd[-1]]  # the library knows special tokens in a text
    docs = documents(spark, odd[:-1]).coalesce(1)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in odd[:-1]}
    rows = packing.pack(docs, with_ids=True).collect()
    for i, ids in want.items():
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert list(itertools.chain(*(p.ids for p in pieces))) == ids and all(p.doc_tokens == len(ids) for p in pieces)
        assert [p.start for p in pieces] == list(itertools.accumulate([0, *(p.length for p in pieces[:-1])]))
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at == packing.CAPACITY or at & (at - 1) == 0
    assert packing.pack(empty).count() == 0
    assert packing.pack(documents(spark, [odd[5], odd[5]])).count() >= 2


def test_pieces_of_equal_lengths():
    for lengths in ([], [1], [4096], [4097, 1], [100] * 500, [3000] * 9, [9000, 5, 5]):
        pieces = packing.plan_pieces(lengths)
        assert sum(p[2] for p in pieces) == sum(lengths)
        assert [sum(p[2] for p in pieces if p[0] == d) for d in range(len(lengths))] == lengths


def brute_plan(lengths, capacity):
    """Each document to the lowest-cost sequence of all that have room, cut only where none has; (document, start, sequence, length)."""
    out, rest, full = [], [], 0
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            out.append((d, k * capacity, full, capacity))
            full += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    total = sum(n for n, _, _ in rest)
    room = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if (total % capacity) >> b & 1]
    costs, cut = [0.0] * len(room), []
    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        s = min((s for s in range(len(room)) if room[s] >= n), key=lambda s: (costs[s], s), default=None)
        if s is None:
            cut.append(d)
            continue
        out.append((d, start, full + s, n))
        room[s] -= n
        costs[s] += packing.cost(n)
    return out, cut


def test_pieces_by_brute_force():
    """More sequences than one would look at in turn, the cheap ones among them nearly full."""
    rng = random.Random(17)
    for capacity, lengths in [
        (64, [rng.randint(1, 150) for _ in range(60)]), (64, [33] * 40 + [20] * 40 + [1] * 9), (256, [rng.choice([3, 40, 90, 140, 255]) for _ in range(500)]),
        (4096, [int(rng.lognormvariate(6, 1.3)) + 1 for _ in range(1500)]), (4096, [rng.randint(1, 4095) for _ in range(800)]),
    ]:
        want, cut = brute_plan(lengths, capacity)
        pieces = packing.plan_pieces(lengths, capacity)
        assert {p[0] for p in pieces if p[0] not in cut and p[2] < lengths[p[0]] % capacity} == set()
        assert sorted((d, start, s, n) for d, start, n, s, _ in pieces if d not in cut) == sorted(w for w in want if w[0] not in cut)
        assert [sum(p[2] for p in pieces if p[0] == d) for d in range(len(lengths))] == lengths


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(set(ids)), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def hold_near_duplicates(spark, rows):
    sets = {i: minhash.shingles(minhash.words_of(t)) for i, t, _ in rows}
    want = brute_components(sets, lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r


def test_near_duplicates(spark, odd, empty):
    hold_near_duplicates(spark, odd)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_in_long_lists(spark, words, monkeypatch):
    """A large group of near copies and unrelated texts that share a long passage, with lists that count as long early."""
    monkeypatch.setattr(minhash, "HOT", 4)
    rng = random.Random(9)
    base, passage = rng.choices(words, k=80), rng.choices(words, k=60)
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(50)}"
        rows.append((i, " ".join(w), "en"))
    rows += [(100 + i, " ".join(passage + rng.choices(words, k=rng.choice([5, 10, 40, 90]))), "en") for i in range(30)]
    hold_near_duplicates(spark, rows)


@pytest.mark.parametrize(("block_rows", "sizes"), [(4096, (500, 150)), (40, (160, 60))])
def test_near_duplicates_in_large_groups(spark, words, monkeypatch, block_rows, sizes):
    """Two groups of hundreds of near copies, whose members stand on either side of the threshold, and cut versions."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", block_rows)
    rng = random.Random(29)
    rows = []
    for start, size, most in ((0, sizes[0], 9), (1000, sizes[1], 14)):
        base = rng.choices(words, k=120)
        for i in range(size):
            w = list(base)
            for _ in range(rng.randint(0, most)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10_000)}"
            if i % 7 == 0:
                at = rng.randrange(80)
                del w[at : at + rng.randint(1, 40)]
            rows.append((start + i, " ".join(w), "en"))
    hold_near_duplicates(spark, rows)


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(i, list(map(float, x))) for i, x in enumerate(base)]
    rows += [(100 + i, list(map(float, base[i % 6] + rng.normal(size=16) * 0.05))) for i in range(40)]
    rows += [(200 + i, list(map(float, base[0]))) for i in range(5)] + [(300, [0.0] * 16), (301, None), (302, [1.0, None]), (303, [float("nan")] * 16), (304, []), (305, [1.0, 2.0])]
    good = {i: vectors.unit(x) for i, x in rows}
    linked = lambda a, b: good[a] is not None and good[b] is not None and len(good[a]) == len(good[b]) and float(good[a] @ good[b]) >= 0.9
    want = brute_components([i for i, _ in rows], linked)
    items = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, row int, bucket long")
    found, there = 0, 0
    for r in vectors.near_duplicates(items).collect():
        n = sum(linked(r.vec_id, o) for o, _ in rows if o != r.vec_id)
        assert r.n_links <= n
        found, there = found + r.n_links, there + n
        assert r.kept == (r.component_id == r.vec_id)
        if n == 0:
            assert r.component_id == r.vec_id
    assert found >= 0.9 * there > 0
    assert vectors.near_duplicates(items.limit(0)).count() == 0
    assert sum(want[i] != i for i, _ in rows) > 0


@pytest.mark.parametrize("turns", [1, 4])
def test_recall_of_vectors(spark, monkeypatch, turns):
    """Ten thousand vectors with planted links just above the threshold, held to brute force, with more turns than so few need."""
    monkeypatch.setattr(vectors, "PER_BUCKET", {1: 128, 4: 1 / 1000}[turns])
    rng = np.random.default_rng(turns)
    base = rng.normal(size=(7000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(3000, 64))
    side -= (side * base[:3000]).sum(1, keepdims=True) * base[:3000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate((base, 0.901 * base[:3000] + (1 - 0.901**2) ** 0.5 * side))
    want = (x @ x.T >= 0.9).sum(1) - 1
    got = vectors.near_duplicates(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()
    n = np.zeros(len(x), int)
    for r in got:
        n[r.vec_id] = r.n_links
    assert (n <= want).all() and n.sum() >= 0.98 * want.sum() > 0


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.choice([-0.5, 0.1, 0.3], 4)]) for i in range(120)] + [(500, None), (501, [float("inf")] * 4), (502, [0.1, 0.2])]
    items = spark.createDataFrame([(i, x, 7) for i, x in rows], "vec_id long, embedding array<double>, low int")
    fine = {i: [math.floor(256 * y) for y in x] for i, x in rows if x and all(map(math.isfinite, x))}
    got = {}
    for r in topk.top_k(items, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in (i for i in fine if i % 50 == 0):
        best = sorted((-sum(map(int.__mul__, fine[q], fine[c])), c) for c in fine if c != q and len(fine[c]) == len(fine[q]))[:5]
        assert got[q] == {n: (c, -s) for n, (s, c) in enumerate(best, 1)}
    assert topk.top_k(items.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("left", [10_000, 2])
def test_top_k_of_odd_rows(spark, monkeypatch, left):
    """A query whose length no other row has, components of any size, repeated rows and query ids, ties; blocks of a few rows."""
    monkeypatch.setattr(topk, "LEFT", left)
    monkeypatch.setattr(topk, "CANDIDATES", 4)
    monkeypatch.setattr(topk, "AT_ONCE", 3)
    rows = [(0, [1.0, 2.0, 3.0]), (50, [1e9, 1.0]), (1, [1e9, -1.0]), (2, [-1e9, 0.0]), (3, [0.5, 0.25]), (100, [1e200, 1.0]), (4, [1e308, 1e308]), (150, [0.5, 0.5]), (150, [0.25, 0.5]), (5, [0.5, 0.25]), (5, [0.5, 0.25]), (6, [0.5, 0.25])]
    rows += [(600 + i, [1e200 * (1 + i % 4 / 8), -1.0]) for i in range(9)] + [(700 + i, [-1e150 * (1 + i % 3), 2.0]) for i in range(9)] + [(650, [-1e300, 3.0]), (800, [1.7e308, -1.7e308]), (801, [float("inf"), 0.0])]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = lambda v: [int(y) * 256 if abs(y) > 2**53 else math.floor(256 * y) for y in v]
    fine = [(i, ints(v)) for i, v in rows if i != 801]
    asked = {50: rows[1][1], 100: rows[5][1], 150: rows[8][1], 600: [1e200, -1.0], 650: [-1e300, 3.0], 700: [-1e150, 2.0], 800: [1.7e308, -1.7e308]}
    got = {}
    for r in topk.top_k(items, F.col("vec_id") % 50 == 0, k=6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(asked)
    clip = lambda x, most: max(-most, min(most, x))
    for q, found in got.items():
        v = ints(asked[q])
        best = sorted((-sum(map(int.__mul__, v, c)), i) for i, c in fine if i != q and len(c) == len(v))[:6]
        assert sorted(found) == [(n, i, clip(-s, 2**63 - 1)) for n, (s, i) in enumerate(best, 1)]


def test_texts_that_sort_as_numbers():
    numbers = [0, 5, -5, 10**40, -(10**40), 10**40 + 1, -(10**41), 9 * 10**39, 123 * 10**600, -123 * 10**600, -122 * 10**600]
    assert sorted(numbers, key=topk.sortable) == sorted(numbers)


def brute_scores(rows, order=3, alpha=0.4, least=2):
    from collections import Counter

    texts = [minhash.words_of(t) for _, t, _ in rows]
    counts = Counter(tuple(w[i : i + n]) for w in texts for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, texts))
    out = []
    for w in texts:
        s = 0.0
        for i in range(len(w)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1 or counts[g] >= least:
                    s += math.log(alpha ** (longest - n) * counts[g] / (counts[g[:-1]] if n > 1 else total))
                    break
        out.append(s)
    return out


def test_language_model(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(ngram, "BLOCK_BYTES", 2000)
    got = sorted((r.doc_id, r.log_score) for r in ngram.scores(documents(spark, odd)).collect())
    want = sorted((i, s) for (i, _, _), s in zip(odd, brute_scores(odd), strict=True))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want])
    assert ngram.scores(empty).count() == 0


class Here:
    """Stands in for a DataFrame: runs Arrow functions in this process, and notes the most that each held, by its name."""

    def __init__(self, table, peaks, key=None, other=None):
        self.table, self.peaks, self.key, self.other = table, peaks, key, other

    def run(self, f, *given):
        tracemalloc.start()
        try:
            return [b for out in [f(*given)] for b in (out.to_batches() if isinstance(out, pa.Table) else out)]
        finally:
            self.peaks[f.__name__] = max(self.peaks.get(f.__name__, 0), tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()

    def agg(self, _):
        return self

    def first(self):
        return (sum(self.table.column("n_words").to_pylist()),)

    def drop(self, *names):
        return Here(self.table.drop_columns(list(names)), self.peaks)

    def groupBy(self, key):
        return Here(self.table, self.peaks, key)

    def cogroup(self, other):
        return Here(self.table, self.peaks, self.key, other)

    def mapInArrow(self, f, _):
        return Here(pa.Table.from_batches(self.run(f, self.table.to_batches())), self.peaks)

    def applyInArrow(self, f, _):
        of = lambda df, k: df.table.filter(pc.equal(df.table.column(df.key), k))
        keys = self.table.column(self.key).unique()
        return Here(pa.Table.from_batches([b for k in keys for b in self.run(f, of(self, k) if self.other else k, of(self.other or self, k))]), self.peaks)


def scores_here(docs, monkeypatch):
    """doc_id and log_score in order, the most bytes that each function of the language model held, and the blocks."""
    peaks, blocks = {}, ngram.block_table(docs).toArrow()
    monkeypatch.setattr(ngram, "block_table", lambda _: Here(blocks, peaks))
    got = ngram.scores(docs).table
    return sorted(zip(got.column("doc_id").to_pylist(), got.column("log_score").to_pylist(), strict=True)), peaks, blocks


def test_language_model_by_slices(spark, odd, monkeypatch):
    for name, value in {"BLOCK_BYTES": 2000, "BUCKET_NGRAMS": 50, "SLICE": 7, "ADDED": 16, "RANGES": 5}.items():
        monkeypatch.setattr(ngram, name, value)
    got, _, blocks = scores_here(documents(spark, odd), monkeypatch)
    assert len(blocks) > 2 and sum(blocks.column("n_words").to_pylist()) > 50 * ngram.RANGES
    want = sorted((i, s) for (i, _, _), s in zip(odd, brute_scores(odd), strict=True))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


def test_language_model_holds_a_few_numbers_a_word(spark, monkeypatch):
    monkeypatch.setattr(ngram, "BUCKET_NGRAMS", 20_000)
    monkeypatch.setattr(ngram, "SLICE", 1 << 13, raising=False)
    draw = np.random.default_rng(5).zipf(1.3, (10, 20_000)) % 30_000
    rows = [(i, " ".join(map(str, x)), "en") for i, x in enumerate(draw.tolist())]
    got, peaks, blocks = scores_here(documents(spark, rows).coalesce(1), monkeypatch)
    assert len(blocks) == 1 and np.allclose([s for _, s in got], brute_scores(rows))
    assert peaks["ask"] < 40 * draw.size and peaks["settle"] < 60 * draw.size


def test_language_model_cuts_blocks_of_short_words(spark, monkeypatch):
    monkeypatch.setattr(ngram, "BLOCK_WORDS", 1000, raising=False)
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices("abcdef", k=i % 7 * 50)), "en") for i in range(60)]
    got, _, blocks = scores_here(documents(spark, rows).coalesce(1), monkeypatch)
    sizes = blocks.column("n_words").to_pylist()
    assert len(set(blocks.column("block").to_pylist())) == len(sizes) > 5 and max(sizes) < 1300
    assert [i for i, _ in got] == list(range(60)) and np.allclose([s for _, s in got], brute_scores(rows))


def test_language_model_adds_up_a_bucket_a_part_at_a_time(monkeypatch):
    rng = np.random.default_rng(6)
    asked = [np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64)) for n in (0, 100_000, 1, 200_000)] + [np.array([5], np.uint64)] * 2
    asked[3] = np.unique(np.concatenate((asked[3], asked[1][::3])))
    given = [rng.integers(1, 9, len(a)).astype("<u4") for a in asked]
    counts = Counter()
    for a, g in zip(asked, given, strict=True):
        counts.update(dict(zip(a.tolist(), g.tolist(), strict=True)))
    monkeypatch.setattr(ngram, "ADDED", 1 << 13)
    tracemalloc.start()
    got = ngram.added(asked, given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [g.tolist() for g in got] == [[counts[h] for h in a.tolist()] for a in asked]
    assert peak < 12 * sum(map(len, asked))
    assert [len(g) for g in ngram.added([asked[0]], [given[0]])] == [0]


def test_licenses(spark, empty):
    texts = ["Prose.\nReleased under the MIT License.", "mit der Zeit\nund mit ihm", "You need a license to drive.", "Licensed under CC BY-NC 4.0.", None, "", "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0."]
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in licenses.scan(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert got == {(0, 1): ("mit", True), (2, 0): ("unknown", False), (3, 0): ("cc-by-nc", True), (6, 0): ("apache-2.0", True)}
    assert licenses.scan(empty).count() == 0
    model = licenses.train()
    for r in licenses.scan(documents(spark, [(1, "This work is licensed under the GNU General Public License, version 3.", None)])).collect():
        assert r.probability == pytest.approx(float(model.probabilities("This work is licensed under the GNU General Public License, version 3.").max()))


def test_license_paragraphs(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following\n * conditions are met."
    mpl = "# This Source Code Form is subject to the terms of the Mozilla Public License, v.\n# 2.0."
    texts = [
        "Distributed under the terms of the GPLv3.", "Released under LGPL 2.1", "Redistributions of source code must retain the above copyright notice", "THE SOFTWARE IS PROVIDED AS IS, ...", "Title\n\n" + bsd, mpl,
        "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0\nThis work is licensed under the GNU\nGeneral Public License, version 3.",
    ]
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in licenses.scan(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert got == {
        (0, 0): ("gpl-3.0", True), (1, 0): ("lgpl-2.1", True), (2, 0): ("bsd", True), (3, 0): ("mit", True), (4, 2): ("bsd", True), (5, 0): ("mpl-2.0", True),
        (6, 0): ("mit", True), (6, 1): ("apache-2.0", True), (6, 2): ("gpl-3.0", True),
    }


UNSEEN = {
    "This library is covered by the GNU Lesser General Public License, version 2.1.": "lgpl-2.1", "Available under the GNU Affero General Public License v3": "agpl-3.0", "Released under LGPL 2.1": "lgpl-2.1",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)": "bsl-1.0", "This program and the accompanying materials are made available under the Eclipse Public License 2.0": "epl-2.0",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "isc", "under the terms of the GNU General Public License version 2 only": "gpl-2.0",
    "To the extent possible under law, the person has waived all copyright to this file, CC0 1.0 Universal": "cc0-1.0", "see the Mozilla Public License for details": "mpl-2.0",
    "Permission is hereby granted to visitors to enter the garden.": "unknown", "He studied at MIT.": "unknown", "some words here": "unknown", "The licence of the inn was renewed.": "unknown",
}


def test_license_notices_that_no_template_holds(spark):
    model = licenses.train()
    texts = list(UNSEEN)
    assert not set(texts) & {t for rows in licenses.examples() for t, _ in rows}
    assert {t: model.families[int(model.probabilities(t).argmax())] for t in texts} == UNSEEN
    got = {r.doc_id: (r.family, r.probability) for r in licenses.scan(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        if UNSEEN[t] != "unknown":
            assert got[i] == (UNSEEN[t], pytest.approx(float(model.probabilities(t).max())))


# Sentences in frames that neither training nor calibration has.
FRAMES = ["This package ships under {}; see COPYING.", "You may copy this text as {} allows.", "// {}", "Terms: {}."]
PROSE = ["Many {} were sold last year.", "The word {} is found in old books.", "Nobody at the office likes {} very much.", "A {} is what he asked for."]
FAR = ["The Apache helicopter landed near Boost mobile store.", "The software is provided by the vendor under a commercial agreement.", "The BSD operating system was developed at Berkeley.", "Zlib compresses the data.", "Open Software License version 3.0", "The lease was signed under the law of the state.", "He works for the Mozilla office in Paris."]


def test_license_probabilities_can_be_relied_on():
    """On held-out sentences, licences and prose with the same words, confidence is near the share that is right."""
    model = licenses.train()
    families = list(model.families)
    seen = {t for rows in licenses.examples() for t, _ in rows}
    rows = [(f.format(n), k) for k, family in enumerate(families[:-1]) for n in licenses.NAMES[family] for f in FRAMES]
    words = sorted({w for t in (*(n for ns in licenses.NAMES.values() for n in ns), *(t for ts in licenses.TEXTS.values() for t in ts)) for w in licenses.tokens(t)})
    alone = {w[0] for ns in licenses.NAMES.values() for n in ns if len(w := licenses.tokens(n)) == 1}
    rows += [(PROSE[i % len(PROSE)].format(w), len(families) - 1) for i, w in enumerate(words) if w not in alone]
    rows += [(t, len(families) - 1) for t in FAR]
    assert len(rows) > 500 and not seen & {t for t, _ in rows}
    p, truth = np.array([model.probabilities(t) for t, _ in rows]), np.array([k for _, k in rows])
    sure, right = p.max(1), p.argmax(1) == truth
    assert right.mean() > 0.95 and -np.log(p[np.arange(len(rows)), truth] + 1e-12).mean() < 0.25
    error = 0.0
    for low, high in ((0, 0.6), (0.6, 0.8), (0.8, 0.95), (0.95, 0.995), (0.995, 2)):
        some = (sure >= low) & (sure < high)
        if some.any():
            error += some.mean() * abs(sure[some].mean() - right[some].mean())
    assert error < 0.05
    assert all(model.probabilities(t)[:-1].max() < 0.9 for t in FAR)


def brute_scan(text, model):
    """Paragraphs, family, probability and similarity of a text from their definitions."""
    import re

    pairs_of = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
    texts = [q for ts in licenses.TEXTS.values() for t in ts if (q := set(licenses.pairs(licenses.tokens(t))))]
    names = [q for f in licenses.NAMES for t in licenses.named(f) if (q := set(licenses.pairs(licenses.tokens(t))))]

    def whole(line):
        x = pairs_of(licenses.tokens(line))
        return any(len(q & x) >= licenses.CONFIRM * len(q) for q in texts) or any(q <= x for q in names)

    lines = text.split("\n")
    out, start = [], 0
    blank = lambda x: not any(c.isalnum() for c in x)
    opens = lambda x: (c := re.sub(r"^[\W_]*", "", x)[:1]) != "" and c.isupper()
    for i in range(1, len(lines) + 1):
        a, b = lines[i - 1], lines[i] if i < len(lines) else ""
        if i == len(lines) or blank(a) or blank(b) or (re.search(r"[.!?][\"')\]]*\s*$", a) and opens(b)) or whole(a) or whole(b):
            out.append((start, "\n".join(lines[start:i])))
            start = i
    found = []
    for at, paragraph in out:
        words = licenses.tokens(paragraph)
        p = model.probabilities(paragraph)
        family = model.families[int(p.argmax())]
        if family == "unknown" and not set(words) & set(licenses.CUES):
            continue
        g = licenses.grams(words)
        similarity = max((len(set(q) & g) / len(q) for q in licenses.templates().get(family, [])), default=0.0)
        found.append((at, family, round(float(p.max()), 6), round(similarity, 6), similarity >= licenses.CONFIRM))
    return found


def test_license_scan_by_hand(spark):
    """Cutting, gate, family, probability and similarity of whole texts."""
    rng, model = random.Random(41), licenses.train()
    parts = ["Prose of no kind", "it goes on.", "", "  ", "MIT", "Released under the MIT License.", "license", "The Apache helicopter landed.", "# a comment", "* All rights reserved", "GPLv3", "Zlib compresses", "of the data!", '"Quoted."', "Él dijo"]
    parts += [w for ts in list(licenses.TEXTS.values())[:8] for t in ts for w in (t, t[: len(t) // 2], t[len(t) // 2 :])] + [n for ns in licenses.NAMES.values() for n in ns[:1]]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    got = {}
    for r in licenses.scan(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, round(r.probability, 6), round(r.similarity, 6), r.confirmed))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_scan(t, model), t


def test_license_scan_of_odd_rows(spark):
    """Ties, repeated rows, a very long line, columns named like the operator's own."""
    notice = "Released under the MIT License."
    rows = [(1, notice), (1, notice), (2, "word " * 60_000 + "license"), (3, notice + "\n" + notice), (4, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, 1, "l", 2.0, [1]) for i, t in rows], "doc_id long, text string, paragraph int, line string, p double, w array<int>")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(docs).collect())
    assert got == [(1, 0, "mit"), (1, 0, "mit"), (2, 0, "unknown"), (3, 0, "mit"), (3, 1, "mit")]
    even = licenses.Model(("a", "b", "unknown"), ("zeta",), np.array([[9.0, 9.0, 0.0]]), np.array([0.0, 0.0, 1.0]), 1.0)
    assert [r.family for r in licenses.scan(docs.select("doc_id", F.lit("zeta").alias("text")).limit(1), even).collect()] == ["a"]


def test_license_gate_passes_every_family():
    model, rng = licenses.train(), random.Random(19)
    gate = set(model.gate())
    words = sorted({w for f in model.features for w in f.split()} - gate)
    whole = [" ".join(words), " ".join(f for f in model.features if not gate & set(f.split()))]
    assert all(model.families[int(model.probabilities(t).argmax())] == "unknown" for t in whole)
    for _ in range(2000):
        text = " ".join(rng.choices(words, k=rng.choice([1, 3, 10, 200])))
        assert gate & licenses.grams(text.split()) or model.families[int(model.probabilities(text).argmax())] == "unknown"


def test_segments_are_maximal():
    rng = random.Random(2)
    for _ in range(300):
        w = np.array([rng.choice([-3, -1, 1, 2, 4]) for _ in range(rng.randint(1, 12))], float)

        def maximal(lo, hi, w=w):
            """The definition: the best-scoring run, then those left and right of it."""
            runs = [(float(w[i:j].sum()), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
            if not runs or max(runs)[0] <= 0:
                return []
            s, _, i, j = max(runs, key=lambda r: (r[0], r[1], -r[2]))
            return [*maximal(lo, i), s, *maximal(j, hi)]

        assert sum(s for _, _, s in toxicity.maximal_segments(w)) == pytest.approx(sum(maximal(0, len(w))))


def test_toxicity(spark, odd, words, empty):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(400):
        w = rng.choices(words, k=60)
        if i % 5 == 0:
            for _ in range(6):
                w[rng.randrange(60)] = rng.choice(["vilest", "rottenest", "cursedly"])
        rows.append((i, " ".join(w), "en"))
        marks.append((i, 1, int(i % 5 == 0)))
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    scored = toxicity.score(docs, model, passages=True).collect()
    assert sum((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in scored) >= 0.97 * len(rows)
    assert any(r.passages for r in scored if r.doc_id % 5 == 0)
    assert all(0 <= r.score < 0.7 for r in toxicity.score(documents(spark, odd), model).collect())
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_quality(spark, odd, words, empty):
    rng = random.Random(12)
    rows = [(i, " ".join(w.upper() + "!!" if i % 4 == 0 else w for w in rng.choices(words, k=50)), "en") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = quality.fit(docs, labels.where(crc_mod(F.col("doc_id"), 3) != 1))
    assert all((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in quality.score(docs, model).collect())
    assert all(0 <= r.score <= 1 for r in quality.score(documents(spark, odd), model).collect())
    assert quality.score(empty, model).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect())


def test_top_word_counts_the_whole_text():
    at = quality.STATISTICS.index("top_word")
    share = lambda text: quality.statistics(text)[at]
    assert share(" ".join(["one", "two"] * 500)) == 0.5
    assert share(" ".join(f"w{i}" if i % 50 == 0 else "often" for i in range(20_000))) == 0.98
    assert share("a b c") == pytest.approx(1 / 3) and share(" \n ") == 0.0 and share("a " * 900) == 1.0


def brute_word(model, word):
    out = []
    for k in range(len(model.languages)):
        p = {s: model.probability[i, k] for i, s in enumerate(model.pieces.pieces)}
        text, forward = langid.MARK + word, [1.0]
        for e in range(1, len(text) + 1):
            forward.append(forward[e - 1] * langid.UNSEEN + sum(forward[b] * p.get(text[b:e], 0.0) for b in range(e)))
        out.append(math.log(forward[-1]))
    return out


def test_language_identification(spark, odd, empty):
    rng = random.Random(13)
    lists = {"en": "the and of with this that from have".split(), "de": "der und mit nicht ein auch sich wird".split(), "fr": "le et avec dans pour une est que".split()}
    rows = [(i, " ".join(rng.choices(lists[g], k=30)), g) for i in range(120) for g in [("en", "de", "fr")[i % 3]]]
    docs = documents(spark, rows)
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in langid.predict(docs, model, ["doc_id", "lang"]).collect())
    assert np.allclose(model.word_scores(["that", "nicht", "x", "qqqq"]), [brute_word(model, w) for w in ("that", "nicht", "x", "qqqq")])
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents(spark, odd), model).collect()}
    assert told[0] == told[1] == told[2] == told[7] == ("und", 0.0) and told[8][0] != "und"
    assert langid.predict(empty, model).count() == 0
    assert langid.fit(empty) is None and {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_pipeline(spark, tmp_path, words):
    import corpus_pipeline

    rng = random.Random(14)
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(60)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(100, texts[3], "en"), (101, texts[4] + " more", "en"), (102, None, None), (103, "123", "en")]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == set(range(60))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
