"""Vector codes against whole-number Lloyd rounds written out, odd rows included."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest

from irloom.llm import codes


def brute(rows, parts=16, entries=64, rounds=2):
    """id -> (code, error), label totals and the digest, for vectors of one length, from the definition."""
    kept = [(i, label, [math.floor(Fraction(c) * 256) for c in v]) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cuts = codes.bounds(len(kept[0][2]), parts)
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in cuts]

    def nearest(v):
        return [min((sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)), k) for k, e in enumerate(book)) for (a, b), book in zip(cuts, books, strict=True)]

    for _ in range(rounds):
        own = defaultdict(list)
        for _, _, v in kept:
            for p, ((a, b), (_, k)) in enumerate(zip(cuts, nearest(v), strict=True)):
                own[p, k].append(v[a:b])
        books = [[[sum(c) // len(own[p, k]) for c in zip(*own[p, k], strict=True)] if own[p, k] else e for k, e in enumerate(book)] for p, book in enumerate(books)]
    found, totals = [], defaultdict(int)
    for i, label, v in kept:
        n = nearest(v)
        error = min(sum(d for d, _ in n), codes.LONGEST)
        found.append((i, label, "".join(f"{k:02x}" for _, k in n), error))
        totals[label] += error
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, code, error, min(totals[label], codes.LONGEST)) for i, label, code, error in found), key=repr), digest


def run(spark, rows, kind="double", **more):
    docs = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error int").repartition(5)
    got, books = codes.compress(docs, **more)
    return sorted(((r.id, r.code.hex(), r.error, r.label_error) for r in got.collect()), key=repr), books


def vectors(n, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(7)]
    return [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([None, 0, 1, 2])) for i in range(n)]


def test_codes_of_odd_rows(spark):
    rows = vectors(300, 32, 61)
    rows += [(5, rows[9][1], 1)] * 3 + [(None, rows[11][1], 0), (400, None, 1), (401, [None] + [0.5] * 31, 1), (402, [float("nan")] * 32, 2), (403, [float("inf")] + [0.0] * 31, None)]
    rows += [(-1, rows[17][1], 2), (-2, [0.0] * 32, 2), (-3, [-0.001] * 32, 2)]  # small ids come first; all floors go down
    want, digest = brute(rows)
    got, books = run(spark, rows)
    assert got == want and codes.book_digest(books[32]) == digest


def test_magnitudes_past_doubles_and_longs(spark):
    """Sums, distances and codebooks stay exact; only the error that is returned ends at the largest long."""
    rows = vectors(90, 16, 62)
    rows += [(3000 + k, [s * 1e8] * 16, 1) for k, s in enumerate((1, -1, 1.5))] + [(-7, [1e200, -1e200] * 8, 2), (2000, [3e307] * 16, 0), (2001, [3.1e307] * 16, 0)]
    want, digest = brute(rows)
    got, books = run(spark, rows)
    assert got == want and codes.book_digest(books[16]) == digest


def test_lengths_few_vectors_and_none(spark):
    assert run(spark, []) == ([], {})
    one = vectors(3, 20, 63)  # 16 does not divide 20
    two = [(i + 100, v, c) for i, v, c in vectors(70, 16, 64)]
    got, books = run(spark, [*one, *two, (500, [], 0)], kind="float")
    shorten = lambda rows: [(i, [float(__import__("numpy").float32(c)) for c in v], t) for i, v, t in rows]
    a, b = brute(shorten(one)), brute(shorten(two))
    assert codes.book_digest(books[20]) == a[1] and codes.book_digest(books[16]) == b[1] and set(books) == {0, 16, 20}
    assert {r[:3] for r in got} == {r[:3] for r in (*a[0], *b[0])} | {(500, "00" * 16, 0)}


def test_only_changed_parts_are_sent(spark):
    rows = vectors(200, 32, 65)
    state = spark.createDataFrame([(i, None, v, None, bytes(16), bytes(16)) for i, v, _ in rows], "id long, label int, v array<double>, far array<double>, code binary, was binary")
    assert codes.changes(state, 16, 64).count() == 0
    one = spark.createDataFrame([(1, None, [256.0] * 32, None, bytes([0] * 15 + [3]), bytes([0] * 15 + [7]))], state.schema)
    got = {(r.part, r.entry, r.position): r.amount for r in codes.changes(one, 16, 64).collect()}
    assert got == {(15, 3, -1): 1, (15, 7, -1): -1, (15, 3, 0): 256, (15, 3, 1): 256, (15, 7, 0): -256, (15, 7, 1): -256}


@pytest.mark.parametrize("most", [0, 50_000])
def test_label_totals_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", most)
    rows = vectors(120, 16, 66)
    assert run(spark, rows)[0] == brute(rows)[0]
