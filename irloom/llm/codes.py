"""Vector codes by product quantisation, with codebooks kept up by changes.

A vector is cut into PARTS equal consecutive parts, and each part is replaced by the number
of its nearest codebook entry. Codebooks are moved by Lloyd's rounds, exactly, in whole
numbers. What a round needs is kept in the shared folder: each vector's last assignment lies
beside it in one table, and the sums and counts of all entries are running totals in another. A round
writes the new assignment next to the last one; then only parts whose entry changed give
a contribution, plus to the new entry and minus to the old one. Tasks add these up before
the shuffle, so it carries a row for each entry and component, whatever the input's size. The
driver reads codebooks and totals, whose size is fixed by ENTRIES and the vector's length.

Arithmetic is exact at any magnitude: matrices of doubles while squared distances stay
below 2^53, whole numbers of any length beyond; totals travel in limbs of LIMB bits.

Cases: rows whose vector is null or holds a null or non-finite component are dropped; equal
distances go to the lower entry; vectors of another length have codebooks of their own, learned
from vectors of that length; where 16 does not divide the length, part p begins at
floor(p * length / 16), and an empty vector has entry 0 everywhere; with fewer vectors than ENTRIES
there are fewer entries; null ids come last among the first, and repeated ids go by their vectors;
repeated rows count each; an error above 2^63 - 1 is given as that; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from irloom.llm.common import cut, cut_at, discard

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMB = 24
#: Squared distances below this are exact in double precision.
EXACT = float(1 << 53)
LONGEST = (1 << 63) - 1
#: Rows compared with the entries at a time, and groups in which the first ids are looked for.
CHUNK, GROUPS = 4096, 256
#: Totals by label are broadcast up to so many labels; beyond it they are joined with SALTS salts.
BROADCAST_LABELS, SALTS = 50_000, 32

Books = dict[int, list[list[list[int]]]]  # length -> part -> entry -> components


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def whole(x: np.ndarray) -> np.ndarray:
    """Whole-valued doubles as Python's whole numbers."""
    return np.array([int(c) for c in x.ravel()], object).reshape(x.shape)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries; objects only where doubles would round."""
    width = x.shape[1]
    if x.dtype != object and book.dtype != object:
        most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
        if 4 * max(width, 1) * most * most < EXACT:
            return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    a, b = (m if m.dtype == object else whole(m) for m in (x, book))
    out = np.zeros((len(a), len(b)), object)
    for j in range(width):
        out = out + (a[:, j, None] - b[None, :, j]) ** 2
    return out


def near(x: np.ndarray) -> np.ndarray:
    """Rows whose distances to entries like them are exact in doubles."""
    return 4 * max(x.shape[1], 1) * np.square(np.abs(x).max(1, initial=0)) < EXACT


def matrices(batch: pa.RecordBatch):
    """(row numbers, matrix) of a batch, by length; rows too far for doubles come apart, as whole numbers."""
    v, far = batch.column(batch.schema.get_field_index("v")), batch.column(batch.schema.get_field_index("far"))
    sizes = np.diff(np.asarray(v.offsets))
    flat, starts = np.asarray(v.values, float), np.asarray(v.offsets)[:-1]
    beyond = np.asarray(far.is_valid())
    for dim in np.unique(sizes):
        rows = np.flatnonzero((sizes == dim) & ~beyond)
        for at in range(0, len(rows), CHUNK):
            some = rows[at : at + CHUNK]
            x = flat[starts[some, None] + np.arange(dim)]
            ok = near(x)
            if ok.any():
                yield some[ok], x[ok]
            if not ok.all():
                yield some[~ok], whole(x[~ok])
        if len(some := np.flatnonzero((sizes == dim) & beyond)):
            yield some, np.array([[int(c) * SCALE if abs(c) >= 1 << 53 else int(np.floor(c * SCALE)) for c in far[int(i)].as_py()] for i in some], object).reshape(len(some), dim)


def as_array(entries: list[list[int]]) -> np.ndarray:
    small = all(abs(c) < 1 << 53 for e in entries for c in e)
    return np.array(entries, float if small else object).reshape(len(entries), -1)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label and v, the components' floor(256 * x) as whole-valued doubles; `far` has the vector itself where that is past a double."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: c * float(SCALE)
    floor = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    huge = F.exists(x, lambda c: F.abs(c) >= 2.0**1000)
    rows = vectors.where(x.isNotNull() & finite)
    return rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(x, lambda c: F.when(F.abs(c) >= 2.0**1000, F.lit(0.0)).otherwise(floor(scaled(c)))).alias("v"), F.when(huge, x).alias("far"))


def first_books(rows: DataFrame, parts: int, entries: int) -> Books:
    """Codebooks of the first ids, by length. Groups of tasks find theirs first, so one task sees GROUPS * entries rows at most."""
    order = [F.col("id").asc_nulls_last(), "v", "far"]
    pool = rows.select("id", "v", "far", F.size("v").alias("dim"), (F.spark_partition_id() % GROUPS).alias("g"))
    for by in (["dim", "g"], ["dim"]):
        pool = pool.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("n") <= entries)
    found = defaultdict(dict)
    for r in pool.select("dim", "n", "v", "far").collect():
        far = r.far or [None] * r.dim
        found[r.dim][r.n] = [int(c) if f is None else int(f) * SCALE if abs(f) >= 1 << 53 else int(np.floor(f * SCALE)) for c, f in zip(r.v, far, strict=True)]
    return {dim: [[by_n[n][a:b] for n in sorted(by_n)] for a, b in bounds(dim, parts)] for dim, by_n in found.items()}


def assign(rows: DataFrame, books: Books, parts: int, keep: bool = True) -> DataFrame:
    """The rows with `code`, a byte a part, and the one before it as `was`; without keep, with `error` in place of vectors."""

    def run(batches):
        arrays = {dim: [as_array(b) for b in bs] for dim, bs in books.items()}
        for batch in batches:
            codes, errors, dims = np.zeros((batch.num_rows, parts), np.uint8), [0] * batch.num_rows, np.zeros(batch.num_rows, np.int32)
            for at, x in matrices(batch):
                total, dims[at] = np.zeros(len(at), object), x.shape[1]
                for p, (a, b) in enumerate(bounds(x.shape[1], parts)):
                    d = distances(x[:, a:b], arrays[x.shape[1]][p])
                    best = np.array([min(range(len(r)), key=r.__getitem__) for r in d]) if d.dtype == object else d.argmin(1)
                    codes[at, p] = best
                    if not keep:
                        mine = d[np.arange(len(at)), best]
                        total = total + (mine if mine.dtype == object else mine.astype(np.int64))
                for i, e in zip(at, total, strict=True):
                    errors[i] = min(int(e), LONGEST)
            got = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            new = pa.array([c.tobytes() for c in codes], pa.binary())
            if keep:
                yield pa.RecordBatch.from_arrays([got["id"], got["label"], got["v"], got["far"], new, got["code"]], names=["id", "label", "v", "far", "code", "was"])
            else:
                yield pa.RecordBatch.from_arrays([got["id"], got["label"], pa.array(dims), new, pa.array(errors, pa.int64())], names=["id", "label", "dim", "code", "error"])

    kinds = dict(rows.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, "
    return rows.mapInArrow(run, schema + ("v array<double>, far array<double>, code binary, was binary" if keep else "dim int, code binary, error long"))


def limbs(n: int) -> list[tuple[int, int]]:
    """The number as (place, digit) in base 2^LIMB, every digit with its sign."""
    sign, n, out = (-1 if n < 0 else 1), abs(n), []
    while n:
        out.append((len(out), sign * (n & ((1 << LIMB) - 1))))
        n >>= LIMB
    return [(k, d) for k, d in out if d]


def changes(rows: DataFrame, parts: int, entries: int) -> DataFrame:
    """dim, part, entry, position (-1: the count), limb and amount: what changed parts add to the running totals."""

    def run(batches):
        sums, counts, beyond = {}, {}, defaultdict(int)
        for batch in batches:
            code, was = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("code", "was"))
            for at, x in matrices(batch):
                dim = x.shape[1]
                new = np.frombuffer(b"".join(code[i] for i in at), np.uint8).reshape(-1, parts)
                had = np.array([was[i] is not None for i in at])
                old = np.frombuffer(b"".join(was[i] if was[i] is not None else bytes(parts) for i in at), np.uint8).reshape(-1, parts)
                total, count = sums.setdefault(dim, np.zeros((entries, dim), np.int64)), counts.setdefault(dim, np.zeros((parts, entries), np.int64))
                for p, (a, b) in enumerate(bounds(dim, parts)):
                    moved = ~had | (new[:, p] != old[:, p])
                    for sign, which, entry in ((1, moved, new[:, p]), (-1, moved & had, old[:, p])):
                        e, y = entry[which], x[which, a:b]
                        np.add.at(count[p], e, sign)
                        if x.dtype == object:
                            for k, row in zip(e, y, strict=True):
                                for j, c in enumerate(row):
                                    beyond[dim, p, int(k), j] += sign * c
                        else:
                            np.add.at(total[:, a:b], e, sign * y.astype(np.int64))
        out = defaultdict(int, beyond)
        for dim, total in sums.items():
            for p, (a, b) in enumerate(bounds(dim, parts)):
                for k in range(entries):
                    out[dim, p, k, -1] += int(counts[dim][p, k])
                    for j in range(a, b):
                        out[dim, p, k, j - a] += int(total[k, j])
        flat = [(*key, place, digit) for key, n in out.items() for place, digit in limbs(n)]
        if flat:
            types = [pa.int32()] * 5 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), types, strict=True)], names=["dim", "part", "entry", "position", "limb", "amount"])

    moved = rows.where(~F.col("code").eqNullSafe(F.col("was")))
    return moved.mapInArrow(run, "dim int, part int, entry int, position int, limb int, amount long").groupBy(*TOTALS).agg(F.sum("amount").alias("amount"))


TOTALS = ["dim", "part", "entry", "position", "limb"]


def update(books: Books, totals: DataFrame, parts: int) -> Books:
    """Each entry moves to the floor of its mean by the running totals; one without parts stays."""
    sums = defaultdict(int)
    for r in totals.collect():  # a row for each entry, component and limb at most
        sums[r.dim, r.part, r.entry, r.position] += r.amount << (LIMB * r.limb)
    return {
        dim: [[[sums[dim, p, k, j] // n for j in range(b - a)] if (n := sums[dim, p, k, -1]) else entry for k, entry in enumerate(bs[p])] for p, (a, b) in enumerate(bounds(dim, parts))]
        for dim, bs in books.items()
    }


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds the sum of errors over rows of the same label; a label may hold most rows, so its total is broadcast or salted."""
    totals = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(str(LONGEST)).cast("decimal(38,0)")).cast("long").alias("label_error"))
    totals = totals.withColumnRenamed("label", "t_label")
    if totals.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("t_label"))).drop("t_label")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    copies = totals.select("t_label", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t_salt"))
    return dealt.join(copies, F.col("label").eqNullSafe(F.col("t_label")) & (F.col("salt") == F.col("t_salt"))).drop("t_label", "salt", "t_salt")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books]:
    """id, label, dim, code (a byte a part), error and label_error of every vector that takes part, and the final codebooks by length."""
    rows = integers(vectors, id_col, vector_col, label_col)
    state, path = cut_at(rows.withColumn("code", F.lit(None).cast("binary")))
    books, totals = first_books(state, parts, entries), None
    for _ in range(rounds):
        new, new_path = cut_at(assign(state, books, parts))
        discard(state.sparkSession, path)
        state, path = new, new_path
        moved = changes(state, parts, entries)
        totals = cut(moved if totals is None else totals.unionByName(moved).groupBy(*TOTALS).agg(F.sum("amount").alias("amount")))
        books = update(books, totals, parts)
    done, _ = cut_at(assign(state, books, parts, keep=False))
    discard(state.sparkSession, path)
    return with_label_error(done), books


def book_digest(book: list[list[list[int]]]) -> str:
    """Hash of one length's codebooks: decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for part in book for entry in part for c in entry).encode()).hexdigest()
