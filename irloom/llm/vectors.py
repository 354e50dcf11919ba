"""Near-duplicate vectors by cross-polytope hashing.

Each table turns a vector by three rounds of random signs and a fast Hadamard transform;
the largest coordinate and its sign is the hash, and several turns together make a
bucket. A vector also goes to the buckets it nearly fell in (multiprobe). More vectors
need more turns, which a pair at the threshold survives less often; so the number of
tables follows from the share of random pairs at the threshold that meet in one, and the
chance to meet in some table stays at RECALL for any size. Every pair that shares a
bucket is compared by its cosine, in blocks; it counts in the first bucket that it
shares, so in one alone. Equal vectors form a class with a multiplicity and are never
paired with one another. A bucket of over BLOCK classes is dealt out as pairs of blocks,
so no task holds all of it. Vectors travel to their buckets in single precision; a pair
whose cosine is then too close to the threshold to tell is settled in double precision
from the vectors themselves.

Cases: vectors that are null, empty, zero, or hold a null or non-finite component link
with nothing; vectors of different lengths do not link; ties go to the smallest id; repeated
rows are members of one class; vectors count as equal if their unit vectors are, bit for
bit, and multiples that round apart are linked like any others; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import cut, text_batches
from irloom.llm.components import components

THRESHOLD = 0.9
TABLES, PROBES, DEPTH = 6, 4, 3
#: Chance of a pair at the threshold to meet in some table, and random pairs by which it is measured.
RECALL, TRIALS = 0.995, 1500
BLOCK, ROWS = 2048, 256
#: More than single precision can be off by for unit vectors.
UNSURE = 1e-5
#: Classes a bucket should hold, from which the turns per table follow.
PER_BUCKET = 16
SEED = 20_24
BROADCAST_BUCKETS = 50_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return x / d**0.5


def buckets(x: np.ndarray, turns: int, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """The buckets of unit vectors: a row of tables * probes numbers each, the first of a table's being its own."""
    n, dim = x.shape
    d = 1 << max(0, dim - 1).bit_length()
    padded = np.zeros((n, d))
    padded[:, :dim] = x
    out = np.zeros((n, tables, probes), np.int64)
    depth = min(DEPTH, 2 * d)
    for t in range(tables):
        codes, losses = np.zeros((n, 1), np.uint64), np.zeros((n, 1))
        for k in range(turns):
            rng = np.random.default_rng([SEED, d, t, k])
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, : min(depth, d)]
            best = np.take_along_axis(size, top, 1)
            code = (top * 2 + (np.take_along_axis(y, top, 1) < 0)).astype(np.uint64)
            loss = (best[:, :1] - best) ** 2
            codes = (codes[:, :, None] * np.uint64(2 * d + 1) + code[:, None, :] + np.uint64(1)).reshape(n, -1)
            losses = (losses[:, :, None] + loss[:, None, :]).reshape(n, -1)
            order = np.argsort(losses, axis=1, kind="stable")[:, :probes]
            codes, losses = np.take_along_axis(codes, order, 1), np.take_along_axis(losses, order, 1)
        with np.errstate(over="ignore"):
            mixed = (codes + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64) + np.uint64(dim)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        got = (mixed >> np.uint64(1)).astype(np.int64)
        if got.shape[1] < probes:
            got = np.concatenate((got, np.repeat(got[:, :1], probes - got.shape[1], 1)), 1)
        out[:, t] = got
    return out.reshape(n, -1)


def unit(v: list | None) -> np.ndarray | None:
    """The vector at length 1; None if it takes no part."""
    if not v or None in v:
        return None
    x = np.array(v, float) + 0.0
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def tables_for(turns: int, dim: int, threshold: float) -> int:
    """Tables with which pairs at the threshold meet with probability RECALL; TABLES at least."""
    rng = np.random.default_rng([SEED, turns, dim])
    a, b = rng.normal(size=(2, TRIALS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + (1 - threshold**2) ** 0.5 * np.divide(b, norm, out=np.zeros_like(b), where=norm > 0)
    x, y = buckets(a, turns, 1), buckets(b, turns, 1)
    met = (x[:, :, None] == y[:, None, :]).any((1, 2)).mean()
    return max(TABLES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - min(max(met, 1e-3), 0.999)))))


def first_shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The first bucket, by table, that the rows of p and q (tables by probes) share; -1 for none."""
    same = (p[:, :, :, None] == q[:, :, None, :]).any(3).reshape(len(p), -1)
    return np.where(same.any(1), p.reshape(len(p), -1)[np.arange(len(p)), same.argmax(1)], -1)


def near_pairs(x: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Batches of (positions i, positions j, whether in doubt) of the pairs of left and right at the threshold."""
    inside = left is right
    for start in range(0, len(left), ROWS):
        rows = left[start : start + ROWS]
        cosine = x[rows] @ x[right].T
        i, j = np.nonzero(cosine >= threshold - UNSURE)
        doubt = cosine[i, j] < threshold + UNSURE
        i, j = rows[i], right[j]
        keep = ids[i] < ids[j] if inside else ids[i] != ids[j]
        yield i[keep], j[keep], doubt[keep]


class Groups:
    """Whole groups (pairs of blocks of a bucket) of vectors of one length, settled together."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, turns: int, tables: int):
        self.x, self.ids, self.copies, self.turns, self.tables = x, ids, copies, turns, tables
        self.links, self.low = np.zeros(len(x), np.int64), ids.copy()
        self.doubtful: list[tuple[int, int]] = []
        self.held: list[tuple[np.ndarray, ...]] = []
        self.number_held = 0
        self.own = np.zeros((len(x), tables, PROBES), np.int64)
        self.hashed = np.zeros(len(x), bool)

    def add(self, i: np.ndarray, j: np.ndarray, doubt: np.ndarray, bucket: int) -> None:
        self.held.append((i, j, doubt, np.full(len(i), bucket)))
        self.number_held += len(i)
        if self.number_held >= 1 << 16:
            self.settle()

    def settle(self) -> None:
        """Count the pairs held of which the bucket where they were found is the first that they share."""
        if not self.held:
            return
        i, j, doubt, bucket = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.number_held = [], 0
        new = np.unique(np.concatenate((i, j)))
        new = new[~self.hashed[new]]
        if len(new):
            self.own[new] = buckets(self.x[new].astype(float), self.turns, self.tables).reshape(len(new), self.tables, PROBES)
            self.hashed[new] = True
        mine = np.concatenate([first_shared(self.own[i[at : at + 65_536]], self.own[j[at : at + 65_536]]) == bucket[at : at + 65_536] for at in range(0, len(i), 65_536)])
        i, j, doubt = i[mine], j[mine], doubt[mine]
        self.doubtful += zip(self.ids[i[doubt]].tolist(), self.ids[j[doubt]].tolist(), strict=True)
        i, j = i[~doubt], j[~doubt]
        for a, b in ((i, j), (j, i)):
            np.add.at(self.links, a, self.copies[b])
            np.minimum.at(self.low, a, self.ids[b])


def doubtful_links(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """rep, links and low of the pairs (a, b) that are at the threshold in double precision."""

    def run(batches):
        for batch in batches:
            found = []
            for a, b, ca, cb, va, vb in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if float(np.frombuffer(va, "<f8") @ np.frombuffer(vb, "<f8")) >= threshold:
                    found += [(a, cb, min(a, b)), (b, ca, min(a, b))]
            cols = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rep", "links", "low"])

    side = lambda x: classes.select(F.col("rep").alias(x), F.col("copies").alias(f"c{x}"), F.col("v").alias(f"v{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb", "va", "vb").mapInArrow(run, "rep long, links long, low long")


def near_duplicates(items: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of `items`."""
    spark = items.sparkSession
    text_batches(spark)

    def normal(batches):
        for batch in batches:
            vectors = [unit(v) for v in batch.column(1).to_pylist()]
            raw = [None if v is None else v.astype("<f8").tobytes() for v in vectors]
            sigs = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "sig", "v"])

    rows = items.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = cut(rows.mapInArrow(normal, "vec_id long, sig binary, v binary").withColumn("row", F.monotonically_increasing_id()))
    valid = rows.where("sig IS NOT NULL AND vec_id IS NOT NULL")
    first = cut(valid.groupBy("sig").agg(F.min(F.struct("vec_id", "row")).alias("r"), F.count("*").alias("copies")).select("sig", F.col("r.vec_id").alias("rep"), F.col("r.row").alias("row"), "copies"))
    classes = cut(rows.select("row", "v").join(first.drop("sig"), "row").select("rep", "copies", "v"))
    n = classes.count()
    longest = (classes.agg(F.max(F.octet_length("v"))).first()[0] or 8) // 8
    width = 2 * (1 << max(0, longest - 1).bit_length())
    turns = 1
    while width**turns * PER_BUCKET < n:
        turns += 1
    # Lengths up to one power of two share a transform; the shortest and the longest of each are tried.
    powers = [r.power for r in classes.select(F.ceil(F.log2(F.octet_length("v") / 8)).cast("int").alias("power")).distinct().collect()]  # at most 31
    tables = max((tables_for(turns, dim, threshold) for p in powers for dim in {2**p, 2**p // 2 + 1}), default=TABLES)

    def place(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, r in enumerate(raw):
                by_size.setdefault(len(r), []).append(i)
            short: list[bytes] = [b""] * len(raw)
            rows_, where = [], []
            for at in by_size.values():
                x = np.frombuffer(b"".join(raw[i] for i in at), "<f8").reshape(len(at), -1)
                single = x.astype("<f4")
                for i, own, s in zip(at, buckets(single.astype(float), turns, tables), single, strict=True):
                    short[i] = s.tobytes()
                    for b in set(own.tolist()):
                        rows_.append(i)
                        where.append(b)
            taken = pa.array(rows_, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(short, pa.binary()).take(taken)], names=["bucket", "rep", "copies", "v"])

    text_batches(spark)
    placed = cut(classes.mapInArrow(place, "bucket long, rep long, copies long, v binary"))
    big = cut(placed.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    few = big.count() <= BROADCAST_BUCKETS
    dealt = placed.join(F.broadcast(big) if few else big, "bucket", "left").withColumn("n", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    # Block p of a bucket meets every block q: it goes to each pair (smaller, larger) of which it is one.
    dealt = dealt.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("bucket", F.least("own", "q").alias("i"), F.greatest("own", "q").alias("j"), "own", "rep", "copies", "v")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")

    def compare(batches):
        """Per member its links and the smallest linked id (kind 0); a pair in doubt with its multiplicities (kind 1)."""

        def settled(held: pa.Table) -> pa.RecordBatch:
            names = ("rep", "links", "low", "other")
            parts: list[list[np.ndarray]] = []
            lengths = np.array([len(r) for r in held.column("v").to_pylist()])
            for size in np.unique(lengths).tolist():
                some = held.take(pa.array(np.flatnonzero(lengths == size)))
                bucket, i, j, own, ids, copies = (some.column(c).to_numpy() for c in ("bucket", "i", "j", "own", "rep", "copies"))
                x = np.frombuffer(b"".join(some.column("v").to_pylist()), "<f4").reshape(len(ids), -1)
                groups = Groups(x, ids, copies, turns, tables)
                ends = np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
                bounds = np.concatenate(([0], ends, [len(ids)]))
                for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
                    at = np.arange(bounds[k], bounds[k + 1])
                    left = at[own[at] == i[at[0]]]
                    right = left if i[at[0]] == j[at[0]] else at[own[at] == j[at[0]]]
                    for p, q, doubt in near_pairs(x, ids, left, right, threshold):
                        if len(p):
                            groups.add(p, q, doubt, bucket[at[0]])
                groups.settle()
                linked = np.flatnonzero(groups.links)
                parts.append([ids[linked], groups.links[linked], groups.low[linked], np.full(len(linked), -1)])
                parts.append([np.array([d[0] for d in groups.doubtful], np.int64), *[np.full(len(groups.doubtful), -1)] * 2, np.array([d[1] for d in groups.doubtful], np.int64)])
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
            sure = np.concatenate([np.full(len(p[0]), k % 2 == 0) for k, p in enumerate(parts)])
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], mask=~sure), pa.array(cols[2], mask=~sure), pa.array(cols[3], mask=sure)], names=names)

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(c).to_numpy() for c in ("bucket", "i", "j")]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(ends):
                yield settled(held.slice(0, int(ends[-1])))
                held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            yield settled(held)

    compared = cut(dealt.mapInArrow(compare, "rep long, links long, low long, other long"))
    settled = doubtful_links(compared.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")), classes, threshold)
    links = cut(compared.where("other IS NULL").select("rep", "links", "low").union(settled).groupBy("rep").agg(F.sum("links").alias("links"), F.collect_set("low").alias("lows")))
    found = components(links.select("rep", F.explode("lows").alias("low")), "rep", "low")
    by_class = first.select("sig", "rep", "copies").join(links.select("rep", "links"), "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("sig", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "sig").join(by_class, "sig", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
