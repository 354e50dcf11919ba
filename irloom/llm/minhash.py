"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's set holds the hashes of its distinct five-word shingles; its sketch the
   SKETCH smallest. Documents with equal sets form a class, of which one goes on.
2. Inverted lists: each class is listed under its LISTED smallest values. Two classes
   that share enough of these overlaps are a candidate pair.
3. The sketch of the union, from both sketches, estimates the similarity and drops pairs
   far below the threshold.
4. The exact similarity on the full sets of words confirms a pair.

Lists of over HOT classes (a passage that many documents share, a large group of near
copies) never emit all their pairs. Classes of which at most a third of the listed values
are that common meet their partners in the short lists as well, so they leave the long
ones. Those with more are listed among themselves under their whole sketch, and leave
the long lists if at most COMMON of it is common even there. The others, mostly made of
common content, go on with their whole sets. Of these, a class with under PERCENT of its
set in other classes has no partner and leaves. In each long list the most typical member
leads: all others are compared with it, and those linked form the list's main component;
a few more leaders from outside it follow. What then stands outside the main component
is compared with the whole list, in blocks, which return a spanning forest of what they
link; pairs inside the main component are never looked at. So no pair of different
components goes uncompared, and a group of copies takes one comparison a member.

Bounds: a pair at the threshold without common values shares fewer than 6 of 24 listed
values with probability 4e-8; one whose partner's sketch is common up to the limit, none
of the others with 2e-5 (both fall steeply above the threshold); the estimate drops a pair
at the threshold with 6e-5. Sets of at most SKETCH shingles are never estimated. Whole
sets are compared by 63-bit hashes of shingles in long lists, by their words elsewhere.

Cases: null or empty texts, and such without words, have the empty set, are linked with
nothing and are kept; texts of one to four words have one shingle, their whole sequence;
ties go to the smallest id; repeated rows are one class, and each gets its row; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import cut, text_batches, worker_memo
from irloom.llm.components import components

WORDS, PERCENT = 5, 75
SKETCH, LISTED, HOT = 64, 24, 32
#: Share of a sketch in long lists from which a class must meet others there, and in how many of them.
COMMON, MET = 0.5, 12
#: Four standard errors of the estimate below the threshold.
SLACK = 4 * (0.75 * 0.25 / SKETCH) ** 0.5
#: Leaders, one after another, that a long list is compared with before blocks of it are.
LEADER_ROUNDS = 2
#: Members and set values of a block of a long list.
BLOCK_ROWS, BLOCK_VALUES = 4096, 4_000_000
#: Ids of at most so many documents are broadcast to fetch their texts; beyond that the tables are joined by shuffle.
BROADCAST_IDS = 200_000
MEMO_WORDS = 600_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


class WordHashes(dict):
    """The hashes of words that a worker has met."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def shingles(words: list, k: int = WORDS) -> set:
    """The full set, of tuples of words."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k)), strict=False))


def hashed_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.int64)
    known = worker_memo("minhash", WordHashes)
    if len(known) > MEMO_WORDS:
        known.clear()
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(w) < k:
            h = (w * FACTORS[: len(w)]).sum(keepdims=True) + np.uint64(len(w)) * FACTORS[-1]
        else:
            h = w[: len(w) - k + 1] * FACTORS[0]
            for i in range(1, k):
                h = h + w[i : len(w) - k + 1 + i] * FACTORS[i]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), sig (digest of the whole set, null if empty), sketch (its smallest hashes)."""
    text_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sizes, sigs, small = [], [], []
            for text in batch.column(1).to_pylist():
                s = hashed_set(text)
                sizes.append(len(s))
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                small.append(s[:SKETCH])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(small, pa.list_(pa.int64()))], names=["doc_id", "n", "sig", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, sig binary, sketch array<long>")


def near(a: str = "na", b: str = "nb"):
    """Sizes that allow the similarity."""
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def list_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of each list of at most HOT classes (v, rep, n, hot): a < b, their overlaps, and whether either has common values."""
    grouped = lists.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "hot"))).alias("l"))
    each = grouped.select("l", F.explode("l").alias("x"))
    pairs = each.select("x", F.explode(F.filter("l", lambda y: (y.rep > F.col("x.rep")) & (y.n * 100 >= F.col("x.n") * PERCENT) & (F.col("x.n") * 100 >= y.n * PERCENT))).alias("y"))
    return (
        pairs.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .agg(F.count("*").alias("overlaps"), F.first((F.col("x.hot") > 0) | (F.col("y.hot") > 0)).alias("common"), F.first(F.least("x.n", "y.n")).alias("smaller"))
    )


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves the threshold possible; `exact` where both sketches are whole sets."""
    left, right = (classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").where(near())
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    whole = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH)
    common = F.size(F.array_intersect("sa", "sb"))
    exact = common * 100 >= (F.col("na") + F.col("nb") - common) * PERCENT
    far = shared >= F.size(union) * (PERCENT / 100 - SLACK)
    return both.withColumn("whole", whole).where(F.when(whole, exact).otherwise(far)).select("a", "b", "whole")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    few = ids.count() <= BROADCAST_IDS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity, from the texts."""
    pairs = cut(pairs)
    sure, open_ = pairs.where("whole"), pairs.where("NOT whole").select("a", "b")
    texts = cut(texts_of(docs, open_.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = shingles(words_of(x)), shingles(words_of(y))
                both = len(s & t)
                ok.append(both * 100 >= (len(s) + len(t) - both) * PERCENT)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    joined = open_.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return sure.select("a", "b").union(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def set_bytes(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, n and `set`, the whole hashed set, of the classes in `reps`, from the texts."""

    def run(batches):
        for batch in batches:
            sets = [hashed_set(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "n", "set"])

    return texts_of(docs, reps.select(F.col("rep").alias("doc_id"))).dropDuplicates(["doc_id"]).mapInArrow(run, "rep long, n long, set array<long>")


def shared_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, n, `common` (the values of the whole set that another class of `reps` has as well) and `typical`.

    A partner holds PERCENT of a class's set at least, so a class with fewer common values
    has none here and is left out. `typical` is the cosine to the sum of all sets, up to a
    constant.
    """
    values = cut(set_bytes(docs, reps).select("rep", "n", F.explode("set").alias("v")))
    counts = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    each = values.join(counts, "v").groupBy("rep", "n").agg(F.collect_list("v").alias("common"), (F.sum("df") / F.sqrt(F.first("n"))).alias("typical"))
    return cut(each.where(F.size("common") * 100 >= F.col("n") * PERCENT))


def with_main(members: DataFrame) -> DataFrame:
    """Members of lists that span several components, with each list's largest component as `main`."""
    sizes = members.groupBy("v", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("v").agg(F.count("*").alias("many"), F.max_by("component", F.struct("size", -F.col("component"))).alias("main"))
    return members.join(main.where("many > 1").select("v", "main"), "v")


def leader_links(lists: DataFrame, shared: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Links (a, b) found by comparing each list (v, rep, typical) with its leaders, and the members (v, rep, component).

    A component here is the smallest leader that a class is linked to by itself; the links
    tell what leaders have to do with one another.
    """
    links: list[DataFrame] = []
    members = cut(lists.withColumn("component", F.col("rep")))
    for k in range(LEADER_ROUNDS):
        live = with_main(members).where("component <> main") if k else members
        leaders = live.groupBy("v").agg(F.max_by(F.struct("rep", "component"), F.struct("typical", -F.col("rep"))).alias("leader"))
        met = members.join(leaders, "v").where("component <> leader.component").select(F.col("leader.rep").alias("a"), F.col("leader.component").alias("to"), F.col("rep").alias("b")).distinct()
        left, right = (shared.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("common").alias(f"s{x}")) for x in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        linked = met.join(left, "a").join(right, "b").where(near()).withColumn("both", both).where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * PERCENT)
        new = cut(linked.select("a", "b", "to"))
        links.append(new.select("a", "b"))
        to = new.groupBy(F.col("b").alias("rep")).agg(F.min("to").alias("to"))
        members = cut(members.join(to, "rep", "left").select("v", "rep", "typical", F.least("component", "to").alias("component")))
    return links, members.drop("typical")


def block_links(members: DataFrame, shared: DataFrame) -> DataFrame:
    """Links (a, b) of components from all pairs of each list (v, rep, component) but those inside its main component.

    A list is dealt out in blocks of bounded bytes, and pairs of blocks are compared. A
    pair of blocks yields a spanning forest of the components that it links, not its pairs.
    """
    live = with_main(members).join(shared.select("rep", "n", "common"), "rep")
    live = cut(live.withColumn("rest", F.col("component") != F.col("main")))
    need = lambda rest: F.ceil(F.greatest(F.sum(F.when(rest, F.size("common") + 1)) / BLOCK_VALUES, F.count(F.when(rest, 1)) / BLOCK_ROWS))
    blocks = live.groupBy("v").agg(need(F.lit(True)).alias("all"), need(F.col("rest")).alias("r"), need(~F.col("rest")).alias("c"))
    # A list of one block stays whole; else the rest and the main component get blocks of their own.
    blocks = blocks.select("v", F.when(F.col("all") <= 1, 1).otherwise(F.col("r")).cast("int").alias("r"), F.when(F.col("all") <= 1, 0).otherwise(F.col("c")).cast("int").alias("c"))
    dealt = live.join(blocks, "v")
    spot = F.xxhash64("rep")
    own = F.when(F.col("rest") | (F.col("c") == 0), F.pmod(spot, F.col("r"))).otherwise(F.col("r") + F.pmod(spot, F.greatest("c", F.lit(1)))).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("q", F.explode(F.sequence(F.lit(0), F.when(F.col("own") < F.col("r"), F.col("r") + F.col("c")).otherwise(F.col("r")) - 1)))
    dealt = dealt.select("v", F.least("own", "q").alias("i"), F.greatest("own", "q").alias("j"), "rep", "n", "component", "rest", "common")
    dealt = dealt.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j", "rep")

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(c).to_numpy() for c in ("v", "i", "j")]
            ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            start = 0
            for end in ends.tolist():
                yield forest(held.slice(start, end - start))
                start = end
            held = held.slice(start)
        if held is not None and held.num_rows:
            yield forest(held)

    text_batches(members.sparkSession)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def forest(block: pa.Table) -> pa.RecordBatch:
    """A spanning forest (a, b) of the components that similar pairs of the block link."""
    block = block.combine_chunks()
    n, component, rest = (block.column(c).to_numpy() for c in ("n", "component", "rest"))
    sets = block.column("common").combine_chunks()
    _, value = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    owner = np.repeat(np.arange(len(n)), np.diff(sets.offsets.to_numpy()))
    some = np.flatnonzero(rest)
    both = np.zeros((len(some), len(n)), np.float32)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    width = 2048
    for first in range(0, int(value[-1]) + 1 if len(value) else 0, width):
        lo, hi = np.searchsorted(value, (first, first + width))
        holds = np.zeros((len(n), width), np.float32)
        holds[owner[lo:hi], value[lo:hi] - first] = 1
        both += holds[some] @ holds.T
    x, y = np.nonzero(both * 100 >= (n[some][:, None] + n[None] - both) * PERCENT)
    a, b = component[some[x]], component[y]
    found = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1)[a != b], axis=0)
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for a, b in found.tolist():
        s, t = top(a), top(b)
        if s != t:
            root[max(s, t)] = min(s, t)
            out.append((a, b))
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept, one row per row of `docs`."""
    rows = cut(sketches(docs).withColumn("row", F.monotonically_increasing_id()))
    first = rows.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("sig").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("sig", F.col("r.doc_id").alias("rep"), F.col("r.row").alias("row"))
    classes = cut(rows.drop("sig", "doc_id").join(first.drop("sig"), "row").select("rep", "n", "sketch"))

    def with_counts(values: DataFrame) -> DataFrame:
        """rep, n and l, the values (v, at, df) that another class has too, in order."""
        counts = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
        return cut(values.join(counts, "v").groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "v", "df"))).alias("l")))

    def hot(c: str = "l"):
        return F.size(F.filter(c, lambda x: x.df > HOT))

    def short_lists(of: DataFrame) -> DataFrame:
        return list_pairs(of.select("rep", "n", hot().alias("hot"), F.explode(F.filter("l", lambda x: x.df <= HOT)).alias("x")).select("x.v", "rep", "n", "hot"))

    listed = with_counts(classes.select("rep", "n", F.posexplode(F.slice("sketch", 1, LISTED)).alias("at", "v")))
    rare = short_lists(listed)
    # Without common values, a pair at the threshold shares about 18 of 24 listed values.
    rare = rare.where((F.col("overlaps") >= 6) | F.col("common") | (F.col("smaller") <= 2 * LISTED)).select("a", "b")

    # Classes with much common content are listed under their whole sketch, among themselves.
    mixed = listed.where(hot() * 3 > F.least(F.col("n"), F.lit(LISTED))).select("rep")
    again = with_counts(classes.join(mixed, "rep").select("rep", "n", F.posexplode("sketch").alias("at", "v")))
    # At most COMMON of a sketch is common here, so a pair at the threshold shares about 16 other values.
    short = short_lists(again).where((F.col("overlaps") >= 2) | (F.col("smaller") <= 2 * SKETCH)).select("a", "b")

    # What is left is made of common content: it meets in the long lists of its smallest common values.
    mostly = again.where(hot() > COMMON * F.least(F.col("n"), F.lit(SKETCH)))
    shared = shared_sets(docs, mostly.select("rep"))
    lists = F.slice(F.filter("l", lambda x: x.df > HOT), 1, MET)["v"]
    mostly = mostly.join(shared.select("rep", "typical"), "rep").select(F.explode(lists).alias("v"), "rep", "typical")
    links, members = leader_links(mostly, shared)
    links.append(cut(block_links(members, shared)))
    links.append(confirmed(estimated(rare.union(short).distinct(), classes), docs))
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    found = components(every)
    by_sig = first.select("sig", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(by_sig, "sig", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
