"""A manifest of a data set as Merkle trees: one over the rows of each group, one over the groups, with a proof a row.

Rows are leaves, numbered within their group by key. A block of consecutive leaves, aligned
to a power of ARITY, is one task's work at a time: its hash stands for it in the tree above,
whose nodes are dealt into blocks in the same way, and so on up to the group's root and,
over the groups in order, to the root of all. Proofs come down again: each block gets the
proof of its own node from the block above and appends it to the paths inside.

Inside a block, paths are made by fractal traversal. The block's tree is cut into subtrees
STACKED levels high. Of each height only two are kept: the existing one, which holds the
siblings of the leaf at hand, and the desired one, its right neighbour, which grows by
one leaf with each path that is given out, and so is whole when it is needed. Besides the
leaves' own digests memory is bounded by the number of heights.

Cases: a null field is written as `-`; a null group is a group of its own and comes first; keys
ascend, null first; rows that share a key follow each other by their digest, and equal rows are
leaves like any others; an only leaf is its group's root, an only group's root is the root of all;
an empty table has no proofs and no root; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import cut, cut_at, discard, text_batches
from irloom.operators.aggregate import numbered

#: Children of a node; levels of a block; levels of a subtree that is kept while its block is walked through.
ARITY, LEVELS, STACKED = 8, 4, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: bytes) -> bytes:
    """Lowercase hex of the hash; digests are hashed as such text."""
    return hashlib.sha256(text).hexdigest().encode()


def leaf_digest(*values: Column) -> Column:
    """Hash of a row: each value as its length in bytes, a colon and the text, a null as a dash."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


class Subtree:
    """The nodes of some levels above a run of leaves, grown a leaf at a time; of levels below only open runs are held."""

    def __init__(self, low: int, height: int, first: int, end: int):
        self.low, self.top, self.first, self.at, self.end = low, low + height, first, first, end
        self.nodes = [bytearray() for _ in range(height)]
        self.open: list[list[bytes]] = [[] for _ in range(self.top)]

    def feed(self, leaf: bytes) -> None:
        self.at += 1
        self._put(0, leaf)
        if self.at == self.end:
            for level in range(self.top - 1):
                self._shut(level)

    def _put(self, level: int, node: bytes) -> None:
        if level >= self.low:
            self.nodes[level - self.low] += node
        if level + 1 < self.top:
            self.open[level].append(node)
            if len(self.open[level]) == ARITY:
                self._shut(level)

    def _shut(self, level: int) -> None:
        if run := self.open[level]:
            self.open[level] = []
            self._put(level + 1, digest(b"".join(run)))


def height_of(n: int) -> int:
    """Levels of hashing until n nodes are one."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def block_root(leaves: list[bytes], height: int) -> bytes:
    if not height:
        return leaves[0]
    tree = Subtree(height - 1, 1, 0, len(leaves))
    for leaf in leaves:
        tree.feed(leaf)
    return digest(bytes(tree.nodes[0]))


def paths(leaf: Callable[[int], bytes], n: int, height: int, stacked: int = STACKED) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """For each leaf in turn its place in its run and the siblings left and right of it, level by level."""
    stack = []
    for low in range(0, height, stacked):
        levels = min(stacked, height - low)
        span = ARITY ** (low + levels)
        existing = Subtree(low, levels, 0, min(span, n))
        for i in range(existing.end):
            existing.feed(leaf(i))
        stack.append([span, existing, Subtree(low, levels, span, min(2 * span, n)) if span < n else None])
    for i in range(n):
        path = []
        for kept in stack:
            span, existing, desired = kept
            if i and i % span == 0:
                existing = kept[1] = desired
                desired = kept[2] = Subtree(existing.low, existing.top - existing.low, i + span, min(i + 2 * span, n)) if i + span < n else None
            for level, nodes in enumerate(existing.nodes, existing.low):
                place = i // ARITY**level - existing.first // ARITY**level
                start = place - place % ARITY
                path.append((place - start, bytes(nodes[start * 64 : place * 64]), bytes(nodes[(place + 1) * 64 : (start + ARITY) * 64])))
            if desired is not None and desired.at < desired.end:
                desired.feed(leaf(desired.at))
        yield path


def pack(path: list[tuple[int, bytes, bytes]]) -> bytes:
    """Per level the place in the run, the number of siblings, and the siblings."""
    return b"".join(bytes([place, (len(left) + len(right)) // 64]) + bytes.fromhex((left + right).decode()) for place, left, right in path)


def unpack(proof: bytes) -> list[tuple[int, bytes, bytes]]:
    path, at = [], 0
    while at < len(proof):
        place, n = proof[at], proof[at + 1]
        siblings = proof[at + 2 : at + 2 + 32 * n].hex().encode()
        path.append((place, siblings[: place * 64], siblings[place * 64 :]))
        at += 2 + 32 * n
    return path


def fold(leaf: bytes, path: list[tuple[int, bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for _, left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _blocks(batch: pa.RecordBatch):
    """(row, nodes of the block, their digests, levels of hashing above them inside the block)"""
    get = lambda n: batch.column(batch.schema.get_field_index(n))
    nodes, more = get("nodes"), get("more").to_pylist()
    starts = nodes.offsets.to_pylist()
    levels = get("levels").to_pylist()
    for j in range(batch.num_rows):
        own = nodes.values.slice(starts[j], starts[j + 1] - starts[j])
        leaves = [d.hex().encode() for d in own.field("digest").to_pylist()]
        yield j, own, leaves, levels[j] if more[j] else height_of(len(leaves))


class Forest:
    """Trees over nodes (tree, position, digest and payload): blocks of every level, and a root a tree."""

    def __init__(self, nodes: DataFrame, levels: int):
        self.blocks: list[DataFrame] = []
        self.roots = None
        while True:
            payload = [c for c in nodes.columns if c not in ("tree", "position")]
            group = nodes.groupBy("tree", F.floor(F.col("position") / ARITY**levels).cast("long").alias("block"))
            blocks = group.agg(F.sort_array(F.collect_list(F.struct("position", *payload))).alias("nodes"))  # ARITY ** levels rows at most
            blocks = cut(blocks.withColumn("levels", F.lit(levels)))
            second = blocks.where("block = 1").select(F.col("tree").alias("s_tree"), F.lit(True).alias("second"))
            first = blocks.where("block = 0").join(second, F.col("tree").eqNullSafe(F.col("s_tree")), "left")
            blocks = first.select(*blocks.columns, F.coalesce("second", F.lit(False)).alias("more")).unionByName(blocks.where("block > 0").withColumn("more", F.lit(True)))
            tops = cut(blocks.mapInArrow(self._hash, f"tree {dict(nodes.dtypes)['tree']}, block long, more boolean, digest binary"))
            self.blocks.append(blocks)
            ended = tops.where("NOT more").select("tree", "digest")
            self.roots = ended if self.roots is None else self.roots.unionByName(ended)
            nodes = tops.where("more").select("tree", F.col("block").alias("position"), "digest")
            if nodes.isEmpty():
                return

    @staticmethod
    def _hash(batches):
        for batch in batches:
            tops = [bytes.fromhex(block_root(leaves, height).decode()) for _, _, leaves, height in _blocks(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("tree", "block", "more")), pa.array(tops, pa.binary())], names=["tree", "block", "more", "digest"])

    def proofs(self, above: DataFrame, give: Callable, schema: str) -> DataFrame:
        """What `give` yields for the blocks of leaves; `above` (tree, proof, subroot) has what follows a tree's root.

        Blocks that are alone take it from `above`, the others from the level over theirs.
        """
        from_above = above.select(F.col("tree").alias("u_tree"), F.lit(0).cast("long").alias("u_block"), F.col("proof").alias("upper"), F.col("subroot").alias("u_subroot"))
        upper = None
        kind = dict(above.dtypes)["tree"]
        for depth in range(len(self.blocks) - 1, -1, -1):
            blocks = self.blocks[depth]
            key = F.col("tree").eqNullSafe(F.col("u_tree")) & (F.col("block") == F.col("u_block"))
            rows = blocks.where("NOT more").join(from_above, key)
            if upper is not None:
                rows = rows.unionByName(blocks.where("more").join(upper, key))
            if depth == 0:
                return rows.mapInArrow(give, schema)
            upper = cut(rows.mapInArrow(self._down, f"u_tree {kind}, u_block long, upper binary, u_subroot binary"))

    @staticmethod
    def _down(batches):
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            for j, own, leaves, height in _blocks(batch):
                upper = get("upper")[j].as_py()
                proofs = [pack(path) + upper for path in paths(leaves.__getitem__, len(leaves), height)]
                n = len(leaves)
                yield pa.RecordBatch.from_arrays([pa.array([get("tree")[j].as_py()] * n, get("tree").type), own.field("position"), pa.array(proofs, pa.binary()), pa.array([get("u_subroot")[j].as_py()] * n, pa.binary())], names=["u_tree", "u_block", "upper", "u_subroot"])


def manifest(leaves: DataFrame, levels: int = LEVELS, with_proofs: bool = False) -> DataFrame:
    """A row a leaf: key, leaf, subroot, root, proof_sha256, folded_root and verified; with_proofs adds the packed siblings.

    `leaves` has tree, key, digest (the leaf that counts) and claimed (the one that is
    checked), both binary. folded_root is what the claimed leaf and the siblings give.
    """
    text_batches(leaves.sparkSession)
    staged, path = cut_at(leaves.select("tree", "key", "digest", "claimed"))
    groups = Forest(numbered(staged, ["tree"], ["key", "digest"]), levels)
    subroots = groups.roots.select(F.col("tree").alias("group"), "digest")
    over = Forest(numbered(cut(subroots), [], ["group"]).withColumn("tree", F.lit("")).select("tree", "position", "digest", "group"), levels)
    discard(leaves.sparkSession, path)
    top = over.roots.first()  # one row, or none if there are no leaves
    root = top.digest.hex() if top else None

    def of_groups(batches):
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            for j, own, nodes, height in _blocks(batch):
                upper = get("upper")[j].as_py()
                proofs = [pack(p) + upper for p in paths(nodes.__getitem__, len(nodes), height)]
                yield pa.RecordBatch.from_arrays([own.field("group"), pa.array(proofs, pa.binary()), own.field("digest")], names=["tree", "proof", "subroot"])

    kinds = dict(leaves.dtypes)
    ends = leaves.sparkSession.createDataFrame([("", b"", b"")], "tree string, proof binary, subroot binary")
    above = cut(over.proofs(ends, of_groups, f"tree {kinds['tree']}, proof binary, subroot binary"))

    def of_leaves(batches):
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            for j, own, nodes, height in _blocks(batch):
                upper, subroot = get("upper")[j].as_py(), get("u_subroot")[j].as_py().hex()
                over_path = unpack(upper)
                over_siblings = b"".join(left + right for _, left, right in over_path)
                shas, folded, packed = [], [], []
                for p, claimed in zip(paths(nodes.__getitem__, len(nodes), height), own.field("claimed").to_pylist(), strict=True):
                    shas.append(hashlib.sha256(b"".join(left + right for _, left, right in p) + over_siblings).hexdigest())
                    folded.append(fold(fold(claimed.hex().encode(), p), over_path).decode())
                    packed.append(pack(p) + upper if with_proofs else None)
                n = len(nodes)
                cols = {"tree": pa.array([get("tree")[j].as_py()] * n, get("tree").type), "key": own.field("key"), "leaf": pa.array([x.decode() for x in nodes]), "subroot": pa.array([subroot] * n), "root": pa.array([root] * n, pa.string())}
                cols |= {"proof_sha256": pa.array(shas), "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded])} | ({"proof": pa.array(packed, pa.binary())} if with_proofs else {})
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = f"tree {kinds['tree']}, key {kinds['key']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return groups.proofs(above, of_leaves, schema + (", proof binary" if with_proofs else ""))


def row_leaves(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS, by: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Leaves of the rows; where `tampered` holds, the claimed leaf is that of the text with A-Z lower-cased."""
    leaf = leaf_digest(*(F.col(c) for c in fields))
    changed = leaf_digest(*(F.translate(c, UPPER, LOWER) if c == text else F.col(c) for c in fields))
    return docs.select(F.col(by).alias("tree"), F.col(key).alias("key"), F.unhex(leaf).alias("digest"), F.unhex(F.when(tampered, changed).otherwise(leaf)).alias("claimed"))
