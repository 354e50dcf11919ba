"""Manifest trees against trees built in full."""

import hashlib
import random
import tracemalloc
import zlib

import pytest
from pyspark.sql import functions as F

from irloom.llm import merkle
from irloom.llm.common import crc_mod


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def brute_path(levels, i):
    path = []
    for nodes in levels[:-1]:
        start = i - i % 8
        path.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + 8])))
        i //= 8
    return path


def leaf(row, text):
    shown = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in shown))


def brute(rows):
    claimed_of = lambda r: leaf(r, None if r["text"] is None else r["text"].translate(str.maketrans(merkle.UPPER, merkle.LOWER)))
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0), leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_levels([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    over = brute_levels([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for i, (_, digest, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            path = brute_path(trees[g], i) + brute_path(over, n)
            folded = claimed_of(r) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else digest
            for left, right in path:
                folded = h(left + folded + right)
            out.append((r["doc_id"], digest, trees[g][-1][0], over[-1][0], h("".join(a + b for a, b in path)), folded, folded == over[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest int, root string"


def run(spark, rows, levels):
    docs = spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], 1, "x") for r in rows], SCHEMA).repartition(3)
    got = merkle.manifest(merkle.row_leaves(docs, crc_mod(F.col("doc_id"), 3) == 0), levels)
    return sorted((tuple(r) for r in got.select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def documents(n, langs, seed):
    rng = random.Random(seed)
    texts = [None, "", "lower only", "Mixed Case", "ÄÖ Ünïcode", "X" * 50_000]
    return [{"doc_id": i, "source": rng.choice([None, "", "a:b"]), "lang": rng.choice(langs), "n_chars": rng.choice([None, 7]), "text": rng.choice(texts)} for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels):
    """Blocks of 8 rows make many levels of blocks; null and empty groups, null and repeated keys, equal rows."""
    rows = documents(330, ["en"] * 20 + [None, "", "é", "fr"], 71)
    rows += [rows[0], rows[0] | {"text": "other"}, rows[1], {**rows[2], "doc_id": None}, {"doc_id": -5, "source": None, "lang": "lone", "n_chars": None, "text": "A"}]
    assert run(spark, rows, levels) == brute(rows)


def test_one_row_and_none(spark):
    rows = documents(1, ["en"], 72)
    assert run(spark, rows, 4) == brute(rows) and run(spark, [], 4) == []


def test_more_groups_than_a_block(spark):
    rows = documents(150, [f"g{i}" for i in range(90)], 73)
    assert run(spark, rows, 1) == brute(rows)


@pytest.mark.parametrize("n,stacked", [(1, 2), (7, 1), (8, 2), (9, 2), (64, 1), (65, 2), (700, 2), (4096, 2), (4097, 3), (5003, 1)])
def test_traversal_gives_every_path(n, stacked):
    leaves = [h(str(i)) for i in range(n)]
    levels = brute_levels(leaves)
    got = list(merkle.paths(lambda i: leaves[i].encode(), n, merkle.height_of(n), stacked))
    assert len(got) == n
    for i in {0, n - 1, n // 2, *random.Random(74).sample(range(n), min(n, 60))}:
        want = brute_path(levels, i)
        assert [(a.decode(), b.decode()) for _, a, b in got[i]] == want
        assert merkle.fold(leaves[i].encode(), merkle.unpack(merkle.pack(got[i]))).decode() == levels[-1][0]


def test_traversal_holds_few_nodes():
    """Leaves come from a function, so what is held is the kept subtrees: far less than the tree's 37,000 nodes of 64 bytes."""
    n = 8**5
    leaf_of = lambda i: h(str(i)).encode()
    tracemalloc.start()
    for _ in merkle.paths(leaf_of, n, 5, 1):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200_000


def test_proofs_given_out_verify(spark):
    rows = documents(120, ["en", "de"], 75)
    docs = spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in rows], ", ".join(SCHEMA.split(", ")[:5]))
    for r in merkle.manifest(merkle.row_leaves(docs, F.lit(False)), 2, with_proofs=True).collect():
        assert r.verified and merkle.fold(r.leaf.encode(), merkle.unpack(r.proof)).decode() == r.root
        assert merkle.fold(b"0" * 64, merkle.unpack(r.proof)).decode() != r.root
