"""Byte-level BPE by corpus-level merge replay, and its inverse.

The pieces that a pattern cuts from a block of texts are numbered once. The merges then
run over all distinct pieces of the block together: an inverted index holds, for each
token pair that merges, the positions where it stands; the pair of lowest rank is taken,
all its positions are merged in one step, and only the pairs with their two neighbours
are looked up and indexed anew. A worker keeps the ids of pieces it has replayed, up to a
bound, so a common piece is replayed once. Texts never leave their task.

Result per piece: that of merging the leftmost pair of lowest rank until none is left.

Cases: a null text counts as empty; an empty text has no ids; a text of one very long
piece is replayed like any other; repeated rows give repeated results; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import Numbering, gather, text_batches, text_blocks, worker_memo
from irloom.llm.common import digest as digest_of

BLOCK_BYTES = 24 << 20
#: Distinct pieces whose ids a worker keeps; about 250 bytes each.
MEMO_PIECES = 700_000
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """The pairs that merge and what decoding needs, from a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values, self.back = [], [], np.zeros(self.size, bool)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                x, y = ranks.get(token[:i]), ranks.get(token[i:])
                if x is not None and y is not None:
                    keys.append(x * self.size + y)
                    values.append(rank)
                    for z in (x, y):
                        # A merge into z can open a pair of a lower rank than z's own.
                        self.back[z] |= z > rank
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.first = self.rank(np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256), self.byte)
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths

    def rank(self, a: np.ndarray, b: np.ndarray, to: np.ndarray | None = None) -> np.ndarray:
        key = (a if to is None else to[a]).astype(np.int64) * self.size + (b if to is None else to[b])
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_starts, self.token_lengths, self.token_bytes, ids.astype(np.int64)).tobytes()


def replay(merges: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and how many each word has."""
    sizes = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    ends = np.cumsum(sizes)[sizes > 0] - 1
    symbol = merges.byte[raw]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends], before[np.concatenate(([0], ends[:-1] + 1))] = -1, -1
    alive, rank = np.ones(n, bool), np.full(n, NONE)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = merges.first[raw[inner].astype(np.int64) * 256 + raw[inner + 1]]

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for i, r in enumerate(ranks[bounds[:-1]].tolist()):
            at = positions[bounds[i] : bounds[i + 1]]
            if r in index:
                index[r].append(at)
            else:
                index[r] = [at]
                heapq.heappush(heap, r)

    open_pairs = np.flatnonzero(rank != NONE).astype(np.int32)
    if len(open_pairs):
        add(open_pairs, rank[open_pairs])
    while heap:
        r = heapq.heappop(heap)
        held = index.pop(r)
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        at = at[rank[at] == r]
        if not len(at):
            continue
        if len(held) == 1 and len(at) > 1 and (at[1:] < at[:-1]).any():
            at = np.unique(at)
        if len(at) > 1:
            if merges.back[r]:  # one merge a word at a time: it may open a lower pair that comes first
                first = np.ones(len(at), bool)
                first[1:] = word_of[at[1:]] != word_of[at[:-1]]
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(heap, r)
                    at = at[first]
            else:
                overlaps = after[at[:-1]] == at[1:]
                if overlaps.any():  # in a run of overlapping pairs every second one merges
                    start = np.concatenate(([True], ~overlaps))
                    run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = after[at]
        follows = after[gone]
        symbol[at] = r
        after[at] = follows
        linked = follows >= 0
        before[follows[linked]] = at[linked]
        alive[gone] = False
        rank[gone] = NONE
        rank[at] = NONE
        left = before[at]
        changed = np.concatenate((left[left >= 0], at[linked]))
        if len(changed):
            new = merges.rank(symbol[changed], symbol[after[changed]])
            rank[changed] = new
            keep = new != NONE
            if keep.any():
                add(changed[keep], new[keep])
    return symbol[alive], np.bincount(word_of[alive], minlength=len(words))


class Encoder:
    """Ids of texts; remembers the pieces it has replayed."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges, self.cut = Merges(ranks), regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.number, self.lengths, self.flat = Numbering(), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > MEMO_PIECES:
            self.forget()
        known = len(self.number)
        pieces = [np.fromiter(map(self.number.__getitem__, self.cut(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        new = [p.encode("utf-8") for p in itertools.islice(self.number, known, None)]
        flat, lengths = replay(self.merges, new)
        self.lengths, self.flat = np.concatenate((self.lengths, lengths)), np.concatenate((self.flat, flat))
        starts = np.cumsum(self.lengths) - self.lengths
        return [gather(starts, self.lengths, self.flat, p) for p in pieces]


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the ids of every text; with `digest`, in place of the ids their SHA-256 and that of what they decode to."""
    spark = docs.sparkSession
    text_batches(spark)
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = load_ranks(path)
    table = spark.sparkContext.broadcast(ranks)  # a fixed vocabulary file
    key = ("bpe", digest_of(repr(sorted(ranks.items())).encode(), pattern.encode()))

    def run(batches):
        encoder = worker_memo(key, lambda: Encoder(table.value, pattern))
        for ids_, texts in text_blocks(batches, ["doc_id", "text"], BLOCK_BYTES):
            encoded = encoder.encode(texts)
            texts.clear()  # the block's source holds the list as well
            for i in range(0, len(encoded), 512):
                part = encoded[i : i + 512]
                cols = [pa.array(ids_[i : i + 512], pa.int64()), pa.array([len(x) for x in part], pa.int64())]
                if digest:
                    cols.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in part], pa.string()))
                    cols.append(pa.array([hashlib.sha256(encoder.merges.decode(x)).hexdigest() for x in part], pa.string()))
                else:
                    cols.append(pa.array(part, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"))


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id and the bytes that each row's `ids` stand for; null ids count as none."""
    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast(load_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")))

    def run(batches):
        tokens = {rank: token for token, rank in table.value.items()}
        for batch in batches:
            rows = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(tokens[i] for i in r or ()) for r in rows], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")
