"""Stupid-backoff language-model scores from the corpus itself.

The score of a word is its longest n-gram's count over that of the context, if the n-gram
occurs at least `min_count` times; each step to a shorter n-gram multiplies by `alpha`;
a single word's count is over the number of words. A text's score is the sum of logs.

The counts live in tables partitioned by the hash of the n-gram. Texts are cut into
blocks; a block sends each bucket of the table the distinct n-grams it has there, with
how often, as one packed row. A bucket adds up the counts of all blocks and answers each
block in the order of its request. The block then looks up every n-gram of every
position and sums per document. A frequent n-gram is one entry a block, so no key is hot,
and no count reaches the driver.

A task holds a few whole numbers a word of one block: n-grams are hashed, sorted and looked
up a slice of places or a range of hashes at a time, and only two orders' counts are kept.

n-grams are known by a hash so wide that two of all those in the corpus share one with a
probability of 2**-SPARE for each.

Cases: null or empty texts have no words and the score 0; a text of one word has a
single-word score; repeated rows count and are scored each; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import Numbering, cut, text_batches, text_blocks

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: A block ends at whichever comes first; texts of usual words reach the bytes.
BLOCK_BYTES, BLOCK_WORDS = 16 << 20, 5_000_000
#: n-grams of a bucket, about.
BUCKET_NGRAMS = 3_000_000
SPARE = 24
#: Places that are worked on at a time, n-grams of a bucket that are added up at a time, and ranges of hashes that a block looks up one after another.
SLICE, ADDED, RANGES = 1 << 18, 1 << 19, 16
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()) if len(x) else b""


def unpacked(raw: bytes, dtype: str) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).reshape(-1).view(dtype)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def hashes(words: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash of the n-gram that ends at each of the given places."""
    out = np.empty(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for first in range(0, len(at), SLICE):
            some = at[first : first + SLICE]
            h = np.full(len(some), n, np.uint64) * FACTORS[-1]
            for i in range(n):
                h += words[some - i] * FACTORS[i]
            out[first : first + SLICE] = mixed(h) >> np.uint64(64 - bits)
    return out


def places(lengths: np.ndarray, n: int) -> np.ndarray:
    """Positions, over all texts one after another, where an n-gram of a text ends."""
    starts, ends = np.cumsum(lengths) - lengths, np.ones(int(lengths.sum()), bool)
    for k in range(n - 1):
        ends[starts[lengths > k] + k] = False
    return np.flatnonzero(ends).astype(np.int32)


def block_table(docs: DataFrame) -> DataFrame:
    """Texts as blocks of word numbers: block, doc_ids, lengths, words (numbers), known (the words' hashes), n_words."""
    text_batches(docs.sparkSession)

    def row(block, ids, words, number):
        lengths = np.array([len(w) for w in words], np.int32)
        known = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([packed(lengths)]), "words": pa.array([packed(np.concatenate(words))]), "known": pa.array([packed(known)]), "n_words": pa.array([int(lengths.sum())], pa.int64())})

    def run(batches):
        block = TaskContext.get().partitionId() << 24
        for ids, texts in text_blocks(batches, ["doc_id", "text"], BLOCK_BYTES):
            first, held, words, number = 0, 0, [], Numbering()
            for end, text in enumerate(texts, 1):
                words.append(np.fromiter(map(number.__getitem__, words_of(text)), np.int32))
                held += len(words[-1])
                if held >= BLOCK_WORDS or end == len(texts):
                    yield row(block, ids[first:end], words, number)
                    block, first, held, words, number = block + 1, end, 0, [], Numbering()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(run, "block long, doc_ids array<long>, lengths binary, words binary, known binary, n_words long"))


def of_block(lengths: bytes, words: bytes, known: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and the hash of every word."""
    return unpacked(lengths, "<i4").astype(np.int64), unpacked(known, "<u8")[unpacked(words, "<i4")]


def cuts(sorted_hashes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's range of hashes starts, and the end."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]))


def runs(buckets: int, most: int) -> list[range]:
    """All buckets as ranges of at most so many."""
    return [range(first, min(buckets, first + most)) for first in range(0, buckets, most)]


def requests_of(sizes: np.ndarray, words: np.ndarray, n: int, bits: int, buckets: int) -> Iterator[tuple[range, list[bytes], list[bytes]]]:
    """Some buckets at a time: the distinct n-grams that a block has in each, as steps from hash to hash, and how often."""
    h = hashes(words, places(sizes, n), n, bits)
    h.sort()
    at = cuts(h, buckets, bits)
    for some in runs(buckets, min(256, -(-buckets // RANGES))):
        start, end = at[some[0]], at[some[-1] + 1]
        new = np.flatnonzero(np.diff(h[start:end]))
        new = np.concatenate(([0], new + 1)) if end > start else new
        own, times = h[start:end][new], np.diff(new, append=end - start).astype("<u4")
        inner = np.searchsorted(new, at[some[0] : some[-1] + 2] - start)
        parts = [slice(inner[k], inner[k + 1]) for k in range(len(some))]
        yield some, [packed(np.diff(own[x], prepend=np.uint64(0))) for x in parts], [packed(times[x]) for x in parts]


def added(asked: list[np.ndarray], given: list[np.ndarray]) -> list[np.ndarray]:
    """Of each list of ascending hashes of one bucket, every hash's number over all lists."""
    got = [np.zeros(len(a), "<u8") for a in asked]
    full = [i for i, a in enumerate(asked) if len(a)]
    if not full:
        return got
    low, high = min(int(asked[i][0]) for i in full), max(int(asked[i][-1]) for i in full)
    ranges = -(-sum(map(len, asked)) // ADDED)
    edges = np.array([low + (high - low) * k // ranges for k in range(1, ranges)], np.uint64)
    at = {i: [0, *np.searchsorted(asked[i], edges).tolist(), len(asked[i])] for i in full}
    for k in range(ranges):
        own = np.concatenate([asked[i][at[i][k] : at[i][k + 1]] for i in full])
        which = np.unique(own, return_inverse=True)[1]
        sums = np.bincount(which, np.concatenate([given[i][at[i][k] : at[i][k + 1]] for i in full])).astype("<u8")  # sums below 2**53 are exact
        done = 0
        for i in full:
            start, end = at[i][k], at[i][k + 1]
            got[i][start:end] = sums[which[done : done + end - start]]
            done += end - start
    return got


def counts_of(sizes: np.ndarray, words: np.ndarray, n: int, bits: int, replies: list[bytes], total: int) -> np.ndarray:
    """The count of the n-gram that ends at each place, 0 where none does, from the replies of all buckets in turn; none is above the total."""
    buckets, at = len(replies), places(sizes, n)
    out, h = np.zeros(int(sizes.sum()), "<u4" if total < 1 << 32 else "<u8"), hashes(words, at, n, bits)
    for some in runs(buckets, max(1, -(-buckets // RANGES))):
        low, high = ((b << bits) // buckets for b in (some[0], some[-1] + 1))
        here = np.flatnonzero((h >= np.uint64(low)) & (h < np.uint64(high)))
        sums = np.concatenate([unpacked(replies[b], "<u8") for b in some])
        out[at[here]] = sums[np.unique(h[here], return_inverse=True)[1]]
    return out


def logs_of(sizes: np.ndarray, words: np.ndarray, bits: int, replies: list[list[bytes]], total: int, alpha: float, min_count: int) -> np.ndarray:
    """The log of every place's score; replies: of each order, those of all buckets in turn."""
    log = np.zeros(int(sizes.sum()))
    longest = np.zeros(len(log), np.int8)
    for n in range(1, len(replies) + 1):
        longest[places(sizes, n)] = n
    shorter = None
    for n, of_order in enumerate(replies, 1):  # what a longer n-gram gives replaces what a shorter one gave
        counts = counts_of(sizes, words, n, bits, of_order, total)
        for first in range(0, len(log), SLICE):
            use = longest[first : first + SLICE] >= n
            if n > 1:
                use &= counts[first : first + SLICE] >= min_count
            at = first + np.flatnonzero(use)
            over = shorter[at - 1] if n > 1 else float(total)
            log[at] = np.log(counts[at] / over) + np.log(alpha) * (longest[at] - n)
        shorter = counts
    return log


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_words and log_score of every row of `docs`."""
    spark = docs.sparkSession
    table = block_table(docs)
    total = table.agg(F.sum("n_words")).first()[0] or 0
    bits = min(63, int(order * total + 1).bit_length() + SPARE)
    buckets = max(4, -(-order * total // BUCKET_NGRAMS))
    text_batches(spark)

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes, words = of_block(row["lengths"], row["words"], row["known"])
                for n in range(1, order + 1):  # one order at a time bounds memory
                    for some, steps, counts in requests_of(sizes, words, n, bits, buckets):
                        yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([n] * len(some), pa.int32()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], names=["bucket", "block", "n", "steps", "counts"])

    def answer(key, batches):
        table = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        asked = [np.cumsum(unpacked(s.as_py(), "<u8"), dtype=np.uint64) for s in table.column("steps")]
        given = [unpacked(c.as_py(), "<u4") for c in table.column("counts")]
        replies = [packed(got) for got in added(asked, given)]
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "n": table.column("n"), "sums": pa.array(replies, pa.binary())})

    def settle(block, answers):
        ids, sizes_out, logs = [], [], []
        for row in block.to_pylist():
            sizes, words = of_block(row["lengths"], row["words"], row["known"])
            replies = [[b""] * buckets for _ in range(order)]
            for n, b, sums in zip(answers.column("n").to_pylist(), answers.column("bucket").to_pylist(), answers.column("sums").to_pylist(), strict=True):
                replies[n - 1][b] = sums
            log = logs_of(sizes, words, bits, replies, total, alpha, min_count)
            ends = np.cumsum(sizes)
            ids += row["doc_ids"]
            sizes_out += sizes.tolist()
            logs += [float(np.sum(log[e - s : e])) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(sizes_out, pa.int64()), "log_score": pa.array(logs, pa.float64())})

    requests = table.drop("doc_ids", "n_words").mapInArrow(ask, "bucket int, block long, n int, steps binary, counts binary")
    replies = requests.groupBy("bucket").applyInArrow(answer, "bucket int, block long, n int, sums binary")
    return table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(settle, "doc_id long, n_words long, log_score double")
