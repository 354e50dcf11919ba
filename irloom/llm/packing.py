"""Cost-balanced packing of token ids into fixed-length training sequences.

Each task packs the documents it reads, so nothing is shuffled. A block's token total
fixes how many full sequences it gets. Documents come in descending order of estimated
cost (linear plus quadratic in the length attended over); each goes whole to the
lowest-cost sequence that has room. A document for which no sequence has room is cut
over the sequences with the most room. What is over at the end of a block fills
sequences whose lengths are powers of two, which need no padding.

Cases: a null text counts as empty and holds the end id only; a document longer than a
sequence is cut at multiples of the capacity first, its rest is packed like any other;
equal costs go by doc_id; repeated rows are packed once per row; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import Numbering, digest, gather, text_batches, text_blocks, worker_memo

CAPACITY = 4096
END_ID = 2
#: Attention cost of one token pair relative to the linear cost of one token.
QUADRATIC = 1 / 2048
#: Text packed together; bounds a worker's memory and sets how rarely a block's tail is cut.
BLOCK_BYTES = 12 << 20

#: Distinct strings whose ids a worker keeps; about 250 bytes each.
MEMO_WORDS = 250_000
#: Strings that the library encodes at a time.
ASKED = 10_000

#: ASCII punctuation that the tokenizer keeps together behind a word (an apostrophe may start an ending of its own).
TAIL = """!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"""

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class WordEncoder:
    """Token ids of texts, string by string between spaces; remembers what it has encoded."""

    def __init__(self, model: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.is_end[ends] = True
        self.forget()

    def forget(self) -> None:
        self.number, self.lengths, self.flat = Numbering(), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _encode_new(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, one after another, and how many each has.

        A Latin word, with or without punctuation behind it, is lower-cased here; the
        library then encodes many distinct words in one text, whose ids fall apart at
        the tokens that end a word. It encodes any other string by itself. What it
        returns is large, so it is asked for little at a time.
        """
        parts, of, odd = Numbering(), np.full((len(strings), 2), -1, np.int64), []
        for k, s in enumerate(strings):
            word = s.lower()
            body = word.rstrip(TAIL)
            if body.isalpha() and max(body) < "\u0250":
                of[k, 0] = parts[body]
                if len(body) < len(word):
                    of[k, 1] = parts[word[len(body) :]]
            else:
                odd.append(k)
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        listed = list(parts)
        for at in range(0, len(listed), ASKED):
            some = listed[at : at + ASKED]
            got = self.tokenizer.encode_batch_fast([" ".join(some[i : i + 256]) for i in range(0, len(some), 256)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in got])
            stop = np.flatnonzero(self.is_end[ids]) + 1
            assert len(stop) == len(some), "a word did not end in one end token"
            flat.append(ids)
            sizes.append(np.diff(stop, prepend=0))
        of[odd, 0] = np.arange(len(listed), len(listed) + len(odd))
        for at in range(0, len(odd), ASKED):
            got = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([strings[k] for k in odd[at : at + ASKED]], add_special_tokens=False)]
            flat.append(np.concatenate(got))
            sizes.append(np.array([len(x) for x in got], np.int64))
        ids, size = np.concatenate(flat), np.concatenate(sizes)
        lengths = np.where(of >= 0, size[of] if len(size) else 0, 0).sum(1)
        return gather(np.cumsum(size) - size, size, ids, of[of >= 0]), lengths

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > MEMO_WORDS:
            self.forget()
        known = len(self.number)
        words = [np.fromiter(map(self.number.__getitem__, t.split(" ")), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        new = list(itertools.islice(self.number, known, None))
        flat, lengths = self._encode_new(new)
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, flat))
        starts = np.cumsum(self.lengths) - self.lengths
        return [gather(starts, self.lengths, self.flat, w) for w in words]


def cost(length, quadratic: float = QUADRATIC):
    """Estimated cost of attending within one piece of `length` tokens."""
    return length + quadratic * length * length


def plan_pieces(lengths: list[int], capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of a block; documents by position in `lengths`.

    Every sequence is full or has a power of two as its length.
    """
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # length, document, start
    n_full = 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, n_full, 0))
            n_full += 1
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    total = sum(r[0] for r in rest)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1]
    used, costs = [0] * len(sizes), [0.0] * len(sizes)
    # Documents come by descending length, so a sequence with room for one keeps it for those that follow
    # until it is filled further; one with too little waits under its room until documents are that short.
    fits: list[tuple[float, int]] = []  # a heap of the sequences with room for the document at hand
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for s, size in enumerate(sizes):
        waiting[size].append(s)
    reached = capacity + 1

    def put(s: int, d: int, start: int, n: int) -> None:
        out.append((d, start, n, n_full + s, used[s]))
        used[s] += n
        costs[s] += cost(n, quadratic)

    spill: list[tuple[int, int, int]] = []
    for n, d, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while reached > n:
            reached -= 1
            for s in waiting[reached]:
                heapq.heappush(fits, (costs[s], s))
        if not fits:
            spill.append((n, d, start))
            continue
        s = heapq.heappop(fits)[1]
        put(s, d, start, n)
        if sizes[s] - used[s] >= n:
            heapq.heappush(fits, (costs[s], s))
        else:
            waiting[sizes[s] - used[s]].append(s)
    room = sorted((s for s in range(len(sizes)) if used[s] < sizes[s]), key=lambda s: (used[s] - sizes[s], costs[s], s))
    at = 0
    for n, d, start in spill:
        while n:
            s = room[at]
            m = min(n, sizes[s] - used[s])
            put(s, d, start, m)
            n, start = n - m, start + m
            at += used[s] == sizes[s]
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, quadratic: float = QUADRATIC, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences; with_ids adds the piece's ids as an array.

    The tokenizer drops white space, so what stands between two spaces is encoded by
    itself. A worker keeps the ids of up to MEMO_WORDS such strings and encodes only new
    ones. A special token that is written out in a text gets its id, as the library does it.
    """
    spark = docs.sparkSession
    text_batches(spark)
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        raw = f.read()
    model = spark.sparkContext.broadcast(raw)  # a fixed vocabulary file
    key = ("packing", digest(raw.encode()))

    def run(batches):
        encoder = worker_memo(key, lambda: WordEncoder(model.value))
        part, n_seq = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        for ids_, texts in text_blocks(batches, ["doc_id", "text"], BLOCK_BYTES):
            tokens = [np.concatenate((x, end)) for x in encoder.encode(texts)]
            texts.clear()  # the block's source holds the list as well
            order = sorted(range(len(ids_)), key=lambda i: (ids_[i] is None, ids_[i] or 0, i))
            pieces = plan_pieces([len(tokens[i]) for i in order], capacity, quadratic)
            cols = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", "ids")}
            for d, start, n, s, offset in pieces:
                whole = tokens[order[d]]
                piece = whole[start : start + n]
                for c, v in zip(cols, (ids_[order[d]], start, n, zlib.crc32(piece.tobytes()), len(whole), (part << 40) + n_seq + s, offset, cost(n, quadratic), piece if with_ids else None), strict=True):
                    cols[c].append(v)
            n_seq += 1 + max((p[3] for p in pieces), default=-1)
            if not with_ids:
                cols.pop("ids")
            types = {"cost": pa.float64(), "ids": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in cols.items()], names=list(cols))
            del tokens, pieces, cols, whole, piece

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<long>" if with_ids else ""))
