"""Language identification by segmentation-marginalised unigrams.

A fixed public piece vocabulary is given; each language has a probability for each
piece. The probability of a word is the sum over all ways to cut it into pieces, found
by a forward recursion over its characters, so no single segmentation decides. A text's
score for a language is the sum of the log-probabilities of its words; the prediction is
the language with the largest, and the score its posterior under even priors.

Words are maximal runs of letters of the lower-cased text, marked at their start. The
forward sums are scaled every few characters, so a run of any length is scored whole.

Cases: a null text or one without letters gives `und` with score 0; equal likelihoods go
to the first language by name; with no labelled row nothing is learned and every text is
`und`; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import Numbering, bounded_sample, digest, text_batches, worker_memo

WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Labelled rows learned from at most.
SAMPLE_ROWS = 6000
#: Added to every count of a piece.
SMOOTHING = 0.5
#: Probability of one character that no piece covers.
UNSEEN = 1e-7
MEMO_WORDS = 600_000
#: Characters after which the forward sums are scaled.
SCALED = 8
#: Letters scored together.
BATCH_LETTERS = 200_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Pieces:
    """A piece vocabulary that finds the piece at each place and length of many words at once."""

    pieces: list[str]
    longest: int = 0
    hashes: np.ndarray = field(default=None, repr=False)
    order: np.ndarray = field(default=None, repr=False)

    def __post_init__(self):
        self.longest = max(map(len, self.pieces))
        with np.errstate(over="ignore"):
            h = []
            for p in self.pieces:
                x = np.uint64(0)
                for c in p:
                    x = x * BASE + np.uint64(ord(c) + 1)
                h.append(x)
        h = np.array(h, np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def find(self, codes: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For each place after a character, by length from 1: the piece that ends there, of each word (-1: none)."""
        n, m = codes.shape
        with np.errstate(over="ignore"):
            power, p = [], np.uint64(1)
            for _ in range(self.longest + 1):
                power.append(p)
                p = p * BASE
            prefix = [np.zeros(n, np.uint64)]
            for e in range(1, m + 1):
                prefix.append(prefix[-1] * BASE + codes[:, e - 1].astype(np.uint64) + np.uint64(1))
                prefix = prefix[-self.longest - 1 :]
                row = []
                for size in range(1, len(prefix)):
                    h = prefix[-1] - prefix[-1 - size] * power[size]
                    at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                    row.append(np.where(self.hashes[at] == h, self.order[at], -1))
                yield row


def by_length(words: list[str]):
    """Groups of words of one length: their positions and a matrix of characters, with the start mark in front."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for size, at in groups.items():
        step = max(1, BATCH_LETTERS // (size + 1))
        for k in range(0, len(at), step):
            part = at[k : k + step]
            codes = np.frombuffer("".join(MARK + words[i] for i in part).encode("utf-32-le"), "<u4").reshape(len(part), size + 1)
            yield np.array(part), codes


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    #: Row per piece and one of zeros at the end, column per language.
    probability: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P(word | language), summed over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        for at, codes in by_length(words):
            forward, logs = [np.ones((len(at), len(self.languages)))], np.zeros((len(at), len(self.languages)))
            for e, row in enumerate(self.pieces.find(codes), 1):
                total = forward[-1] * UNSEEN
                for size, piece in enumerate(row, 1):
                    hit = np.flatnonzero(piece >= 0)
                    if len(hit):
                        total[hit] += forward[-size][hit] * self.probability[piece[hit]]
                forward = [*forward[-self.pieces.longest + 1 :], total]
                if e % SCALED == 0:
                    logs += np.log(total)
                    forward = [f / total for f in forward]
            out[at] = logs + np.log(forward[-1])
        return out


class Scorer:
    """A worker's model and the scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number, self.table = Numbering(), np.zeros((0, len(self.model.languages)))

    def score(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Per text the summed log-probabilities of its words; None without letters."""
        if len(self.number) > MEMO_WORDS:
            self.forget()
        known = len(self.number)
        rows = []
        for t in texts:
            words = words_of(t) if t else []
            rows.append(np.fromiter(map(self.number.__getitem__, words), np.int64))
        new = list(itertools.islice(self.number, known, None))
        if new:
            self.table = np.concatenate((self.table, self.model.word_scores(new)))
        return [self.table[r].sum(0) if len(r) else None for r in rows]


def read_pieces(path: str) -> tuple[bytes, list[str]]:
    """The vocabulary file and its ordinary pieces, in id order ("" where a piece is not ordinary)."""
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return raw, ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]


def fit(docs: DataFrame, vocabulary_path: str | None = None, sample_rows: int = SAMPLE_ROWS, smoothing: float = SMOOTHING) -> Model | None:
    """Learn piece probabilities from text and non-null lang of a bounded sample of `docs`.

    The vocabulary's own segmentation gives the counts; per language only one number a
    piece comes to the driver.
    """
    spark = docs.sparkSession
    text_batches(spark)
    raw, pieces = read_pieces(vocabulary_path or public_tokenizers.path("piece_bpe_32k.model"))
    labelled = docs.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    proto = spark.sparkContext.broadcast(raw)  # a fixed vocabulary file

    def count(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto.value)
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text) if text else []
                if words:
                    ids = sp.encode(" ".join(words), num_threads=1)
                    mine = counts.setdefault(lang, np.zeros(len(pieces), np.int64))
                    mine += np.bincount(ids, minlength=len(pieces))
        for lang, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(mine[at])], names=["lang", "piece", "n"])

    sample = bounded_sample(labelled, "doc_id", sample_rows).select("lang", "text")
    rows = sample.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    counts = np.zeros((len(pieces), len(languages)))
    for r in rows:
        counts[r.piece, languages.index(r.lang)] = r.n
    ordinary = [i for i, p in enumerate(pieces) if p]
    counts = counts[ordinary] + smoothing
    probability = np.concatenate((counts / counts.sum(0), np.zeros((1, len(languages)))))
    return Model(languages, Pieces([pieces[i] for i in ordinary]), probability)


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None, to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in `keep` with the language and score of every text under the names in `to`."""
    spark = docs.sparkSession
    text_batches(spark)
    keep = keep or ["doc_id"]
    at = keep.index("text") if "text" in keep else len(keep)
    if model is None:
        return docs.select(*keep, F.lit("und").alias(to[0]), F.lit(0.0).alias(to[1]))
    shared = spark.sparkContext.broadcast(model)  # as large as the vocabulary times the languages
    key = ("langid", digest(repr((model.languages, model.pieces.pieces)).encode(), model.probability.tobytes()))
    languages = model.languages

    def run(batches):
        scorer = worker_memo(key, lambda: Scorer(shared.value))
        for batch in batches:
            langs, scores = [], []
            for total in scorer.score(batch.column(at).to_pylist()):
                if total is None:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    best = int(total.argmax())
                    langs.append(languages[best])
                    scores.append(1 / math.fsum(np.exp(total - total[best])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs), pa.array(scores)], names=[*keep, *to])

    schema = docs.select(*keep).schema.add(to[0], "string").add(to[1], "double")
    return docs.select(*keep, *([] if "text" in keep else [F.col("text").cast("string")])).mapInArrow(run, schema)
