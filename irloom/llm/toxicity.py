"""Toxic passages by maximum-scoring segment search.

Each word has a weight: the log-odds that a toxic rather than a clean document holds it,
with a Dirichlet prior taken from both kinds together; words too rare to tell fall back
to the weight of their first letters, and the rest share one weight. A linear-time scan
finds every maximal-scoring segment of a document's weights. Extreme-value statistics of
segments by chance, with rate and scale fitted on clean documents, tell how significant
a segment of a document of that length is; a logistic curve turns the evidence of the
significant ones into a probability.

Cases: a null or empty text has no segment and gets the score of no evidence; equal
segments are all kept; without labelled rows of both kinds every score is 0; repeated
rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from irloom.llm.common import bounded_sample, digest, text_batches, worker_memo

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows learned from at most.
SAMPLE_ROWS = 24_000
#: Documents' worth of prior counts; z (of a word, of a stem) and log-odds from which there is a weight of its own.
PRIOR, MIN_Z, MIN_Z_STEM, MIN_ODDS = 10.0, 2.5, 3.5, 1.3
STEMS = (7, 6, 5, 4)
MEMO_WORDS = 400_000
#: Bounds of the evidence of a single segment.
FAR = 12.0
#: Expected chance segments of this score in a document, from which a segment is significant.
SIGNIFICANT = 0.05


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def maximal_segments(weights: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of every maximal-scoring segment, left to right, in linear time.

    Runs of one sign are taken together first; then candidates are kept on a stack with
    the sums before and after them, each linked to the next one below with a smaller sum
    before it.
    """
    at = np.flatnonzero(weights > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(weights)))
    cut = np.flatnonzero(np.diff(at) > 1)
    starts, ends = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        low, high = float(sums[start]), float(sums[end])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, high - low) for s, e, low, high, _ in stack]


class Known(dict):
    """Weights of words that a worker has met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        x = self[word] = self.model.weigh(word)
        return x


@dataclass
class Model:
    """`words` and `stems` hold weights above 0; the longest stem with one counts for a word without."""

    words: dict[str, float]
    stems: dict[str, float]
    other: float
    rate: float = 1.0
    scale: float = 1.0
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def weigh(self, word: str) -> float:
        if (x := self.words.get(word)) is not None:
            return x
        for n in STEMS:
            if len(word) >= n and (x := self.stems.get(word[:n])) is not None:
                return x
        return self.other

    def weights(self, words: list[str]) -> np.ndarray:
        """Weights of words; those met before are kept, up to a bound."""
        if "_key" not in self.__dict__:
            self._key = ("toxicity", digest(repr((sorted(self.words.items()), sorted(self.stems.items()), self.other)).encode()))
        known = worker_memo(self._key, lambda: Known(self))
        if len(known) > MEMO_WORDS:
            known.clear()
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_key"}

    def surprise(self, score: float, n: int) -> float:
        """-log of how many segments of this score chance gives in n words."""
        return self.rate * score - math.log(self.scale * max(n, 1))

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], int]:
        """(first word, word after the last, score, surprise) of every significant segment; the number of words."""
        words = words_of(text) if text else []
        if not words:
            return [], 0
        n, least = len(words), -math.log(SIGNIFICANT)
        found = [(s, e, x, self.surprise(x, n)) for s, e, x in maximal_segments(self.weights(words))]
        return [f for f in found if f[3] >= least], n

    def evidence(self, text: str | None) -> tuple[float, float]:
        """Of all significant passages together, and of the best segment whether significant or not."""
        words = words_of(text) if text else []
        found = [self.surprise(x, len(words)) for _, _, x in maximal_segments(self.weights(words))] if words else []
        least = -math.log(SIGNIFICANT)
        return math.log1p(sum(x for x in found if x >= least)), max(-FAR, min(FAR, max(found, default=-FAR)))

    def probability(self, text: str | None) -> float:
        a, b = self.evidence(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] * a + self.curve[1] * b + self.curve[2]))))


def fit_rate(weights: np.ndarray, counts: np.ndarray) -> float:
    """The positive x with mean exp(x * weight) = 1; the mean weight must be negative."""
    p = counts / counts.sum()
    low, high = 1e-6, 1.0
    while (p * np.exp(np.minimum(high * weights, 500))).sum() < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * weights, 500))).sum() < 1 else (low, mid)
    return high


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, ...]:
    """Slopes and intercept of a logistic curve, by Newton's method with a little ridge."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    return tuple(map(float, w))


def near_key(batches):
    """Adds the two smallest hashes of three-word shingles, which near copies mostly share."""
    for batch in batches:
        keys = []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))}
            keys.append(" ".join(map(str, heapq.nsmallest(2, hashes))))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(1), pa.array(keys, pa.string())], names=["toxic", "text", "near"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from `labels` (doc_id, toxic), a bounded sample of whose rows is looked up in `docs`.

    Of equal and most nearly equal texts of one label one counts. Words are counted on the executors; only those
    that pass the test of significance come to the driver. They are words and stems of the sample, so its bound is
    theirs. A label counts as toxic if it is above 0.
    """
    spark = docs.sparkSession
    text_batches(spark)
    marked = bounded_sample(labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")), "doc_id", sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))  # bounded by sample_rows
    texts = texts.mapInArrow(near_key, "toxic int, text string, near string").groupBy("toxic", "near").agg(F.min("text").alias("text")).drop("near").persist()

    def tally(batches):
        counts: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(words_of(text))
                for key in [*((w, 0) for w in words), *((s, 1) for s in {w[:n] for n in STEMS for w in words if len(w) >= n}), ("", 2)]:
                    counts.setdefault(key, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array([v[1] for v in counts.values()], pa.int64()), pa.array([v[0] for v in counts.values()], pa.int64())], names=["word", "kind", "toxic", "clean"])

    counts = texts.mapInArrow(tally, "word string, kind int, toxic long, clean long").groupBy("word", "kind").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).persist()
    total = counts.where("kind = 2").first()
    if total is None or not total.t or not total.c:
        counts.unpersist()
        texts.unpersist()
        return None
    share = (F.col("t") + F.col("c")) / F.lit(float(total.t + total.c))
    odds = lambda y, n: F.log((y + PRIOR * share) / (n + PRIOR - y - PRIOR * share))
    delta = odds(F.col("t"), F.lit(float(total.t))) - odds(F.col("c"), F.lit(float(total.c)))
    z = delta / F.sqrt(1 / (F.col("t") + PRIOR * share) + 1 / (F.col("c") + PRIOR * share))
    told = counts.where("kind < 2 AND t + c > 1").select("word", "kind", delta.alias("delta"), z.alias("z")).where((F.col("z") >= F.when(F.col("kind") == 0, MIN_Z).otherwise(MIN_Z_STEM)) & (F.col("delta") >= MIN_ODDS))
    rows = told.collect()
    counts.unpersist()
    bound = 6.0
    weights = {k: {r.word: max(-bound, min(bound, r.delta)) for r in rows if r.kind == k and r.delta > 0} for k in (0, 1)}
    model = Model(weights[0], weights[1], other=0.0)

    base = spark.sparkContext.broadcast(model)

    def above_zero(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                w = base.value.weights(words_of(text))
                out.append((len(w), int((w > 0).sum()), float(w[w > 0].sum())))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["n", "n_above", "above"])

    def best(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                w = scored.value.weights(words_of(text))
                out.append((len(w), max((s[2] for s in maximal_segments(w)), default=0.0)))
            cols = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64())], names=["n", "best"])

    # Each of the following brings at most sample_rows rows of numbers to the driver.
    untouched = texts.where("toxic = 0")
    clean = [r for r in untouched.mapInArrow(above_zero, "n long, n_above long, above double").collect() if r.n]
    n_above, n_all = sum(r.n_above for r in clean), sum(r.n for r in clean)
    mean_above = (sum(r.above for r in clean) + 1.0) / (n_above + 1.0)
    # All other words share one weight, low enough that a clean text's sum falls twice as fast as it rises.
    model.other = -(0.03 + 3 * sum(r.above for r in clean) / max(1, n_all))
    model.__dict__.pop("_key", None)
    model.rate = fit_rate(np.array([mean_above, model.other]), np.array([n_above + 1.0, max(1.0, n_all - n_above)]))
    scored = spark.sparkContext.broadcast(model)
    clean = [r for r in untouched.mapInArrow(best, "n long, best double").collect() if r.n]
    model.scale = len(clean) / max(1e-9, sum(max(r.n, 1) * math.exp(-model.rate * r.best) for r in clean)) if clean else 1.0
    fitted = spark.sparkContext.broadcast(model)

    def evidence(batches):
        for batch in batches:
            found = [fitted.value.evidence(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], names=["toxic", "a", "b"])

    rows = sorted(tuple(r) for r in texts.mapInArrow(evidence, "toxic int, a double, b double").collect())  # at most sample_rows of numbers
    texts.unpersist()
    x = np.array(rows, float)
    model.curve = fit_curve(x[:, 1:], x[:, 0])
    return model


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, passages: bool = False, to: str = "score") -> DataFrame:
    """The columns in `keep` with the score of every text as `to`; with `passages` also its significant passages."""
    spark = docs.sparkSession
    text_batches(spark)
    keep = keep or ["doc_id"]
    at = keep.index("text") if "text" in keep else len(keep)
    schema = docs.select(*keep).schema.add(to, "double")
    if passages:
        schema = schema.add(*T.StructType.fromDDL("passages array<struct<first_word:int,end_word:int,score:double,surprise:double>>").fields)
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(to), *([F.array().cast(schema["passages"].dataType).alias("passages")] if passages else []))
    shared = spark.sparkContext.broadcast(model)  # words of a bounded sample

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            cols = [*batch.columns[: len(keep)], pa.array([shared.value.probability(t) for t in texts], pa.float64())]
            if passages:
                kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("surprise", pa.float64())]))
                cols.append(pa.array([[dict(zip(("first_word", "end_word", "score", "surprise"), p, strict=True)) for p in shared.value.passages(t)[0]] for t in texts], kind))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*keep, *([] if "text" in keep else [F.col("text").cast("string")])).mapInArrow(run, schema)
