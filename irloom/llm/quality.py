"""Document quality by a sparse rule ensemble.

Statistics of the whole text feed small boosted trees; every path from a root to a node
becomes a conjunctive rule; logistic regression with an L1 penalty keeps the few rules
that matter; these are compiled to one Spark column expression over the statistics.

Cases: a null text counts as empty; an empty text has all statistics 0 and is scored like
any other; without labelled rows of both kinds every score is the share of label 1 (1 with
no labels); equal statistics give equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irloom.llm.common import bounded_sample, text_batches

#: Labelled rows learned from at most.
SAMPLE_ROWS = 24_000
TREES, DEPTH, BINS = 40, 3, 32
PENALTY = 4e-4

STATISTICS = [
    "n_chars", "n_words", "n_lines", "mean_word", "longest_word", "upper_share", "digit_share", "space_share", "symbol_share", "bang_share",
    "pipe_share", "stop_share", "comma_share", "angle_share", "wide_share", "distinct_words", "repeated_next", "distinct_lines", "short_words", "top_word",
]

#: Of the columns of statistics, which so clash with none of a table.
PREFIX = "__stat_"

UPPER, DIGIT, SPACE = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
SYMBOL, ANGLE, WIDE = b"#$%&*^~=+_@\\/`", b"<>{}[]", bytes(range(0xC2, 0xF5))


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text, in the order of STATISTICS."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    w = len(words)
    lengths = list(map(len, words))
    counts = Counter(words)
    kinds = len(counts)
    again = sum(map(bytes.__eq__, words, words[1:])) if w > 1 else 0
    top = max(counts.values()) / w if w else 0.0
    return [
        float(n), float(w), float(len(lines)), sum(lengths) / w if w else 0.0, float(max(lengths, default=0)), share(UPPER), share(DIGIT), share(SPACE), share(SYMBOL), raw.count(b"!") / n,
        raw.count(b"|") / n, raw.count(b".") / n, raw.count(b",") / n, share(ANGLE), share(WIDE), kinds / w if w else 0.0, again / w if w else 0.0, len(set(lines)) / len(lines) if lines else 0.0, sum(map((4).__gt__, lengths)) / w if w else 0.0, top,
    ]


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in `keep` and one double column per statistic, named PREFIX and its name."""
    text_batches(docs.sparkSession)
    schema = docs.select(*keep).schema
    for s in STATISTICS:
        schema = schema.add(PREFIX + s, "double")

    def run(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(np.ascontiguousarray(rows[:, j])) for j in range(len(STATISTICS)))], names=schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)


#: A rule is a conjunction: (statistic, above, threshold) each.
Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, path: Rule = ()) -> tuple[list[Rule], list[tuple[np.ndarray, float]]]:
    """Rules of all nodes below this one, and its leaves as (row mask, value)."""
    rules: list[Rule] = []

    def split(rows: np.ndarray, depth: int, path: Rule) -> list[tuple[np.ndarray, float]]:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, -1, 0)
        if depth and len(rows) >= 20:
            for j, c in enumerate(cuts):
                if len(c):
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                    n_left = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(n_left < 5) | (len(rows) - n_left < 5)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
        if best[1] < 0:
            return [(rows, float(gs / (hs + 1)))]
        _, j, k = best
        below = binned[rows, j] <= k
        out = []
        for side, above in ((rows[below], False), (rows[~below], True)):
            p = (*path, (j, above, float(cuts[j][k])))
            rules.append(p)
            out += split(side, depth - 1, p)
        return out

    return rules, split(np.arange(len(x)), depth, path)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) if above else (x[:, j] <= t)
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient; the intercept is not penalised."""
    n, m = a.shape
    step = 4 / (np.linalg.norm(a, 2) ** 2 / n + 1)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30))) - y
        w2 = v - step * (a.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * r.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass
class Model:
    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            test = F.lit(True)
            for j, above, t in rule:
                c = F.col(PREFIX + STATISTICS[j])
                test = test & (c > F.lit(t) if above else c <= F.lit(t))
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} " + " and ".join(f"{STATISTICS[j]} {'>' if a else '<='} {t:.5g}" for j, a, t in r) for r, w in self.rules]


def fit_arrays(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Model:
    if not len(y) or y.min() == y.max():
        return Model([], 30.0 if not len(y) or y[0] else -30.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    cuts = [np.array([q for q in c if (col > q).any()]) for c, col in zip(cuts, x.T, strict=True)]
    binned = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)])
    rules: dict[Rule, None] = {}
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        new, leaves = grow(x, binned, cuts, y - p, p * (1 - p), depth)
        if not new:
            break
        rules.update(dict.fromkeys(new))
        for rows, value in leaves:
            f[rows] += 0.3 * value
    listed = list(rules)
    if not listed:
        return Model([], float(np.log(y.mean() / (1 - y.mean()))))
    w, b = lasso(np.column_stack([holds(r, x) for r in listed]).astype(float), y, penalty)
    return Model([(r, float(v)) for r, v in zip(listed, w, strict=True) if v], b)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from `labels` (doc_id, quality), a bounded sample of whose rows is looked up in `docs`."""
    marked = bounded_sample(labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("quality", "text")  # bounded by sample_rows
    rows = with_statistics(texts, ["quality"]).collect()  # at most about sample_rows of numbers
    x = np.array([r[1:] for r in rows], float).reshape(-1, len(STATISTICS))
    y = np.array([r[0] for r in rows], float)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order rows came in
    return fit_arrays(x[order], y[order])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    keep = keep or ["doc_id"]
    return with_statistics(docs, keep).select(*keep, model.column().alias("score"))
