"""Fitted operators and the pipeline against plain versions of what they say they do."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from irloom.llm import langid, minhash, quality, toxicity

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.fixture(scope="module")
def words():
    rng = random.Random(31)
    return ["".join(rng.choice(["ba", "ru", "ti", "os", "el", "ky"]) for _ in range(rng.randint(2, 4))) for _ in range(250)]


def test_quality_column_is_the_rules(spark, words):
    rng = random.Random(32)
    texts = [None, "", " ", "A" * 3000, *(" ".join(rng.choices(words, k=rng.randint(1, 300))) + rng.choice(["", "!!", "\nx\nx"]) for _ in range(60))]
    texts += texts[4:8]  # repeated rows, and so ties
    rules = []
    for _ in range(25):
        some = rng.sample(range(len(quality.STATISTICS)), rng.randint(1, 3))
        rules.append((tuple((j, rng.random() < 0.5, rng.choice([0.0, 0.01, 0.3, 3.0, 40.0, 500.0])) for j in some), rng.uniform(-2, 2)))
    model = quality.Model(rules, -0.3)
    docs = spark.createDataFrame([(i, t, 1.0, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words double, score int")
    for r in quality.score(docs, model, ["doc_id", "n_words"]).collect():
        x = quality.statistics(texts[r.doc_id])
        z = -0.3 + sum(w for rule, w in rules if all((x[j] > t) if above else (x[j] <= t) for j, above, t in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.n_words == 1.0


def test_lasso_is_at_its_optimum():
    rng = np.random.default_rng(33)
    a = (rng.random((400, 30)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * a[:, 0] - 3 * a[:, 1] + 0.5)))).astype(float)
    w, b = quality.lasso(a, y, 0.01, steps=4000)
    r = 1 / (1 + np.exp(-(a @ w + b))) - y
    slope = a.T @ r / len(y)
    assert abs(r.mean()) < 1e-4 and (np.abs(slope[w == 0]) <= 0.01 + 1e-4).all()
    assert np.allclose(slope[w != 0], -0.01 * np.sign(w[w != 0]), atol=1e-4) and w[0] > 0 > w[1]


def brute_segments(w):
    """The best run, then those left and right of it."""
    runs = [(sum(w[i:j]), i - j, i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)]
    if not runs or max(runs)[0] <= 0:
        return []
    s, _, i, j = max(runs, key=lambda r: (r[0], r[1], -r[2]))
    return [*brute_segments(w[:i]), s, *brute_segments(w[j:])]


def test_toxicity_by_hand(spark, words):
    """Counts, log-odds, z, the rate and the score of every text from their definitions."""
    rng = random.Random(34)
    bad = ["vileness", "rottenly", "accursed"]
    rows, marks = [], []
    for i in range(240):
        w = rng.choices(words, k=rng.randint(8, 18))
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, 1, 2 if i % 4 == 0 else 0))  # any label above 0 is one
    docs, labels = spark.createDataFrame(rows, ROWS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    n = {k: sum((t > 0) == k for _, _, t in marks) for k in (True, False)}
    held = {k: collections.Counter(w for (_, text, *_), (_, _, t) in zip(rows, marks, strict=True) if (t > 0) == k for w in set(text.split())) for k in (True, False)}
    want = {}
    for w in {*held[True], *held[False]}:
        t, c = held[True][w], held[False][w]
        share = (t + c) / sum(n.values())
        odds = lambda y, of, share=share: math.log((y + 10 * share) / (of + 10 - y - 10 * share))
        delta = odds(t, n[True]) - odds(c, n[False])
        z = delta / math.sqrt(1 / (t + 10 * share) + 1 / (c + 10 * share))
        if t + c > 1 and z >= toxicity.MIN_Z and delta >= toxicity.MIN_ODDS:
            want[w] = min(6.0, delta)
    assert set(bad) <= set(want) and model.words == pytest.approx(want)
    clean = [[model.weigh(w) for w in text.split()] for (_, text, *_), (_, _, t) in zip(rows, marks, strict=True) if not t]
    above = [x for ws in clean for x in ws if x > 0]
    share = (len(above) + 1) / (len(above) + 1 + max(1, sum(map(len, clean)) - len(above)))
    mean = (sum(above) + 1) / (len(above) + 1)
    assert share * math.exp(model.rate * mean) + (1 - share) * math.exp(model.rate * model.other) == pytest.approx(1, abs=1e-6)
    texts = {i: t for i, t, *_ in rows} | {1000: None, 1001: "", 1002: "vileness", 1003: rows[0][1]}
    got = toxicity.score(spark.createDataFrame([(i, t, None, None, 0) for i, t in [*texts.items(), (0, texts[0])]], ROWS), model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ws = [model.weigh(w) for w in (texts[r.doc_id] or "").split()]
        surprise = [model.rate * s - math.log(model.scale * max(1, len(ws))) for s in brute_segments(ws)]
        a = math.log1p(sum(x for x in surprise if x >= -math.log(toxicity.SIGNIFICANT)))
        b = max(-toxicity.FAR, min(toxicity.FAR, max(surprise, default=-toxicity.FAR)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.curve[0] * a + model.curve[1] * b + model.curve[2]))))


def test_language_of_whole_texts(spark):
    """The sums over all segmentations of every word of a text, one of them 400 letters long."""
    lists = {"de": "der und mit nicht ein auch".split(), "en": "the and of with this that".split()}
    rng = random.Random(35)
    docs = [(i, " ".join(rng.choices(lists[g], k=20)), g, "s", 1) for i in range(60) for g in [("de", "en")[i % 2]]]
    model = langid.fit(spark.createDataFrame(docs, ROWS))
    texts = ["the und of", "x" * 400, "the " + "andmit" * 60, "12 ,", None, "Nicht AUCH"]

    def log_word(word, k):
        p = {s: model.probability[i, k] for i, s in enumerate(model.pieces.pieces)}
        text = langid.MARK + word
        at = [0.0]
        for e in range(1, len(text) + 1):
            ways = [at[e - 1] + math.log(langid.UNSEEN), *(at[b] + math.log(p[text[b:e]]) for b in range(max(0, e - model.pieces.longest), e) if p.get(text[b:e]))]
            top = max(ways)
            at.append(top + math.log(sum(math.exp(w - top) for w in ways)))
        return at[-1]

    for r in langid.predict(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], ROWS), model).collect():
        found = langid.words_of(texts[r.doc_id] or "")
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = [sum(log_word(w, k) for w in found) for k in range(len(model.languages))]
        best = max(range(len(logs)), key=lambda k: logs[k])
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs))


@pytest.fixture(scope="module")
def corpus(spark, words, tmp_path_factory):
    """Clean, toxic, foreign, copied and long documents, with columns named like those of the stages."""
    rng = random.Random(36)
    rows, marks = [], []
    for i in range(160):
        w = rng.choices(words, k=40)
        if i % 5 == 0:
            for _ in range(6):
                w[rng.randrange(40)] = rng.choice(["vileness", "rottenly", "accursed"])
        rows.append((i, " ".join(w), "en"))
        marks.append((i, 1, int(i % 5 == 0)))
    rows += [(200 + i, rows[i][1] + " one more", None) for i in range(1, 30)] + [(300 + i, rows[7][1], "en") for i in range(20)]
    rows += [(400, " ".join(rng.choices(words, k=9000)), "en"), (401, None, "en"), (402, "", None), (403, "12 34 --", "en"), (7, rows[7][1], "en")]
    path = tmp_path_factory.mktemp("corpus")
    extra = "score int, lang_pred string, row int, component string, paragraph int"
    spark.createDataFrame([(i, t, g, "s", len(t or ""), 1, "x", 2, "y", 3) for i, t, g in rows], f"{ROWS}, {extra}").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_by_brute_force(spark, corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    rows = lambda df: sorted((r.doc_id, r.text or "") for r in df.collect())
    stages = dict(pipeline.STAGES)

    model = toxicity.fit(docs, labels.where(F.col("doc_id").isin([r.doc_id for r in labels.collect() if crc(r.doc_id, 3) != 1])))
    kept = stages["toxicity"](spark, docs, corpus)
    assert kept.columns == docs.columns
    assert rows(kept) == sorted((r.doc_id, r.text or "") for r in docs.collect() if model.probability(r.text) < 0.7)
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert gone and all(i % 5 == 0 for i in gone if i < 200)

    told = stages["language_id"](spark, docs, corpus)
    assert told.columns == docs.columns and rows(told) == [x for x in rows(docs) if any(map(str.isalpha, x[1]))]
    unknown = stages["language_id"](spark, docs.withColumn("lang", F.lit(None).cast("string")), corpus)
    assert rows(unknown) == rows(told)

    single = stages["minhash_dedup"](spark, docs, corpus)
    sets = {r.doc_id: minhash.shingles(minhash.words_of(r.text)) for r in docs.collect()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    assert single.columns == docs.columns and [i for i, _ in rows(single)] == sorted(i for i in sets if top(i) == i)

    packed = stages["packing"](spark, docs, corpus).collect()
    length = {(r.doc_id, r.doc_tokens) for r in packed}
    by_doc = collections.Counter()
    for r in packed:
        by_doc[r.doc_id] += r.length
    assert set(by_doc) == set(sets) and all(by_doc[i] == n * (2 if i == 7 else 1) for i, n in length)


def test_whole_pipeline(spark, corpus):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, corpus).collect(), docs.schema)
        assert name
    assert sorted({r.doc_id for r in pipeline.run(spark, corpus).collect()}) == sorted({r.doc_id for r in docs.collect()})


def test_empty_tables(spark, corpus, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for table in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
