"""The maximum-entropy model: counts against plain ones, scores against a plain walk, probabilities that add up."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import maxent

SCHEMA = "doc_id long, text string, lang string, block long, units string, learn string, t string"
CLASH = ("en", 1, "u", "l", "t")


def corpus(n=300, seed=4):
    """Two made-up tongues; a word's tongue follows from the words before it."""
    r = np.random.default_rng(seed)
    tongues = [[f"{p}{a}{b}" for a in "aeiou" for b in "bdgklmnrst"] for p in ("w", "z")]
    common = [["the", "of", "and"], ["le", "du", "et"]]
    out = []
    for i in range(n):
        k = int(r.integers(0, 2))
        words = [str(r.choice(common[k])) if r.random() < 0.4 else tongues[k][min(49, int(r.exponential(12)))] for _ in range(int(r.integers(5, 60)))]
        out.append((i, " ".join(words), *CLASH))
    return out


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


@pytest.mark.parametrize("small", [False, True])
def test_counts_base_and_gain(spark, monkeypatch, small):
    if small:  # many blocks, buckets and shards
        monkeypatch.setattr(maxent, "BLOCK_BYTES", 900)
        monkeypatch.setattr(maxent, "BUCKET_BYTES", 2000)
        monkeypatch.setattr(maxent, "CELL_BYTES", 2000)
    rows = corpus() + [(None, "the OF \x1f wÉ the of", *CLASH), (1000, None, *CLASH), (1001, "", *CLASH), (5, "the", *CLASH), (5, "the", *CLASH), (1002, "lone " * 3000 + "x" * 5000, *CLASH)]
    got = [r.asDict() for r in maxent.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    counts = Counter(w for d, t, *_ in rows if not held_out(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), held_out(d), len(tokens(t)), sum(w in counts for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t, *_ in rows)
    assert sorted((str(g["doc_id"]), g["held_out"], g["n_tokens"], g["n_known"], round(g["base_score"], 6)) for g in got) == want
    assert all(g["train_tokens"] == n and g["score"] <= 0 for g in got)
    ours = [g for g in got if g["held_out"] and g["doc_id"] < 1000]
    assert sum(g["score"] for g in ours) > sum(g["base_score"] for g in ours) + 0.15 * sum(g["n_tokens"] for g in ours)


def test_scores_by_a_plain_walk(spark):
    rows = corpus(120)
    docs = spark.createDataFrame(rows, SCHEMA).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("t"), (F.col("doc_id") % 5 != 0).alias("learn"))
    fitted = maxent.fit(docs)
    model, lexicon = fitted.model, fitted.model.lexicon
    assert all(b > a for a, b in zip(model.likelihood, model.likelihood[1:], strict=False))
    count, kind = {}, {}
    for r in fitted.words.select("words", "counts", "classes").collect():
        for w, c, k in zip(bytes(r["words"]).split(b"\n"), np.frombuffer(r["counts"], np.int64), r["classes"], strict=True):
            count[w], kind[w] = int(c), k

    def unit(w):
        if w not in count:
            return maxent.UNKNOWN
        k, slot = lexicon.heads.get(w, (kind[w], maxent.HEADS))
        return k * maxent.SLOTS + slot

    used = {divmod(unit(w), maxent.SLOTS) for w in count}

    def softmax(side, code):
        rows = maxent.features(side, np.array([code]))[0]
        x = np.exp(sum(model.weights[side][r].astype(float) for r in rows))
        k = code // (maxent.UNKNOWN + 1)
        there = [any(i == c for c, _ in used) if side == "class" else (k, i) in used for i in range(len(x))]
        x = np.where(there, x, 0)
        return x / x.sum()

    def probability(w, one, two):
        if w not in count:
            return lexicon.unknown
        u = unit(w)
        k, slot = divmod(u, maxent.SLOTS)
        two = {maxent.BEGIN: maxent.BEGIN_CLASS, maxent.UNKNOWN: maxent.UNKNOWN_CLASS}.get(two, two // maxent.SLOTS)
        own = 1.0 if slot < maxent.HEADS else (count[w] + 1) / lexicon.rest[k]
        return (1 - lexicon.unknown) * softmax("class", one * maxent.WIDE + two)[k] * softmax("slot", k * (maxent.UNKNOWN + 1) + one)[slot] * own

    def walk(text):
        one = two = maxent.BEGIN
        total = 0.0
        for w in tokens(text):
            total += math.log10(probability(w, one, two))
            one, two = unit(w), one
        return total

    for g in maxent.score_blocks(fitted.units, model).filter("doc_id < 15").collect():
        assert g["score"] == pytest.approx(walk(rows[g["doc_id"]][1]), abs=1e-3)
    for one, two in ((maxent.BEGIN, maxent.BEGIN), (unit(b"the"), unit(b"of"))):
        total = lexicon.unknown + sum(probability(w, one, two) for w in count)
        assert total == pytest.approx(1, abs=1e-9)


def test_what_goes_through_the_driver(spark, monkeypatch):
    """A round brings no more than the weights back, and what it sends is given up when it ends."""
    context, frame, rounds = type(spark.sparkContext), type(spark.range(0)), 3
    sent, back = [], []

    def broadcast(self, value, f=context.broadcast):
        sent.append(f(self, value))
        return sent[-1]

    def collect(self, f=frame.collect):
        rows = f(self)
        back.append(sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray)))
        return rows

    monkeypatch.setattr(context, "broadcast", broadcast)
    monkeypatch.setattr(frame, "collect", collect)
    docs = spark.createDataFrame(corpus(60), SCHEMA).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("t"), F.lit(True).alias("learn"))
    model = maxent.fit(docs, rounds).model
    assert len(model.likelihood) == rounds and model.likelihood[-1] > model.likelihood[0]
    assert sum(back) <= rounds * sum(w.nbytes for w in model.weights.values())
    assert [b for b in sent if os.path.exists(b._path)] == []


def test_nothing_to_learn_from(spark):
    assert maxent.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [(i, "some words", *CLASH) for i in range(200) if held_out(i)][:3]
    got = maxent.score_documents(spark.createDataFrame(held, SCHEMA)).collect()
    assert [(g["n_tokens"], g["n_known"], g["train_tokens"], g["base_score"], g["score"]) for g in got] == [(3, 0, 0, 0.0, 0.0)] * 3


def test_words_that_are_no_heads_are_modelled_too(spark):
    """Of two words too long to be heads, of one class and equally frequent, each follows words of another class."""
    j1, j2, p1, p2 = (w * 50 for w in ("j1", "j2", "p1", "p2"))
    texts = [f"aa {j1} {j1} {j1} the {j1} {p1}", f"bb {j2} {j2} {j2} the {j2} {p2}"] * 150 + [f"the {j1} {p}" for p in (p1, p2)]
    docs = spark.createDataFrame([(str(i), t, i < 300) for i, t in enumerate(texts)], "doc_id string, t string, learn boolean").repartition(3)
    fitted = maxent.fit(docs)
    model, lexicon = fitted.model, fitted.model.lexicon
    assert all(b > a for a, b in zip(model.likelihood, model.likelihood[1:], strict=False))
    rest = {}
    for r in fitted.words.select("words", "counts", "classes").collect():
        for w, c, k in zip(bytes(r["words"]).split(b"\n"), np.frombuffer(r["counts"], np.int64), r["classes"], strict=True):
            if w not in lexicon.heads:
                rest[w.decode()] = k, (c + 1) / lexicon.rest[k]
    assert set(rest) == {j1, j2, p1, p2} and rest[p1] == rest[p2] and rest[p1][1] == 0.5

    def probability(w, before):
        k = rest[w][0]
        power = {v: x * math.exp(sum(float(model.weights["word"][row, before]) for row in maxent.word_rows(maxent.word_codes([v.encode()]))[0])) for v, (kind, x) in rest.items() if kind == k}
        assert math.exp(model.log_sums[k, before]) == pytest.approx(sum(power.values()))
        return power[w] / sum(power.values())

    scores = {g["doc_id"]: g["score"] for g in maxent.score_blocks(fitted.units, model).filter("held_out").collect()}
    after = rest[j1][0]
    assert probability(p1, after) > 0.9 and probability(p1, after) + probability(p2, after) == pytest.approx(1)
    assert scores[300] - scores[301] == pytest.approx(math.log10(probability(p1, after) / probability(p2, after)), abs=1e-6)
