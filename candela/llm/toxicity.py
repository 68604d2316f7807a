"""Toxicity (8) by weak supervision.

Voters are lexicons, patterns of writing, and word beginnings that stand out; each fires on a text or not. A generative model of
label and votes, log-linear in all of them, has a weight between the label and each voter (its accuracy) and one between
every two voters (their correlation), so voters that repeat each other do not count twice. Gold labels set where the
accuracies begin and hold them there weakly; no text's posterior label sees its own gold label, only its votes. The posterior is
then used to look for further voters, which gold labels alone may not show, and the model is fitted again. A linear classifier
is fitted to the posterior labels and scores every document from its text alone.

Bounds: the model is fitted on at most SAMPLE labelled documents, chosen by a hash; it has at most MOST_FEATURES
weights and is sent to every task. Scoring reads whole texts and needs no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, PreTokenizer
from .common import PrefixHash, id_text, ids_of, text_or_empty

SAMPLE = 8000  # labelled documents that the model is fitted on
MOST_FEATURES = 1 << 14
MINED_VOTERS, STANDS_OUT = 256, 2.0  # at most so many, whose share of label 1 is surely so many times the usual
FOLDS = 5
BEGINNINGS = (3, 4, 5, 6)  # letters of a word's beginning that are a feature, besides whole words
CHUNK = 1 << 19

# Words of plain abuse, by kind.
LEXICONS = {
    "insult": "idiot moron imbecile stupid dumb fool loser clown scum trash garbage worthless pathetic disgusting ugly",
    "contempt": "filthy vile vermin pig rat coward creep freak jerk liar hypocrite ignorant useless hate despise",
    "threat": "kill murder hang burn destroy die hurt punch strangle shoot",
    "de": "dumm idiot trottel depp versager abschaum arschloch blödmann widerlich wertlos",
    "fr": "imbécile crétin débile connard salaud ordure minable dégoûtant stupide abruti",
    "es": "idiota estúpido imbécil basura escoria asqueroso inútil patético tonto maldito",
}


class Words:
    """Word features of texts: hashes of words and of their beginnings, with the text each belongs to."""

    _kind: np.ndarray | None = None

    @classmethod
    def kind(cls) -> np.ndarray:
        if cls._kind is None:
            cls._kind = PreTokenizer().kind == LETTER
        return cls._kind

    @classmethod
    def features(cls, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every word and beginning, in any order, repeats included."""
        low = [t.lower() for t in texts]
        cps = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le"), np.uint32)
        letter = cls.kind()[cps].astype(np.int8)
        edge = np.diff(letter, prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
        doc = np.searchsorted(ends, start, "right")
        hashes, size = PrefixHash(cps), end - start
        docs, out = [doc], [hashes.slices(start, end) | np.uint64(1)]  # odd: a whole word
        for k in BEGINNINGS:
            long = size > k
            docs.append(doc[long])
            out.append(hashes.slices(start[long], start[long] + k) & ~np.uint64(1))
        return np.concatenate(docs), np.concatenate(out)

    @classmethod
    def word(cls, w: str) -> int:
        return int(cls.features([w])[1][0])


def pattern_votes(texts: list[str]) -> np.ndarray:
    """Votes of pattern voters: shouting, many exclamation marks, one character repeated, mostly symbols."""
    out = np.zeros((len(texts), 4), bool)
    for i, t in enumerate(texts):
        n = max(1, len(t))
        out[i] = (len(t) > 20 and t == t.upper() and t != t.lower(), t.count("!") * 50 > n, any(c * 5 in t for c in "!?.*"), 4 * sum(t.count(c) for c in "#$%&*@") > n)
    return out


@dataclass
class Model:
    """hashes (sorted) of word features with their weights, weights of patterns, and the intercept."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    patterns: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = -2.0

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.bias + pattern_votes(texts) @ self.patterns
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                size += len(texts[hi])
                hi += 1
            z[lo:hi] += self._words(texts[lo:hi])
            lo = hi
        return sigmoid(z)

    def _words(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.hashes):
            return out
        if not hasattr(self, "_maybe"):
            self._maybe = np.zeros(1 << 20, bool)
            self._maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        doc, h = Words.features(texts)
        near = self._maybe[(h >> np.uint64(44)).astype(np.int64)]
        doc, h = doc[near], h[near]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[at] == h
        once = np.unique(doc[same] * len(self.hashes) + at[same])  # presence, not counts
        np.add.at(out, once // len(self.hashes), self.weights[once % len(self.hashes)])
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class LabelModel:
    """P(y, v) in proportion to exp(c y + alpha v + y theta v + v omega v / 2), votes v being 0 or 1.

    The normalising sum is one for the whole, so the posterior of label 1 is sigmoid(c + theta v) exactly."""

    c: float
    theta: np.ndarray
    omega: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return sigmoid(votes @ self.theta + self.c)


def intercept(z: np.ndarray, count: np.ndarray, gold: np.ndarray) -> tuple[float, float, float]:
    """The c, and P(gold 1 | label 1) and P(gold 1 | label 0), under which gold labels are likeliest, if they are 1 with one probability where the label is 1 and with another where it
    is 0. z are theta v of kinds of texts, `count` how many texts are of each, `gold` how many of these have gold label 1."""
    best, out = -np.inf, (0.0, 0.8, 0.1)
    for c in -np.unique(np.quantile(z, np.linspace(0, 1, 41), weights=count, method="inverted_cdf")[:, None] + np.array([-3.0, -1.0, 1.0, 3.0])):
        s = sigmoid(z + c)
        one, zero = 0.8, 0.1
        for _ in range(8):
            p = np.clip(zero + (one - zero) * s, 1e-6, 1 - 1e-6)
            mine, other = s * one / p, s * (1 - one) / (1 - p)  # of texts with gold 1 and with gold 0 those that are truly 1
            t1, t0 = gold @ mine, (count - gold) @ other
            one = np.clip((t1 + 4) / (t1 + t0 + 5), 0.5, 0.99)
            zero = np.clip((gold @ (1 - mine) + 0.5) / (count.sum() - t1 - t0 + 5), 0.001, 0.5)
        p = np.clip(zero + (one - zero) * s, 1e-6, 1 - 1e-6)
        fit = gold @ np.log(p) + (count - gold) @ np.log(1 - p)
        if fit > best:
            best, out = fit, (float(c), float(one), float(zero))
    return out


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 8, steps: int = 10, sparse: float = 0.02, hold: float = 0.02) -> LabelModel:
    """Weights by expectation maximisation; within a round by steps up the pseudo-likelihood, in which each vote is a
    logistic regression on the label and all other votes. Correlations have an L1 penalty, so most are 0; accuracies
    are held to those that gold labels show, with little weight. Gold labels, as right as they prove to be, are evidence in
    these rounds, and none in the posterior. Texts with the same votes are one kind with a count."""
    kinds, kind = np.unique(np.packbits(votes.astype(bool), axis=1), axis=0, return_inverse=True)
    kind = kind.ravel()
    v = np.unpackbits(kinds, axis=1, count=votes.shape[1]).astype(np.float64)
    count, g = np.bincount(kind).astype(float), np.bincount(kind, weights=gold)
    n, m = count.sum(), v.shape[1]
    fires = v.T @ count
    a, b = (v.T @ g + 0.5) / (g.sum() + 1), (v.T @ (count - g) + 0.5) / (n - g.sum() + 1)
    first = np.log(a / (1 - a)) - np.log(b / (1 - b))
    theta, alpha, omega = first.copy(), np.log(b / (1 - b)), np.zeros((m, m))
    spread = np.maximum(fires / n * (1 - fires / n), 1e-3)
    scale = np.sqrt(np.outer(spread, spread))
    for _ in range(rounds):
        z = v @ theta
        c, one, zero = intercept(z, count, g)
        is1 = g * sigmoid(z + c + np.log(one / zero)) + (count - g) * sigmoid(z + c + np.log((1 - one) / (1 - zero)))
        w1, w0 = (is1 / n)[:, None], ((count - is1) / n)[:, None]
        for _ in range(steps):
            other = alpha + v @ omega
            up1, up0 = w1 * (v - sigmoid(other + theta)), w0 * (v - sigmoid(other))
            theta = np.clip(theta + 0.3 * (up1.sum(0) - hold * spread * (theta - first)) / spread, first - 4, first + 4)
            alpha = alpha + 0.3 * (up1 + up0).sum(0) / spread
            both = v.T @ (up1 + up0)
            omega = omega + (both + both.T) / scale / 4
            omega = np.clip(np.sign(omega) * np.maximum(np.abs(omega) - sparse, 0), -6, 6)
            np.fill_diagonal(omega, 0)
    return LabelModel(intercept(v @ theta, count, g)[0], theta, omega)


def standing_out(q: np.ndarray, doc: np.ndarray, inverse: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For n features the expected number of documents with label 1 that have it, and a lower bound of their share."""
    ones = np.bincount(inverse, weights=q[doc], minlength=n)
    total = np.bincount(inverse, minlength=n)
    p, z = ones / total, 1.6
    return ones, (p + z * z / (2 * total) - z * np.sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)


def fit(texts: list[str], gold: np.ndarray) -> Model:
    return fit_features([document_features(t) for t in texts], pattern_votes(texts), gold)


def document_features(text: str) -> np.ndarray:
    """Distinct hashes of a text's words and beginnings, some words at a time."""
    parts, at = [], 0
    while at < len(text) or not parts:
        end = at + CHUNK
        while end < len(text) and not text[end].isspace() and end < at + 2 * CHUNK:
            end += 1
        parts.append(np.unique(Words.features([text[at:end]])[1]))
        at = end
    return np.unique(np.concatenate(parts))


def fit_features(features: list[np.ndarray], patterns: np.ndarray, gold: np.ndarray) -> Model:
    """A model of labelled texts, given by their features. Without both labels the patterns and mined words stay out and the
    lexicons alone decide."""
    lexicon = [np.array(sorted(Words.word(w) for w in words.split()), np.uint64) for words in LEXICONS.values()]
    every = np.unique(np.concatenate(lexicon))
    n, n1 = len(features), int(gold.sum())
    if not 0 < n1 < n:
        return Model(every, np.full(len(every), 3.0))
    doc, h = np.repeat(np.arange(n), [len(x) for x in features]), np.concatenate(features)
    ids, inverse = np.unique(h, return_inverse=True)
    by_list = np.zeros((n, len(lexicon)), bool)
    for k, words in enumerate(lexicon):
        by_list[doc[np.isin(h, words)], k] = True
    q, base = gold.astype(float), n1 / n
    for _ in range(2):  # voters that gold labels show, then those that the posterior shows
        ones, low = standing_out(q, doc, inverse, len(ids))
        out = np.flatnonzero((ones >= 2) & (low > STANDS_OUT * base))
        mined = out[np.argsort(-low[out] * np.sqrt(ones[out]), kind="stable")[:MINED_VOTERS]]
        voter = np.full(len(ids), -1)
        voter[mined] = np.arange(len(mined))
        votes = np.zeros((n, len(mined)), bool)
        hit = voter[inverse] >= 0
        votes[doc[hit], voter[inverse[hit]]] = True
        every_vote = np.hstack([votes, by_list, patterns])
        q = label_model(every_vote, gold).posterior(every_vote)

    ones, low = standing_out(q, doc, inverse, len(ids))
    good = np.flatnonzero((ones >= 1.5) & (low > 1.5 * q.mean()) | np.isin(ids, every))
    good = np.sort(good[np.argsort(-low[good] * np.log1p(ones[good]), kind="stable")][:MOST_FEATURES])
    column = np.full(len(ids), -1)
    column[good] = np.arange(len(good))
    used = column[inverse] >= 0
    row, col = doc[used], column[inverse[used]]

    # Logistic regression on the posteriors: accelerated gradient steps with an L1 and an L2 penalty.
    m = len(good)
    w, pat, bias = np.zeros(m), np.zeros(4), float(np.log(base / (1 - base)))
    vw, vp, vb = w.copy(), pat.copy(), bias
    balance = np.where(q > 0.5, 0.5 / max(1e-9, np.mean(q > 0.5)), 0.5 / max(1e-9, np.mean(q <= 0.5))) / n
    size = 1 + np.bincount(row, minlength=n)
    rate = 1.0 / np.maximum(1e-4, 0.25 * np.bincount(col, weights=(balance * size)[row], minlength=m) + 1e-3)
    rate_pat, rate_bias = 1.0, 0.5
    for step in range(1500):
        zs = vb + patterns @ vp + np.bincount(row, weights=vw[col], minlength=n)
        g = (sigmoid(zs) - q) * balance
        new = vw - rate * (np.bincount(col, weights=g[row], minlength=m) + 1e-4 * vw)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * 5e-6, 0)
        new_pat, new_bias = vp - rate_pat * (g @ patterns + 1e-2 * vp), vb - rate_bias * g.sum()
        k = step / (step + 3)
        vw, vp, vb = new + k * (new - w), new_pat + k * (new_pat - pat), new_bias + k * (new_bias - bias)
        w, pat, bias = new, new_pat, new_bias
    keep = w != 0
    return Model(ids[good][keep], w[keep], pat, float(bias))


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of at most `sample` labelled documents of the learning folds, the first by a hash of doc_id.
    Of rows with one doc_id one counts, the first by a hash of its text, so no document outweighs the others. Labels of one doc_id that differ are averaged; null labels and ids are left out."""
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0))
        .groupBy("doc_id")
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    first = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return first.select("doc_id", "first.text", "toxic")


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            patterns = pattern_votes(list(f["text"]))
            yield pd.DataFrame({"doc_id": f["doc_id"], "features": [document_features(t).tobytes() for t in f["text"]], "patterns": [p.tobytes() for p in patterns], "toxic": f["toxic"]})

    # The bounded sample is fitted in one task: its features, not its texts, and the weights alone come to the driver.
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, patterns, gold = [], [], []
        for f in frames:
            found += [np.frombuffer(x, np.uint64) for x in f["features"]]
            patterns += [np.frombuffer(x, bool) for x in f["patterns"]]
            gold += list(f["toxic"])
        m = fit_features(found, np.array(patterns, bool).reshape(-1, 4), np.array(gold, float))
        yield pd.DataFrame({"hashes": [m.hashes.tobytes()], "weights": [m.weights.tobytes()], "patterns": [m.patterns.tobytes()], "bias": [m.bias]})

    each = learning_rows(docs, labels, sample).mapInPandas(features, "doc_id long, features binary, patterns binary, toxic int")
    got = each.repartition(1).sortWithinPartitions("doc_id").mapInPandas(run, "hashes binary, weights binary, patterns binary, bias double").collect()
    if not got:
        return fit([], np.zeros(0))
    r = got[0]
    return Model(np.frombuffer(bytes(r[0]), np.uint64), np.frombuffer(bytes(r[1])), np.frombuffer(bytes(r[2])), float(r[3]))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for every row of docs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = model.scores(list(f["t"]))
            held = [d is not None and zlib.crc32(d.encode()) % FOLDS == 0 for d in f["doc_id"]]
            yield pd.DataFrame({"doc_id": ids_of(f["doc_id"]), "held_out": held, "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return docs.select(id_text("doc_id"), text_or_empty().alias("t")).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score of every row of docs. Null and empty texts get the score of a text without words; a null doc_id is
    not held out; repeated rows get equal scores; without usable labels the lexicons alone decide. Texts of any length are read whole;
    an empty table gives no rows; columns other than doc_id and text, and doc_id and toxic of labels, are ignored."""
    return with_scores(docs, fit_on(docs, labels, sample))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whatever their names, that are not predicted toxic: with score_documents' score under 0.5."""
    model = fit_on(docs, labels, sample)
    schema = docs.schema

    def run(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for b in frames:
            texts = [t or "" for t in b.column(schema.names.index("text")).to_pylist()]
            yield b.filter(pa.array(model.scores(texts) < 0.5))

    return docs.mapInArrow(run, schema)
