"""Language-model scoring (11): a hashed maximum-entropy model with a class-factored softmax.

A word's probability is that of its class given the history, times that of its slot in the class given class and history. Slots are the
HEADS most frequent words of a class, each by itself, and one for all the rest; a word of the rest has also its probability in a third
softmax, over all words of the rest whatever their number, given the class of the word before it. There words begin with their share of
the slot by counts plus one. All softmaxes have weights of hashed n-gram and skip features: rows of a table of fixed size, a column for each
class, slot, or class before. A word belongs to the class of the frequent word (anchor) that it most often follows.

Documents are tokenised once, into blocks of packed word numbers. Words meet by hash, once a block, for exact counts over all learning
documents, and what a block needs to know of its words comes back packed. All histories of the learning documents are then
counted: (history, class) and (history, slot) cells are summed over blocks; their number is bounded by the number of possible histories, so
passes over them stay cheap however large the corpus is. In each of ROUNDS passes every task adds up expected feature counts
of its cells under the weights sent to it; the difference to the observed counts, scaled, is the update. For words of the rest it goes
over the words themselves, bucket by bucket: once for the sums that probabilities of a class and a class before are divided by, once for expected
counts. Scoring takes the histories of a block once each.

A word that no learning document has gets what the base model gives it, 1 / (N + V + 1), and all others share the rest, so the
probabilities of all words, the end, and one unknown word add up to one.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, id_text, ids_of, mix64, n_blocks, stored, text_or_empty

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20  # of words that meet in one group
CELL_BYTES = 8 << 20
CLASSES, HEADS = 64, 31
SLOTS = HEADS + 1
TOP_OF_BLOCK = 512  # most frequent words of a block, from which anchors are chosen
LONGEST_HEAD = 64  # bytes; longer words are neither anchors nor heads
TABLE = 1 << 14  # rows of weights
ROUNDS = 14
PRIOR = 1.0  # strength of the Gaussian prior on weights
NO_ANCHOR = 255
NEVER = -1e30
BEGIN, UNKNOWN = CLASSES * SLOTS, CLASSES * SLOTS + 1  # units of histories beside class * SLOTS + slot
BEGIN_CLASS, UNKNOWN_CLASS = CLASSES, CLASSES + 1
END = b""

BLOCK = "block long, ids binary, lengths binary, learns binary, tokens binary, words binary, counts binary"
TOLD = "kind int, block long, bucket int, words binary, counts binary, classes binary, mass array<long>, n_tokens long, n_words long, head binary, head_class int, head_count long"
REST = "bucket int, size int, codes binary, classes binary, shares binary"
UNITS = "ids binary, lengths binary, learns binary, units binary, rest binary, rest_codes binary, known binary, base binary, share binary"


def words_of(text: str) -> list[bytes]:
    """Tokens without the end: A-Z lower-cased, split at ASCII white space."""
    return text.encode().lower().split()


def packed(a: np.ndarray) -> bytes:
    """Small whole numbers, byte by byte, compressed."""
    if not len(a):
        return b""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1)


def unpacked(b: bytes, kind: type, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(b, max_output_size=max(1, n * size)), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def _numbering() -> defaultdict:
    out: defaultdict = defaultdict()
    out.default_factory = out.__len__
    return out


# -- blocks


def _block(number: int, docs: list[tuple[str | None, str, bool]]) -> pd.DataFrame:
    numbers = _numbering()
    numbers[END]  # 0
    parts = []
    for _, text, _ in docs:
        words = words_of(text)
        words.append(END)
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
    lengths, learns = np.array([len(p) for p in parts], np.uint32), np.array([x[2] for x in docs])
    tokens = np.concatenate(parts)
    counts = np.bincount(tokens[np.repeat(learns, lengths)], minlength=len(numbers)).astype(np.int64)
    ids = "\n".join("" if x[0] is None else x[0] for x in docs).encode()
    row = [number, ids, lengths.tobytes(), learns.tobytes(), packed(tokens), b"\n".join(numbers), counts.tobytes()]
    return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK.split(", ")])


def blocks_of(docs: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, t, learn) packed in blocks of about BLOCK_BYTES of text, as they come: no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for f in frames:
            for row in zip(f["doc_id"], f["t"], f["learn"], strict=True):
                held.append(row)
                size += len(row[1]) + 1
                if size >= BLOCK_BYTES:
                    yield _block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _block(number, held)

    return docs.mapInPandas(run, BLOCK)


def anchors_of(blocks: DataFrame) -> list[bytes]:
    """The most frequent words of learning documents, as the blocks' most frequent ones show them: at most CLASSES."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for words, counts in zip(f["words"], f["counts"], strict=True):
                words, n = words.split(b"\n"), np.frombuffer(counts, np.int64)
                top = [i for i in np.argsort(-n, kind="stable")[:TOP_OF_BLOCK] if n[i] and 0 < len(words[i]) <= LONGEST_HEAD]
                yield pd.DataFrame({"word": [words[i] for i in top], "n": n[top]})

    sums = blocks.select("words", "counts").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in sums.orderBy(F.desc("n"), "word").limit(CLASSES).collect()]


# -- words meet


def _dealt(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words by bucket, and the buckets' bounds."""
    to = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    return np.argsort(to, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(to, minlength=buckets))])


def _votes(words: list[bytes], tokens: np.ndarray, lengths: np.ndarray, learns: np.ndarray, anchors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word the anchor that most often comes last before it in a learning document, and how often."""
    kind = np.full(len(words), -1, np.int64)
    place = {w: k for k, w in enumerate(anchors)}
    for i, w in enumerate(words):
        if w in place:
            kind[i] = place[w]
    at = kind[tokens]
    last = np.maximum.accumulate(np.where(at >= 0, np.arange(len(tokens)), -1))
    last = np.concatenate([[-1], last[:-1]]) if len(last) else last
    starts = np.repeat(np.cumsum(lengths, dtype=np.int64) - lengths, lengths)
    voted = (last >= starts) & np.repeat(learns, lengths)
    code, n = np.unique(tokens[voted].astype(np.int64) * CLASSES + at[last[voted]], return_counts=True)
    best, most = np.full(len(words), NO_ANCHOR, np.uint8), np.zeros(len(words), np.int64)
    order = np.lexsort((code % CLASSES, -n, code // CLASSES))
    word, first = np.unique(code[order] // CLASSES, return_index=True)
    best[word], most[word] = code[order][first] % CLASSES, n[order][first]
    return best, most


def send_words(buckets: int, anchors: list[bytes]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                words, counts = r.words.split(b"\n"), np.frombuffer(r.counts, np.int64)
                lengths, learns = np.frombuffer(r.lengths, np.uint32), np.frombuffer(r.learns, bool)
                best, most = _votes(words, unpacked(r.tokens, np.uint32, int(lengths.sum())), lengths, learns, anchors)
                order, bounds = _dealt(words, buckets)
                spans = [(b, order[lo:hi]) for b, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if hi > lo]
                yield pd.DataFrame({
                    "bucket": [b for b, _ in spans], "block": r.block, "words": [b"\n".join([words[i] for i in at]) for _, at in spans],
                    "counts": [packed(counts[at]) for _, at in spans], "best": [best[at].tobytes() for _, at in spans], "most": [packed(most[at]) for _, at in spans],
                })

    return run


def answer_words(classes: int):
    """Exact counts and classes of a bucket's words, for every block that asked, and what the model needs of them."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block")
        numbers = _numbering()
        asked = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in (x.split(b"\n") for x in f["words"])]
        words, ids = list(numbers), np.concatenate(asked)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, ids, np.concatenate([unpacked(c, np.int64, len(a)) for c, a in zip(f["counts"], asked, strict=True)]))
        best = np.frombuffer(b"".join(f["best"]), np.uint8)
        most = np.concatenate([unpacked(m, np.int64, len(a)) for m, a in zip(f["most"], asked, strict=True)])
        voted = best != NO_ANCHOR
        code, back = np.unique(ids[voted] * 256 + best[voted], return_inverse=True)
        votes = np.bincount(back, weights=most[voted], minlength=len(code))
        order = np.lexsort((code % 256, -votes, code // 256))
        word, first = np.unique(code[order] // 256, return_index=True)
        own = np.full(len(words), NO_ANCHOR, np.uint8)
        own[word] = code[order][first] % 256
        for i in np.flatnonzero(own == NO_ANCHOR):
            own[i] = zlib.crc32(words[i]) % classes
        there = np.flatnonzero(counts)
        mass = np.bincount(own[there], weights=counts[there] + 1, minlength=classes).astype(np.int64)
        bucket = int(f["bucket"].iat[0])
        out = [{"kind": 0, "block": b, "bucket": bucket, "counts": packed(counts[a]), "classes": own[a].tobytes()} for b, a in zip(f["block"], asked, strict=True)]
        out.append({"kind": 1, "bucket": bucket, "words": b"\n".join([words[i] for i in there]), "counts": counts[there].tobytes(), "classes": own[there].tobytes(), "mass": mass.tolist(), "n_tokens": int(counts.sum()), "n_words": len(there)})
        by = there[np.lexsort((-counts[there], own[there]))]
        for k in range(classes):
            for i in [i for i in by[own[by] == k] if len(words[i]) <= LONGEST_HEAD][: 2 * HEADS]:
                out.append({"kind": 2, "bucket": bucket, "head": words[i], "head_class": k, "head_count": int(counts[i])})
        return pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object) for c in (x.split()[0] for x in TOLD.split(", "))})

    return run


@dataclass
class Lexicon:
    """What all tasks need of the words: bounded by CLASSES and HEADS, whatever the corpus."""

    n_tokens: int
    n_words: int
    classes: int
    heads: dict[bytes, tuple[int, int]]  # word: class, slot
    rest: np.ndarray  # for each class the sum of counts plus one of words that are no heads

    @property
    def unknown(self) -> float:
        return 1 / (self.n_tokens + self.n_words + 1)

    def shut(self) -> np.ndarray:
        """Added to the logits of slots, a line for each class: what has no word gets no probability. The last line is for classes."""
        out = np.full((CLASSES + 1, max(CLASSES, SLOTS)), NEVER, np.float32)
        out[: self.classes, HEADS][self.rest > 0] = 0
        for k, slot in self.heads.values():
            out[k, slot] = 0
        out[CLASSES, :CLASSES][(out[:CLASSES, :SLOTS] == 0).any(1)] = 0
        return out


def lexicon_of(told: DataFrame, classes: int) -> Lexicon:
    words = told.filter("kind = 1")
    n, v = words.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    rest = np.zeros(classes)
    for r in words.select(F.posexplode("mass").alias("k", "m")).groupBy("k").agg(F.sum("m").alias("m")).collect():
        rest[r["k"]] = r["m"]
    rank = F.row_number().over(Window.partitionBy("head_class").orderBy(F.desc("head_count"), "head"))
    heads = {}
    for r in told.filter("kind = 2").select("head", "head_class", "head_count", rank.alias("rank")).filter(F.col("rank") <= HEADS).collect():
        heads[bytes(r["head"])] = (r["head_class"], r["rank"] - 1)
        rest[r["head_class"]] -= r["head_count"] + 1
    return Lexicon(n or 0, v or 0, classes, heads, rest)


def units_of(blocks: DataFrame, told: DataFrame, lexicon: Lexicon, buckets: int) -> DataFrame:
    """Blocks as units (class * SLOTS + slot, or UNKNOWN), with each document's base score, known words, and the log10 of its words' shares of their
    slots. Of words of the rest (slot HEADS) rest says which one of the block's it is, and rest_codes its code."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                words, lengths = r.words.split(b"\n"), np.frombuffer(r.lengths, np.uint32)
                tokens = unpacked(r.tokens, np.uint32, int(lengths.sum()))
                order, bounds = _dealt(words, buckets)
                counts, classes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for x in r.replies:
                    at = order[bounds[x["bucket"]] : bounds[x["bucket"] + 1]]
                    counts[at], classes[at] = unpacked(x["counts"], np.int64, len(at)), np.frombuffer(x["classes"], np.uint8)
                unit, share = classes * SLOTS + HEADS, np.zeros(len(words))
                known = counts > 0
                base = np.log10((counts + 1) * lexicon.unknown)
                share[known] = np.log10((counts[known] + 1) / np.maximum(lexicon.rest[classes[known]], 1))
                for i, w in enumerate(words):
                    if w in lexicon.heads and known[i]:
                        k, slot = lexicon.heads[w]
                        unit[i], share[i] = k * SLOTS + slot, 0.0
                share[known] += math.log10(1 - lexicon.unknown) if lexicon.n_tokens else 0.0
                unit[~known], share[~known] = UNKNOWN, math.log10(lexicon.unknown)
                starts = np.cumsum(lengths, dtype=np.int64) - lengths
                sums = [np.add.reduceat(x[tokens], starts) for x in (known.astype(np.int64), base, share)]
                there, rest = np.unique(tokens[of_rest(unit[tokens])], return_inverse=True)
                codes = word_codes([words[i] for i in there])
                yield pd.DataFrame([[r.ids, r.lengths, r.learns, packed(unit.astype(np.uint16)[tokens]), packed(rest.astype(np.uint32)), codes.tobytes(), *[s.tobytes() for s in sums]]], columns=[c.split()[0] for c in UNITS.split(", ")])

    replies = told.filter("kind = 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "counts", "classes")).alias("replies"))
    return blocks.drop("counts", "learns").join(replies, "block").join(blocks.select("block", "learns"), "block").mapInPandas(run, UNITS)


def rest_words(told: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The words that are no heads, a row for each bucket: their codes, sorted by the first row of weights, classes and shares of their slots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                counts, classes = np.frombuffer(r.counts, np.int64), np.frombuffer(r.classes, np.uint8)
                words = r.words.split(b"\n") if len(counts) else []
                at = np.array([i for i, w in enumerate(words) if w not in lexicon.heads], np.int64)
                codes = word_codes([words[i] for i in at])
                order = np.argsort(word_rows(codes)[:, 0], kind="stable")
                codes, at = codes[order], at[order]
                classes = classes[at]
                share = (counts[at] + 1) / np.maximum(lexicon.rest[classes], 1)
                yield pd.DataFrame({"bucket": [r.bucket], "size": [len(at)], "codes": [codes.tobytes()], "classes": [classes.tobytes()], "shares": [share.tobytes()]})

    return told.filter("kind = 1").select("bucket", "words", "counts", "classes").mapInPandas(run, REST)


# -- histories and features


def _before(units: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each word of its document, and the class of the one before that."""
    n = len(units)
    place = np.arange(n) - np.repeat(np.cumsum(lengths, dtype=np.int64) - lengths, lengths)
    one = np.where(place >= 1, np.concatenate([[0], units[:-1]]) if n else units, BEGIN)
    two = np.where(place >= 2, np.concatenate([[0, 0], units[:-2]])[:n], BEGIN)
    return one.astype(np.int64), class_of(two.astype(np.int64))


def class_of(unit: np.ndarray) -> np.ndarray:
    return unit // SLOTS + (unit == UNKNOWN)  # BEGIN // SLOTS is BEGIN_CLASS already


def of_rest(unit: np.ndarray) -> np.ndarray:
    return unit % SLOTS == HEADS  # not so BEGIN and UNKNOWN


def word_codes(words: list[bytes]) -> np.ndarray:
    """Two rows of the weight table for each word, as one number."""
    crc = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    return (mix64(crc) & np.uint64(TABLE * TABLE - 1)).astype(np.uint32)


def word_rows(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes % TABLE, codes // TABLE], axis=1).astype(np.int64)


WIDE = 128  # more than the classes of histories
SIDES = {"class": CLASSES, "slot": SLOTS}
PREVIOUS = UNKNOWN_CLASS + 1  # classes of the word before
TABLES = SIDES | {"word": PREVIOUS}  # columns of the weights


def history(side: str, target_class: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A number for what a softmax looks at: the unit before and the class before that, or the class of the word and the unit before it."""
    return one * WIDE + two if side == "class" else target_class * (UNKNOWN + 1) + one


def features(side: str, code: np.ndarray) -> np.ndarray:
    """Rows of the weight table, a line for each history: bias, n-grams, skips."""
    if side == "class":
        one, two = code // WIDE, code % WIDE
        parts = [(1, 0 * one), (2, one), (3, two), (4, code), (5, class_of(one))]  # bias, bigram, skip, trigram, class bigram
    else:
        target, one = code // (UNKNOWN + 1), code % (UNKNOWN + 1)
        parts = [(6, target), (7, code), (8, target * WIDE + class_of(one))]
    return np.stack([(mix64(x.astype(np.uint64) * np.uint64(16) + np.uint64(k)) & np.uint64(TABLE - 1)).astype(np.int64) for k, x in parts], axis=1)


def _logits(side: str, weights: np.ndarray, code: np.ndarray, rows: np.ndarray, shut: np.ndarray) -> np.ndarray:
    out = np.broadcast_to(shut[CLASSES, :CLASSES], (len(code), CLASSES)).copy() if side == "class" else shut[code // (UNKNOWN + 1), :SLOTS]
    for k in range(rows.shape[1]):
        out += weights[rows[:, k]]
    return out


def _log_sums(logits: np.ndarray) -> np.ndarray:
    top = logits.max(1)
    return top + np.log(np.exp(logits - top[:, None]).sum(1))


def count_cells(shards: int):
    """Of each block: how often every (history, target) occurs in its learning documents, by shard of the history."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                lengths, learns = np.frombuffer(r.lengths, np.uint32), np.frombuffer(r.learns, bool)
                units = unpacked(r.units, np.uint16, int(lengths.sum())).astype(np.int64)
                one, two = _before(units, lengths)
                seen = np.repeat(learns, lengths)
                units, one, two = units[seen], one[seen], two[seen]
                for side, wide in SIDES.items():
                    target = units // SLOTS if side == "class" else units % SLOTS
                    code, n = np.unique(history(side, units // SLOTS, one, two) * wide + target, return_counts=True)
                    to = (mix64((code // wide).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    code, n, bounds = code[order], n[order], np.concatenate([[0], np.cumsum(np.bincount(to, minlength=shards))])
                    spans = [(s, lo, hi) for s, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)) if hi > lo]
                    yield pd.DataFrame({"side": side, "shard": [s for s, _, _ in spans], "size": [hi - lo for _, lo, hi in spans], "cells": [packed(code[lo:hi]) for _, lo, hi in spans], "n": [packed(n[lo:hi]) for _, lo, hi in spans]})

    return run


def sum_cells(f: pd.DataFrame) -> pd.DataFrame:
    code = np.concatenate([unpacked(c, np.int64, s) for c, s in zip(f["cells"], f["size"], strict=True)])
    n = np.concatenate([unpacked(c, np.int64, s) for c, s in zip(f["n"], f["size"], strict=True)])
    code, back = np.unique(code, return_inverse=True)
    n = np.bincount(back, weights=n).astype(np.int64)
    return pd.DataFrame({"side": f["side"].iat[0], "shard": f["shard"].iat[0], "size": len(code), "cells": [packed(code)], "n": [packed(n)]})


PARTS = 16  # of a weight table, in which sums travel
COUNTS = "side string, shard int, part int, good double, table binary"
OBSERVED = -1  # in place of a shard: observed counts of all shards, before the expected ones when sorted
ACTIVE = {"class": 5, "slot": 3, "word": 2}  # features of a history
WORDS_AT_ONCE = 1 << 15


@dataclass
class Model:
    lexicon: Lexicon
    weights: dict[str, np.ndarray] = field(default_factory=dict)  # TABLE rows, a column for each class or slot
    likelihood: list[float] = field(default_factory=list)  # of the cells, natural log, before each round; of words of the rest beyond that of their shares
    log_sums: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES, PREVIOUS)))  # of shares times exp(weights) of a class's rest, for each class before


def _counts(shut: np.ndarray, weights: Broadcast | None):
    """Feature counts of each shard, observed where there are no weights, else expected under them, and then its log-likelihood."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                wide = SIDES[r.side]
                code, n = unpacked(r.cells, np.int64, r.size), unpacked(r.n, np.int64, r.size).astype(np.float64)
                histories, back = np.unique(code // wide, return_inverse=True)
                table, good = np.zeros((TABLE, wide), np.float64), 0.0
                for lo in range(0, len(histories), 1 << 14):
                    rows = features(r.side, histories[lo : lo + (1 << 14)])
                    a, b = np.searchsorted(back, [lo, lo + len(rows)])
                    at, target, count = back[a:b] - lo, code[a:b] % wide, n[a:b]
                    if weights is None:
                        share = np.zeros((len(rows), wide))
                        share[at, target] = count
                    else:
                        logits = _logits(r.side, weights.value[r.side], histories[lo : lo + (1 << 14)], rows, shut)
                        sums = _log_sums(logits)
                        good += float((count * (logits[at, target] - sums[at])).sum())
                        share = np.exp(logits - sums[:, None]) * np.bincount(at, weights=count, minlength=len(rows))[:, None]
                    _add_rows(table, rows, share)
                yield _in_parts(r.side, r.shard, good, table)

    return run


def _add_rows(table: np.ndarray, rows: np.ndarray, share: np.ndarray) -> None:
    """Adds each line of share to all of its rows of the table."""
    for k in range(rows.shape[1]):
        row, each = rows[:, k], share
        if (row[1:] < row[:-1]).any():
            order = np.argsort(row.astype(np.uint16), kind="stable")  # below TABLE; small numbers sort faster
            row, each = row[order], share[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        table[row[first]] += np.add.reduceat(each, first, axis=0)


def _in_parts(side: str, shard: int, good: float, table: np.ndarray) -> pd.DataFrame:
    each = TABLE // PARTS
    return pd.DataFrame({"side": side, "shard": shard, "part": range(PARTS), "good": [good] + [0.0] * (PARTS - 1), "table": [packed(table[k * each : (k + 1) * each].astype(np.float32).ravel()) for k in range(PARTS)]})


# -- words of the rest


def _rest_tokens(r, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a block's words of the rest, and their codes."""
    at = np.flatnonzero(of_rest(units))
    return at, np.frombuffer(r.rest_codes, np.uint32)[unpacked(r.rest, np.uint32, len(at))]


def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Observed feature counts of the words of the rest in learning documents, of all blocks of a task together."""
    table = np.zeros(TABLE * PREVIOUS, np.int64)
    for f in frames:
        for r in f.itertuples(index=False):
            lengths = np.frombuffer(r.lengths, np.uint32)
            units = unpacked(r.units, np.uint16, int(lengths.sum())).astype(np.int64)
            at, codes = _rest_tokens(r, units)
            seen = np.repeat(np.frombuffer(r.learns, bool), lengths)[at]
            before = class_of(_before(units, lengths)[0][at[seen]])
            for rows in word_rows(codes[seen]).T:
                table += np.bincount(rows * PREVIOUS + before, minlength=len(table))
    yield _in_parts("word", 0, 0.0, table.reshape(TABLE, PREVIOUS))


def rest_counts(cells: DataFrame) -> np.ndarray:
    """How often words of the rest of a class come after each class in the learning documents."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                code, n = unpacked(r.cells, np.int64, r.size), unpacked(r.n, np.int64, r.size)
                seen = of_rest(code)  # the slot is the last digit
                history, n = code[seen] // SLOTS, n[seen]
                at, back = np.unique(history // (UNKNOWN + 1) * PREVIOUS + class_of(history % (UNKNOWN + 1)), return_inverse=True)
                yield pd.DataFrame({"at": at, "n": np.bincount(back, weights=n, minlength=len(at)).astype(np.int64)})

    out = np.zeros(CLASSES * PREVIOUS)
    for r in cells.filter("side = 'slot'").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # CLASSES * PREVIOUS at most
        out[r["at"]] = r["n"]
    return out.reshape(CLASSES, PREVIOUS)


def _powers(r, weights: np.ndarray, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Classes, rows, and shares times exp(weights) after each class, of some words of a bucket at a time."""
    codes, classes, shares = np.frombuffer(r.codes, np.uint32), np.frombuffer(r.classes, np.uint8), np.frombuffer(r.shares).astype(kind)
    for lo in range(0, len(codes), WORDS_AT_ONCE):
        rows = word_rows(codes[lo : lo + WORDS_AT_ONCE])
        power = weights[rows[:, 0]].astype(kind, copy=False)
        power += weights[rows[:, 1]]
        np.exp(power, out=power)
        power *= shares[lo : lo + WORDS_AT_ONCE, None]
        yield classes[lo : lo + WORDS_AT_ONCE], rows, power


def log_sums(rest: DataFrame, weights: Broadcast, kind: type = np.float32) -> np.ndarray:
    """Natural logs of what probabilities of the words of the rest are divided by, for each class and class before; words are added up in kind."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, bucket = np.zeros((CLASSES, PREVIOUS)), None
        for f in frames:
            for r in f.itertuples(index=False):
                bucket = r.bucket if bucket is None else bucket
                for classes, _, power in _powers(r, weights.value["word"], kind):
                    out += (classes[:, None] == np.arange(CLASSES)).astype(kind).T @ power
        if bucket is not None:
            yield pd.DataFrame({"bucket": [bucket], "sums": [out.tobytes()]})

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = sorted((b, s) for f in frames for b, s in zip(f["bucket"], f["sums"], strict=True))
        if each:
            yield pd.DataFrame({"sums": [sum(np.frombuffer(s) for _, s in each).tobytes()]})

    rows = rest.mapInPandas(run, "bucket int, sums binary").repartition(1).mapInPandas(total, "sums binary").collect()  # one row, from a small table of each task
    out = np.frombuffer(rows[0]["sums"]).reshape(CLASSES, PREVIOUS) if rows else np.zeros((CLASSES, PREVIOUS))
    return np.log(np.where(out > 0, out, 1))


def expected_words(weights: Broadcast, sums: np.ndarray, counts: np.ndarray):
    """Feature counts of the words of the rest, expected under the weights, of all words of a task together."""
    times = (counts * np.exp(-sums)).astype(np.float32)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bucket = np.zeros((TABLE, PREVIOUS)), None
        for f in frames:
            for r in f.itertuples(index=False):
                bucket = r.bucket if bucket is None else bucket
                for classes, rows, power in _powers(r, weights.value["word"], np.float32):
                    power *= times[classes]
                    _add_rows(table, rows, power)
        if bucket is not None:
            yield _in_parts("word", bucket, 0.0, table)

    return run


def _sum_of(tables: pd.Series, wide: int) -> np.ndarray:
    return sum(unpacked(t, np.float32, TABLE // PARTS * wide).astype(np.float64) for t in tables)


def _observed(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("shard")
    side = f["side"].iat[0]
    return pd.DataFrame({"side": side, "shard": OBSERVED, "part": f["part"].iat[0], "good": 0.0, "table": [packed(_sum_of(f["table"], TABLES[side]))]})


def _updated(weights: Broadcast):
    """A part's next weights: the gradient over the curvature along its own coordinate, shared among a history's features."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("shard")
        side, part, each = f["side"].iat[0], int(f["part"].iat[0]), TABLE // PARTS
        w = weights.value[side][part * each : (part + 1) * each].ravel()
        observed, expected = unpacked(f["table"].iat[0], np.float64, len(w)), _sum_of(f["table"].iloc[1:], TABLES[side])
        good = f["good"].sum() + (float(observed @ w) if side == "word" else 0.0)
        step = (observed - expected - PRIOR * w) / (ACTIVE[side] * (expected + PRIOR))
        return pd.DataFrame({"side": side, "part": part, "good": [good], "weights": [packed((w + np.clip(step, -1, 1)).astype(np.float32))]})

    return run


def train(cells: DataFrame, units: DataFrame, rest: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS) -> Model:
    """Weights after `rounds` updates, each from all cells and all words of the rest. Counts are added up and weights updated part by part in tasks:
    through the driver go only the weights, once each way a round, and sums of classes; what is sent is given up before the next round."""
    model = Model(lexicon, {s: np.zeros((TABLE, w), np.float32) for s, w in TABLES.items()})
    if not lexicon.n_tokens:
        return model
    shut, each, context = lexicon.shut(), TABLE // PARTS, cells.sparkSession.sparkContext
    seen = cells.mapInPandas(_counts(shut, None), COUNTS).unionByName(units.select("lengths", "learns", "units", "rest", "rest_codes").mapInPandas(count_words, COUNTS))
    observed, after = stored(seen.groupBy("side", "part").applyInPandas(_observed, COUNTS), "lm-observed"), rest_counts(cells)
    for _ in range(rounds):
        weights = context.broadcast(model.weights)
        model.log_sums = log_sums(rest, weights)
        expected = cells.mapInPandas(_counts(shut, weights), COUNTS).unionByName(rest.mapInPandas(expected_words(weights, model.log_sums, after), COUNTS))
        sums = expected.unionByName(observed).groupBy("side", "part")
        rows = sums.applyInPandas(_updated(weights), "side string, part int, good double, weights binary").collect()  # the weight tables' size
        weights.destroy()
        model.likelihood.append(sum(r["good"] for r in rows) - float((after * model.log_sums).sum()))
        for r in rows:
            model.weights[r["side"]][r["part"] * each : (r["part"] + 1) * each] = unpacked(r["weights"], np.float32, each * TABLES[r["side"]]).reshape(each, -1)
    weights = context.broadcast(model.weights)
    model.log_sums = log_sums(rest, weights, np.float64)
    weights.destroy()
    drop_stored(observed)
    return model


def score_blocks(units: DataFrame, model: Model) -> DataFrame:
    shared = units.sparkSession.sparkContext.broadcast(model.weights)  # TABLE rows
    n, shut, sums = model.lexicon.n_tokens, model.lexicon.shut(), model.log_sums

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                lengths = np.frombuffer(r.lengths, np.uint32)
                unit = unpacked(r.units, np.uint16, int(lengths.sum())).astype(np.int64)
                one, two = _before(unit, lengths)
                known = unit != UNKNOWN
                log = np.zeros(len(unit))
                for side in SIDES:
                    target = unit[known] // SLOTS if side == "class" else unit[known] % SLOTS
                    codes, back = np.unique(history(side, unit[known] // SLOTS, one[known], two[known]), return_inverse=True)
                    got = np.zeros(len(target))
                    order = np.argsort(back, kind="stable")
                    for lo in range(0, len(codes), 1 << 14):
                        a, b = np.searchsorted(back[order], [lo, lo + (1 << 14)])
                        part = codes[lo : lo + (1 << 14)]
                        logits = _logits(side, shared.value[side], part, features(side, part), shut).astype(np.float64)
                        at = back[order[a:b]] - lo
                        got[order[a:b]] = logits[at, target[order[a:b]]] - _log_sums(logits)[at]
                    log[known] += got
                at, codes = _rest_tokens(r, unit)
                rows, before = word_rows(codes), class_of(one[at])
                log[at] += sum(shared.value["word"][rows[:, k], before].astype(np.float64) for k in range(rows.shape[1])) - sums[unit[at] // SLOTS, before]
                starts = np.cumsum(lengths, dtype=np.int64) - lengths
                score = np.add.reduceat(log, starts) / math.log(10) + np.frombuffer(r.share)
                learns = np.frombuffer(r.learns, bool)
                yield pd.DataFrame({
                    "doc_id": ids_of([x or None for x in r.ids.decode().split("\n")]), "held_out": ~learns, "n_tokens": lengths.astype(np.int64), "n_known": np.frombuffer(r.known, np.int64),
                    "train_tokens": n, "base_score": np.frombuffer(r.base), "score": score,
                })

    return units.mapInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@dataclass
class Fitted:
    model: Model
    units: DataFrame  # all documents
    words: DataFrame  # kind 1 rows of TOLD: the learning documents' words, counts and classes


def fit(docs: DataFrame, rounds: int = ROUNDS) -> Fitted:
    """The model of the rows of docs(doc_id, t, learn) with learn, and all rows as its units."""
    blocks = stored(blocks_of(docs), "lm-blocks")
    anchors = anchors_of(blocks)
    classes = max(1, len(anchors))
    buckets = n_blocks(int(blocks.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0), BUCKET_BYTES)
    sent = blocks.mapInPandas(send_words(buckets, anchors), "bucket int, block long, words binary, counts binary, best binary, most binary")
    told = stored(sent.groupBy("bucket").applyInPandas(answer_words(classes), TOLD), "lm-words")
    lexicon = lexicon_of(told, classes)
    units = stored(units_of(blocks, told, lexicon, buckets), "lm-units", blocks)
    words = int(units.agg(F.sum(F.octet_length("units").cast("long"))).first()[0] or 0)
    cell = "side string, shard int, size int, cells binary, n binary"
    each = units.select("lengths", "learns", "units").mapInPandas(count_cells(n_blocks(words, CELL_BYTES)), cell)
    cells = stored(each.groupBy("side", "shard").applyInPandas(sum_cells, cell), "lm-cells")
    rest = stored(rest_words(told, lexicon), "lm-rest")
    model = train(cells, units, rest, lexicon, rounds)
    drop_stored(cells)
    drop_stored(rest)
    return Fitted(model, units, told.filter("kind = 1"))


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; those whose crc32(doc_id as text) mod `folds` is
    `held` are held out, the model learns from the others.

    A null text counts as empty: one token, the end. Rows without a doc_id are not held out. Repeated rows are documents of their own. Ties between
    anchors and between heads go to the more frequent word, then to the one that comes first. If nothing is learnt from, every
    token is unknown and has probability 1. A text larger than a block is a block of its own. An empty table gives no rows; other columns are
    ignored, whatever their names."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    rows = docs.select(id_text("doc_id"), text_or_empty().alias("t"), F.coalesce(remainder != held, F.lit(True)).alias("learn"))
    fitted = fit(rows)
    return score_blocks(fitted.units, fitted.model)
