"""Byte-level BPE (9): vectorised pre-tokenisation, cached batched pair merging, decoding with offsets.

Boundaries come without a regex. Every code point gets a class; with the next code points' classes it
becomes one of nine symbols; each symbol is a transition function on eight states. Functions compose
associatively, so boundaries are found by a two-level scan: rows of the text are reduced to one function
each, the functions of the rows are scanned by doubling, and the states inside all rows follow in step.

Pieces are keyed by a 64-bit hash into a bounded cache of id lists; only distinct unseen pieces are merged,
many at a time. Decoding checks every document against its input, so a clash of hashes cannot pass: such a
document is encoded again piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, id_text, ids_of, ranges, text_or_empty

# Code points with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

LETTER, NUMBER, OTHER, BLANK = range(4)
# Symbols: a letter, a number, another character; a space before a non-blank; another blank before a
# non-blank; a blank before a blank or the end; an apostrophe that may open a contraction of one or two
# letters; the end of a text.
S_LETTER, S_NUMBER, S_OTHER, S_PREFIX, S_LAST, S_BLANK, S_APOS1, S_APOS2, S_END = range(9)
# States after a character: in a run of letters, numbers, others or blanks; after a prefix space; after a
# complete piece; with one or two letters of a contraction to come.
Q_LETTER, Q_NUMBER, Q_OTHER, Q_BLANK, Q_PREFIX, Q_DONE, Q_ONE, Q_TWO = range(8)
N_SYMBOLS, N_STATES, ROW = 9, 8, 256


def _classes() -> np.ndarray:
    kind = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kind[cp] = LETTER
        elif c == "N":
            kind[cp] = NUMBER
    kind[WHITE_SPACE] = BLANK
    return kind


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[state, symbol] and opens[state, symbol]: does the character begin a piece?"""
    nxt, opens = np.zeros((N_STATES, N_SYMBOLS), np.uint8), np.ones((N_STATES, N_SYMBOLS), bool)
    for symbol, state in ((S_LETTER, Q_LETTER), (S_NUMBER, Q_NUMBER), (S_OTHER, Q_OTHER), (S_PREFIX, Q_PREFIX), (S_LAST, Q_DONE), (S_BLANK, Q_BLANK), (S_APOS1, Q_ONE), (S_APOS2, Q_TWO), (S_END, Q_DONE)):
        nxt[:, symbol] = state
    for symbol, state in ((S_LETTER, Q_LETTER), (S_NUMBER, Q_NUMBER), (S_OTHER, Q_OTHER)):
        opens[[state, Q_PREFIX], symbol] = False
    opens[Q_BLANK, S_BLANK] = False
    for symbol in (S_APOS1, S_APOS2):  # inside a run of others an apostrophe is one of them
        nxt[[Q_OTHER, Q_PREFIX], symbol] = Q_OTHER
        opens[[Q_OTHER, Q_PREFIX], symbol] = False
    nxt[Q_TWO, S_LETTER], nxt[Q_ONE, S_LETTER] = Q_ONE, Q_DONE
    opens[[Q_ONE, Q_TWO], S_LETTER] = False
    return nxt, opens


def _monoid(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions the symbols generate: their images, step[f, symbol] and compose[f, g] (f first)."""
    ident = tuple(range(N_STATES))
    known, todo = {ident: 0}, [ident]
    for f in todo:
        for s in range(N_SYMBOLS):
            g = tuple(int(nxt[q, s]) for q in f)
            if g not in known:
                known[g] = len(known)
                todo.append(g)
    images = np.array(todo, np.uint8)
    step = np.array([[known[tuple(int(nxt[q, s]) for q in f)] for s in range(N_SYMBOLS)] for f in todo], np.uint16)
    compose = np.array([[known[tuple(int(g[q]) for q in f)] for g in todo] for f in todo], np.uint16)
    return images, step, compose


class PreTokenizer:
    def __init__(self):
        self.kind = _classes()
        self.next, self.opens = _machine()
        self.images, self.step, self.compose = _monoid(self.next)

    def symbols(self, cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols of code points; ends: positions of the separators that follow the texts."""
        kind = self.kind[cps]
        kind[ends] = BLANK  # a run of blanks before the end is a whole piece
        n = len(cps)
        sym = kind.copy()
        blank = kind == BLANK
        before_word = np.zeros(n, bool)
        before_word[:-1] = blank[:-1] & ~blank[1:]
        sym[blank] = S_BLANK
        sym[before_word] = S_LAST
        sym[before_word & (cps == 0x20)] = S_PREFIX
        apos = np.flatnonzero(cps == 0x27)
        if len(apos):
            a = cps[np.minimum(apos + 1, n - 1)]
            b = cps[np.minimum(apos + 2, n - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            sym[apos[one]] = S_APOS1
            sym[apos[two & (apos + 2 < n)]] = S_APOS2
        sym[ends] = S_END
        return sym

    def starts(self, cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions at which pieces (and separators) begin."""
        n = len(cps)
        if not n:
            return np.zeros(0, np.int64)
        rows = -(-n // ROW)
        grid = np.full(rows * ROW, S_END, np.uint8)
        grid[:n] = self.symbols(cps, ends)
        grid = np.ascontiguousarray(grid.reshape(rows, ROW).T)
        flat_step, flat_next, flat_opens = self.step.ravel(), self.next.ravel(), self.opens.ravel()
        f = np.zeros(rows, np.uint16)
        for j in range(ROW):
            f = flat_step[f * np.uint16(N_SYMBOLS) + grid[j]]
        reach = 1
        while reach < rows:  # inclusive scan of the rows' functions
            f = np.concatenate([f[:reach], self.compose[f[:-reach], f[reach:]]])
            reach *= 2
        state = np.full(rows, Q_DONE, np.uint8)
        state[1:] = self.images[f[:-1], Q_DONE]
        opens = np.empty((ROW, rows), bool)
        for j in range(ROW):
            k = state * np.uint8(N_SYMBOLS) + grid[j]
            opens[j] = flat_opens[k]
            state = flat_next[k]
        return np.flatnonzero(opens.T.ravel()[:n])


class PairTable:
    """(left id, right id) -> rank and merged id; open addressing, looked up for whole arrays."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, left, right, rank, merged):
        if max(map(len, (left, right))) and max(np.max(left), np.max(right)) > 0xFFFF:
            raise ValueError("ids of merged pairs must be below 65,536")
        key = np.asarray(left, np.uint32) * np.uint32(65536) + np.asarray(right, np.uint32)
        self.bits = max(16, int(4 * max(1, len(key)) - 1).bit_length())
        self.mask = np.uint32((1 << self.bits) - 1)
        self.slot_of = np.full(1 << self.bits, -1, np.int32)
        self.key, self.rank, self.merged = key, np.append(np.asarray(rank, np.int32), self.NONE), np.append(np.asarray(merged, np.int32), 0)
        todo, at = np.arange(len(key)), self._home(key)
        while len(todo):
            free = self.slot_of[at] < 0
            self.slot_of[at[free]] = todo[free]
            lost = self.slot_of[at] != todo
            todo, at = todo[lost], (at[lost] + np.uint32(1)) & self.mask
        self.key_at = np.where(self.slot_of >= 0, key[self.slot_of], 0) if len(key) else np.zeros(1 << self.bits, np.uint32)

    def _home(self, key: np.ndarray) -> np.ndarray:
        h = key ^ (key >> np.uint32(15))
        h = h * np.uint32(0x2C1B3C6D)
        return (h ^ (h >> np.uint32(13))) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index into rank and merged; the last one where there is no such pair or an id is negative."""
        bad = (left < 0) | (right < 0)
        key = left.astype(np.uint32) * np.uint32(65536) + right.astype(np.uint32)
        at = self._home(key)
        got = self.slot_of[at]
        clash = np.flatnonzero((got >= 0) & (self.key_at[at] != key))
        while len(clash):
            at[clash] = (at[clash] + np.uint32(1)) & self.mask
            got[clash] = self.slot_of[at[clash]]
            clash = clash[(got[clash] >= 0) & (self.key_at[at[clash]] != key[clash])]
        got[bad] = -1
        return got


class ByteBPE:
    """Encodes and decodes with a vocabulary; ids are those that the public libraries give for its file."""

    SLOTS, POOL, WIDE, CHUNK = 1 << 19, 1 << 22, 32, 1 << 20

    def __init__(self, token_bytes: dict[int, bytes], pairs: tuple, whole_pieces: bool, added: dict[str, int] | None = None):
        """pairs: left, right, rank, merged id; whole_pieces: a piece that is a token is never split;
        added: strings of the vocabulary file that are ids of their own wherever a text holds them."""
        n = max(token_bytes) + 1
        parts = [token_bytes.get(i, b"") for i in range(n)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.byte_id = np.zeros(256, np.int32)
        self.id_of = {p: i for i, p in token_bytes.items()}
        for b in range(256):
            self.byte_id[b] = self.id_of[bytes([b])]
        self.pairs, self.whole_pieces, self.added = PairTable(*pairs), whole_pieces, added or {}
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pre = PreTokenizer()
        self._clear()

    def _clear(self) -> None:
        self.tag = np.zeros(self.SLOTS, np.uint64)
        self.at, self.count = np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int64)
        self.pool, self.used = np.zeros(self.POOL, np.int32), 0

    # -- vocabularies

    @classmethod
    def from_tiktoken(cls, path: str) -> ByteBPE:
        """Rank file: any two neighbours whose joined bytes are a token may merge, lowest rank first."""
        with open(path, "rb") as f:
            tokens = {int(r): base64.b64decode(t) for t, r in (x.split() for x in f if x.strip())}
        ids = {t: r for r, t in tokens.items()}
        rows = [(ids[t[:k]], ids[t[k:]], r, r) for r, t in tokens.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        return cls(tokens, tuple(zip(*rows, strict=True)), True)

    @classmethod
    def from_json(cls, path: str) -> ByteBPE:
        """Vocabulary with a list of merges, bytes written as printable characters."""
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, added = whole["model"], {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in added and all(c in byte_of for c in t)}
        tokens |= {i: t.encode() for t, i in added.items()}
        rows = [(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges)]
        return cls(tokens, tuple(zip(*rows, strict=True)), False, added)

    # -- merging

    def merge_one(self, piece: bytes) -> list[int]:
        """A piece by itself: for long pieces and for checks."""
        if self.whole_pieces and piece in self.id_of:
            return [self.id_of[piece]]
        import heapq

        ids = [int(self.byte_id[b]) for b in piece]
        right, left, alive = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], [True] * len(ids)
        table = self.__dict__.setdefault("_dict", {int(k): i for i, k in enumerate(self.pairs.key)})
        heap: list = []

        def offer(i: int) -> None:
            if i >= 0 and (j := right[i]) >= 0 and (x := table.get(ids[i] * 65536 + ids[j])) is not None:
                heapq.heappush(heap, (int(self.pairs.rank[x]), i, ids[i], ids[j], int(self.pairs.merged[x])))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := right[i]) < 0 or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = new, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def _merge_many(self, tok: np.ndarray) -> np.ndarray:
        """Rows of byte ids, padded with -1, merged in step: one pair a row at a time, lowest rank, leftmost."""
        n, width = tok.shape
        if width < 2:
            return tok
        found = self.pairs.find(tok[:, :-1].ravel(), tok[:, 1:].ravel())
        rank = self.pairs.rank[found].reshape(n, width - 1)
        rows, cols = np.arange(n), np.arange(width)
        out = tok
        live, tok = rows, tok.copy()
        while True:
            j = rank.argmin(1)
            go = rank[np.arange(len(j)), j] < PairTable.NONE
            if not go.all():
                out[live[~go]] = tok[~go]
                live, tok, rank, j = live[go], tok[go], rank[go], j[go]
            if not len(live):
                return out
            r = np.arange(len(live))
            x = self.pairs.find(tok[r, j], tok[r, j + 1])
            new = self.pairs.merged[x]
            src = cols[None, :] + (cols[None, :] > j[:, None])
            tok = np.take_along_axis(np.concatenate([tok, np.full((len(r), 1), -1, np.int32)], 1), src, 1)
            tok[r, j] = new
            rank = np.take_along_axis(np.concatenate([rank, np.full((len(r), 1), PairTable.NONE, np.int32)], 1), src[:, :-1], 1)
            nxt = np.where(j + 1 < width, tok[r, np.minimum(j + 1, width - 1)], -1)
            ok = j < width - 1
            rank[r[ok], j[ok]] = self.pairs.rank[self.pairs.find(new[ok], nxt[ok])]
            ok = j > 0
            rank[r[ok], j[ok] - 1] = self.pairs.rank[self.pairs.find(tok[r[ok], j[ok] - 1], new[ok])]

    def _merge_pieces(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, concatenated, and how many each has."""
        n = len(start)
        count, parts, order = np.zeros(n, np.int64), [], []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, self.WIDE)):
            pick = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(pick), 1 << 15):
                p = pick[at : at + (1 << 15)]
                where = start[p][:, None] + np.arange(high)
                inside = np.arange(high) < size[p][:, None]
                tok = np.where(inside, self.byte_id[data[np.minimum(where, len(data) - 1)]], np.int32(-1))
                tok = self._merge_many(tok)
                keep = tok >= 0
                count[p] = keep.sum(1)
                parts.append(tok[keep])
                order.append(p)
        for p in np.flatnonzero(size > self.WIDE):
            ids = self.merge_one(data[start[p] : start[p] + size[p]].tobytes())
            count[p] = len(ids)
            parts.append(np.array(ids, np.int32))
            order.append(np.array([p]))
        if not order:
            return np.zeros(0, np.int32), count
        order, ids = np.concatenate(order), np.concatenate(parts)
        begin = np.zeros(n, np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        ids = ids[ranges(begin, count)]
        if self.whole_pieces:  # a token that merging does not reach; those are rare
            for p in np.flatnonzero((count > 1) & (size <= self.longest)):
                if (whole := self.id_of.get(data[start[p] : start[p] + size[p]].tobytes())) is not None:
                    at = count[:p].sum()
                    ids = np.concatenate([ids[:at], [np.int32(whole)], ids[at + count[p] :]])
                    count[p] = 1
        return ids, count

    @property
    def longest(self) -> int:
        return int(self.size.max())

    # -- texts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text, in order."""
        if self.added and any(a in t for a in self.added for t in texts):
            parts = [self.added_pattern.split(t) for t in texts]
            done = iter(self.encode([p for ps in parts for p in ps if p not in self.added]))
            return [np.concatenate([np.array([self.added[p]], np.uint32) if p in self.added else next(done) for p in ps]) for ps in parts]
        out: list[np.ndarray] = []
        lo = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > self.CHUNK:
                out += self._encode(texts[lo:i])
                lo, size = i, 0
            size += len(t) + 1
        return out + self._encode(texts[lo:])

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        joined = "\n".join(texts) + "\n"
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(lens) - 1
        begin = self.pre.starts(cps, ends)
        byte_at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(1 + (cps >= 0x80).view(np.int8) + (cps >= 0x800).view(np.int8) + (cps >= 0x10000).view(np.int8), out=byte_at[1:])
        sep = np.zeros(len(cps), bool)
        sep[ends] = True
        text_of = np.searchsorted(ends, begin)  # the text of each piece
        stop = np.append(begin[1:], len(cps))
        real = ~sep[begin]
        begin, stop, text_of = byte_at[begin[real]], byte_at[stop[real]], text_of[real]
        ids, count = self._pieces(data, begin, stop - begin)
        per_text = np.bincount(text_of, weights=count, minlength=len(texts)).astype(np.int64)
        cut = np.cumsum(per_text)
        out = [ids[c - k : c].astype(np.uint32) for c, k in zip(cut, per_text, strict=True)]
        # Every text decodes to itself; what a clash of hashes spoiled is done again.
        if not self._same(ids, data, byte_at[ends]):
            for k, t in enumerate(texts):
                if self.decode(out[k]) != t.encode():
                    out[k] = self._slow(t)
        return out

    def _same(self, ids: np.ndarray, data: np.ndarray, sep_bytes: np.ndarray) -> bool:
        keep = np.ones(len(data), bool)
        keep[sep_bytes] = False
        want = data[keep]
        size = self.size[ids]
        if int(size.sum()) != len(want):
            return False
        return bool(np.array_equal(self.bytes[ranges(self.offset[ids], size)], want))

    def _slow(self, text: str) -> np.ndarray:
        cps = np.frombuffer((text + "\n").encode("utf-32-le"), np.uint32)
        begin = self.pre.starts(cps, np.array([len(cps) - 1]))
        ids = [x for a, b in zip(begin[:-1], begin[1:], strict=True) for x in self.merge_one(text[a:b].encode())]
        return np.array(ids, np.uint32)

    def _pieces(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, through the cache."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        h = PrefixHash(data).slices(start, start + size) | np.uint64(1)
        slot = (h >> np.uint64(64 - self.SLOTS.bit_length() + 1)).astype(np.int64)
        miss = np.flatnonzero(self.tag[slot] != h)
        at, count = self.at[slot], self.count[slot]
        pool = self.pool
        if len(miss):
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            pick = miss[first]
            ids, k = self._merge_pieces(data, start[pick], size[pick])
            if self.used + len(ids) > self.POOL:
                hit = np.ones(len(start), bool)
                hit[miss] = False
                moved = np.flatnonzero(hit)  # what this batch needs of the old pool moves to its own
                old = pool[ranges(at[moved], count[moved])]
                at[moved] = np.cumsum(count[moved]) - count[moved]
                pool = np.concatenate([old, ids])
                base = len(old)
                self._clear()
                keep = len(ids) <= self.POOL
                if keep:
                    self.pool[: len(ids)] = ids
                    self.used = len(ids)
            else:
                base, keep = self.used, True
                self.pool[base : base + len(ids)] = ids
                self.used += len(ids)
            begin = np.cumsum(k) - k
            at[miss], count[miss] = base + begin[back], k[back]
            if keep:
                s = slot[pick]
                self.tag[s], self.at[s], self.count[s] = h[pick], (begin if pool is not self.pool else base + begin), k
        return pool[ranges(at, count)], count

    def _joined(self, ids: np.ndarray) -> bytes:
        return self.bytes[ranges(self.offset[ids], self.size[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        return self._joined(np.asarray(ids, np.int64))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of every id in the decoded text, and its end: token spans for decoding any part."""
        return np.concatenate([[0], np.cumsum(self.size[np.asarray(ids, np.int64)])])


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """One encoder a Python worker and vocabulary file (.json or ranks), with its cache."""
    if path not in _loaded:
        _loaded[path] = ByteBPE.from_json(path) if path.endswith(".json") else ByteBPE.from_tiktoken(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of docs plus token_ids (array<int>), token_offsets (array<int>: byte starts and the end)
    and decoded (string). Null text counts as empty: no ids, offsets [0]."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c not in ("token_ids", "token_offsets", "decoded")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("token_offsets", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(parts: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = load(path)
        for b in parts:
            ids = bpe.encode([t or "" for t in b.column(names.index(text)).to_pylist()])
            lists = pa.list_(pa.int32())
            more = [pa.array([x.astype(np.int32) for x in ids], lists), pa.array([bpe.offsets(x).astype(np.int32) for x in ids], lists), pa.array([bpe.decode(x).decode() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, "token_ids", "token_offsets", "decoded"])

    return docs.select(*names).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids (little-endian unsigned 32 bit) and of the bytes decoded from them.
    Null text counts as empty; repeated rows are encoded each by itself; no shuffle. Texts of any length are encoded whole, in
    slices of one array; an empty table gives no rows; other columns are ignored, whatever their names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for f in frames:
            ids = bpe.encode(list(f["t"]))
            yield pd.DataFrame({
                "doc_id": ids_of(f["doc_id"]),
                "n_tokens": np.array([len(x) for x in ids], np.int64),
                "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            })

    return docs.select(id_text("doc_id"), text_or_empty().alias("t")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
