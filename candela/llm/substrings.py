"""Repeated passages: content-defined chunks (1) and suffixes by bucket-pointer refinement (10).

Both work on blocks of documents: some MB of text make one row of a table
bucketed by block, so texts are shuffled once and every later pass finds its documents together. Rows are dealt to blocks by a hash of the
document and its place in the input, so repeated rows spread. What blocks must learn from each other travels as packed arrays of keys. A block sends each key once, however many of its documents
have it, so a passage in a third of all documents costs one entry a block. Of documents with equal texts only the
one with the smallest doc_id is looked into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of, mix64, n_blocks, ranges, scratch_path, scratch_table, stored, text_or_empty, total_bytes

BLOCK_BYTES, LARGEST_BLOCK = 4 << 20, 64 << 20  # of text; a task needs about 20 times as much memory for its block
FEW_BLOCKS = 50_000  # blocks grow once there are so many, as an exchange has a row for every block and bucket
MOST_BUCKETS = 400_000
NO_ID = -(1 << 63)  # stands for a null doc_id: smaller than all others

SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# -- blocks ---------------------------------------------------------------------------------------


def blocks_of(docs: DataFrame, name: str, carry: list[str] | None = None) -> tuple[DataFrame, int]:
    """(block, ids, keys, texts, reps), number of buckets. ids, keys and texts are arrays with an element for each
    row of docs; reps are the keys of those rows whose text no smaller doc_id has. Columns to carry come along as
    an array of structs named carried."""
    others = F.struct(*carry) if carry else F.lit(None).cast("int")
    spark = docs.sparkSession
    size = total_bytes(docs)
    n = n_blocks(size, min(max(BLOCK_BYTES, size // FEW_BLOCKS), LARGEST_BLOCK))
    buckets = min(n, MOST_BUCKETS)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_or_empty().cast("binary").alias("t"), others.alias("o"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("digest", F.md5("t"))
    key = F.xxhash64("doc_id", "digest")
    packed = (
        rows.select(key.alias("key"), "doc_id", "t", "o", "place")
        .withColumn("block", F.pmod(F.xxhash64("key", "place"), F.lit(n)))
        .repartition(buckets, "block")
        .groupBy("block")
        .agg(F.collect_list(F.struct("doc_id", "key", "t", "o") if carry else F.struct("doc_id", "key", "t")).alias("d"))
        .select("block", F.col("d.doc_id").alias("ids"), F.col("d.key").alias("keys"), F.col("d.t").alias("texts"), *([F.col("d.o").alias("carried")] if carry else []))
    )
    table = scratch_table(name)
    packed.write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "zstd").bucketBy(buckets, "block").sortBy("block").saveAsTable(table)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select(key.alias("key"))
    where = spark.table(table).select("block", F.explode("keys").alias("key")).distinct()  # repeated rows stand in several blocks
    return told(spark.table(table), where.join(first, "key").groupBy("block").agg(F.collect_list("key").alias("reps"))), buckets


def told(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks with what is known of each; the side with the texts is not shuffled."""
    return blocks.join(replies.hint("merge"), "block", "left")


class Block:
    """Documents of one row of the table in ascending doc_id; the distinct texts joined into one array."""

    def __init__(self, ids, keys, texts, reps):
        self.order = order = np.lexsort((np.asarray(keys), np.asarray(ids)))
        self.ids = np.asarray(ids, np.int64)[order]
        self.texts = [bytes(texts[i]) for i in order]
        reps = np.zeros(0, np.int64) if reps is None else np.asarray(reps, np.int64)
        self.is_rep = np.isin(np.asarray(keys, np.int64)[order], reps)
        self.rep = np.flatnonzero(self.is_rep)  # rows that are looked into
        parts = [self.texts[i] for i in self.rep]
        self.raw = b"".join(parts)
        self.data = np.frombuffer(self.raw, np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.rep_ids = self.ids[self.rep]

    def cut(self, start: np.ndarray, end: np.ndarray, whole_from: int) -> list[tuple]:
        """Rows of SPANS: bytes start[i] .. end[i] of the joined texts go, and copies of at least whole_from bytes
        go whole."""
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        out = []
        at = 0
        for i, text in enumerate(self.texts):
            doc = None if self.ids[i] == NO_ID else int(self.ids[i])
            if self.is_rep[i]:
                g = gone[self.start[at] : self.end[at]]
                at += 1
                removed = int(g.sum())
                if removed:
                    kept = self.data[self.start[at - 1] : self.end[at - 1]][~g].tobytes()
                    out.append((doc, len(text), removed, int(g[0]) + int((g[1:] & ~g[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept))
                    continue
            elif len(text) >= whole_from:
                out.append((doc, len(text), len(text), int(len(text) > 0), EMPTY_SHA, b""))
                continue
            out.append((doc, len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
        return out


def as_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([x[1:] for x in rows], columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    out.insert(0, "doc_id", ids_of([x[0] for x in rows]))
    return out


def each_block(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, Block, dict]]:
    for f in frames:
        names = [c for c in f.columns if c not in ("block", "ids", "keys", "texts", "reps")]
        for r in f.itertuples(index=False):
            yield r.block, Block(r.ids, r.keys, r.texts, r.reps), {c: getattr(r, c) for c in names}


def joined(parts) -> bytes:
    return b"" if parts is None else b"".join(map(bytes, parts))


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of keys; a bucket is decided by the key alone."""
    # Keys are mixed again: those of least grams are small by their nature.
    bucket = (mix64(keys ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(32)).astype(np.int64) * buckets >> 32
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


# -- content-defined chunks (1) -------------------------------------------------------------------

REACH, MOST_CHUNK = 24, 256  # bytes; a cut follows a byte whose hash is the largest for REACH bytes on both sides
GEAR_BYTES = 32  # that a gear hash depends on
LEAST_REPEAT = 50  # bytes: shorter runs of repeated chunks stay
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h = 2 h + gear[byte] modulo 2**32 at every byte: only the last 32 bytes count, so it is a sum by doubling."""
    h = GEAR[data]
    reach = 1
    while reach < 32:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(reach)
        h = more
        reach *= 2
    return h


def chunk_ends(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ends of the chunks of the texts data[start[i] : end[i]], in order.

    Such a cut depends on GEAR_BYTES + REACH bytes before it and REACH after it and on nothing else, so a passage is cut alike
    in all texts, from its first bytes on; these cuts are more than REACH bytes apart. Where there is none for MOST_CHUNK bytes one is
    forced, so many bytes after the cut before it: forced cuts also depend on that one."""
    head = ranges(start, np.minimum(end - start, GEAR_BYTES - 1))  # their hashes would depend on the text before
    cuts, size, side = [], 1 << 18, GEAR_BYTES + REACH
    for lo in range(0, len(data), size):
        a, z = max(0, lo - side), min(len(data), lo + size + REACH)
        h = gear_hash(data[a:z])
        h[head[np.searchsorted(head, a) : np.searchsorted(head, z)] - a] = 0
        h = np.concatenate([np.zeros(REACH, np.uint32), h, np.zeros(REACH + 1, np.uint32)])
        m = h
        for k in (1, 2, 4, 8):
            m = np.maximum(m[:-k], m[k:])
        m = np.maximum(m[:-8], m[8:])  # the largest of REACH values from each place on
        n = z - a
        own = h[REACH : REACH + n]
        top = np.flatnonzero((own > m[:n]) & (own >= m[REACH + 1 : REACH + 1 + n])) + a
        cuts.append(top[(top >= lo) & (top < lo + size)] + 1)
    cut = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
    place = np.union1d(cut, end[end > start])
    out, at = [], 0
    for c in place.tolist():
        while c - at > MOST_CHUNK:
            at += MOST_CHUNK
            out.append(at)
        if c > at:
            out.append(c)
            at = c
    return np.array(out, np.int64)


def chunks_of(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, document (position in rep_ids) and digest (n x 2 words) of the chunks."""
    end = chunk_ends(b.data, b.start, b.end)
    start = np.append(0, end[:-1]).astype(np.int64) if len(end) else end
    doc = np.searchsorted(b.end, start, "right")
    raw, digest = b.raw, hashlib.blake2b
    words = b"".join([digest(raw[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    return start, end, doc, np.frombuffer(words, "<u8").reshape(-1, 2)


def grouped(words: np.ndarray, *after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both words of a digest and then by `after`; number of the group of each in that order."""
    order = np.lexsort((*after, words[:, 1], words[:, 0]))
    w = words[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]).any(1)
    return order, np.cumsum(new) - 1


def send_chunks(buckets: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, b, _ in each_block(frames):
            _, _, doc, words = chunks_of(b)
            order, group = grouped(words, doc)
            first = order[np.append(True, np.diff(group) > 0)] if len(order) else order
            words, owner = words[first], b.rep_ids[doc[first]]
            rows = [(k, block, words[p].tobytes(), owner[p].tobytes()) for k, p in by_bucket(words[:, 0], buckets)]
            yield pd.DataFrame(rows, columns=["bucket", "block", "words", "owners"])

    return run


def answer_chunks(f: pd.DataFrame) -> pd.DataFrame:
    """To each block the digests that a document with a smaller doc_id in another block has, and that doc_id."""
    words = np.frombuffer(joined(f["words"]), "<u8").reshape(-1, 2)
    owner = np.frombuffer(joined(f["owners"]), "<i8")
    block = np.repeat(f["block"].to_numpy(), [len(x) // 8 for x in f["owners"]])
    order, group = grouped(words, owner)
    least = np.empty(len(order), np.int64)
    first = np.append(True, np.diff(group) > 0) if len(order) else np.zeros(0, bool)
    least[order] = owner[order][first][group]
    pick = np.flatnonzero(least < owner)
    pick = pick[np.argsort(block[pick], kind="stable")]
    rows = [(int(block[p[0]]), words[p].tobytes(), least[p].tobytes()) for p in np.split(pick, np.flatnonzero(np.diff(block[pick])) + 1) if len(p)]
    return pd.DataFrame(rows, columns=["block", "words", "owners"])


def cut_chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, b, r in each_block(frames):
        start, end, doc, words = chunks_of(b)
        far = np.frombuffer(joined(r["words"]), "<u8").reshape(-1, 2)
        far_owner = np.frombuffer(joined(r["owners"]), "<i8")
        every, owner = np.concatenate([words, far]), np.concatenate([b.rep_ids[doc], far_owner])
        order, group = grouped(every, owner)
        first = np.append(True, np.diff(group) > 0) if len(order) else np.zeros(0, bool)
        least = np.empty(len(order), np.int64)
        least[order] = owner[order][first][group]
        gone = np.flatnonzero(least[: len(start)] < b.rep_ids[doc])
        if len(gone):  # runs of repeated chunks that are long enough
            head = np.append(True, (start[gone][1:] != end[gone][:-1]) | (doc[gone][1:] != doc[gone][:-1]))
            run = np.cumsum(head) - 1
            gone = gone[np.bincount(run, weights=(end - start)[gone])[run] >= LEAST_REPEAT]
        rows = b.cut(start[gone], end[gone], 1)
        chunks = np.bincount(doc, minlength=len(b.rep)) if len(b.rep) else np.zeros(0, np.int64)
        n = np.zeros(len(b.ids), np.int64)
        n[b.rep] = chunks
        yield as_frame(rows).assign(n_chunks=n)


def chunk_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes that stay), n_chunks, by row of docs.

    Texts are cut where a gear hash of the last 32 bytes is largest, hence alike wherever a passage stands; a chunk
    is repeated if a document with a smaller doc_id has a chunk with the same 128-bit digest. Runs of repeated chunks
    of LEAST_REPEAT bytes or more go; copies of a whole text go whole. n_chunks is 0 for copies. Null text counts as empty and keeps its (empty) text; rows
    with the same doc_id never remove each other's chunks; a null doc_id counts as smaller than all others. A text of any length is in
    one block, whole; an empty table gives no rows; other columns are ignored, whatever their names."""
    blocks, buckets = blocks_of(docs, "chunks")
    sent = blocks.mapInPandas(send_chunks(buckets), "bucket int, block long, words binary, owners binary")
    replies = sent.groupBy("bucket").applyInPandas(answer_chunks, "block long, words binary, owners binary")
    replies = replies.groupBy("block").agg(F.collect_list("words").alias("words"), F.collect_list("owners").alias("owners"))
    # Pairs of lists keep their order: both come from the same rows.
    return told(blocks, replies).mapInPandas(cut_chunks, f"{SPANS}, kept binary, n_chunks long")


# -- suffixes (10) --------------------------------------------------------------------------------

LENGTH = 50  # bytes of a repeated string
GRAM = 24  # bytes of the grams that make the initial buckets
WIDTH = LENGTH - GRAM + 1  # grams in a string
PIECE_BITS = 17
HOT_BLOCKS = 2000  # a gram of more blocks is dealt out by whole strings
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_B = [np.uint64(pow(0x5851F42D4C957F2D, 1 << k, 1 << 64)) for k in range(4)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position, by doubling."""
    h, k = _BYTE[data], 1
    for b in _B:
        h8 = h
        h = h[:-k] * b + h[k:]
        k *= 2
    # h: 16 bytes; h8: 8 bytes
    return mix64(h[: len(data) - GRAM + 1] * _B[3] + h8[16 : 16 + len(data) - GRAM + 1])


class Runs:
    """Runs of strings (LENGTH bytes inside one text) that have the same least gram: first and last position of the
    strings, the gram's hash, and the text's number. Equal strings have the same gram at the same distance."""

    def __init__(self, b: Block):
        first, last, key, doc = [], [], [], []
        n, size = len(b.data), 1 << PIECE_BITS
        text = np.repeat(np.arange(len(b.start), dtype=np.int32), b.end - b.start)
        for lo in range(0, n - LENGTH + 1, size - LENGTH):
            part = b.data[lo : min(n, lo + size)]
            if len(part) < LENGTH:
                break
            h = gram_hashes(part)
            low = np.uint64(size - 1)
            m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
            for k in (1, 2, 4, 8):
                m = np.minimum(m[:-k], m[k:])
            m = np.minimum(m[: len(part) - LENGTH + 1], m[WIDTH - 16 :][: len(part) - LENGTH + 1])
            m = m[: size - LENGTH]
            gram = (m & low).astype(np.int64)
            p = np.arange(lo, lo + len(m))
            t = text[p]
            ok = p + LENGTH <= b.end[t]
            new = np.ones(len(m), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (t[1:] != t[:-1]) | ~ok[:-1]
            at = np.flatnonzero(new & ok)
            stop = np.flatnonzero(np.append(new[1:], True) | ~np.append(ok[1:], False))
            stop = stop[ok[stop]]
            first.append(at + lo)
            last.append(stop + lo)
            key.append(h[gram[at]])
            doc.append(t[at])
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.first, self.last, self.key, self.doc = join(first, np.int64), join(last, np.int64), join(key, np.uint64), join(doc, np.int64)

    def of_several(self) -> np.ndarray:
        """Keys that several documents of the block have, sorted."""
        order = np.lexsort((self.doc, self.key))
        k, d = self.key[order], self.doc[order]
        return np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])


def send_grams(buckets: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, b, _ in each_block(frames):
            keys = np.unique(Runs(b).key)
            yield pd.DataFrame([(k, block, keys[p].tobytes()) for k, p in by_bucket(keys, buckets)], columns=["bucket", "block", "grams"])

    return run


def answer_grams(f: pd.DataFrame) -> pd.DataFrame:
    """To each block those of its grams that other blocks have too, and those that very many have."""
    key = np.frombuffer(joined(f["grams"]), "<u8")
    block = np.repeat(f["block"].to_numpy(), [len(x) // 8 for x in f["grams"]])
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.append(True, k[1:] != k[:-1]) if len(k) else np.zeros(0, bool)
    count = np.diff(np.append(np.flatnonzero(new), len(k)))
    n = np.empty(len(k), np.int64)
    n[order] = np.repeat(count, count)
    rows = []
    pick = np.flatnonzero(n > 1)
    pick = pick[np.argsort(block[pick], kind="stable")]
    for p in np.split(pick, np.flatnonzero(np.diff(block[pick])) + 1):
        if len(p):
            rows.append((int(block[p[0]]), key[p].tobytes(), key[p[n[p] > HOT_BLOCKS]].tobytes()))
    return pd.DataFrame(rows, columns=["block", "shared", "hot"])


def segments(b: Block, shared: np.ndarray, hot: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct byte segments that cover the strings of shared grams, with key and first document of each; then
    segment number and start of every occurrence. Strings of hot grams are segments by themselves, with a key of
    their own."""
    runs = Runs(b)
    near = np.union1d(shared, runs.of_several())
    pick = np.flatnonzero(np.isin(runs.key, near))
    first, last, key, doc = runs.first[pick], runs.last[pick], runs.key[pick], runs.doc[pick]
    is_hot = np.isin(key, hot)
    if is_hot.any():
        count = np.where(is_hot, last - first + 1, 1)
        row = np.repeat(np.arange(len(pick)), count)
        offset = np.where(is_hot[row], np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count), 0)
        split = is_hot[row]
        first, last, key, doc = first[row] + offset, np.where(split, first[row] + offset, last[row]), key[row].copy(), doc[row]
        for i in np.flatnonzero(split):
            key[i] = int.from_bytes(hashlib.blake2b(b.raw[first[i] : first[i] + LENGTH], digest_size=8).digest(), "little")
    known: dict[bytes, int] = {}
    raw, number = b.raw, known.setdefault
    seg = np.fromiter((number(raw[f:l], len(known)) for f, l in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)), np.int64, len(first))
    at = np.full(len(known), len(seg), np.int64)
    np.minimum.at(at, seg, np.arange(len(seg)))  # documents are in order, so the first has the smallest doc_id
    return list(known), key[at], b.rep_ids[doc[at]] if len(at) else np.zeros(0, np.int64), seg, first


def send_segments(buckets: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, b, r in each_block(frames):
            segs, key, owner, _, _ = segments(b, np.frombuffer(joined(r["shared"]), "<u8"), np.frombuffer(joined(r["hot"]), "<u8"))
            size = np.fromiter(map(len, segs), np.int32, len(segs))
            rows = [(k, block, p.astype(np.int32).tobytes(), key[p].tobytes(), owner[p].tobytes(), size[p].tobytes(), b"".join([segs[i] for i in p])) for k, p in by_bucket(key, buckets)]
            yield pd.DataFrame(rows, columns=["bucket", "block", "number", "key", "owner", "size", "bytes"])

    return run


def refine(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bucket pointers of all positions by the LENGTH bytes from them; end[p] is the end of p's segment, and only
    positions with so many bytes before it get one (others -1).

    Buckets of the first eight bytes are refined by the pairs (own pointer, pointer at a later offset). Each round
    uses the pointers of the round before at double the depth, and positions alone in their bucket leave."""
    room = end - np.arange(len(data))
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    word = np.zeros(len(data), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(data)]
    pointer = np.full(len(data), -1, np.int64)
    live = np.flatnonzero(room >= 8)
    _, pointer[live] = np.unique(word[live], return_inverse=True)
    depth = 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        live = np.flatnonzero(room >= depth + step)
        pair = pointer[live].astype(np.uint64) << np.uint64(32) | pointer[live + step].astype(np.uint64)
        size = np.bincount(pointer[live])
        alone = size[pointer[live]] == 1
        fresh = np.full(len(data), -1, np.int64)
        _, among = np.unique(pair[~alone], return_inverse=True)
        fresh[live[~alone]] = among
        fresh[live[alone]] = np.arange(alone.sum()) + (among.max() + 1 if len(among) else 0)
        pointer = fresh
        depth += step
    return pointer


REFINE_BYTES = 1 << 18  # of segments that are refined at once, but for a single key's


def _key_batches(of_key: np.ndarray, mixed: np.ndarray, size: np.ndarray, kind: np.ndarray, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of segments and entries of those kinds, whole keys together, about REFINE_BYTES of kinds at a time."""
    kinds = np.flatnonzero(mixed)
    if not len(kinds):
        return
    kinds = kinds[np.argsort(of_key[kinds], kind="stable")]
    first = np.append(True, np.diff(of_key[kinds]) > 0)
    before = (np.cumsum(size[kinds]) - size[kinds])[first]  # bytes before each key
    batch = np.repeat(before // REFINE_BYTES, np.diff(np.append(np.flatnonzero(first), len(kinds))))
    batch_of = np.full(len(mixed), -1)
    batch_of[kinds] = batch
    entries = entries[np.argsort(batch_of[kind[entries]], kind="stable")]
    theirs = batch_of[kind[entries]]
    for b in np.unique(batch):
        lo, hi = np.searchsorted(theirs, [b, b + 1])
        yield kinds[np.searchsorted(batch, b) : np.searchsorted(batch, b + 1)], entries[lo:hi]


def answer_segments(f: pd.DataFrame) -> pd.DataFrame:
    """To each block, by its segments' numbers, the byte spans of those strings that a smaller doc_id has."""
    size = np.frombuffer(joined(f["size"]), "<i4").astype(np.int64)
    key, owner, number = np.frombuffer(joined(f["key"]), "<u8"), np.frombuffer(joined(f["owner"]), "<i8"), np.frombuffer(joined(f["number"]), "<i4")
    block = np.repeat(f["block"].to_numpy(), [len(x) // 4 for x in f["size"]])
    raw = joined(f["bytes"])
    stop = np.cumsum(size)
    begin = stop - size
    known: dict[bytes, int] = {}
    put = known.setdefault
    kind = np.fromiter((put(raw[a:z], len(known)) for a, z in zip(begin.tolist(), stop.tolist(), strict=True)), np.int64, len(size))
    n = len(known)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, kind, owner)
    example = np.zeros(n, np.int64)
    example[kind] = np.arange(len(kind))
    of_key = np.unique(key[example], return_inverse=True)[1] if n else np.zeros(0, np.int64)
    mixed = np.bincount(of_key)[of_key] > 1 if n else np.zeros(0, bool)
    # A gram with one kind of segment: its least document decides for all strings at once.
    whole = ~mixed[kind] & (least[kind] < owner)
    out_entry, out_from, out_to = [np.flatnonzero(whole)], [np.zeros(whole.sum(), np.int64)], [size[whole]]
    # The others are refined, some keys at a time; strings of different keys are never equal.
    entries = np.flatnonzero(mixed[kind])
    for many, mine in _key_batches(of_key, mixed, size[example], kind, entries):
        e = example[many]
        data = np.frombuffer(raw, np.uint8)[ranges(begin[e], size[e])]
        end = np.cumsum(size[e])
        start = end - size[e]
        pointer = refine(data, np.repeat(end, size[e]))
        strings = size[e] - LENGTH + 1
        p = ranges(start, strings)
        best = np.full(int(pointer.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, pointer[p], np.repeat(least[many], strings))
        place = np.full(n, -1)
        place[many] = np.arange(len(many))
        for at in range(0, len(mine), 1 << 14):  # every entry, string by string
            entry = mine[at : at + (1 << 14)]
            k = place[kind[entry]]
            p = ranges(start[k], strings[k])
            row = np.repeat(np.arange(len(entry)), strings[k])
            gone = best[pointer[p]] < owner[entry][row]
            p, row = p[gone], row[gone]
            if len(p):
                head = np.flatnonzero(np.append(True, (np.diff(p) != 1) | (np.diff(row) != 0)))
                tail = np.append(head[1:], len(p)) - 1
                out_entry.append(entry[row[head]])
                out_from.append(p[head] - start[k[row[head]]])
                out_to.append(p[tail] - start[k[row[tail]]] + LENGTH)
    entry, lo, hi = np.concatenate(out_entry), np.concatenate(out_from), np.concatenate(out_to)
    order = np.argsort(block[entry], kind="stable")
    rows = []
    for p in np.split(order, np.flatnonzero(np.diff(block[entry[order]])) + 1):
        if len(p):
            rows.append((int(block[entry[p[0]]]), np.stack([number[entry[p]], lo[p], hi[p]], 1).astype(np.int32).tobytes()))
    return pd.DataFrame(rows, columns=["block", "spans"])


def strings_cut(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[Block, dict, list[tuple]]]:
    for _, b, r in each_block(frames):
        segs, _, owner, seg, first = segments(b, np.frombuffer(joined(r["shared"]), "<u8"), np.frombuffer(joined(r["hot"]), "<u8"))
        size = np.fromiter(map(len, segs), np.int64, len(segs))
        doc = b.rep_ids[np.searchsorted(b.end, first, "right")] if len(first) else first
        later = owner[seg] < doc if len(seg) else np.zeros(0, bool)  # the block itself has the segment before
        start, end = [first[later]], [first[later] + size[seg[later]]]
        spans = np.frombuffer(joined(r["spans"]), "<i4").reshape(-1, 3).astype(np.int64)
        if len(spans):
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            mine = np.flatnonzero(~later)
            lo, hi = np.searchsorted(spans[:, 0], seg[mine], "left"), np.searchsorted(spans[:, 0], seg[mine], "right")
            row, at = np.repeat(mine, hi - lo), ranges(lo, hi - lo)
            start.append(first[row] + spans[at, 1])
            end.append(first[row] + spans[at, 2])
        yield b, r, b.cut(np.concatenate(start), np.concatenate(end), LENGTH)


def cut_strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, _, rows in strings_cut(frames):
        yield as_frame(rows)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), one row for every row of docs.

    Each byte goes that is covered by a string of LENGTH bytes which also starts in a document with a smaller doc_id.
    Strings are put into initial buckets by their least GRAM-byte gram; buckets of one block or one segment are settled
    at once, the others are refined by bucket pointers at later offsets until LENGTH bytes are told apart, all on the
    bytes themselves. Rows with the same doc_id never remove each other's bytes; a null doc_id counts as smaller than
    all others; null text counts as empty; texts shorter than LENGTH bytes lose nothing. Of equal texts all but that with the smallest
    doc_id go; rows repeated with it stay like it. A text of any length is in one block, whole; an empty table gives no rows; other columns
    are ignored, whatever their names."""
    return _with_spans(docs).mapInPandas(cut_strings, f"{SPANS}, kept binary")


def _with_spans(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Blocks with all that their documents must be told."""
    blocks, buckets = blocks_of(docs, "suffixes", carry)
    grams = blocks.select("block", "ids", "keys", "texts", "reps").mapInPandas(send_grams(buckets), "bucket int, block long, grams binary")
    shared = grams.groupBy("bucket").applyInPandas(answer_grams, "block long, shared binary, hot binary")
    shared = stored(shared.groupBy("block").agg(F.collect_list("shared").alias("shared"), F.collect_list("hot").alias("hot")), "suffixes-shared")
    blocks = told(blocks, shared)
    sent = blocks.select("block", "ids", "keys", "texts", "reps", "shared", "hot").mapInPandas(send_segments(buckets), "bucket int, block long, number binary, key binary, owner binary, size binary, bytes binary")
    spans = sent.groupBy("bucket").applyInPandas(answer_segments, "block long, spans binary").groupBy("block").agg(F.collect_list("spans").alias("spans"))
    return told(blocks, spans)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns, whatever their names, and rows, with the repeated bytes of suffix_dedup taken out of text. Where that leaves
    part of a character, the part goes too. n_chars, if there, is counted anew for texts that changed; other texts, null
    ones among them, stay as they are."""
    schema, names = docs.schema, docs.columns
    others = [c for c in names if c not in ("doc_id", "text")]
    place = {c: f"c{k}" for k, c in enumerate(others)}  # names that clash with nothing
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(place[c]) for c in others], F.col("text").isNull().alias("is_null"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, r, rows in strings_cut(frames):
            carried = [r["carried"][i] for i in b.order]
            texts = [x[5].decode(errors="ignore") if x[2] else None if c["is_null"] else x[5].decode() for x, c in zip(rows, carried, strict=True)]
            out = {"doc_id": ids_of([x[0] for x in rows]), "text": texts}
            for c in others:
                values = [v[place[c]] for v in carried]
                if c == "n_chars":
                    values = pd.array([len(t) if x[2] else v for x, t, v in zip(rows, texts, values, strict=True)], "Int64")
                out[c] = pd.Series(list(values), dtype=object) if c != "n_chars" else values
            yield pd.DataFrame({c: out[c] for c in names})

    return _with_spans(plain, [*place.values(), "is_null"]).mapInPandas(run, schema)
