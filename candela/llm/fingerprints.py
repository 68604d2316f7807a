"""Document fingerprints (3): Lempel-Ziv phrases, hashed, compared by their minimum hashes.

Each text is parsed into LZ78 phrases over code points: a phrase is the longest one known so far plus a
character. The fingerprint is the SIZE smallest hashes of the set of phrases, so two fingerprints estimate
the Jaccard likeness of the phrase sets, which is high where a joint compression would gain much.

The dictionary of a text is kept whole while that text is parsed: about 200 bytes a phrase, 350 MB for 12 million characters of prose, and
phrases grow more slowly than the text.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, id_text, ids_of, n_blocks, text_or_empty

SIZE = 128  # hashes of a fingerprint
BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 50_000  # tasks, several for each core of a large cluster; beyond 200 GB they grow with the data
SAMPLED = 16  # rows for each bucket, from which the bounds of the buckets are taken
_STEP = 1 << 21  # above all code points: a trie key is node * _STEP + code point


class Parse:
    """An LZ78 parse that can be copied and continued."""

    __slots__ = ("trie", "node", "next", "ends", "at")

    def __init__(self):
        self.trie, self.node, self.next, self.ends, self.at = {}, 0, _STEP, [], 0

    def copy(self) -> Parse:
        p = Parse()
        p.trie, p.node, p.next, p.ends, p.at = dict(self.trie), self.node, self.next, list(self.ends), self.at
        return p

    def feed(self, text: str) -> Parse:
        trie, node, new, i = self.trie, self.node, self.next, self.at
        known, add = trie.setdefault, self.ends.append
        for c in memoryview(text.encode("utf-32-le")).cast("I"):
            i += 1
            got = known(node + c, new)
            if got is new:
                add(i)
                new += _STEP
                node = 0
            else:
                node = got
        self.node, self.next, self.at = node, new, i
        return self


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The SIZE smallest distinct 32-bit hashes of the phrases that end at `ends`."""
    stop = np.array(ends, np.int64)
    start = np.zeros(len(stop), np.int64)
    start[1:] = stop[:-1]
    h = PrefixHash(np.frombuffer(text.encode("utf-32-le"), np.uint32)).slices(start, stop)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard likeness of two phrase sets; 1 for two empty ones."""
    both = np.union1d(a, b)[:SIZE]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def written(sig: np.ndarray) -> str:
    return base64.b64encode(sig.astype("<u4").tobytes()).decode()


def read_fingerprint(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def fingerprint(text: str) -> str:
    return written(signature(text, Parse().feed(text).ends))


Key = tuple[bool, int, int, int]


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, t, halo, bucket: rows in partitions that follow each other in order, sorted; each partition ends with a copy (halo = 1)
    of the row that follows it, the first row of all after the last one. Only a bounded sample of keys and the buckets'
    first keys reach the driver.

    The order is by doc_id, null first, the text's CRC-32, and the row's place in the input, so rows without an id and rows
    of one doc_id, equal ones too, are dealt over as many buckets as they need. docs is read several times: a stored table. Where the reads
    differ, edited_fingerprints ends with an error."""
    text = text_or_empty()
    place = F.xxhash64(F.monotonically_increasing_id())
    rows = docs.select(F.col("doc_id").isNotNull().alias("k0"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"), F.crc32(text.cast("binary")).alias("k2"), place.alias("k3"), text.alias("t"))
    key = ["k0", "k1", "k2", "k3"]
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("t").cast("long"))).first()
    buckets = min(MOST_BUCKETS, n_blocks(size or 0, BUCKET_BYTES))
    edges: list[Key] = []
    if buckets > 1:
        share = min(1.0, SAMPLED * buckets / n)
        picked = F.pmod(F.xxhash64(F.lit(3), *key), F.lit(1 << 30)) < int(share * (1 << 30))
        sample = sorted(tuple(r) for r in rows.filter(picked).select(*key).collect())  # about SAMPLED * MOST_BUCKETS keys at most
        edges = sorted({sample[i * len(sample) // buckets] for i in range(1, buckets)}) if sample else []

    def keys_of(k0, k1, k2, k3) -> Iterator[Key]:
        return zip(k0.tolist(), k1.tolist(), k2.tolist(), k3.tolist(), strict=True)

    @F.pandas_udf("int")
    def bucket_of(k0: pd.Series, k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(edges, k) for k in keys_of(k0, k1, k2, k3)], dtype="int32")

    found = rows.select(*key).withColumn("bucket", bucket_of(*key)).groupBy("bucket").agg(F.min(F.struct(*key)).alias("f")).collect()
    firsts = sorted((r["bucket"], tuple(r["f"])) for r in found)
    if not firsts:
        return rows.select(F.lit(None).cast("long").alias("doc_id"), "t", F.lit(0).alias("halo"), F.lit(0).alias("bucket"))
    to = {f: firsts[i - 1][0] for i, (_, f) in enumerate(firsts)}  # i = 0: the last bucket

    @F.pandas_udf("array<int>")
    def goes_to(k0: pd.Series, k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        return pd.Series([[bisect_right(edges, k), to[k]] if k in to else [bisect_right(edges, k)] for k in keys_of(k0, k1, k2, k3)])

    spread = rows.select(*key, "t", F.posexplode(goes_to(*key)).alias("halo", "bucket"))
    ordered = spread.repartitionById(firsts[-1][0] + 1, F.col("bucket")).sortWithinPartitions("bucket", "halo", *key)
    return ordered.select(F.when(F.col("k0"), F.col("k1")).alias("doc_id"), "t", "halo", "bucket")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the next row by doc_id; rows of one doc_id follow each other by the text's CRC-32, rows
    without an id come first, and after the last row comes the first. Null text counts as empty: its fingerprint
    is the empty string, like only to itself. A table of one row is its own next document; an empty one gives none.
    Texts of any length are parsed whole (see above for memory). Other columns are ignored, whatever their names.
    docs must have the same rows in the same order each time it is read; a row that is left without a next one raises an error.
    """
    rows = in_order(docs)
    lost = "a row has no next one: docs changed between reads, write it to a table first"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for f in frames:
            out = []
            for doc, text, halo, bucket in zip(f["doc_id"], f["t"], f["halo"], f["bucket"], strict=True):
                own = Parse().feed(text[: (len(text) + 1) // 2])
                half = own.copy()
                sig = signature(text, own.feed(text[(len(text) + 1) // 2 :]).ends)
                if held is not None:
                    if held[5] != bucket:
                        raise ValueError(lost)
                    was, before, parse, had, _, _ = held
                    k = len(before) // 2
                    edited = before[: len(before) - k] + text[:k]
                    new = signature(edited, parse.feed(text[:k]).ends)
                    out.append((was, len(before), hashlib.sha256(edited.encode()).hexdigest(), written(had), written(new), likeness(had, new), likeness(had, sig)))
                held = None if halo else (doc, text, half, sig, halo, bucket)
            made = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            yield made.assign(doc_id=ids_of(made["doc_id"]))
        if held is not None:
            raise ValueError(lost)

    return rows.withColumn("doc_id", id_text("doc_id")).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
