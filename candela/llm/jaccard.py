"""N-gram Jaccard join (6): MinHash candidates pruned by their posterior, exact verification.

Texts with equal words form a class with one representative. Bands of MinHash values put representatives into
buckets; inside a bucket pairs compare their values STEP at a time, and a pair is dropped as soon as the posterior
probability that its Jaccard similarity reaches the threshold is below TOLERANCE. What remains connects representatives into groups. In a
group the candidate pairs, those that share a band and are not dropped, are verified exactly on their word n-grams; what leaves it are counts
of links and paths through what they connect, so no pair is ever a row.

Large buckets and groups are cut into chunks, every two of which meet. In a large group with few candidate pairs only those members come to two
chunks that have such a pair there, which the buckets tell; so in a long chain of texts neighbours meet, not all with all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE_SPACE
from .common import PrefixHash, batches, id_text, ids_of, mix64, most_rows, n_blocks, ranges, spread_join, stored, text_or_empty
from .graph import components, paths

NGRAM, THRESHOLD = 5, 0.8
VALUES, BAND, BANDS = 128, 5, 25  # a pair at the threshold misses all bands once in 20,000
STEP, TOLERANCE = 16, 1e-6
CHUNK = 256  # members of a bucket or group that one task holds, times two
CHUNK_BYTES = 32 << 20  # of n-grams of a group's members that one task holds, times two; a member is not cut
GROUP_BYTES = 1 << 20
_MUL = (mix64(np.arange(1, VALUES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix64(np.arange(1001, VALUES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_blank: np.ndarray | None = None


def _blanks() -> np.ndarray:
    global _blank
    if _blank is None:
        _blank = np.zeros(0x110000, np.int8)
        _blank[[*WHITE_SPACE, 0x1C, 0x1D, 0x1E, 0x1F]] = 1
    return _blank


def shingles(texts: list[str], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts in order, how many each text has, hashes of all words, and how many.
    Words are parted by white space. A text of fewer than n words has one gram, all its words; one without words none."""
    cps = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    edge = np.diff(_blanks()[cps], prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    words = PrefixHash(cps).slices(start, end)
    count = np.bincount(np.searchsorted(ends, start, "right"), minlength=len(texts))
    first = np.cumsum(count) - count
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = ranges(first, grams)
    short = np.repeat((count < n) & (count > 0), grams)
    padded = np.append(words, np.zeros(n, np.uint64))
    h = np.zeros(len(at), np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    if len(at):
        left = np.repeat(count, grams)
        for k in range(n):
            w = padded[at + k]
            h = np.where(short & (k >= left), h, mix64(h * base + w)) if short.any() else mix64(h * base + w)
    return h, grams, words, count


def minhash(h: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """One row of VALUES minima for each text; all ones where it has no grams."""
    out = np.full((len(grams), VALUES), 0xFFFFFFFF, np.uint32)
    there = np.flatnonzero(grams)
    if len(there):
        x = (h >> np.uint64(32)).astype(np.uint32)
        begin = (np.cumsum(grams) - grams)[there]
        for k in range(VALUES):
            out[there, k] = np.minimum.reduceat(x * _MUL[k] + _ADD[k], begin)
    return out


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values the fewest matches with P(similarity >= threshold | matches) >= tolerance. With a uniform
    prior that probability is P(Binomial(n + 1, threshold) <= matches)."""
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def candidates(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Positions of the pairs (i, j) that are not dropped."""
    live, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for n, m in least.items():
        got = matches + (sig[i[live], n - STEP : n] == sig[j[live], n - STEP : n]).sum(1)
        keep = got >= m
        live, matches = live[keep], got[keep]
    return live


def _pairs(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions if there is one chunk, else those of two chunks."""
    kinds = np.unique(side)
    if len(kinds) == 1:
        return np.triu_indices(len(side), 1)
    a, b = np.flatnonzero(side == kinds[0]), np.flatnonzero(side == kinds[1])
    return np.repeat(a, len(b)), np.tile(b, len(a))


def meet_in_chunks(rows: DataFrame, group: str, size: str, member: str, small_groups: int, chunk: int = CHUNK, chunks: str | None = None) -> DataFrame:
    """Adds task, chunk, ca and cb: rows of a group of `size` members, in as many chunks as they make up or as the column `chunks`
    says, meet in tasks, every two chunks in one of theirs and all members of a small group in one; small groups share tasks."""
    n = F.col(chunks) if chunks else F.ceil(F.col(size) / chunk).cast("int")
    with_chunk = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), F.col(member)), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    met = with_chunk.withColumns({"ca": F.least("chunk", "other"), "cb": F.greatest("chunk", "other")}).drop("other")
    # A task's key is dealt out as a whole, so equal ids keep chunk pairs and small groups apart.
    large: Column = F.xxhash64(F.col(group), "ca", "cb")
    return met.withColumn("task", F.when(n == 1, F.pmod(F.xxhash64(F.col(group)), F.lit(small_groups)).cast("long")).otherwise(large))


def digest(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), words (digest of the words; null without any), n_grams, sig, by row of docs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, parts = list(f["t"]), []
            for lo, hi in batches(texts, 1 << 19):
                h, grams, words, count = shingles(texts[lo:hi])
                sig = minhash(h, grams)
                stop = np.cumsum(count)
                for k, (z, n) in enumerate(zip(stop, count, strict=True)):
                    parts.append((digest(words[z - n : z]) if n else None, int(grams[k]), sig[k].tobytes() if n else None))
            yield pd.DataFrame({"doc_id": ids_of(f["doc_id"]), "hash": f["hash"], "words": [p[0] for p in parts], "n_grams": [p[1] for p in parts], "sig": [p[2] for p in parts]})

    text = text_or_empty()
    return docs.select(id_text("doc_id"), F.xxhash64(text).alias("hash"), text.alias("t")).mapInPandas(run, "doc_id long, hash long, words binary, n_grams long, sig binary")


def band_values(sig: np.ndarray) -> np.ndarray:
    return sig[:, : BAND * BANDS].reshape(-1, BANDS, BAND)


def in_band(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that share a band."""
    bands, out = band_values(sig), []
    for lo in range(0, len(i), 1 << 14):
        out.append(lo + np.flatnonzero((bands[i[lo : lo + (1 << 14)]] == bands[j[lo : lo + (1 << 14)]]).all(2).any(1)))
    at = np.concatenate(out) if out else np.zeros(0, np.int64)
    return i[at], j[at]


def buckets(reps: DataFrame) -> DataFrame:
    """band (bucket), m (members), key: buckets of two members or more of reps(key, sig)."""

    def bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = band_values(np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, VALUES)).astype(np.uint64)
            h = np.full(s.shape[:2], 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(BAND):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
            yield pd.DataFrame({"band": h.view(np.int64).ravel(), "key": np.repeat(f["key"].to_numpy(), BANDS)})

    every = stored(reps.mapInPandas(bands, "band long, key long"), "jaccard-bands")
    mixed = [F.bit_xor(F.xxhash64(F.lit(k), "key")).alias(f"members{k}") for k in (1, 2)]
    counted = stored(every.groupBy("band").agg(F.count(F.lit(1)).alias("m"), *mixed).filter("m > 1"), "jaccard-counted")
    hot = counted.filter(F.col("m") > most_rows(every.count())).select("band")
    # Buckets with the same members tell the same: one of them stands for all.
    several = counted.groupBy("m", "members1", "members2").agg(F.min("band").alias("band")).select("band", "m")
    return stored(spread_join(every, several, ["band"], hot).filter("m is not null").select("band", "m", "key"), "jaccard-buckets", every)


def survivors(met: DataFrame, threshold: float, tell, schema: str) -> DataFrame:
    """What tell(f, at, i, j) says of every two chunks of a bucket: rows `at` of f meet, pairs (i, j) of them are not dropped."""
    least = least_matches(threshold)

    def prune(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        f = f.sort_values("key", kind="stable").reset_index(drop=True)
        sig, chunk = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, VALUES), f["chunk"].to_numpy()
        for at in f.groupby(["band", "ca", "cb"], sort=False).indices.values():
            if f["ca"].iat[at[0]] != f["cb"].iat[at[0]] and len(np.unique(chunk[at])) == 1:
                continue
            s = sig[at]
            i, j = _pairs(chunk[at])
            live = candidates(s, i, j, least)
            out.append(tell(f, at, *in_band(s, i[live], j[live])))
        return pd.concat(out) if out else tell(f, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    return met.groupBy("task").applyInPandas(prune, schema)


def connecting(f: pd.DataFrame, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Edges (u, v), and for one member u the number n of pairs."""
    key = f["key"].to_numpy()
    u, v = paths(len(at), i, j, f["chunk"].to_numpy()[at])
    one = [key[at[i[0]]]] if len(i) else []
    return pd.DataFrame({"u": [*key[at[u]], *one], "v": pd.array([*key[at[v]], *[None for _ in one]], "Int64"), "n": [*[0] * len(u), *[len(i) for _ in one]]})


def meeting(f: pd.DataFrame, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Which members have a candidate pair in which two chunks of their group."""
    part = f["part"].to_numpy()[at]
    a, b = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
    place = np.unique(np.stack([np.concatenate([i, j]), np.concatenate([a, a]), np.concatenate([b, b])], 1), axis=0)
    row = at[place[:, 0]]
    return pd.DataFrame({"component": f["component"].to_numpy()[row], "ca": place[:, 1], "cb": place[:, 2], "chunk": part[place[:, 0]], "key": f["key"].to_numpy()[row]})


def candidate_members(reps: DataFrame, threshold: float) -> DataFrame:
    """component, ca, cb, chunk, key: the members of groups for every two chunks, but in a large group with few candidate pairs only those members
    that have such a pair in these chunks."""
    members = buckets(reps)
    groups = n_blocks(members.count() * VALUES * 5, GROUP_BYTES)
    met = meet_in_chunks(members, "band", "m", "key", groups, CHUNK).join(reps.select("key", "sig"), "key")
    pairs = stored(survivors(met, threshold, connecting, "u long, v long, n long"), "jaccard-pairs")
    found = stored(components(pairs.filter("v is not null").select("u", "v")), "jaccard-components")
    of_bytes = F.ceil(F.sum("n_grams") * 8 / CHUNK_BYTES)
    sizes = found.join(reps.select(F.col("key").alias("node"), "n_grams"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), of_bytes.alias("of_bytes"))
    sizes = sizes.withColumn("chunks", F.greatest(F.ceil(F.col("size") / CHUNK), "of_bytes").cast("int"))
    counted = pairs.filter("v is null").select(F.col("u").alias("node"), "n").join(found, "node").groupBy("component").agg(F.sum("n").alias("pairs"))
    # Sparse are those in which fewer members come to their pairs than would come to all meetings of two chunks.
    sizes = stored(sizes.join(counted, "component").select("component", "size", "chunks", (2 * F.col("pairs") < F.col("size") * F.col("chunks")).alias("sparse")), "jaccard-sizes")
    of_group = stored(spread_join(found, sizes, ["component"]).select(F.col("node").alias("key"), "component", "size", "chunks", "sparse"), "jaccard-groups", found)
    dense = meet_in_chunks(of_group.filter((F.col("chunks") == 1) | ~F.col("sparse")), "component", "size", "key", 1, chunks="chunks").select("component", "ca", "cb", "chunk", "key")
    part = F.pmod(F.xxhash64(F.lit(7), "key"), F.col("chunks")).cast("int")
    sparse = of_group.filter((F.col("chunks") > 1) & F.col("sparse")).select("key", "component", part.alias("part"))
    if sparse.isEmpty():
        return dense
    again = meet_in_chunks(members.join(sparse, "key"), "band", "m", "key", groups, CHUNK).join(reps.select("key", "sig"), "key")
    told = survivors(again, threshold, meeting, "component long, ca int, cb int, chunk int, key long").distinct()
    return dense.unionByName(told)


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(col) > 1  # what one set has alone is in no intersection
    pick = often[col]
    row, col = row[pick], (np.cumsum(often) - 1)[col[pick]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, n), np.float64)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 8192):
        a, z = np.searchsorted(col, [lo, lo + 8192])
        dense = np.zeros((n, 8192), np.float32)
        dense[row[a:z], col[a:z] - lo] = 1
        both += dense @ dense.T
    return both


def shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j): each by itself if they are few, else by products of all."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.float64)
    return overlap(sets)[i, j]


def verified(members: DataFrame, classes: DataFrame, docs: DataFrame, repeated: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n): for the candidate members of groups edges (u, v) that connect what true links connect, and rows
    (u, null, n) whose n add up to u's links, every linked class counted with its copies. repeated(doc, hash) are the texts that many
    rows of docs hold under one doc_id, at most MOST_HOT."""

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.drop_duplicates(["key", "t"])
            texts, sets, same = list(f["t"]), [], []
            for lo, hi in batches(texts, 1 << 19):
                h, count, words, n_words = shingles(texts[lo:hi])
                sets += [np.unique(h[z - n : z]).tobytes() for z, n in zip(np.cumsum(count), count, strict=True)]
                same += [digest(words[z - n : z]) for z, n in zip(np.cumsum(n_words), n_words, strict=True)]
            ok = np.array([a == bytes(b) for a, b in zip(same, f["words"], strict=True)], bool)
            yield f.drop(columns=["t", "words"]).assign(grams=sets)[ok]

    wanted = members.select("key").distinct().join(classes.select("key", "words", "doc", "hash", "copies", "sig"), "key")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text_or_empty()).alias("hash"), text_or_empty().alias("t"))
    # Rows of an often repeated (doc_id, text) become one before they are shuffled. Other texts of the same hash stay beside it.
    again = texts.join(F.broadcast(repeated), ["doc", "hash"], "left_semi").groupBy("doc", "hash", "t").agg(F.count(F.lit(1))).select("doc", "hash", "t")
    texts = texts.join(F.broadcast(repeated), ["doc", "hash"], "left_anti").unionByName(again)
    found = texts.join(wanted, ["doc", "hash"]).select("key", "words", "copies", "sig", "t").mapInPandas(grams, "key long, copies long, sig binary, grams binary")
    sets = stored(found.dropDuplicates(["key"]), "jaccard-sets")
    groups = n_blocks(int(members.count() * (sets.agg(F.avg(F.octet_length("grams"))).first()[0] or 0)), GROUP_BYTES)
    met = members.join(sets, "key").withColumn("task", F.pmod(F.xxhash64("component", "ca", "cb"), F.lit(groups)))
    least = least_matches(threshold)

    def verify(f: pd.DataFrame) -> pd.DataFrame:
        links, counts = [], []
        f = f.sort_values("key", kind="stable").reset_index(drop=True)
        key, copies, chunk, grams = (f[c].to_numpy() for c in ("key", "copies", "chunk", "grams"))
        sig = np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, VALUES)
        for at in f.groupby(["component", "ca", "cb"], sort=False).indices.values():
            if f["ca"].iat[at[0]] != f["cb"].iat[at[0]] and len(np.unique(chunk[at])) == 1:
                continue
            i, j = _pairs(chunk[at])
            live = candidates(sig[at], i, j, least)
            i, j = in_band(sig[at], i[live], j[live])
            s = [np.frombuffer(grams[k], np.uint64) for k in at]
            size = np.array([len(x) for x in s])
            both = shared(s, i, j)
            true = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[true], j[true]
            u, v = paths(len(at), i, j, chunk[at])
            links += zip(key[at[u]], key[at[v]], strict=True)
            n = np.bincount(i, weights=copies[at[j]], minlength=len(at)) + np.bincount(j, weights=copies[at[i]], minlength=len(at))
            some = np.flatnonzero(n)
            counts += zip(key[at[some]], n[some].astype(np.int64).tolist(), strict=True)
        return pd.DataFrame({"u": [x[0] for x in (*links, *counts)], "v": pd.array([*(x[1] for x in links), *[None] * len(counts)], "Int64"), "n": [*[0] * len(links), *(x[1] for x in counts)]})

    return met.groupBy("task").applyInPandas(verify, "u long, v long, n long")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links, kept, one row for every row of docs.

    Two rows are linked if the Jaccard similarity of their sets of word 5-grams is at least the threshold; texts with
    equal words are. n_links counts the other rows linked directly, class_id is the smallest doc_id reachable by links,
    kept marks one row of each class, the first. Texts without words, null among them, link with nothing and are kept.
    Repeated rows are rows like any others; those of a kept doc_id are kept. A null doc_id links with nothing: its
    class_id is null, and it is kept. Texts of any length are taken whole; an empty table gives no rows; other columns are
    ignored, whatever their names. Ties: of equal doc_ids all rows are kept. docs is read twice: a stored table."""
    rows = stored(signatures(docs), "jaccard-rows")
    there = rows.filter(F.col("words").isNotNull() & F.col("doc_id").isNotNull())
    classes = there.groupBy("words").agg(F.min(F.struct("doc_id", "hash")).alias("one"), F.count(F.lit(1)).alias("copies"), F.first("n_grams").alias("n_grams"), F.first("sig").alias("sig"))
    # A class has a number of its own, given when it is written.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("key"), "words", F.col("one.doc_id").alias("doc"), F.col("one.hash").alias("hash"), "copies", "n_grams", "sig"), "jaccard-classes")
    members = stored(candidate_members(classes.select("key", "n_grams", "sig"), threshold), "jaccard-candidates")
    often = there.groupBy(F.col("doc_id").alias("doc"), "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_rows(rows.count()))
    repeated = stored(often.select("doc", "hash"), "jaccard-repeated")
    links = stored(verified(members, classes, docs, repeated, threshold), "jaccard-links")
    of_class = links.groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    linked = components(links.filter(F.col("v").isNotNull()).select("u", "v"))
    # The smallest doc_id of a component, not the smallest key.
    named = stored(linked.join(classes.select("key", "doc"), F.col("node") == F.col("key")).select("key", "component", "doc"), "jaccard-named")
    named = spread_join(named, named.groupBy("component").agg(F.min("doc").alias("least")), ["component"]).select("key", "least")
    known = classes.join(of_class, "key", "left").join(named, "key", "left").select("words", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("least", "doc").alias("least"))
    return spread_join(rows.select("doc_id", "words"), stored(known, "jaccard-known"), ["words"]).select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNull() | F.col("words").isNull(), 0).otherwise(F.col("copies") - 1 + F.col("n")).cast("long").alias("n_links"),
        F.coalesce(F.coalesce("least", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whatever their names: of each class the one with the smallest doc_id, and those without an id.
    Rows of a doc_id that very many rows have stay where they are."""
    ids = docs.select(F.col("doc_id").cast("long").alias("hot_id")).filter("hot_id is not null")
    hot = stored(ids.groupBy("hot_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_rows(docs.count())).select("hot_id"), "jaccard-hot-ids")
    kept = stored(jaccard_join(docs, threshold).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct(), "jaccard-kept")
    every, same_id = docs.alias("all"), F.col("all.doc_id").cast("long")
    few = kept.join(F.broadcast(hot), F.col("kept_id") == F.col("hot_id"), "left_semi").alias("kept")  # at most MOST_HOT
    frequent = every.join(F.broadcast(few), same_id == F.col("kept.kept_id"), "left_semi")
    others = every.join(F.broadcast(hot.alias("hot")), same_id == F.col("hot.hot_id"), "left_anti").join(kept.alias("kept"), same_id == F.col("kept.kept_id"), "left_semi")
    return frequent.unionByName(others).unionByName(docs.filter(F.col("doc_id").isNull()))
