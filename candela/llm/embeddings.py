"""Embedding near-dedup (5): a pivot-permutation index.

Pivots are a sample of the vectors, thinned so that no two lie close together: a dense group of near copies has few pivots
of its own, and its members keep common lists however many they are. A vector is described by its PREFIX nearest pivots in order and stands in the
inverted list of each. Two vectors of a list are compared if they share at least LEAST_SHARED pivots; then their cosine
is taken in double precision. A pair counts in the list of the smallest pivot they share, so it counts once. Lists are
compared block by block; blocks return sums of links and paths through what they connect, never pairs.

Equal vectors are one class with a count. The number of pivots grows with the table, so lists keep their length; their
number is bounded (MOST_PIVOTS for all lengths of vectors together, in proportion), beyond which lists grow and are cut into more
chunks. Vectors of a length so rare that it gets no pivots are one list, in which all are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_blocks, spread_join, stored
from .graph import components, paths
from .jaccard import meet_in_chunks

THRESHOLD = 0.9
PREFIX, LEAST_SHARED = 10, 2
VECTORS_PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 64, 16, 8192
PIVOT_BYTES = 64 << 20  # of the pivots of all lengths together; each task holds them
CHUNK = 1024
APART = 0.8  # cosine that no two pivots reach
DIRECT = 50_000  # pairs of a block whose pivots are compared one by one; beyond, by a matrix product
GROUP_BYTES = 1 << 20


def usable(c: str = "embedding"):
    """True where a vector can have a cosine: all components finite, not all zero."""
    inf = float("inf")
    finite = F.forall(c, lambda x: F.coalesce((F.abs(x) < inf) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(F.col(c).isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def key_of() -> Column:
    """128 bits of the vector."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "embedding")), 16, "0") for k in (1, 2)]))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so nothing over- or underflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def apart(v: np.ndarray) -> np.ndarray:
    """Unit rows of v, in order, whose cosine to every row kept before them is under APART."""
    kept = np.zeros(len(v), bool)
    for lo in range(0, len(v), 256):
        part = v[lo : lo + 256]
        free = ~(part @ v[:lo][kept[:lo]].T >= APART).any(1)
        among = part @ part.T >= APART
        for i in np.flatnonzero(free):
            kept[lo + i] = not (among[i, :i] & kept[lo : lo + i]).any()
    return v[kept]


def pivots_of(classes: DataFrame) -> dict[int, np.ndarray]:
    """Unit pivots by length of vectors, in a fixed order: the first vectors by a hash, without those close to one before. In all at
    most MOST_PIVOTS, and PIVOT_BYTES; lengths whose share of these is below LEAST_PIVOTS, of which there may be any number, get none."""
    counts = classes.groupBy("dim").count()
    total = classes.count()
    out = {}
    for r in counts.filter(F.col("count") * MOST_PIVOTS >= LEAST_PIVOTS * total).collect():  # at most MOST_PIVOTS / LEAST_PIVOTS rows
        n = min(MOST_PIVOTS * r["count"] // total, max(LEAST_PIVOTS, -(-r["count"] // VECTORS_PER_PIVOT)))
        n = min(n, PIVOT_BYTES * r["count"] // (total * 8 * r["dim"]))
        if n < LEAST_PIVOTS:
            continue
        rows = classes.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64(F.lit(11), "key"), "key").limit(n).select("v").toArrow()
        out[r["dim"]] = apart(unit(rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, r["dim"])))
    return out


def inverted_lists(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """dim, list (pivot), key, copies, prefix (int32 pivots), v (float64 bytes): PREFIX rows for each class."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors and PIVOT_BYTES

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby("dim"):
                p = shared.value.get(dim)
                if p is None:
                    v = [np.array(x, np.float64).tobytes() for x in g["v"]]
                    yield pd.DataFrame({"dim": dim, "list": np.zeros(len(g), np.int32), "key": g["key"], "copies": g["copies"], "prefix": np.array([0] + [-1] * (PREFIX - 1), np.int32).tobytes(), "v": v})
                    continue
                k = min(PREFIX, len(p))
                for lo in range(0, len(g), 1000):
                    part = g.iloc[lo : lo + 1000]
                    v = np.array(part["v"].tolist(), np.float64)
                    near = unit(v) @ p.T
                    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    order = np.lexsort((top, -np.take_along_axis(near, top, 1)), axis=1)
                    top = np.take_along_axis(top, order, 1).astype(np.int32)
                    wide = np.full((len(v), PREFIX), -1, np.int32)
                    wide[:, :k] = top
                    yield pd.DataFrame({
                        "dim": dim, "list": top.ravel(), "key": np.repeat(part["key"].to_numpy(), k), "copies": np.repeat(part["copies"].to_numpy(), k),
                        "prefix": [x for w in wide for x in [w.tobytes()] * k], "v": [x for w in v for x in [w.tobytes()] * k],
                    })

    return classes.mapInPandas(run, "dim int, list int, key binary, copies long, prefix binary, v binary")


def owned(pa: np.ndarray, pb: np.ndarray, i: np.ndarray, j: np.ndarray, own: int, least: int) -> np.ndarray:
    """Positions of the pairs (i, j) that share at least `least` pivots, the smallest of them `own`."""
    if len(i) <= DIRECT:
        out = []
        for lo in range(0, len(i), 10_000):
            x, y = pa[i[lo : lo + 10_000]], pb[j[lo : lo + 10_000]]
            same = (x[:, :, None] == y[:, None, :]).any(2) & (x >= 0)
            out.append(lo + np.flatnonzero((same.sum(1) >= least) & (np.where(same, x, np.iinfo(np.int32).max).min(1) == own)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)
    both = np.intersect1d(pa, pb)
    both = both[both >= 0]

    def held(p: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(both, p), len(both) - 1)
        row, col = np.nonzero(both[at] == p)
        out = np.zeros((len(p), len(both)), np.float32)
        out[row, at[row, col]] = 1
        return out

    ha, hb, smaller = held(pa), held(pb), int(np.searchsorted(both, own))
    good = (ha @ hb.T >= least) & (ha[:, :smaller] @ hb[:, :smaller].T == 0)
    return np.flatnonzero(good[i, j] & (pa == own).any(1)[i] & (pb == own).any(1)[j])


def compare(threshold: float):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        links, counts = [], []
        f = f.sort_values("key", kind="stable").reset_index(drop=True)
        key, copies, chunk = f["key"].to_numpy(), f["copies"].to_numpy(), f["chunk"].to_numpy()
        prefix = np.frombuffer(b"".join(f["prefix"]), np.int32).reshape(-1, PREFIX)
        vectors = f["v"].to_numpy()
        for at in f.groupby(["place", "ca", "cb"], sort=False).indices.values():
            if f["ca"].iat[at[0]] != f["cb"].iat[at[0]] and len(np.unique(chunk[at])) == 1 or len(at) < 2:
                continue
            own = f["list"].iat[at[0]]
            sides = np.unique(chunk[at])
            a = at[chunk[at] == sides[0]]
            b = at[chunk[at] == sides[-1]]
            pa, pb = prefix[a], prefix[b]
            va = unit(np.frombuffer(b"".join(vectors[a])).reshape(len(a), -1))
            vb = va if len(sides) == 1 else unit(np.frombuffer(b"".join(vectors[b])).reshape(len(b), -1))
            least = min(LEAST_SHARED, int((pa[0] >= 0).sum()))
            i, j = np.nonzero(va @ vb.T >= threshold)
            if len(sides) == 1:
                up = i < j
                i, j = i[up], j[up]
            kept = owned(pa, pb, i, j, own, least)
            i, j = i[kept], j[kept]
            n_a = np.bincount(i, weights=copies[b[j]], minlength=len(a))
            n_b = np.bincount(j, weights=copies[a[i]], minlength=len(b))
            for side, n in ((a, n_a), (b, n_b)):
                some = np.flatnonzero(n)
                counts += zip(key[side[some]], n[some].astype(np.int64).tolist(), strict=True)
            shift = 0 if len(sides) == 1 else len(a)
            every = a if len(sides) == 1 else np.concatenate([a, b])
            left, right = paths(len(every), i, j + shift, chunk[every])
            links += zip(key[every[left]], key[every[right]], strict=True)
        return pd.DataFrame({"u": [x[0] for x in (*links, *counts)], "v": [*(x[1] for x in links), *[None] * len(counts)], "n": [*[0] * len(links), *(x[1] for x in counts)]})

    return run


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for every row of vectors.

    Rows link whose cosine, in double precision, is at least the threshold and which the index finds; equal vectors
    always do. Null or empty vectors, zero vectors and those with null or non-finite components link with nothing; nor
    do vectors of different lengths. Repeated rows are rows like any others. A null vec_id gets a null component_id and
    kept true. Ties between equally near pivots go to the pivot that comes first. An empty table gives no rows. Other columns are ignored,
    whatever their names."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("embedding"))
    good = rows.filter(usable())
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select(key_of().alias("key"), "first", "copies", F.size("embedding").alias("dim"), F.col("embedding").alias("v"))
    classes = stored(classes, "embeddings-classes")
    lists = stored(inverted_lists(classes, pivots_of(classes)).withColumn("place", F.struct("dim", "list")), "embeddings-lists")
    sizes = lists.groupBy("place").agg(F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("v") + 64).alias("bytes"))
    groups = n_blocks(int(sizes.agg(F.sum("bytes")).first()[0] or 0), GROUP_BYTES)
    met = meet_in_chunks(spread_join(lists, sizes.select("place", "size"), ["place"]), "place", "size", "key", groups, CHUNK)
    met = met.withColumn("place", F.xxhash64("place"))
    links = stored(met.groupBy("task").applyInPandas(compare(threshold), "u binary, v binary, n long"), "embeddings-links")
    counted = links.groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    linked = components(links.filter(F.col("v").isNotNull()).select("u", "v"))
    named = stored(linked.join(classes.select("key", "first"), F.col("node") == F.col("key")).select("key", "component", "first"), "embeddings-named")
    named = spread_join(named, named.groupBy("component").agg(F.min("first").alias("least")), ["component"]).select("key", "least")
    known = classes.select("key", "first", "copies").join(counted, "key", "left").join(named, "key", "left")
    known = known.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n"), F.coalesce("least", "first").alias("least"))
    keyed = stored(rows.select("vec_id", F.when(usable(), key_of()).alias("key")), "embeddings-keyed")
    out = spread_join(keyed, stored(known, "embeddings-known"), ["key"])
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
