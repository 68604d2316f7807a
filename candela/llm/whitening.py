"""Embedding whitening (12) by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers x; the distinct ones are the fit list, a matrix that stays distributed and is centred row by row, from exact
integers, before anything is multiplied. A step of the bidiagonalisation is one pass: every task forms Xv and adds up X'(Xv), and
vectors of the width of X come to the driver. A left vector u is kept as the z with u = Xz, so that nothing as long as the table is
ever stored or sent; left and right vectors are reorthogonalised against all before them. The singular values and right vectors of
the small bidiagonal matrix give standard deviations and components.

From one start vector a direction of an eigenvalue that occurs more than once can stay unseen. So the process starts again in
what is orthogonal to the components found, until nothing larger than the last of them is left there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BLOCK_BYTES = 1 << 21
CONVERGED = 1e-15  # residual of a triplet over the largest singular value
GLANCED = 1e-3  # the same over its own value, where it only has to be known that no triplet is larger than it
NOTHING = 1e-10  # of the largest singular value: not more than this is no component
HALF = 31  # bits of the lower part of a number, so that 2**32 of them can be added

OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(c: str = "embedding") -> Column:
    """All entries finite, and 64 times them within long integers."""
    most = float(2**62)
    fine = F.forall(c, lambda x: F.coalesce((F.abs(x.cast("double") * SCALE) < most) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(F.col(c).isNotNull() & fine, F.lit(False))


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the rows that can be used."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).filter(usable())
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("x")).filter(F.size("x") > 0)


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_length(batch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, positions and rows of each length in a batch with the list column x."""
    import pyarrow as pa
    import pyarrow.compute as pc

    x = batch.column(batch.schema.names.index("x"))
    sizes = pc.list_value_length(x).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, _matrix(x if len(at) == len(sizes) else x.take(pa.array(at)), int(dim))


def fit_blocks(rows: DataFrame) -> DataFrame:
    """dim, x: the distinct vectors, those of one length packed together as 64-bit numbers, about BLOCK_BYTES in a row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for dim, _, x in _by_length(b):
                each = max(1, BLOCK_BYTES // (8 * dim))
                parts = [np.ascontiguousarray(x[lo : lo + each]).tobytes() for lo in range(0, len(x), each)]
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["dim", "x"])

    return rows.select("x").distinct().mapInArrow(run, "dim int, x binary")


def _sums(blocks: DataFrame, add: Callable[[np.ndarray], np.ndarray], dim: int, kind: str) -> np.ndarray:
    """The sum over all blocks of a vector of each: added up in every task, then by position."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for b in f["x"]:
                part = add(np.frombuffer(b, np.int64).reshape(-1, dim))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    got = blocks.select("x").mapInPandas(run, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()  # a row for each position
    out = np.zeros(len(got), np.int64 if kind == "long" else np.float64)
    for r in got:
        out[r["k"]] = r["v"]
    return out


def shifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: 64-bit integers where these hold it, Python's otherwise."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    if n * max(abs(low), abs(high), 1) + max(map(abs, sums)) < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    y = shifted(x, n, sums)
    return y / n if y.dtype != object else np.array([[v / n for v in row] for row in y], np.float64)


@dataclass(frozen=True)
class Run:
    """What one bidiagonalisation found: singular values, falling, with right vectors as columns."""

    values: np.ndarray
    vectors: np.ndarray
    complete: bool  # the whole space was seen


def bidiagonalise(product: Callable[[np.ndarray], tuple[float, np.ndarray]], dim: int, want: int, known: np.ndarray, scale: float, enough: float, seed: int) -> Run:
    """The `want` leading triplets in the space orthogonal to the columns of `known`; product(y) gives |Xy|^2 and X'Xy. If one triplet is
    enough to tell that all are below `enough`, it need not be exact."""
    room = dim - known.shape[1]

    def clear(w: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            w = w - known @ (known.T @ w)
            for v in basis:
                w = w - v * (v @ w)
        return w

    right: list[np.ndarray] = []
    left: list[np.ndarray] = []  # z, u = Xz
    images: list[np.ndarray] = []  # X'u
    alphas: list[float] = []
    betas: list[float] = []
    v, beta = clear(np.random.default_rng(seed).normal(size=dim), []), 0.0
    v /= np.linalg.norm(v)
    while True:
        right.append(v)
        y = v - beta * left[-1] if left else v
        square, g = product(y)
        if left:  # what is left of earlier u
            c = np.array(left) @ g
            y, g, square = y - c @ np.array(left), g - c @ np.array(images), square - c @ c
        alpha = np.sqrt(max(square, 0.0))
        done = alpha <= 1e-14 * scale
        alphas.append(0.0 if done else alpha)
        if not done:
            left.append(y / alpha)
            images.append(g / alpha)
            w = clear(images[-1] - alpha * v, right)
            beta = float(np.linalg.norm(w))
            done = len(right) == room or beta <= 1e-14 * scale
        small = np.diag(alphas) + np.diag(betas, 1)
        p, s, q = np.linalg.svd(small)
        open_ = np.zeros(len(s)) if done else beta * np.abs(p[-1])
        enough_seen = len(s) >= want and bool((open_[:want] <= CONVERGED * s[0]).all())
        below = want == 1 and s[0] + open_[0] < enough and open_[0] <= GLANCED * s[0]
        if done or enough_seen or below:
            k = min(want, len(s))
            return Run(s[:k], np.array(right).T @ q[:k].T, len(right) == room)
        betas.append(beta)
        v = w / beta


def leading(product: Callable[[np.ndarray], tuple[float, np.ndarray]], dim: int, scale: float, want: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right vectors (columns) of the at most `want` leading components."""
    values, vectors = np.zeros(0), np.zeros((dim, 0))
    run_no = 0
    while vectors.shape[1] < dim and scale > 0:
        full = len(values) >= want
        last = values[want - 1] if full else 0.0
        got = bidiagonalise(product, dim, 1 if full else want - len(values), vectors, scale, last, run_no)
        run_no += 1
        if full and got.values[0] <= last * (1 + 1e-12) or got.values[0] <= NOTHING * scale:
            break
        values, vectors = np.append(values, got.values), np.hstack([vectors, got.vectors])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        if got.complete:
            break
    real = values[:want] > NOTHING * values.max(initial=0.0)
    return values[:want][real], vectors[:, :want][:, real]


@dataclass(frozen=True)
class Whitener:
    n: int
    sums: list[int]
    components: np.ndarray  # columns
    deviations: np.ndarray  # standard deviations along them
    explained: np.ndarray
    identity_error: float

    def transform(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.components / self.deviations

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - sums; None where a long does not hold them."""
        y = shifted(x, self.n, self.sums)
        most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
        if most * most * y.shape[1] < 2**63:
            return (y.astype(np.int64) ** 2).sum(1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in y]
        return [e if e < 2**63 else None for e in exact]


def fit(blocks: DataFrame, dim: int, want: int = COMPONENTS) -> Whitener:
    """Components of the vectors of one length."""
    own = blocks.filter(F.col("dim") == dim).persist()
    try:
        mask = (1 << HALF) - 1
        counts = _sums(own, lambda x: np.concatenate([[len(x)], (x >> HALF).sum(0), (x & mask).sum(0)]), dim, "long")
        n, sums = int(counts[0]), [(int(h) << HALF) + int(low) for h, low in zip(counts[1 : dim + 1], counts[dim + 1 :], strict=True)]

        def product(y: np.ndarray) -> tuple[float, np.ndarray]:
            def add(x: np.ndarray) -> np.ndarray:
                a = centred(x, n, sums)
                t = a @ y
                return np.append(a.T @ t, t @ t)

            out = _sums(own, add, dim, "double")
            return float(out[-1]), out[:-1]

        squares = float(_sums(own, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), dim, "double")[0])
        values, vectors = leading(product, dim, float(np.sqrt(squares)), want)
        deviations = values / np.sqrt(n)
        k = len(values)

        def covariance(x: np.ndarray) -> np.ndarray:
            w = centred(x, n, sums) @ vectors / deviations
            return (w.T @ w).ravel() / n

        off = float(np.abs(_sums(own, covariance, dim, "double").reshape(k, k) - np.eye(k)).max()) if k else 0.0
        return Whitener(n, sums, vectors, deviations, values**2 / squares if k else values, off)
    finally:
        own.unpersist()


def whiten(vectors: DataFrame, want: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Null vectors, vectors with null or non-finite entries, and those with an entry of 2**56 or more, which no long holds 64 times, are left out, and so are empty
    ones. Vectors of different lengths are fitted apart, each length on its own list. Repeated rows are
    rows of the result, but once in the fit list; a null vec_id stays null. There are fewer than `want` components where the fit list has
    no more directions: none, and so no rows, where all its vectors are equal. Equal eigenvalues have any orthonormal components of theirs. A deviation above
    2**63 - 1 is null. An empty table gives no rows; other columns are ignored, whatever their names."""
    rows = whole(vectors)
    blocks = stored(fit_blocks(rows), "whitening-fit")
    models = {r["dim"]: fit(blocks, r["dim"], want) for r in blocks.select("dim").distinct().collect()}  # lengths of vectors
    shared = vectors.sparkSession.sparkContext.broadcast(models)  # want vectors for each length

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for dim, at, x in _by_length(b):
                m = shared.value[dim]
                k = len(m.deviations)
                if not k:
                    continue
                each = np.repeat(np.arange(len(at)), k)
                ids = b.column(0).take(pa.array(at[each]))
                deviation = pa.array(m.deviation(x), pa.int64()).take(pa.array(each))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), m.n)), deviation,
                        pa.array(m.transform(x).ravel()), pa.array(np.tile(m.explained, len(at))), pa.array(np.full(len(each), m.identity_error)),
                    ],
                    names=[c.split()[0] for c in OUTPUT.split(", ")],
                )

    return rows.select("vec_id", "x").mapInArrow(run, OUTPUT)
