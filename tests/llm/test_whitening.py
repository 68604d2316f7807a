"""Whitening against numpy's eigenvectors of the covariance."""

import numpy as np
import pytest

from candela.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, component string, dim string"
CLASH = (1, "x", "n", "c", "d")


def steps(a):
    count = [0]

    def product(y):
        count[0] += 1
        t = a @ y
        return float(t @ t), a.T @ t

    return product, count


def test_early_end_and_repeated_values():
    r = np.random.default_rng(1)
    u, _ = np.linalg.qr(r.normal(size=(900, 300)))
    v, _ = np.linalg.qr(r.normal(size=(300, 300)))
    s = np.concatenate([[50, 50, 50, 40, 30, 30], 20 * 0.9 ** np.arange(100), np.full(194, 1e-4)])
    a = (u * s) @ v.T
    product, count = steps(a)
    values, vectors = whitening.leading(product, 300, float(np.linalg.norm(a)))
    assert np.allclose(values, s[:16], rtol=1e-12) and count[0] < 200
    assert np.allclose(vectors.T @ vectors, np.eye(16), atol=1e-12) and np.allclose(np.linalg.norm(a @ vectors, axis=0), values, rtol=1e-12)
    product, count = steps(np.diag([3.0] * 5))
    values, vectors = whitening.leading(product, 5, float(np.sqrt(45)))
    assert np.allclose(values, 3) and np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-12)
    product, _ = steps(np.outer(np.ones(9), np.arange(4.0)))
    assert len(whitening.leading(product, 4, float(np.sqrt(9 * 14)))[0]) == 1


def plain(rows):
    """By id: x of the usable rows of one length, and what the fit list gives."""
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    a = fit - s / n
    e, c = np.linalg.eigh(a.T @ a / n)
    return x, n, s, e[::-1], c[:, ::-1]


def test_equals_numpy(spark):
    r = np.random.default_rng(3)
    data = r.normal(size=(400, 20)) * np.linspace(3, 0.5, 20)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(data.astype(np.float32))]
    copies = [(1000 + i, rows[7][1]) for i in range(200)]
    short = [(2000 + i, [float(v) for v in r.normal(size=3)]) for i in range(40)]
    bad = [(9001, None), (9002, [float("nan")] * 20), (9003, [float("inf")] + [1.0] * 19), (9004, [None] + [1.0] * 19), (9005, []), (9006, [2.0**57] * 20)]
    df = spark.createDataFrame([(*x, *CLASH) for x in rows + copies + short + bad + [(None, rows[8][1])]], SCHEMA).repartition(7)
    got = whitening.whiten(df).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 601 * 16 + 40 * 3 and got["vec_id"].isna().sum() == 16
    for part, k in ((rows + copies, 16), (short, 3)):
        x, n, s, e, c = plain(part)
        g = got[got["vec_id"].isin(x)].sort_values(["vec_id", "component"])
        assert (g["n"] == n).all() and list(g["component"][:k]) == list(range(1, k + 1))
        ids = sorted(x)
        ours = g["whitened"].to_numpy().reshape(-1, k)
        theirs = np.array([(x[i] - s / n) @ c[:, :k] / np.sqrt(e[:k]) for i in ids])
        assert np.allclose(ours, theirs * np.sign((ours * theirs).sum(0)), atol=1e-8)
        assert list(g["deviation"])[::k] == [sum((n * int(v) - int(t)) ** 2 for v, t in zip(x[i], s, strict=True)) for i in ids]
        assert np.allclose(g["explained"][:k], e[:k] / e.sum(), rtol=1e-10) and g["identity_error"].max() < 1e-10


def test_nothing_to_find(spark):
    same = [(i, [1.5, 2.5], *CLASH) for i in range(5)]
    assert whitening.whiten(spark.createDataFrame(same, SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("big", [2.0**20, 2.0**54])
def test_large_entries_stay_exact(spark, big):
    rows = [(i, [big * (i % 3), float(i)], *CLASH) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    x = [[int(64 * big * (i % 3)) + 1_000_000, 64 * i + 1_000_000] for i in range(6)]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((6 * v - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    for i, w in enumerate(want):
        found = got[got["vec_id"] == i]["deviation"]
        assert (found == w).all() if w < 2**63 else found.isna().all()
