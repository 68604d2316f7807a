"""The pivot index against brute force."""

import numpy as np

from candela.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, key string"


def brute(rows):
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    n = near.sum(1) - 1
    comp = list(range(len(rows)))
    changed = True
    while changed:
        new = [min(comp[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
        changed, comp = new != comp, new
    return {r[0]: (int(n[i]), rows[comp[i]][0]) for i, r in enumerate(rows)}


def test_links_and_components(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 24)).astype(np.float32)
    x[200:320] = x[3] + 0.05 * r.normal(size=(120, 24))
    x[400:460] = x[5]
    x[500:560] = x[500] + 0.25 * r.normal(size=(60, 24))
    rows = [(i * 2, [float(v) for v in row], 1, "k") for i, row in enumerate(x)]
    bad = [(9001, None, 1, "k"), (9002, [0.0] * 24, 1, "k"), (9003, [float("nan")] * 24, 1, "k"), (9004, [float("inf")] + [1.0] * 23, 1, "k"), (9005, [None] + [1.0] * 23, 1, "k"), (9006, [], 1, "k"), (9007, [1.0, 2.0], 1, "k"), (None, [3.0] * 24, 1, "k")]
    got = embeddings.near_embeddings(spark.createDataFrame(rows + bad, SCHEMA)).collect()
    assert len(got) == len(rows) + len(bad)
    by, want = {g["vec_id"]: g for g in got}, brute(rows)
    found, there = sum(by[d]["n_links"] for d in want), sum(n for n, _ in want.values())
    assert 0.99 * there <= found <= there
    assert sum(by[d]["component_id"] != c for d, (_, c) in want.items()) <= 2
    assert all(by[d]["n_links"] == 0 and by[d]["component_id"] == d and by[d]["kept"] for d, *_ in bad if d is not None)
    assert embeddings.near_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_groups_of_near_copies_keep_common_lists(spark, monkeypatch):
    """As dense in pivots as a group of 19,200 distinct near copies is at the standard rate."""
    monkeypatch.setattr(embeddings, "VECTORS_PER_PIVOT", 2)
    r = np.random.default_rng(5)
    x = r.normal(size=(1000, 64))
    x[:600] = x[0] + 0.1 * r.normal(size=(600, 64))
    rows = [(i, [float(v) for v in row], 1, "k") for i, row in enumerate(x.astype(np.float32))]
    got = {g["vec_id"]: g["n_links"] for g in embeddings.near_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    there = sum(n for n, _ in want.values())
    assert there >= 600 * 599 and 0.99 * there <= sum(got.values()) <= there


def test_rare_lengths_and_common_vectors(spark, monkeypatch):
    """Lengths without pivots are compared in one list; a vector that a third of the rows have, and null ones, are no hot group."""
    monkeypatch.setattr(embeddings, "MOST_PIVOTS", 40)
    monkeypatch.setattr(embeddings, "CHUNK", 8)
    r = np.random.default_rng(8)
    x = r.normal(size=(400, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in row], 1, "k") for i, row in enumerate(x)] + [(1000 + i, [1.0] * 16, 1, "k") for i in range(300)] + [(2000 + i, None, 1, "k") for i in range(200)]
    short = r.normal(size=(30, 5))
    short[10:20] = short[3] + 0.05 * r.normal(size=(10, 5))
    few = [(3000 + i, [float(v) for v in row], 1, "k") for i, row in enumerate(short.astype(np.float32))]
    got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in embeddings.near_embeddings(spark.createDataFrame(rows + few, SCHEMA)).collect()}
    assert {d: got[d] for d, *_ in few} == brute(few)
    assert all(got[1000 + i] == (299, 1000) for i in range(300)) and all(got[2000 + i] == (0, 2000 + i) for i in range(200))


def test_pivots_are_bounded_by_bytes(spark, monkeypatch):
    """Pivots that would take too many bytes are fewer; a length that may have too few gets none. Links stay."""
    r = np.random.default_rng(9)
    x = r.normal(size=(600, 32)).astype(np.float32)
    x[100:160] = x[7] + 0.1 * r.normal(size=(60, 32))
    rows = [(i, [float(v) for v in row], 1, "k") for i, row in enumerate(x)]
    monkeypatch.setattr(embeddings, "VECTORS_PER_PIVOT", 4)
    for most, pivots in ((20 * 8 * 32, 20), (15 * 8 * 32, None)):
        monkeypatch.setattr(embeddings, "PIVOT_BYTES", most)
        df = spark.createDataFrame(rows, SCHEMA)
        classes = df.selectExpr("transform(embedding, x -> double(x)) as v", "size(embedding) as dim", "binary(string(vec_id)) as key")
        got = embeddings.pivots_of(classes)
        assert set(got) == ({32} if pivots else set()) and all(0 < len(p) <= pivots for p in got.values())
        links = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in embeddings.near_embeddings(df).collect()}
        assert links == brute(rows)


def test_equally_near_pivots(spark):
    """Vectors along and between the axes: many pivots are equally near, and the same links are found again and again."""
    axes = [[float(k == i) for k in range(8)] for i in range(8)]
    rows = [(i, [a + 0.05 * (i % 3) * b for a, b in zip(axes[i % 8], axes[(i + 1) % 8], strict=True)], 1, "k") for i in range(96)]
    first, again = ({g["vec_id"]: (g["n_links"], g["component_id"]) for g in embeddings.near_embeddings(spark.createDataFrame(x, SCHEMA)).collect()} for x in (rows, rows[::-1]))
    assert first == again == brute(rows)


def test_shared_pivots_by_either_way(monkeypatch):
    r = np.random.default_rng(6)
    pa, pb = (np.array([r.permutation(40)[:10] for _ in range(50)], np.int32) for _ in range(2))
    i, j = (x.ravel() for x in np.indices((50, 50)))
    want = [k for k in range(2500) if len(s := {*pa[i[k]]} & {*pb[j[k]]}) >= 2 and min(s) == 7]
    assert want and embeddings.owned(pa, pb, i, j, 7, 2).tolist() == want
    monkeypatch.setattr(embeddings, "DIRECT", 10)
    assert embeddings.owned(pa, pb, i, j, 7, 2).tolist() == want
