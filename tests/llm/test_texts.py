"""Substring, Jaccard, fingerprint, toxicity and HTML operators against brute force and planted cases."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from candela.llm import fingerprints, jaccard, substrings, toxicity
from candela.llm.graph import components, paths

SCHEMA = "doc_id long, text string, lang string, key string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choices("abcdeéfgh", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = [words(r, r.choice([0, 1, 3, 8, 60, 200, 400])) for _ in range(120)]
    passage = words(r, 55)
    out = []
    for i, t in enumerate(base):
        if i % 7 == 0:
            t = t + "\n" + passage + " " + words(r, 5)
        if i % 11 == 0 and i:
            w = base[i - 1].split()
            t = " ".join(x if r.random() > 0.01 else "new" for x in w)
        if i % 13 == 0 and i:
            t = base[i - 2]
        out.append((i * 3, t, "en", "k", len(t)))
    long = base[60] + " " + words(r, 3000)
    out += [(1000, None, None, None, None), (1001, "", "en", "k", 0), (1002, long, "en", "k", 1), (1003, long, "en", "k", 1), (1003, long, "en", "k", 1)]
    out += [(2000 + i, "one two three four five six seven eight nine ten", "en", "k", 1) for i in range(30)]
    out += [(5000 + i, f"{passage} tail{i}", "en", "k", 1) for i in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(6).persist()


def brute_suffix(rows):
    seen = {}
    for d, t, *_ in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen.setdefault(b[p : p + 50], d)
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_is_exact(docs, rows, monkeypatch):
    want = brute_suffix(rows)
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(x) for x in substrings.suffix_dedup(docs).select(cols).collect()) == want


def test_suffix_dedup_in_many_blocks_with_hot_grams(rows):
    """The same work, block by block in this process, with tiny blocks, buckets and limits."""
    import pandas as pd

    old = substrings.HOT_BLOCKS, substrings.REFINE_BYTES, substrings.PIECE_BITS
    substrings.HOT_BLOCKS, substrings.REFINE_BYTES, substrings.PIECE_BITS = 3, 300, 10
    try:
        first = {}
        for i, (d, t, *_) in enumerate(rows):
            first.setdefault((t or ""), d)
            first[t or ""] = min(first[t or ""], d)
        blocks = pd.DataFrame([{"block": b, "ids": [rows[i][0] for i in own], "keys": own, "texts": [(rows[i][1] or "").encode() for i in own], "reps": [i for i in own if first[rows[i][1] or ""] == rows[i][0]]} for b in range(12) for own in [list(range(b, len(rows), 12))]])
        group = lambda f, col: {k: g for k, g in f.groupby(col)}
        grams = pd.concat(substrings.send_grams(5)(iter([blocks])))
        shared = pd.concat([substrings.answer_grams(g) for g in group(grams, "bucket").values()])
        assert any(len(x) for x in shared["hot"])
        told = group(shared, "block")
        blocks["shared"] = [list(told[b]["shared"]) if b in told else None for b in blocks["block"]]
        blocks["hot"] = [list(told[b]["hot"]) if b in told else None for b in blocks["block"]]
        sent = pd.concat(substrings.send_segments(5)(iter([blocks])))
        spans = pd.concat([substrings.answer_segments(g) for g in group(sent, "bucket").values()])
        told = group(spans, "block")
        blocks["spans"] = [list(told[b]["spans"]) if b in told else None for b in blocks["block"]]
        got = pd.concat(substrings.cut_strings(iter([blocks]))).drop(columns="kept")
        assert sorted(got.itertuples(index=False, name=None)) == brute_suffix(rows)
    finally:
        substrings.HOT_BLOCKS, substrings.REFINE_BYTES, substrings.PIECE_BITS = old


def test_without_repeats_keeps_columns(docs, rows):
    got = substrings.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1000]["text"] is None and by[1001]["text"] == "" and by[2001]["lang"] == "en"
    want = {d: n for d, _, n, _, _ in brute_suffix(rows)}
    for d, t, _, _, n in rows:
        if not want[d]:
            assert by[d]["text"] == t and by[d]["n_chars"] == n


def test_chunks(docs, rows):
    got = {r["doc_id"]: r for r in substrings.chunk_dedup(docs).collect()}
    assert all(got[5000 + i]["n_removed"] > 100 for i in range(30))  # a passage that earlier documents have
    assert all(got[2000 + i]["n_removed"] == (got[2000 + i]["n_bytes"] if i else 0) for i in range(30))
    exact = {d: n for d, _, n, _, _ in brute_suffix(rows)}
    assert all(r["n_removed"] == 0 for d, r in got.items() if exact[d] == 0 and r["n_bytes"] >= 50)
    r = random.Random(2)
    a = words(r, 400).encode()
    b = b"inserted " + a

    def cut(x):
        ends = substrings.chunk_ends(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])).tolist()
        return {x[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)}

    assert len(cut(a) & cut(b)) > 0.8 * len(cut(a))
    assert b"".join(sorted(cut(a), key=a.index)) == a


def plain_chunks(data):
    """Chunks by a loop over the bytes."""
    gear, h, hashes = [int(x) for x in substrings.GEAR], 0, []
    for i, c in enumerate(data):
        h = (2 * h + gear[c]) % (1 << 32)
        hashes.append(h if i >= substrings.GEAR_BYTES - 1 else 0)
    out, at, n = [], 0, substrings.REACH
    for i, h in enumerate(hashes):
        if i + 1 == len(data) or h > max(hashes[max(0, i - n) : i], default=0) and h >= max(hashes[i + 1 : i + 1 + n], default=0):
            while i + 1 - at > substrings.MOST_CHUNK:
                out.append(data[at : at + substrings.MOST_CHUNK])
                at += substrings.MOST_CHUNK
            out.append(data[at : i + 1])
            at = i + 1
    return out


def brute_chunks(rows):
    seen, texts = {}, {}
    for d, t, *_ in sorted(rows, key=lambda x: x[0]):
        texts.setdefault((t or "").encode(), d)
        for c in plain_chunks((t or "").encode()):
            seen.setdefault(c, d)
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        if b and texts[b] < d:
            out.append((d, len(b), len(b), 1, hashlib.sha256(b"").hexdigest()))
            continue
        runs, kept = [], b""
        for c in plain_chunks(b):
            again = seen[c] < d
            if not runs or runs[-1][0] != again:
                runs.append([again, b""])
            runs[-1][1] += c
        gone = [x for again, x in runs if again and len(x) >= 50]
        kept = b"".join(x for again, x in runs if not again or len(x) < 50)
        out.append((d, len(b), sum(map(len, gone)), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_chunk_dedup_against_a_plain_chunker(spark, docs, rows, monkeypatch):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = brute_chunks(rows)
    assert sum(x[2] > 0 for x in want) > 60
    assert sorted(tuple(x) for x in substrings.chunk_dedup(docs).select(cols).collect()) == want
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 4000)  # in many blocks
    assert sorted(tuple(x) for x in substrings.chunk_dedup(docs).select(cols).collect()) == want


def test_repeated_rows_are_spread_over_blocks(spark, monkeypatch):
    """A third of the rows are one row: they stand in many blocks and are all cut alike."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    r = random.Random(12)
    text = words(r, 60)
    rows = [(None, text, "en", "k", 1)] * 40 + [(3, text + " " + words(r, 20), "en", "k", 1)] * 40 + [(10 + i, words(r, 60), "en", "k", 1) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks, _ = substrings.blocks_of(df, "test")
    assert max(len(x["ids"]) for x in blocks.select("ids").collect()) < 15
    got = substrings.suffix_dedup(df).collect()
    assert {x["n_removed"] for x in got if x["doc_id"] is None} == {0} and {x["n_removed"] for x in got if x["doc_id"] == 3} == {len(text.encode())} and len(got) == len(rows)


def test_columns_that_clash(spark):
    rows = [(1, words(random.Random(1), 60), 1, "a", 2), (2, words(random.Random(1), 60), None, None, 3), (3, None, 4, "b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text_is_null int, `is null` string, __kept_id long").withColumnRenamed("is null", "c0")
    got = {r["doc_id"]: r for r in substrings.without_repeats(df).collect()}
    assert got[1].asDict() == df.filter("doc_id = 1").first().asDict() and got[2]["text"] == "" and got[3]["text"] is None and got[3]["c0"] == "b"
    kept = jaccard.without_near_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    more = df.withColumns({"key": df["doc_id"], "band": df["c0"], "block": df["c0"], "words": df["c0"], "t": df["c0"]})
    assert substrings.chunk_dedup(more).count() == substrings.suffix_dedup(more).count() == jaccard.jaccard_join(more).count() == 3


@pytest.mark.parametrize("op", [substrings.suffix_dedup, substrings.chunk_dedup, jaccard.jaccard_join, fingerprints.edited_fingerprints, substrings.without_repeats, jaccard.without_near_copies])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0


def test_jaccard_join_is_exact(docs, rows):
    sets, links, parent = [], defaultdict(int), list(range(len(rows)))
    for _, t, *_ in rows:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    group = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        group[find(i)].append(d)
    want = sorted((d, min(group[find(i)]), links[i], d == min(group[find(i)])) for i, (d, *_) in enumerate(rows))
    assert sorted(tuple(r) for r in jaccard.jaccard_join(docs).collect()) == want
    kept = jaccard.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(d for d, _, _, k in want if k)


def test_pruning_keeps_what_reaches_the_threshold():
    least = jaccard.least_matches(0.8)
    assert least[16] < 16 * 0.8 < 16 and all(a <= b for a, b in zip(list(least.values()), list(least.values())[1:], strict=False))
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 32, (2000, 128), dtype=np.uint32)
    near, far = a.copy(), a.copy()
    near[r.random(a.shape) > 0.8] = 0
    far[r.random(a.shape) > 0.3] = 0
    i = np.arange(2000)
    both = np.concatenate([a, near, far])
    assert len(jaccard.candidates(both, i, i + 2000, least)) == 2000
    assert len(jaccard.candidates(both, i, i + 4000, least)) == 0


def test_blocks_of_large_groups(spark):
    base = words(random.Random(1), 150)
    rows = [(i, base + f" end{i}", "en", "k", 1) for i in range(600)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 599)}


def test_rows_repeated_very_often(spark, monkeypatch):
    """A third of the rows are one text under one doc_id: they become one before their text is compared, and are kept or dropped together."""
    r = random.Random(31)
    base, other = words(r, 120), [words(r, 90) for _ in range(30)]
    rows = [(7, base, "en", "k", 1)] * 60 + [(8 + i, f"{base} end{i}", "en", "k", 1) for i in range(5)] + [(100 + i, t, "en", "k", 1) for i, t in enumerate(other)]
    rows += [(5, other[3] + " z", "en", "k", 1)] * 40 + [(None, base, "en", "k", 1)] * 30
    told = []
    monkeypatch.setattr(jaccard, "verified", lambda m, c, d, often, *x, real=jaccard.verified: (told.append(often.count()), real(m, c, d, often, *x))[1])
    df = spark.createDataFrame(rows, SCHEMA)
    got = jaccard.jaccard_join(df).collect()
    by = {x["doc_id"]: (x["class_id"], x["n_links"], x["kept"]) for x in got}
    assert told == [2] and len(got) == len(rows)
    assert by[7] == (7, 64, True) and all(by[8 + i] == (7, 64, False) for i in range(5))
    assert by[5] == (5, 40, True) and by[103] == (5, 40, False) and by[None] == (None, 0, True)
    kept = sorted(x["doc_id"] or 0 for x in jaccard.without_near_copies(df).collect())
    assert kept == sorted([7] * 60 + [5] * 40 + [0] * 30 + [100 + i for i in range(30) if i != 3])


@pytest.mark.parametrize("dense", [True, False])
def test_groups_cut_by_bytes(spark, monkeypatch, dense):
    """Few members with many n-grams are cut into chunks too: near copies of one text, and a chain of texts."""
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 8000)
    w = words(random.Random(9), 1500).split()
    texts = [" ".join(w[:300]) + f" end{i}" if dense else " ".join(w[i * 10 : i * 10 + 250]) for i in range(40)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    want = {i: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(40)) for i in range(40)}
    got = jaccard.jaccard_join(spark.createDataFrame([(i, t, "en", "k", 1) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {x["doc_id"]: x["n_links"] for x in got} == want and {x["class_id"] for x in got} == {0} and max(want.values()) == (39 if dense else 4)


def test_small_chunks_some_of_them_empty(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 1)
    base = [words(random.Random(20 + k), 120) for k in range(6)]
    rows = [(10 * k + i, f"{b} end{i}", "en", "k", 1) for k, b in enumerate(base) for i in range(6)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"] - r["doc_id"] % 10 == r["class_id"], r["n_links"]) for r in got} == {(True, 5)}


@pytest.mark.parametrize("chunk", [256, 4])
def test_chained_candidates(spark, monkeypatch, chunk):
    """A chain in which each text links with the few next to it: one class; with many chunks, only neighbours meet."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    w = words(random.Random(8), 2400).split()
    rows = [(i, " ".join(w[i * 6 : i * 6 + 150]), "en", "k", 1) for i in range(370)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t, *_ in rows]
    want = {i: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(370)) for i in range(370)}
    met = []
    monkeypatch.setattr(jaccard, "verified", lambda members, *x, real=jaccard.verified: (met.append(members.count()), real(members, *x))[1])
    got = jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and {r["class_id"] for r in got} == {0} and 1 < want[100] < 8
    assert met[0] == 740 if chunk == 256 else met[0] < 370 * 40


def test_one_doc_id_for_many_texts(spark):
    """A third of the rows share a doc_id and differ in their texts."""
    r = random.Random(13)
    texts = [words(r, 40) for _ in range(40)]
    rows = [(5, t, "en", "k", 1) for t in texts] + [(5, t + " end", "en", "k", 1) for t in texts[:10]] + [(10 + i, words(r, 40), "en", "k", 1) for i in range(60)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and sorted(x["n_links"] for x in got if x["doc_id"] == 5) == [0] * 30 + [1] * 20


def test_paths():
    r = random.Random(4)
    for _ in range(100):
        n = r.randint(1, 12)
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 12))]
        group = [r.randrange(2) for _ in range(n)]
        u, v = paths(n, [a for a, _ in pairs], [b for _, b in pairs], group)

        def classes(edges, n=n):
            at = list(range(n))
            for _ in range(n):
                for a, b in edges:
                    at[a] = at[b] = min(at[a], at[b])
            return at

        assert classes(pairs) == classes(list(zip(u, v, strict=True))) and len(u) == n - len(set(classes(pairs)))
        assert all((u + v).count(k) <= 2 for k in range(n))


def test_chunks_of_groups_meet_where_they_have_candidates():
    """Members come to those two chunks of their group in which they have a candidate pair."""
    import pandas as pd

    f = pd.DataFrame({"key": [b"a", b"b", b"c", b"d"], "component": [b"x"] * 4, "part": [1, 0, 1, 2]})
    got = jaccard.meeting(f, np.arange(4), np.array([0, 0, 2]), np.array([1, 2, 3]))
    assert sorted(got.itertuples(index=False, name=None)) == [(b"x", 0, 1, 0, b"b"), (b"x", 0, 1, 1, b"a"), (b"x", 1, 1, 1, b"a"), (b"x", 1, 1, 1, b"c"), (b"x", 1, 2, 1, b"c"), (b"x", 1, 2, 2, b"d")]
    assert not len(jaccard.meeting(f, *[np.zeros(0, np.int64)] * 3))


@pytest.mark.parametrize("few", [2, 0])
def test_shared_grams_by_either_way(few):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50))).astype(np.uint64) for _ in range(20)]
    i, j = np.triu_indices(20, 1)
    i, j = (i[:30], j[:30]) if few else (i, j)
    assert jaccard.shared(sets, i, j).tolist() == [len({*sets[a]} & {*sets[b]}) for a, b in zip(i, j, strict=True)]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 200)] + [(r.randint(1000, 1040), r.randint(1000, 1040)) for _ in range(30)] + [(9, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def phrases(text):
    """LZ78, by the book: the longest known phrase plus one character becomes known; what is left at the end is no phrase."""
    known, at = {""}, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in known:
            end += 1
        if end > len(text):
            break
        known.add(text[at:end])
        at = end
    return known - {""}


def hash_of(phrase):
    """The polynomial hash of common.PrefixHash on whole numbers."""
    m = 1 << 64
    h = (sum((ord(c) + 1) * pow(0x2545F4914F6CDD1D, i, m) for i, c in enumerate(phrase)) + len(phrase) * 0x9E3779B97F4A7C15) % m
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % m
    h = (h ^ h >> 27) * 0x94D049BB133111EB % m
    return (h ^ h >> 31) >> 32


def plain_fingerprint(text):
    return sorted({hash_of(p) for p in phrases(text)})[:128]


def plain_likeness(a, b):
    both = sorted({*a, *b})[:128]
    return 1.0 if not both else len({*a} & {*b} & {*both}) / len(both)


def by_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode())))


def plain_fingerprints(rows):
    out, order = [], by_order(rows)
    for (d, t, *_), (_, nxt, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        a, e, n = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(nxt)
        code = lambda s: base64.b64encode(np.array(s, "<u4").tobytes()).decode()
        out.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), code(a), code(e), round(plain_likeness(a, e), 9), round(plain_likeness(a, n), 9)))
    return sorted(out)


@pytest.mark.parametrize("bucket", [4 << 20, 3000])
def test_fingerprints_against_a_plain_parse(spark, docs, rows, bucket, monkeypatch):
    """In one bucket and in many; a third of the rows have no id, or are equal, and are spread over buckets."""
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", bucket)
    r = random.Random(9)
    more = rows + [(None, words(r, 30), "en", "k", 1) for _ in range(60)] + [(77, "the same text again and again, all of it", "en", "k", 1)] * 60
    df = spark.createDataFrame(more, "doc_id long, text string, bucket string, t string, k0 long")
    got = fingerprints.edited_fingerprints(df).collect()
    assert sorted((str(x[0]), *x[1:5], round(x[5], 9), round(x[6], 9)) for x in got) == plain_fingerprints(more)
    if bucket == 3000:
        sizes = {x["bucket"]: x["count"] for x in fingerprints.in_order(df).groupBy("bucket").count().collect()}
        assert len(sizes) > 20 and max(sizes.values()) < len(more) // 5


def test_rows_whose_order_changes_between_reads(spark, docs, monkeypatch):
    """No row is lost without an error."""
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 2000)

    def shuffled(frames):
        for f in frames:
            yield f.sample(frac=1)

    moving = docs.select("doc_id", "text").repartition(2).mapInPandas(shuffled, "doc_id double, text string")
    with pytest.raises(Exception, match="a row has no next one"):
        fingerprints.edited_fingerprints(moving).collect()


def test_likeness_estimates_the_jaccard_likeness(rows):
    texts = [t for _, t, *_ in rows if t and len(t) > 1000][:12]
    for a in texts:
        for b in (texts[0], a[: len(a) // 2] + texts[1]):
            x, y = phrases(a), phrases(b)
            got = fingerprints.likeness(*(fingerprints.read_fingerprint(fingerprints.fingerprint(t)) for t in (a, b)))
            assert abs(got - len(x & y) / len(x | y)) < 0.17
    long = words(random.Random(1), 200_000)  # whole, however long
    ends = fingerprints.Parse().feed(long).ends
    assert len(ends) == len({long[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)}) > 100_000


def test_toxicity_is_learnt(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        w = words(r, r.choice([5, 30, 80])).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["zqxidi" + "".join(r.choices("abc", k=3)), "idiot"]))
        docs.append((i, " ".join(w), "en", "k", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(None, None, None, None, None), (9000, "", "en", "k", 0), (1, docs[1][1], "en", "k", 1)]
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels + [(3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    held = [x for x in got if x["held_out"]]
    assert all(zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 for x in held)
    assert sum(x["predicted"] == (x["doc_id"] % 6 == 0) for x in held if x["doc_id"] < 900) >= 0.97 * sum(x["doc_id"] < 900 for x in held)
    kept = toxicity.without_toxic(d, lab)
    assert kept.columns == d.columns and kept.filter("doc_id = 9000 or doc_id is null").count() == 2
    none = toxicity.score_documents(d.limit(5), lab.limit(0)).collect()
    assert len(none) == 5
    assert toxicity.score_documents(d.limit(0), lab).count() == 0


def test_label_model_discounts_copies():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    votes = [np.where(r.random(4000) < 0.85, y, ~y) for _ in range(3)]
    copy = np.where(r.random(4000) < 0.7, y, ~y)
    v = np.stack([*votes, *[np.where(r.random(4000) < 0.99, copy, ~copy) for _ in range(5)]], 1)
    gold = np.where(r.random(4000) < 0.75, y, ~y)
    m = toxicity.label_model(v, gold.astype(float))
    right = ((m.posterior(v) > 0.5) == y).mean()
    naive = (v.mean(0) * 0 + 1) @ v.T > 4
    assert right > 0.92 > (naive == y).mean() + 0.05 and right > (gold == y).mean() + 0.1
    assert (m.omega[3:, 3:][~np.eye(5, dtype=bool)] > 0).mean() > 0.9  # correlations are seen
    assert m.theta[3:].mean() < 0.5 * m.theta[:3].mean()  # and the copies count less


def noisy_rows(n=3000):
    r = random.Random(6)
    marks = [words(r, 1) + "zq" + words(r, 1) for _ in range(40)]
    texts, true, gold = [], [], []
    for i in range(n):
        w = words(r, r.choice([10, 40])).split()
        toxic = i % 6 == 0
        for _ in range(4 * toxic):
            w.insert(r.randint(0, len(w)), r.choice([*marks, *marks, "idiot", "scum"]))
        texts.append(" ".join(w))
        true.append(toxic)
        gold.append(toxic != (r.random() < 0.2))
    return texts, np.array(true), np.array(gold, float)


def test_label_model_carries_the_result(monkeypatch):
    """Learnt from labels of which a fifth are wrong: with the label model against the labels themselves."""
    texts, true, gold = noisy_rows()
    half = len(texts) // 2
    test, want = texts[half:], true[half:]
    right = lambda m: ((m.scores(test) >= 0.5) == want).mean()
    with_model = right(toxicity.fit(texts[:half], gold[:half]))

    class Labels:
        posterior = lambda self, votes: np.clip(gold[:half], 0.02, 0.98)

    monkeypatch.setattr(toxicity, "label_model", lambda votes, gold: Labels())
    without = right(toxicity.fit(texts[:half], gold[:half]))
    assert with_model > 0.97 and with_model > without + 0.1


def test_scores_are_sums_of_weights():
    """Scoring by a plain loop over distinct words and beginnings."""
    texts, _, gold = noisy_rows(600)
    m = toxicity.fit(texts, gold)
    weight = dict(zip(m.hashes.tolist(), m.weights, strict=True))
    for t in [*texts[:40], "", "IDIOT!!!!! " * 3, "x" * 10]:
        found = set()
        for w in t.lower().split():
            w = "".join(c for c in w if c.isalpha())
            if w:
                found |= {toxicity.Words.word(w)} | {int(toxicity.Words.word(w[:k])) & ~1 for k in toxicity.BEGINNINGS if len(w) > k}
        z = m.bias + float(toxicity.pattern_votes([t])[0] @ m.patterns) + sum(weight.get(h, 0.0) for h in found)
        assert abs(m.scores([t])[0] - 1 / (1 + np.exp(-z))) < 1e-9
    assert set(toxicity.document_features("ab cd " * 10).tolist()) == set(toxicity.document_features("cd ab").tolist())


def test_repeated_documents_are_learnt_from_once(spark):
    docs = [(1, "one text", "en", "k", 1)] * 200 + [(1, f"text {i}", "en", "k", 1) for i in range(200)] + [(i, f"text {i}", "en", "k", 1) for i in range(2, 40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    got = [r["doc_id"] for r in toxicity.learning_rows(spark.createDataFrame(docs, SCHEMA), labels, 30).collect()]
    want = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % toxicity.FOLDS]
    assert 1 in want and len(got) == len(set(got)) == min(30, len(want)) and set(got) <= set(want)
    all_rows = [r["doc_id"] for r in toxicity.learning_rows(spark.createDataFrame(docs, SCHEMA), labels).collect()]
    assert sorted(all_rows) == want
