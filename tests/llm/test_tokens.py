"""BPE against the public libraries, packing against a plain best-fit decreasing, sharding's law."""

import base64
import bisect
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from candela.llm import bpe, common, packing, queries, sharding  # noqa: E402

TIK, HF = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", "\n\n a", "a  \n", "it's 'tis 's's 'll'reab 'r ''s a''s \t\x1c\x85 　x", "don't  we'd\n'vex 123abc!!'s '", "aaaa" * 50, " " * 70 + "b", "日本語 𝒳𝒴 ½²³ é́ ", "%%%***'t x", "\r\n\r\n", "'", "'l", "﻿a​b"]
DOCS = "doc_id long, text string, lang string, t string"


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TIK, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(HF)


def test_odd_texts(encoding, tokenizer):
    assert [list(x) for x in bpe.load(TIK).encode(ODD)] == [encoding.encode_ordinary(t) for t in ODD]
    more = [*ODD, "a <|endoftext|> b", "<|endoftext|><|endoftext|>'s"]
    assert [list(x) for x in bpe.load(HF).encode(more)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in more]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'stmdrelv,.!0aé"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_any_texts(encoding, tokenizer, texts):
    got = bpe.load(TIK).encode(texts)
    assert [list(x) for x in got] == [encoding.encode_ordinary(t) for t in texts]
    assert [bpe.load(TIK).decode(x).decode() for x in got] == texts
    if not any("<|" in t for t in texts):
        assert [list(x) for x in bpe.load(HF).encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_cache_and_offsets(encoding):
    b = bpe.ByteBPE.from_tiktoken(TIK)
    b.POOL = 50
    b._clear()
    texts = ["".join(random.Random(i).choices("abc dé'\n", k=300)) for i in range(20)]
    for _ in range(2):
        assert [list(x) for x in b.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]
    ids = b.encode(texts[:1])[0]
    cut = b.offsets(ids)
    assert all(texts[0].encode()[cut[i] : cut[i + 1]] == b.decode(ids[i : i + 1]) for i in range(len(ids)))


def test_a_clash_of_hashes_is_repaired(encoding, monkeypatch):
    b = bpe.ByteBPE.from_tiktoken(TIK)
    monkeypatch.setattr(bpe.PrefixHash, "slices", lambda self, s, e: (e - s).astype(np.uint64))
    texts = ["abc dog", "cat xyz"]
    assert [list(x) for x in b.encode(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_digests_and_general_form(spark, encoding):
    rows = [(1, "Hello world, it's", "x", "y"), (2, None, None, None), (2, None, None, None), (None, "é" * 3000, "x", "y")]
    df = spark.createDataFrame(rows, DOCS)
    got = bpe.encode_digests(df, TIK).collect()
    want = [(d, len(e := encoding.encode_ordinary(t or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(df, TIK).filter("doc_id = 1").first()["decoded"] == "Hello world, it's"
    assert bpe.encode_digests(df.limit(0), TIK).count() == 0


def test_large_ids_beside_null_ids(spark):
    from candela.llm import fingerprints, jaccard, substrings, toxicity

    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a b c d e f g", "x", "y"), (None, "h", "x", "y")], DOCS).coalesce(1)
    labels = spark.createDataFrame([(big, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (bpe.encode_digests(df, TIK), packing.pack(df, HF), fingerprints.edited_fingerprints(df), jaccard.jaccard_join(df), substrings.suffix_dedup(df), substrings.chunk_dedup(df), substrings.without_repeats(df), toxicity.score_documents(df, labels)):
        assert {r["doc_id"] for r in out.collect()} == {big, None}


def test_plan_is_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(20):
        sizes = [r.choice([r.randint(1, 1024), r.randint(1, 60), 512, 341]) for _ in range(300)]
        counts = {s: sizes.count(s) for s in sizes}
        bins = {}
        for length, a, b, first, each, offset in packing.plan(counts):
            for k in range(a, b):
                bins.setdefault(first + (k - a) // each, []).append((offset + (k - a) % each * length, length))
        assert set(bins) == set(range(len(bins))) and sum(map(len, bins.values())) == len(sizes)
        room = []
        for s in sorted(sizes, reverse=True):
            i = bisect.bisect_left(room, s)
            bisect.insort(room, (room.pop(i) if i < len(room) else 1024) - s)
        for parts in bins.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
        assert sorted(1024 - sum(n for _, n in p) for p in bins.values()) == room


def test_pack(spark, tokenizer):
    rows = [(i, " ".join(random.Random(i).choices("alpha beta gamma it's".split(), k=k)), "x", "y") for i, k in enumerate([0, 1, 1023, 1024, 5000, 300, 300])] + [(50, None, "x", "y"), (5, "same id", "x", "y")]
    got = packing.pack(spark.createDataFrame(rows, DOCS), HF).collect()
    ids = {}
    for d, t, _, _ in rows:
        ids.setdefault(d, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(spark.createDataFrame([], DOCS), HF).count() == 0


def test_equal_rows_are_packed_in_small_groups(spark, monkeypatch):
    """Half the rows equal, columns of clashing names, pieces that tie in doc_id, start and digest: no group is more than twice its size, all places are filled once."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    monkeypatch.setattr(packing, "SALTS_TOGETHER", 3)
    rows = [(None, None, "len", 1, 2, 3)] * 900 + [(7, "alpha", "len", 1, 2, 3)] * 500 + [(i, "beta " * (i % 40), "len", 1, 2, 3) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string, salt int, deal int, rank int")
    cut = common.stored(packing.pieces(df, HF).withColumn("deal", F.monotonically_increasing_id()), "cut")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    assert counts[1] >= 900
    for n, total in counts.items():
        salts = common.n_blocks(total, 50)
        sizes = [r["count"] for r in cut.filter(F.col("length") == n).groupBy(F.pmod(F.xxhash64("deal"), F.lit(salts))).count().collect()]
        assert max(sizes) <= 100
    got = packing.pack(df, HF).collect()
    assert len(got) == 2000
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == set(range(len(by)))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024


def test_shards(spark):
    r = random.Random(1)
    rows = [(i, "x" * r.randint(0, 400) + "é", "l", "s") for i in range(3000)] + [(None, None, None, None)] * 40 + [(7, "same", "l", "s")] * 3
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() < 0.01 * size.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (got.groupby(["virtual_slot", "part"])["shard"].nunique() == 1).all()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    assert sorted(zip(got["size"], got["text_crc32"], strict=True)) == want
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def fold(was, size, n_shards, slack=sharding.SLACK):
    """Slots, largest first, stay where there is room, or go to the shard with the fewest bytes."""
    room = -(-sum(size.values()) * (1 + slack) // n_shards)
    load, to = [0] * n_shards, {}
    for slot in sorted(was, key=lambda s: (-size.get(s, 0), s)):
        n = size.get(slot, 0)
        if n == 0:
            to[slot] = was[slot] if was[slot] < n_shards else slot[0] % n_shards
            continue
        to[slot] = was[slot] if was[slot] < n_shards and load[was[slot]] + n <= room else load.index(min(load))
        load[to[slot]] += n
    return to


def as_map(df):
    return {(r["virtual_slot"], r["part"]): r["shard"] for r in df.collect()}


def test_shards_by_an_independent_fold(spark, tmp_path):
    """Eight, nine and then four shards on one stored map; rows, sizes and places are checked each time."""
    r = random.Random(2)
    rows = [(i, "y" * r.randint(0, 900), "l", "s") for i in range(1500)]
    df, path = spark.createDataFrame(rows, DOCS), f"file://{tmp_path}/map"
    was = {(s, 0): s % 8 for s in range(256)}
    for version, n in ((2, 8), (3, 9), (4, 4)):
        got = sharding.shard_documents(df, n, 256, path).toPandas()
        sums = got.groupby(["virtual_slot", "part"])["size"].sum().to_dict()
        begin = {(s, p): was.get((s, p), was[s, 0]) for s in range(256) for p in range(1 + max((b for a, b in sums if a == s), default=0))}
        want = fold(begin, sums, n)
        assert as_map(sharding.read_map(spark, path)) == want and set(got["map_version"]) == {version}
        assert all(want[v, p] == s for v, p, s in zip(got["virtual_slot"], got["part"], got["shard"], strict=True)) and set(want.values()) == set(range(n))
        for _, g in got.groupby("shard"):
            assert sorted(g["slot"]) == list(range(len(g)))
        size = got.groupby("shard")["size"].sum()
        assert size.max() - size.min() < 0.02 * size.mean()
        assert sum(want[s] != was[s] for s in was if s in want) < 256 * (0.3 if n > 4 else 0.7)
        was = want
    assert all(sharding.read_map(spark, path, v).filter("part = 0").count() == 256 for v in (1, 2, 4))
    with pytest.raises(ValueError, match="slots"):
        sharding.shard_documents(df, 4, 128, path)


def test_groups_of_equal_rows_are_split(spark):
    rows = [(None, "z" * 50, "l", "s")] * 2000 + [(5, None, None, None)] * 900 + [(i, "x" * (i % 97), "l", "s") for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).toPandas()
    assert len(got) == len(rows) and got.groupby(["virtual_slot", "part"]).size().max() < 20
    # The slot is a hash of the key, whatever else the table holds; a group of equal rows is one slot of many parts.
    alone = sharding.shard_documents(spark.createDataFrame(rows[1999:2001] + rows[-1:], DOCS)).toPandas()
    both = got.merge(alone, on=["doc_id", "text_crc32"])
    assert len(both) >= 2901 and (both["virtual_slot_x"] == both["virtual_slot_y"]).all()
    assert got[got["doc_id"].isna()]["virtual_slot"].nunique() == 1 and got[["virtual_slot", "part"]].drop_duplicates().shape[0] <= 2 * sharding.SLOTS
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() < 0.01 * size.mean()
    assert (got["doc_id"].isna().sum(), (got["doc_id"] == 5).sum()) == (2000, 901)


def test_rebalancing_moves_little(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    sharding.write_map(sharding.first_map(4, spark, 64), path)
    even = spark.range(64).selectExpr("cast(id as int) virtual_slot", "0 part", "1L slot_rows", "100L slot_bytes")
    second = sharding.rebalance(sharding.read_map(spark, path), even, 4)
    sharding.write_map(second, path)
    moved = sharding.read_map(spark, path).alias("b").join(sharding.read_map(spark, path, 1).alias("a"), "virtual_slot").filter("a.shard <> b.shard").count()
    assert moved == 0 and sharding.read_map(spark, path).first()["version"] == 2
    heavy = even.selectExpr("virtual_slot", "part", "slot_rows", "if(virtual_slot % 4 = 0, 300L, 100L) slot_bytes")
    assert {r["shard"] for r in sharding.rebalance(sharding.read_map(spark, path), even.filter("virtual_slot < 10"), 3).collect()} == {0, 1, 2}
    third = sharding.rebalance(sharding.read_map(spark, path), heavy, 4).join(heavy, "virtual_slot").groupBy("shard").sum("slot_bytes").collect()
    assert max(r[1] for r in third) - min(r[1] for r in third) <= 300


def test_maps_without_parts_are_read(spark, tmp_path):
    """A stored map of the time before parts is edited like any other."""
    path = f"file://{tmp_path}/map"
    sharding.write_map(sharding.first_map(8, spark, 64).drop("part"), path)
    rows = [(1, "y" * 9, "l", "s")] * 900 + [(i, "y" * (i % 50), "l", "s") for i in range(900)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 8, 64, path).toPandas()
    assert set(got["map_version"]) == {2} and len(got) == 1800 and sharding.read_map(spark, path, 1).filter("part = 0").count() == 64
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() < 0.2 * size.mean()


def test_main_path_of_sharding_is_native(spark):
    plan = sharding.shard_documents(spark.createDataFrame([(1, "a", "b", "c")], DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert queries.queries()["op2_sharding"]


def test_large_vocabularies_are_refused():
    with pytest.raises(ValueError, match="65,536"):
        bpe.PairTable(np.array([70_000]), np.array([1]), np.array([0]), np.array([2]))
