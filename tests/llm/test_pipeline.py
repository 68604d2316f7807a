"""The pipeline, stage by stage, against plain versions of its stages."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(r):
    text = lambda n: " ".join("".join(r.choices("abcdeéfgh", k=r.randint(2, 7))) for _ in range(n))
    docs = [(i, text(r.choice([5, 80, 300]))) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " changed") for i in range(20)] + [(130 + i, docs[7][1]) for i in range(9)]
    passage = text(60)
    docs += [(200 + i, f"{text(60)} {passage} {text(60)}") for i in range(5)]
    docs += [(300 + i, text(30) + " idiot moron scum") for i in range(10)]
    docs += [(400, None), (401, ""), (402, ""), (403, "one"), (404, text(3000))]
    r.shuffle(docs)
    return [(d, t, "en", "s", len(t or "")) for d, t in docs]


def kept_of_near_copies(docs):
    """doc_ids of all texts less those that links connect with a smaller one."""
    grams = {}
    for d, t, *_ in docs:
        w = (t or "").split()
        grams[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in grams}
    changed = True
    near = [(a, b) for a in grams for b in grams if a < b and grams[a] and grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    while changed:
        changed = False
        for a, b in near:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {d for d in grams if least[d] == d}


def without_repeats(docs):
    first = {}
    for d, t, *_ in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], d)
    out = {}
    for d, t, *_ in docs:
        b = (t or "").encode()
        gone = set()
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < d:
                gone |= set(range(p, p + 50))
        out[d] = t if not gone else bytes(c for i, c in enumerate(b) if i not in gone).decode(errors="ignore")
    return out


def sequences(lengths, window=1024):
    """How many windows best-fit decreasing opens."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, x in enumerate(room) if x >= n]
        if fits:
            best = min(fits, key=lambda k: room[k])
            room[best] -= n
        else:
            room.append(window - n)
    return len(room)


def test_pipeline_against_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = corpus(random.Random(7))
    spark.createDataFrame(docs, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(300 <= d < 400)) for d, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "packing"]
    now = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, now, f"file://{tmp_path}")
        assert k == 3 or made.columns == now.columns and made.dtypes == now.dtypes
        made.write.parquet(f"file://{tmp_path}/{k}")
        now = spark.read.parquet(f"file://{tmp_path}/{k}")
        out.append(now.collect())
    kept = [tuple(r) for r in out[0]]
    assert sorted(d for d, *_ in kept) == sorted(d for d, *_ in docs if not 300 <= d < 400) and set(kept) <= set(docs)
    want = kept_of_near_copies(kept)
    assert {r["doc_id"] for r in out[1]} == want and {tuple(r) for r in out[1]} <= set(docs)
    texts = without_repeats([tuple(r) for r in out[1]])
    assert {r["doc_id"]: r["text"] for r in out[2]} == texts and all(r["n_chars"] == len(r["text"] or "") for r in out[2])
    pieces = defaultdict(list)
    for r in out[3]:
        pieces[r["doc_id"]].append(r)
    tokenizer, room = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    assert set(pieces) == set(texts)
    for d, mine in pieces.items():
        ids = np.array([*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
            room[r["sequence_id"]] += r["length"]
        assert at == len(ids)
    assert sorted(room) == list(range(len(room))) and max(room.values()) <= 1024 and len(room) == sequences([r["length"] for r in out[3]])
    again = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    digest = lambda rows: hashlib.sha256(str(sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows)).encode()).hexdigest()
    assert digest(again) == digest(out[3])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
