"""Thin registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.chunk_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fingerprints

    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import wrappers

    return wrappers.main_text(_table(spark, sf_dir, "pages"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embeddings

    return embeddings.near_embeddings(_table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode_digests(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op11_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import maxent

    return maxent.score_documents(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import manifest

    return manifest.tamper_evidence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chunk_dedup": op1_chunk_dedup,
        "op2_sharding": op2_sharding,
        "op3_lz_fingerprint": op3_lz_fingerprint,
        "op4_html_wrappers": op4_html_wrappers,
        "op5_embedding_dedup": op5_embedding_dedup,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_packing": op7_packing,
        "op8_toxicity": op8_toxicity,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_maxent_lm": op11_maxent_lm,
        "op12_whitening": op12_whitening,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


# Links by brute force, classes by reachability.
_REACH = "r AS (SELECT id AS d, id AS m FROM ids UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.d), k AS (SELECT x, count(*) AS n FROM l GROUP BY x), c AS (SELECT d, min(m) AS m FROM r GROUP BY d)"

_JACCARD = rf"""WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents),
    w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE k >= 0.8 * (na.c + nb.c - k)), {_REACH}
    SELECT d AS doc_id, m AS class_id, coalesce(n, 0) AS n_links, m = d AS kept FROM c LEFT JOIN k ON k.x = c.d"""

_COSINE = f"""WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings),
    v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9), {_REACH}
    SELECT d AS vec_id, coalesce(n, 0) AS n_links, m AS component_id, m = d AS kept FROM c LEFT JOIN k ON k.x = c.d"""


def oracle_sql() -> dict[str, str]:
    """SQL for those whose rows it can express at this cost; the others are tested against brute force."""
    from . import manifest

    return {"op5_embedding_dedup": _COSINE, "op6_jaccard_join": _JACCARD, "op13_merkle_manifest": manifest.sql()}
