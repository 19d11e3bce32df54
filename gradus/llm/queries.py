"""The registered queries over these operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradus.llm import exact, language_model, licenses, manifest, mixing, packing, secret_scan, simhash, token_counts, token_files, toxicity, trie, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, table)``; ``table(name)`` opens a table of the folder."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, lambda t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet"))
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


@query("op1_simhash_near_dedup")
def _simhash(spark, table):
    return simhash.near_duplicates(table("documents"))


@query("op4_exact_dedup", """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)""")
def _exact(spark, table):
    return exact.exact_duplicates(table("documents"))


@query("op6_mixing_to_target_weights")
def _mixing(spark, table):
    return mixing.mix(table("documents")).rows.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_embedding_near_dedup")
def _vectors(spark, table):
    return vectors.near_vectors(table("embeddings"))


@query("op7_license_scan", licenses.license_sql())
def _licenses(spark, table):
    return licenses.license_scan(table("documents"))


@query("op8_secret_scan")
def _secrets(spark, table):
    return secret_scan.secret_scan(table("documents")).drop("secrets")


@query("op3_toxicity")
def _toxicity(spark, table):
    return toxicity.toxicity(table("documents"), table("labels"))


@query("op5_token_id_files")
def _token_files(spark, table):
    return token_files.encode_and_read(table("documents"), public_tokenizers.path("word_bpe_49k.json"), 2).drop("ids")


@query("op10_best_fit_packing")
def _packing(spark, table):
    return packing.pack(table("documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_language_model_scores")
def _scores(spark, table):
    return language_model.score_documents(table("documents"))


@query("op11_merkle_manifest", manifest.manifest_sql())
def _manifest(spark, table):
    return manifest.documents_manifest(table("documents"))


@query("op12_conversation_trie", trie.TRIE_SQL)
def _trie(spark, table):
    return trie.conversation_trie(table("conversations"))


@query("op13_token_counts")
def _token_counts(spark, table):
    return token_counts.count_tokens(table("documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
