"""The registered queries of the ``llm`` operators: ``fn(spark, sf_dir) -> DataFrame``.

Each applies its operator with production parameters to the whole table; ``ORACLE`` holds the
DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from chainframe.llm import oracles
from chainframe.llm.bpe import encode_documents
from chainframe.llm.exact_dedup import exact_groups
from chainframe.llm.fingerprint import edited_fingerprints
from chainframe.llm.importance import drawn
from chainframe.llm.line_dedup import line_decisions
from chainframe.llm.manifest import tampered_proofs
from chainframe.llm.ngram_join import linked_components
from chainframe.llm.outliers import judged
from chainframe.llm.packing import pack_documents
from chainframe.llm.ppm import score_documents
from chainframe.llm.quality import classify
from chainframe.llm.sharding import shard_documents
from chainframe.llm.text import documents
from chainframe.llm.token_files import token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@_query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


@_query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN, with_ids=False)


@_query("op3_ngram_jaccard")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(documents(spark, sf_dir), width=3, num=90, den=100)


@_query("op4_exact_dedup", oracles.EXACT_DEDUP)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


@_query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_decisions(documents(spark, sf_dir), tau=2, min_bytes=16)


@_query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                          public_tokenizers.PATTERN, capacity=2048, end_id=0)


@_query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=24)


@_query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.PATTERN, end_id=2)


@_query("op10_ppm_scoring")
def op10_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


@_query("op11_manifest", oracles.manifest())
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_proofs(documents(spark, sf_dir))


@_query("op12_importance", oracles.importance())
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = drawn(documents(spark, sf_dir), target, percent=25, min_words=20, buckets=10_000, seed=7)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@_query("op13_outliers")
def op13_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir), min_words=20, max_repeat_percent=30, tail=1e-4, share=0.75, min_cell=50)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
