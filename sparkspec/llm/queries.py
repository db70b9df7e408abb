"""Queries of the training-data operators for the driver contract: ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import oracles, tokenbin
from .bpe import encode
from .codes import compress
from .divergence import audit
from .embed import near_duplicate_vectors
from .langid import held_out, identify, learn
from .licenses import scan
from .lines import dedup_lines
from .minhash import near_duplicates
from .mixing import draw
from .quality import classify
from .topk import top_k
from .urls import judge_urls
from .work import Work, table


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = identify(docs.select("doc_id", "text"), learn(docs))
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 6))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text_kept", 256).alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "documents"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Work(spark).path("tokens")
    tokenbin.write(table(spark, sf_dir, "documents"), at, public_tokenizers.path("word_bpe_49k.json"))
    return tokenbin.read(spark, at, ids=False)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_minhash_near_dedup, op3_language_id, op4_license_scan, op5_quality, op6_embedding_near_dedup, op7_line_dedup, op8_bpe, op9_mixing, op10_token_binary, op11_vector_codes, op12_source_divergence, op13_url_filters)}

ORACLE_SQL = {"op1_topk_search": oracles.OP1, "op4_license_scan": oracles.OP4, "op6_embedding_near_dedup": oracles.OP6, "op2_minhash_near_dedup": oracles.OP2, "op7_line_dedup": oracles.OP7, "op9_mixing": oracles.OP9, "op11_vector_codes": oracles.OP11, "op12_source_divergence": oracles.OP12, "op13_url_filters": oracles.OP13}
