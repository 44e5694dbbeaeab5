"""The opN_ queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import scratch_dir
from .op1_suffix import SUFFIX_SQL, suffix_dedup
from .op2_url import url_sql, url_verdicts
from .op3_token_counts import token_counts
from .op4_decontaminate import leaks
from .op5_mix import MIX_SQL, mix
from .op6_language import identify
from .op7_exact import exact_groups
from .op8_token_files import read_tokens, write_tokens
from .op9_secrets import scan
from .op10_simhash import near_groups


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("removed")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache of its own, so that every distinct text is encoded in this run."""
    cache = f"{scratch_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_url_filter, op3_token_counts, op4_decontaminate, op5_mix, op6_language, op7_exact_dedup, op8_token_files, op9_secrets, op10_simhash)
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": SUFFIX_SQL,
    "op2_url_filter": url_sql(),
    "op5_mix": MIX_SQL,
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id)
""",
}
