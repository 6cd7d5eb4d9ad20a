"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_preferences, swapped_answers
from .common import table
from .exact import exact_dedup
from .lm import lm_score
from .mixing import mix_sources
from .packing import pack_tokens
from .pii import surrogates
from .simhash import near_duplicates
from .sql import CHAT_SQL, EXACT_SQL, LM_SQL, MIX_SQL, NEAR_SQL, TOP_K_SQL
from .tokens import token_counts
from .topk import top_k
from .toxicity import toxicity


def op1_surrogates(spark: SparkSession, d: str) -> DataFrame:
    return surrogates(table(spark, d, "documents").select("doc_id", "text"))


def op2_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_tokens(table(spark, d, "documents"))


def op3_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, d, "labels")).drop("text")


def op5_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "documents"))


def op6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents"))


def op7_top_k(spark: SparkSession, d: str) -> DataFrame:
    return top_k(table(spark, d, "benchmark"), table(spark, d, "documents"))


def op8_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup(table(spark, d, "documents"))


def op9_lm_score(spark: SparkSession, d: str) -> DataFrame:
    return lm_score(table(spark, d, "documents")).withColumns({"log_prob": F.round("log_prob", 4), "bits_per_byte": F.round("bits_per_byte", 6)})


def op10_preferences(spark: SparkSession, d: str) -> DataFrame:
    """The table has one side only: the rejected side gets the next conversation's last answer."""
    chosen = table(spark, d, "conversations")
    return format_preferences(chosen, swapped_answers(chosen))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_pack": op2_pack,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_counts": op6_token_counts,
    "op7_top_k": op7_top_k,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_lm_score": op9_lm_score,
    "op10_preferences": op10_preferences,
}
ORACLE_SQL: dict[str, str] = {"op3_mix_sources": MIX_SQL, "op5_near_duplicates": NEAR_SQL, "op7_top_k": TOP_K_SQL, "op8_exact_dedup": EXACT_SQL, "op9_lm_score": LM_SQL, "op10_preferences": CHAT_SQL}
