"""Registered queries of the operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import (
    op01_secrets,
    op02_jaccard_join,
    op03_quality,
    op04_token_counts,
    op05_fingerprints,
    op06_language,
    op07_licenses,
    op08_chat,
    op09_packing,
    op10_decontamination,
    op11_merkle,
    op12_substring_dedup,
    op13_prefix_trie,
)
from tallyspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_secrets": lambda s, d: op01_secrets.secret_digest(docs(s, d)),
        "op2_jaccard_join": lambda s, d: op02_jaccard_join.join_components(docs(s, d)),
        "op3_quality": lambda s, d: op03_quality.quality(docs(s, d), table(s, d, "labels")),
        "op4_token_counts": lambda s, d: op04_token_counts.token_counts(docs(s, d)),
        "op5_fingerprints": lambda s, d: op05_fingerprints.fingerprints(docs(s, d)),
        "op6_language": lambda s, d: op06_language.identify(docs(s, d)),
        "op7_licenses": lambda s, d: op07_licenses.licenses(docs(s, d)),
        "op8_chat": lambda s, d: op08_chat.chat_digests(table(s, d, "conversations")),
        "op9_packing": lambda s, d: op09_packing.pack(docs(s, d)),
        "op10_decontamination": lambda s, d: op10_decontamination.leaks(docs(s, d), table(s, d, "benchmark")),
        "op11_merkle": lambda s, d: op11_merkle.manifest(docs(s, d)),
        "op12_substring_dedup": lambda s, d: op12_substring_dedup.kept_texts(docs(s, d)),
        "op13_prefix_trie": lambda s, d: op13_prefix_trie.trie(table(s, d, "conversations")),
    }
