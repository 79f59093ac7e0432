"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

1. language: documents without an identifiable main language go;
2. near_duplicates: of each group of near copies the one with the least id stays;
3. decontamination: documents with a benchmark item in them go;
4. secrets: found secrets are replaced by a mark (``n_chars`` follows), so no document goes;
5. packing: what is left is packed into sequences; the result has a row per piece.

Every stage takes (spark, docs, sf_dir), sees all rows that the stage before it
kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import op01_secrets, op02_jaccard_join, op06_language, op09_packing, op10_decontamination
from tallyspark.llm.common import prepare, stage, table

#: Near copies have at least so many hundredths of their shingles of so many words in common (op2's query: 3 and 90).
NEAR_SHINGLE, NEAR_SHARE = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op06_language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op02_jaccard_join.keep_one(docs, shingle=NEAR_SHINGLE, share=NEAR_SHARE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = op01_secrets.scan(docs, ["doc_id"], rules=op01_secrets.WHOLE_RULES, with_text=True)
    rows = rows.withColumn("clean_text_", op01_secrets.redact(F.col("text"), F.col("spans")))
    n = F.when(F.size("spans") > 0, F.char_length("clean_text_").cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col("clean_text_"), "n_chars": n}
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op09_packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", packing)]

#: SQL can't express expectation-maximisation or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
