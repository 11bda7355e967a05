"""A pipeline over ``documents``: language ID, exact dedup, near-duplicate join, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``.

Nulls and edges: rows without a text, or with no letter in it, are in no language and go; of equal texts the row
with the largest doc_id stays, of near copies the document with the smallest, so there are no ties but between
rows of one doc_id, of which the exact stage keeps one text each; null doc_ids stay and are packed; texts are
worked on whole, however long; other columns pass through under any name; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import exact_dedup, jaccard, langid, packing, pii
from concord.llm.common import fresh, quoted, written

#: Documents whose best language is less likely than this are rejected, as are those without a letter.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no recognisable language and sets ``lang`` to the predicted one."""
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score")
    found = langid.identify(docs, langid.train(docs), (lang, score))
    kept = found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(lang)).select(quoted(docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the last of equal texts."""
    return exact_dedup.keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return jaccard.keep_representatives(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind, and n_chars by the new length."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(quoted(docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("private", private), ("packed", packed)]

#: Tokenization and trained predictions are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
