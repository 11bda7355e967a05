"""Data quality: assertions that return failing rows, and summary figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~F.col(column).isin(values))


def relationship(df: DataFrame, column: str, to: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(to.select(F.col(key).alias(column)), column, "left_anti")


def orphans(records: DataFrame, refs: DataFrame) -> DataFrame:
    return records.join(refs, "source_record_id", "left_anti")


def completeness(records: DataFrame, fields: list[str]) -> DataFrame:
    """Percent of records with a value, per source system and field."""
    return records.groupBy("source_system").agg(
        F.count(F.lit(1)).alias("records"), *[F.round(F.sum(F.when(F.col(f).isNotNull() & (F.col(f) != ""), 1).otherwise(0)) * 100.0 / F.count(F.lit(1)), 1).alias(f"pct_{f}") for f in fields]
    )


def histogram(df: DataFrame, score: str, bins: int = 10, clamp: bool = False) -> DataFrame:
    """Counts per bucket of [0, 1]; a score of 1 is in bucket bins + 1 unless ``clamp``."""
    b = F.width_bucket(F.col(score), F.lit(0.0), F.lit(1.0), F.lit(bins))
    return df.where(F.col(score).isNotNull()).groupBy((F.least(b, F.lit(bins)) if clamp else b).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket")


def source_share(records: DataFrame) -> DataFrame:
    """Records and their percentage per source system: the counts, a few rows, are summed once more."""
    n = records.groupBy("source_system").agg(F.count(F.lit(1)).alias("records"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("records").alias("total")))).select("source_system", "records", F.round(F.col("records") * 100.0 / F.col("total"), 1).alias("pct"))


def summary(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: source systems, records and pairs."""
    return records.agg(F.countDistinct("source_system").alias("sources"), F.count(F.lit(1)).alias("records")).crossJoin(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("pairs"))))
