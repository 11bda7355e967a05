"""What the operators share: tables, scratch space on shared storage, and skew-proof group joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A group of more than 1/HOT_SHARE of all rows is hot; so there are at most HOT_SHARE hot groups.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test-data layout."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode a fresh one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        found = "file://" + tempfile.mkdtemp(prefix="concord-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, or under that of the ``scope``."""
    return f"{_scope.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """What is written to scratch paths inside is removed at the end: only for results that were written elsewhere."""
    folder = scratch(spark, name)
    held = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(held)
        discard(spark, folder)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, path or scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(columns: list[str]) -> list[Column]:
    """The columns of these names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def fresh(columns: list[str], name: str) -> str:
    """``name``, or with underscores before it, so that it is none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mapped(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], added: dict[str, str]) -> DataFrame:
    """``df`` through ``part``, which gives for each batch all its columns and those ``added`` (name: type), in order.

    On the way the columns have plain names, as ``mapInArrow`` takes no names with dots.
    """
    own = [f"c{i}" for i in range(len(df.columns))]
    names = [*own, *(f"a{i}" for i in range(len(added)))]
    kinds = [*(f.dataType.simpleString() for f in df.schema), *added.values()]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in part(rows):
            yield pa.RecordBatch.from_arrays(columns, names)

    out = df.toDF(*own).mapInArrow(batches, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    return out.toDF(*df.columns, *added)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``groups`` on ``key``, however uneven the groups are.

    ``groups`` has one row per key and in ``size`` the number of rows with that key. Of the groups
    with more than total / HOT_SHARE rows there are at most HOT_SHARE, so that part is broadcast;
    the others are joined by a shuffle in which no key is large.
    """
    hot = F.col(size) > max(1000, total // HOT_SHARE)
    warm = groups.where(~hot)
    head = F.broadcast(groups.where(hot).limit(HOT_SHARE))
    flagged = rows.join(head, key, "left")
    added = [c for c in groups.columns if c != key]
    done = flagged.where(F.col(size).isNotNull())
    rest = flagged.where(F.col(size).isNull()).drop(*added).join(warm, key)
    return done.select(*rows.columns, *added).unionByName(rest.select(*rows.columns, *added))
