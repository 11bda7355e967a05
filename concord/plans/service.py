"""A session over stored layers: ad-hoc SQL, steward writes, rebuilds and a liveness probe.

Layers are Parquet folders under one root, and each is a view of its name. Decisions and links are appended to
logs and never change stored rows; the last decision on a pair holds when candidates are next derived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import matching, steward
from concord.plans.pipeline import Mastering

#: The stored tables, each derived from those before it.
LAYERS = ("records", "candidates", "groups", "golden", "xref", "hierarchy")
_DECISION = f"{matching.A} string, {matching.B} string, decision string, user string, at timestamp, notes string"
_DECISIONS = ("confirmed_match", "confirmed_no_match")


class Service:
    """The engine over ``raw`` feeds, storing its layers under ``root`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, raw: dict[str, DataFrame], root: str, **options: str) -> None:
        self.spark, self.raw, self.root, self.options = spark, raw, root.rstrip("/"), options
        self.versions: dict[str, str] = {}

    def path(self, layer: str) -> str:
        """Where a layer's present version lies."""
        return f"{self.root}/{layer}/{self.versions[layer]}"

    def _log(self) -> DataFrame:
        """The decision log; one without rows before the first decision."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/decisions")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(_DECISION).parquet(f"{self.root}/decisions") if there else self.spark.createDataFrame([], _DECISION)

    def sql(self, query: str) -> DataFrame:
        """Rows of one statement over the layers."""
        if not query or not query.strip():
            raise ValueError("a query is needed")
        return self.spark.sql(query)

    def write(self, decisions: list[dict]) -> int:
        """Appends decisions on pairs; either all are valid and all are written at once, or none is."""
        rows = []
        for d in decisions:
            if d.get("decision") not in _DECISIONS:
                raise ValueError(f"unknown decision {d.get('decision')!r}")
            a, b = sorted((d["a"], d["b"]))
            rows.append((a, b, d["decision"], d.get("user"), d.get("notes")))
        if rows:
            made = self.spark.createDataFrame(rows, f"{matching.A} string, {matching.B} string, decision string, user string, notes string").withColumn("at", F.current_timestamp())
            made.select(*[c.split()[0] for c in _DECISION.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.root}/decisions")
        return len(rows)

    def audit(self) -> DataFrame:
        """The change log of all decisions."""
        return steward.audit_rows(self._log())

    def rebuild(self, first: str = "records") -> list[str]:
        """Derives the layers from ``first`` on and stores them as new versions; earlier ones are read as they are stored."""
        if first not in LAYERS:
            raise ValueError(f"unknown layer {first!r}")
        done, run = [], Mastering(self.raw, decisions=self._log(), **self.options)
        for layer in LAYERS:
            if LAYERS.index(layer) >= LAYERS.index(first) or layer not in self.versions:
                version = uuid.uuid4().hex
                getattr(run, layer).write.parquet(f"{self.root}/{layer}/{version}")
                self.versions[layer] = version
                done.append(layer)
            run._made[layer] = self.spark.read.parquet(self.path(layer))
            run._made[layer].createOrReplaceTempView(layer)
        return done

    def alive(self) -> bool:
        return self.spark.sql("SELECT 1 AS one").first()["one"] == 1
