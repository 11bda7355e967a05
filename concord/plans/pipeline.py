"""The mastering pipeline: feeds to golden records. Each step is a function of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import cluster, master, matching, staging
from concord.settings import DEFAULT
from concord.sources import feeds
from concord.storage import stored


class Mastering:
    """Lazily built tables of one run.

    ``records`` is the plan of staging; ``staged`` is its result, stored once, as are candidates, groups and golden
    records: several steps read them, and each then scans the columns it needs instead of staging all feeds again.
    """

    def __init__(self, raw: dict[str, DataFrame], decisions: bool | DataFrame = False, mode: str = "full", ids: str = "uuid5") -> None:
        self.raw, self.mode, self.ids, self.decisions = raw, mode, ids, decisions
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:  # noqa: ANN001
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def records(self) -> DataFrame:
        return self._once("records", lambda: staging.union_all(self.raw))

    @property
    def staged(self) -> DataFrame:
        """With a ``number`` for each record, any but the same whenever it is read: components are made of numbers, not of texts."""
        return self._once("staged", lambda: stored(self.records.withColumn("number", F.monotonically_increasing_id()), "records"))

    @property
    def pairs(self) -> DataFrame:
        """Stored only where decisions are made up from them, as they are read twice then."""
        made = lambda: matching.blocking_pairs(self.staged)
        return self._once("pairs", (lambda: stored(made(), "pairs")) if self.decisions is True else made)

    @property
    def scored(self) -> DataFrame:
        return self._once("scored", lambda: matching.score_pairs(self.pairs, self.staged) if self.decisions is True else matching.score_blocks(self.staged))

    @property
    def log(self) -> DataFrame | None:
        if isinstance(self.decisions, DataFrame):
            return self.decisions
        return sample_decisions(self.pairs) if self.decisions else None

    @property
    def candidates(self) -> DataFrame:
        return self._once("candidates", lambda: stored(matching.decide(self.scored, self.log), "candidates"))

    def decided(self, least: float, drop: bool = False) -> DataFrame:
        """Candidates, by the numbers of their records, as far as decisions at or above ``least`` ask for scores. Stored once, by the first call."""
        columns = (matching.A, matching.B, "match_rule", "overall_score", "auto_decision", "steward_decision", "final_decision")
        made = lambda: stored(matching.decide(matching.score_blocks(self.staged, least=least, drop=drop, ident="number")).select(*columns), "decided")
        return self._once("decided", made)

    @property
    def groups(self) -> DataFrame:
        """Where no steward decides, pairs that are no match need no scores."""
        if self.decisions is not False or self.mode != "full" or "candidates" in self._made:
            made = lambda: cluster.groups(self.staged, self.candidates, self.mode, self.ids)
        else:
            made = lambda: cluster.groups(self.staged, self.decided(DEFAULT.auto_match, drop=True), self.mode, self.ids, "number")
        return self._once("groups", lambda: stored(made(), "groups"))

    @property
    def golden(self) -> DataFrame:
        return self._once("golden", lambda: stored(master.golden(self.staged, self.groups), "golden"))

    @property
    def xref(self) -> DataFrame:
        return self._once("xref", lambda: master.xref(self.staged, self.groups))

    @property
    def hierarchy(self) -> DataFrame:
        """Stored, as most of its readers read it twice."""
        refs = lambda: self.groups.select("source_record_id", F.col("match_group_id").alias("master_payor_id"))
        return self._once("hierarchy", lambda: stored(master.infer_hierarchy(self.golden, refs(), self.staged), "hierarchy"))


def sample_decisions(pairs: DataFrame) -> DataFrame:
    """Steward decisions for pairs picked by the number in the first id."""
    k = F.split_part(F.col(matching.A), F.lit("-"), F.lit(2)).cast("bigint") % 10
    return pairs.where(k.isin(4, 6)).select(
        matching.A, matching.B, F.when(k == 6, "confirmed_match").otherwise("confirmed_no_match").alias("decision"), F.lit("steward").alias("user"),
        F.lit("2024-06-01 00:00:00").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("notes"),
    )


def mastering(spark: SparkSession, sf_dir: str, **options: object) -> Mastering:
    return Mastering(feeds.derive(spark, sf_dir), **{"ids": "md5"} | options)
