"""Surviving values per group, by rule: one aggregation for all fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRIORITY = ["crm", "credentialing", "claims", "cms_reference"]

#: field -> (rule, fallback, source priority); the defaults of the catalogue
RULES: dict[str, tuple[str, str | None, list[str] | None]] = {
    "payor_name": ("source_priority", "most_complete", _PRIORITY),
    "payor_name_alt": ("most_complete", "source_priority", None),
    "tax_id": ("source_priority", "any_non_null", _PRIORITY),
    "npi": ("source_priority", "any_non_null", _PRIORITY),
    "cms_plan_id": ("source_priority", "any_non_null", ["cms_reference", "crm", "credentialing", "claims"]),
    "address_line_1": ("most_recent", "source_priority", None),
    "address_line_2": ("most_recent", "source_priority", None),
    "city": ("most_recent", "source_priority", None),
    "state_code": ("most_recent", "source_priority", None),
    "zip_code": ("most_recent", "source_priority", None),
    "phone": ("most_recent", "source_priority", None),
    "website": ("source_priority", "most_complete", _PRIORITY),
    "payor_type": ("source_priority", "most_frequent", _PRIORITY),
    "line_of_business": ("source_priority", "any_non_null", _PRIORITY),
    "is_active": ("any_true", None, None),
    "effective_date": ("earliest", None, None),
    "termination_date": ("latest", None, None),
}
KINDS = ("source_priority", "most_recent", "most_complete", "longest_value", "earliest", "latest", "any_true", "most_frequent", "any_non_null", "manual")


def _order(rule: str, field: str, priority: list[str] | None) -> Column:
    """The key whose least value wins; ties go to the least record id."""
    c = F.col(field)
    if rule == "source_priority" and priority and priority != _PRIORITY:
        rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("source_system")), F.lit(99))
        return F.when(rank == 0, 99).otherwise(rank)
    if rule in ("source_priority", "any_non_null", "manual"):
        return F.col("source_trust_rank")
    if rule == "most_recent":
        # nulls last
        return F.coalesce(-F.unix_micros("loaded_at"), F.lit(2**63 - 1))
    if rule in ("most_complete", "longest_value"):
        return -F.length(c.cast("string"))
    if rule == "earliest":
        return c
    raise ValueError(f"no order for rule {rule}")


def _held(field: str, rule: str) -> Column:
    """Whether a record's value can win by ``rule``."""
    c = F.col(field)
    return c.isNotNull() & (c.cast("string") != "") if rule in ("most_complete", "longest_value") else c.isNotNull()


def value(field: str, rule: str, priority: list[str] | None = None) -> Column:
    """The aggregate that picks ``field`` by ``rule``; nulls never win."""
    c = F.col(field)
    if rule == "any_true":
        return F.bool_or(c)
    if rule == "earliest":
        return F.min(c)
    if rule == "latest":
        return F.max(c)
    if rule == "most_frequent":
        return F.mode(c, True)
    return picked(field, rule, priority)["value"]


def picked(field: str, rule: str, priority: list[str] | None = None) -> Column | None:
    """The surviving value and the id of the record that it is from, where the rule takes it from one: the least of (order, id, value)."""
    if rule in ("any_true", "most_frequent", "latest"):
        return None
    return F.min(F.when(_held(field, rule), F.struct(_order(rule, field, priority).alias("order"), F.col("source_record_id").alias("id"), F.col(field).alias("value"))))


def joined(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Records with their groups, dealt out by group: what is aggregated by group then meets in one place before it is aggregated at all.

    Groups have few records, so that to aggregate before the shuffle as well would shuffle more. A group large enough to hold up a task has
    its pairs among the candidates, which are the square of it.
    """
    return records.join(groups, "source_record_id").repartition("match_group_id")


def survive(records: DataFrame, groups: DataFrame, rules: dict = RULES, fallbacks: bool = False, overrides: DataFrame | None = None, figures: Sequence[Column] = ()) -> DataFrame:
    """One row per group with the surviving fields, ``field_sources`` and further aggregates (``figures``). ``overrides``: match_group_id, field, value (rule ``manual``)."""
    return survive_joined(joined(records, groups), rules, fallbacks, overrides, figures)


def survive_joined(rows: DataFrame, rules: dict = RULES, fallbacks: bool = False, overrides: DataFrame | None = None, figures: Sequence[Column] = ()) -> DataFrame:
    """The same of records that hold their match_group_id."""
    aggs, values, sources = [], [], []
    for i, (f, (rule, fallback, priority)) in enumerate(rules.items()):
        best = picked(f, rule, priority)
        aggs.append((value(f, rule, priority) if best is None else best).alias(f"_{i}"))
        v = F.col(f"_{i}")
        if best is not None:
            sources.append(F.struct(F.lit(f).alias("key"), v["id"].alias("value")))
            v = v["value"]
        if fallbacks and fallback:
            aggs.append(value(f, fallback, priority or _PRIORITY).alias(f"_{i}_else"))
            v = F.coalesce(v, F.col(f"_{i}_else"))
        values.append(v.alias(f))
    found = F.map_from_entries(F.filter(F.array(*sources), lambda e: e["value"].isNotNull())) if sources else F.lit(None).cast("map<string,string>")
    out = rows.groupBy("match_group_id").agg(*aggs, *figures)
    further = out.columns[1 + len(aggs) :]
    out = out.select("match_group_id", *values, found.alias("field_sources"), *further)
    if overrides is not None:
        per = overrides.groupBy("match_group_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("o"))
        out = out.join(per, "match_group_id", "left").withColumns({f: F.coalesce(F.col("o")[f].cast(out.schema[f].dataType), F.col(f)) for f in rules}).drop("o")
    return out


def tax_conflicts(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups whose records carry several tax ids, as rows for the change log."""
    rows = joined(records.where(F.col("tax_id").isNotNull() & (F.col("tax_id") != "")), groups.select("match_group_id", "source_record_id"))
    # most groups have one id, which is told without a set
    several = rows.groupBy("match_group_id").agg(F.min("tax_id").alias("least"), F.max("tax_id").alias("most")).where(F.col("least") != F.col("most"))
    rows = rows.join(several, "match_group_id", "left_semi")
    sets = rows.groupBy("match_group_id").agg(F.array_sort(F.collect_set("tax_id")).alias("ids")).where("size(ids) > 1")
    return sets.select(F.col("match_group_id").alias("entity_id"), F.lit("conflict_detected").alias("action"), F.lit("tax_id").alias("field_name"), F.array_join("ids", ",").alias("new_value"))
