"""Golden records, cross references and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.survivorship import joined, survive_joined
from concord.storage import stored

_COMPLETE = "payor_name payor_name_alt tax_id npi cms_plan_id address_line_1 city state_code zip_code phone website payor_type line_of_business is_active effective_date".split()


def golden(records: DataFrame, groups: DataFrame, **rules: object) -> DataFrame:
    """One row per group: the surviving fields and the group's figures, from one join and one aggregation.

    Source systems are counted where the next one begins, in the order by system in which a group's records are sorted anyhow.
    """
    before = F.lag("source_system").over(Window.partitionBy("match_group_id").orderBy("source_system"))
    rows = joined(records, groups).withColumn("first_of_source", (F.col("source_system").isNotNull() & ~F.col("source_system").eqNullSafe(before)).cast("long"))
    figures = [F.sum("first_of_source").alias("source_count"), F.count(F.lit(1)).alias("record_count"), F.avg(F.coalesce("group_confidence", F.lit(1.0))).alias("confidence_score")]
    s = survive_joined(rows, figures=figures, **rules)
    done = sum((F.col(c).isNotNull().cast("int") for c in _COMPLETE), F.lit(0))
    return s.withColumn("completeness_score", F.round(done / 15.0, 4)).withColumnRenamed("match_group_id", "master_payor_id")


def xref(records: DataFrame, groups: DataFrame) -> DataFrame:
    return groups.join(records.select("source_record_id", "source_system", "source_id"), "source_record_id").select(
        "source_record_id", F.col("match_group_id").alias("master_payor_id"), "source_system", "source_id", F.col("group_confidence").alias("match_confidence")
    )


def infer_hierarchy(gold: DataFrame, refs: DataFrame, records: DataFrame, least: int = 6) -> DataFrame:
    """Parents by reference to a golden name, and by a name contained in a longer one.

    The containment join runs on n-grams of ``least`` characters, as hashes: a longer name holds all n-grams of a contained
    name of that length or more, so an equi-join on any one of them loses nothing; ``contains`` then decides. A name with an n-gram
    that no other name holds is in none. Each other
    name is looked for by the n-gram of its own that fewest names hold, so that common words, which would be
    hot keys, are joined for those names alone that consist of nothing else. Equal names are joined once.
    """
    names = gold.select("master_payor_id", F.upper(F.trim("payor_name")).alias("name")).where(F.col("name").isNotNull())
    own = refs.join(records.select("source_record_id", "parent_ref"), "source_record_id").where(F.col("parent_ref").isNotNull() & (F.col("parent_ref") != ""))
    by_ref = (
        own.select(F.col("master_payor_id").alias("child_master_id"), F.upper(F.trim("parent_ref")).alias("name")).distinct()
        .join(names.select(F.col("master_payor_id").alias("parent_master_id"), "name"), "name").where("parent_master_id != child_master_id")
        .select("parent_master_id", "child_master_id", F.lit("name_ref_match").alias("inference_method"))
    )
    texts = stored(names.where(F.length("name") >= least).select("name").distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    grams = lambda df: df.select("id", "name", F.explode(F.sequence(F.lit(1), F.length("name") - (least - 1))).alias("i")).select("id", F.xxhash64(F.substring(F.col("name"), F.col("i"), F.lit(least))).alias("gram"))
    held = grams(texts).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    alone = held.where(F.col("first") == F.col("last")).select(F.col("first").alias("id")).distinct()
    shared = stored(texts.join(alone, "id", "left_anti"), "shared")
    rarest = grams(shared).join(held.where(F.col("first") != F.col("last")).select("gram", "n"), "gram").groupBy("id").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram")).withColumnRenamed("id", "short_id")
    found = grams(texts).join(rarest, "gram").where("id != short_id").select("id", "short_id").distinct()
    both = found.join(shared.select(F.col("id").alias("short_id"), F.col("name").alias("short")), "short_id").join(texts.withColumnRenamed("name", "long"), "id")
    inside = both.where(F.col("long").contains(F.col("short")) & (F.length("short") < F.length("long"))).select("short", "long")
    by_name = (
        inside.join(names.select(F.col("master_payor_id").alias("parent_master_id"), F.col("name").alias("short")), "short")
        .join(names.select(F.col("master_payor_id").alias("child_master_id"), F.col("name").alias("long")), "long")
        .select("parent_master_id", "child_master_id", F.lit("name_substring").alias("inference_method"))
    )
    return by_ref.unionByName(by_name).distinct()


def hierarchy(inferred: DataFrame, dedupe: bool = False) -> DataFrame:
    """Hierarchy rows with stable ids; ``dedupe`` keeps one row a pair, by reference first."""
    if dedupe:
        inferred = inferred.groupBy("parent_master_id", "child_master_id").agg(F.min("inference_method").alias("inference_method"))
    return inferred.select(
        F.md5(F.concat_ws("|", "parent_master_id", "child_master_id", "inference_method").cast("binary")).alias("hierarchy_id"), "parent_master_id", "child_master_id",
        F.lit("parent_company").alias("relationship_type"), F.lit(None).cast("date").alias("effective_date"), F.lit(None).cast("date").alias("end_date"),
        F.col("inference_method").alias("source"), F.lit(False).alias("steward_confirmed"),
    )


def unassigned(gold: DataFrame, links: DataFrame) -> DataFrame:
    """Golden records in no hierarchy link."""
    ends = links.select(F.col("parent_master_id").alias("master_payor_id")).unionByName(links.select(F.col("child_master_id").alias("master_payor_id")))
    return gold.join(ends, "master_payor_id", "left_anti")


def tree(links: DataFrame, most: int | None = None) -> DataFrame:
    """Every path from a root (a parent that is no child): root, node, depth. Cycles end where they close; only a caller's ``most`` bounds the depth."""
    pairs = links.select("parent_master_id", "child_master_id").distinct()
    roots = pairs.select(F.col("parent_master_id").alias("root")).distinct().join(pairs.select(F.col("child_master_id").alias("root")).distinct(), "root", "left_anti")
    return pairs.sparkSession.sql(
        # Spark's own limit on levels is 100
        "WITH RECURSIVE t(root, node, depth, path) MAX RECURSION LEVEL 2147483647 AS (SELECT root, root, 0, array(root) FROM {roots} UNION ALL "
        "SELECT t.root, p.child_master_id, t.depth + 1, array_append(t.path, p.child_master_id) FROM t JOIN {pairs} p ON p.parent_master_id = t.node "
        f"WHERE NOT array_contains(t.path, p.child_master_id){'' if most is None else f' AND t.depth < {int(most)}'}) SELECT root, node, depth FROM t",
        roots=roots, pairs=pairs,
    )


def named(links: DataFrame, gold: DataFrame) -> DataFrame:
    """``links`` with the golden names of both ends."""
    end = lambda e: gold.select(F.col("master_payor_id").alias(f"{e}_master_id"), F.col("payor_name").alias(f"{e}_name"))
    return links.join(end("parent"), "parent_master_id", "left").join(end("child"), "child_master_id", "left")


def links_of(links: DataFrame, master_id: str) -> DataFrame:
    """The links that a golden record is an end of."""
    return links.where((F.col("parent_master_id") == master_id) | (F.col("child_master_id") == master_id))


def sources_of(refs: DataFrame, records: DataFrame, master_id: str) -> DataFrame:
    """The source records behind a golden record."""
    return refs.where(F.col("master_payor_id") == master_id).select("source_record_id", "match_confidence").join(records, "source_record_id")
