"""Stewardship: decisions, audit, comparisons and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARED = "payor_name tax_id npi cms_plan_id address_line_1 city state_code zip_code phone payor_type".split()


def compare_fields(pairs: DataFrame, records: DataFrame, fields: list[str] = COMPARED) -> DataFrame:
    """One row per pair and field with a colour: neutral (both empty), green (equal), yellow (same first three letters), red."""
    a, b = "source_record_id_a", "source_record_id_b"
    side = lambda k, s: records.select(F.col("source_record_id").alias(k), F.struct(*[F.nullif(F.col(f), F.lit("")).alias(f) for f in fields]).alias(s))
    both = pairs.select(a, b).join(side(a, "x"), a).join(side(b, "y"), b)
    cells = both.select(a, b, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").alias("value_a"), F.col(f"y.{f}").alias("value_b")) for f in fields])).alias("c")).select(a, b, "c.*")
    x, y = F.col("value_a"), F.col("value_b")
    colour = (
        F.when(x.isNull() & y.isNull(), "neutral").when(x.isNull() | y.isNull(), "red").when(x == y, "green")
        .when(F.lower(F.left(x, F.lit(3))) == F.lower(F.left(y, F.lit(3))), "yellow").otherwise("red")
    )
    return cells.withColumn("colour", colour)


def audit_rows(decisions: DataFrame) -> DataFrame:
    """Change-log rows of steward decisions."""
    return decisions.select(
        F.md5(F.concat_ws("|", "source_record_id_a", "source_record_id_b", "decision", F.col("at").cast("string")).cast("binary")).alias("change_id"), F.lit("match_candidate").alias("entity_type"),
        F.md5(F.concat_ws("|", "source_record_id_a", "source_record_id_b").cast("binary")).alias("entity_id"), F.col("decision").alias("action"), F.col("user").alias("changed_by"), F.col("notes").alias("reason"), F.col("at").alias("changed_at"),
    )


def audit_page(log: DataFrame, page: int = 0, size: int = 20, **equals: str | None) -> tuple[DataFrame, bool]:
    """A page of the change log, newest first, and whether there are more; filters that are None do not apply."""
    for c, v in equals.items():
        if v is not None:
            log = log.where(F.col(c) == v)
    rows = log.orderBy(F.desc("changed_at"), "change_id").offset(page * size)
    return rows.limit(size), rows.limit(size + 1).count() > size


def recent(log: DataFrame, most: int = 10) -> DataFrame:
    """The newest rows of the change log."""
    return log.orderBy(F.desc("changed_at"), "change_id").limit(most)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with their key, null keys alike, and the others; of equal keys in ``new`` one row."""
    new = new.dropDuplicates([key])
    gone = new.select(F.col(key).alias("_key"))
    return new.unionByName(old.join(gone, F.col(key).eqNullSafe(F.col("_key")), "left_anti"))


def add_link(parent: str, child: str, kind: str, links: DataFrame) -> DataFrame:
    """``links`` with a confirmed link; a link to itself is refused."""
    if parent == child:
        raise ValueError("a record cannot be its own parent")
    row = links.sparkSession.createDataFrame([(parent, child, kind)], "parent_master_id string, child_master_id string, relationship_type string")
    row = row.withColumns({"hierarchy_id": F.md5(F.concat_ws("|", "parent_master_id", "child_master_id", F.lit("manual")).cast("binary")), "effective_date": F.current_date(), "end_date": F.lit(None).cast("date"), "source": F.lit("manual"), "steward_confirmed": F.lit(True)})
    return links.unionByName(row.select(links.columns))


def golden_list(gold: DataFrame, refs: DataFrame) -> DataFrame:
    n = refs.groupBy("master_payor_id").agg(F.count(F.lit(1)).alias("records"))
    return gold.join(n, "master_payor_id", "left").withColumn("records", F.coalesce("records", F.lit(0))).orderBy("payor_name", "master_payor_id")


def search(df: DataFrame, text: str, order: str, page: int = 0, size: int = 20) -> DataFrame:
    """Rows any of whose values contain ``text``, ordered and paged."""
    hit = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))])).contains(text.lower())
    return df.where(hit).orderBy(order).offset(page * size).limit(size)


def band(score, high: float = 0.8, low: float = 0.5):  # noqa: ANN001, ANN201
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= high, "green").when(c >= low, "yellow").when(c.isNotNull(), "red")


def percent_band(percent: str, high: float = 90.0, low: float = 70.0):  # noqa: ANN201
    """The colour of a percentage."""
    return band(F.round(percent, 1), high, low)
