"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the ``K`` smallest distinct 64-bit hashes of a text's shingles (five
words; fewer words: the whole sequence; no word: none). The bottom-k sketch of a union is the
bottom k of the sketches' union, so parts can be sketched apart and merged. Of two sketches,
``resemblance`` looks at the k smallest hashes of both together and counts those that both hold;
``containment`` and ``distinct_shingles`` follow from the k-th smallest hash. A sketch of fewer
than ``K`` hashes holds all of them, so its estimates are exact.

Words are the runs between ASCII white space after A-Z are lower-cased. Null text is empty. Two
texts without any word resemble each other fully (1.0), a text without words and one with words
not at all (0.0). The next document is that with the next doc_id (ties: by the text); after the last
comes the first, so the only document of a table is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import ascii_lower, table, written

K = 128
WORDS = 5
ROWS_PER_RANGE = 2000
SPACE = "[\\x20\\x09-\\x0D]+"


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Sorted array<bigint> of the ``k`` smallest shingle hashes of ``text``."""
    w = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE), lambda x: x != "")
    # let-binding: an array of one element keeps the word list from being computed again for each use
    found = F.transform(
        F.array(w),
        lambda w: F.when(
            F.size(w) >= words,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, words))),
        ).otherwise(F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(w)))),
    )[0]
    return F.slice(F.sort_array(F.array_distinct(found)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the sketched shingle sets."""
    low = merge(a, b, k)
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    n = F.size(low)
    return F.when(n == 0, F.lit(1.0)).otherwise(both / n)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    j = resemblance(a, b, k)
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The sketch as hex, 16 digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _ranges(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_range``: ascending with ``key``, about ROWS_PER_RANGE rows each. Null keys come first."""
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    parts = max(1, n // ROWS_PER_RANGE)
    width = max(1, -(-((high or 0) - (low or 0) + 1) // parts))
    even = rows.withColumn("_range", F.coalesce(F.floor((F.col(key) - F.lit(low or 0)) / F.lit(width)), F.lit(-1)).cast("long"))
    most = even.groupBy("_range").count().agg(F.max("count")).first()[0]
    if (most or 0) <= 20 * ROWS_PER_RANGE:
        return even
    # keys far from evenly spaced: sampled boundaries instead, at the price of another shuffle
    dealt = rows.repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id().cast("long"))
    return written(dealt, "ranges")


def with_next(rows: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """``rows`` with ``next_<c>`` for c in ``carry``: values of the row that follows in the order of ``key``.

    The rows are dealt once, to ranges of ``key``; within a range the next row is found by a window, and
    the first row of each range serves the last one of the range before.
    """
    ranged = _ranges(rows, key)
    w = Window.partitionBy("_range").orderBy(key, *order)
    here = ranged.withColumns(
        {f"next_{c}": F.lead(c).over(w) for c in carry} | {"_end": F.lead(F.lit(1)).over(w).isNull(), "_start": F.lag(F.lit(1)).over(w).isNull()}
    )
    heads = here.where("_start").select("_range", F.struct(*carry).alias("_head"))
    # the range after each range: by blocks of 1000 ranges, of which there is one in two million rows
    spans = ranged.select("_range").distinct().withColumn("_block", F.floor(F.col("_range") / F.lit(1000)))
    wb, wa = Window.partitionBy("_block").orderBy("_range"), Window.orderBy("_block")
    firsts = spans.groupBy("_block").agg(F.min("_range").alias("_first"))
    jumps = firsts.select("_block", F.lead("_first").over(wa).alias("_jump"))
    least = firsts.agg(F.min("_first").alias("_least"))
    links = (
        spans.withColumn("_next", F.lead("_range").over(wb)).join(jumps, "_block").join(F.broadcast(least))
        .select("_range", F.coalesce("_next", "_jump", "_least").alias("_next"))
    )
    ends = links.join(heads.withColumnRenamed("_range", "_next"), "_next").select("_range", "_head")
    out = here.join(ends, "_range", "left")
    fill = {f"next_{c}": F.when(F.col("_end"), F.col(f"_head.{c}")).otherwise(F.col(f"next_{c}")) for c in carry}
    return out.withColumns(fill).drop("_range", "_end", "_start", "_head")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, sketch per row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), sketch(text, k).alias("sketch"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.withColumn("sketch", sketch(F.col("text")))
    both = with_next(rows, "doc_id", ["text"], ["text", "sketch"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"),
        "sketch",
        "next_sketch",
    )
    done = edited.withColumn("edited_sketch", F.transform(F.array("edited"), lambda t: sketch(t))[0])
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
