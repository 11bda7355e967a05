"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

Pass one maps the hash of every normalised text to a block of ``BLOCK_BITS`` bits and ``PROBES`` bits in it,
and counts how many rows hit each bit; what is dealt out for it are these bit numbers, merged before they
leave a task, and neither rows nor hashes. Bits hit more than once are the filter. Pass two looks the bits
of a row up: a row with a bit hit only once has no equal and passes straight through. Only the rest,
the possibly repeated rows, are shuffled and grouped by the SHA-256 of their text.

The filter has ``BITS_PER_ROW`` bits a row whatever the number of rows. One of more than ``MAX_BITS`` is made
and used in slices of the hash space, one after another, each of at most ``MAX_BITS`` and broadcast alone;
``assign`` looks into a table of hashes sorted by slice, ``keep_distinct`` reads the rows once a slice.

Nulls and edges: null text counts as empty; empty texts equal each other; rows that share both text
and doc_id are one document in ``assign`` (all of them are reported as kept) and ``keep_distinct``
returns one of them; null doc_ids lose against others; an empty table gives an empty result; other
columns, whatever their names, pass through ``keep_distinct`` untouched; ties cannot occur but between
rows of one doc_id; texts are hashed whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import ascii_lower, join_groups, quoted, scratch, table, written

BITS_PER_ROW = 16
PROBES = 2
#: Bits of a block: 64 words of 64 bits.
BLOCK_BITS = 1 << 12
#: Bits of the filter that is broadcast at once: 64 MB.
MAX_BITS = 1 << 29


def layout(total: int, max_bits: int = MAX_BITS) -> tuple[int, int]:
    """(slices, blocks a slice) of a filter for ``total`` rows."""
    bits = max(BLOCK_BITS, BITS_PER_ROW * total)
    slices = -(-bits // max(BLOCK_BITS, max_bits))
    return slices, -(-bits // (slices * BLOCK_BITS))


def _slice(digest: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(7)), F.lit(slices)).cast("int")


def _probes(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (text_sha256, ...) with ``_block`` and ``_bits``, the bit numbers in it."""
    at = F.xxhash64("text_sha256")
    bits = [F.shiftright(at, 12 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for k in range(PROBES)]
    return rows.withColumns({"_block": F.pmod(F.xxhash64("text_sha256", F.lit(1)), F.lit(blocks)), "_bits": F.array_distinct(F.array(*bits))})


def bloom_of_repeats(digests: DataFrame, blocks: int) -> DataFrame:
    """_block, _words (64 masks): the bits that more than one row of ``digests`` (text_sha256) hits; ``blocks`` rows at most."""
    hits = _probes(digests.select("text_sha256"), blocks).select("_block", F.explode("_bits").alias("bit"))
    often = hits.groupBy("_block", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = often.groupBy("_block", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("mask"))
    held = F.map_from_entries(F.collect_list(F.struct("word", "mask")))
    return words.groupBy("_block").agg(held.alias("held")).select("_block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long"))).alias("_words"))


def _flag(rows: DataFrame, digests: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``maybe``, by the filter over ``digests``: both of one slice."""
    hit = F.forall("_bits", lambda b: F.getbit(F.element_at("_words", F.shiftright(b, 6) + 1), b.bitwiseAND(F.lit(63))) == 1)
    found = _probes(rows, blocks).join(F.broadcast(bloom_of_repeats(digests, blocks)), "_block", "left")
    return found.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("_block", "_bits", "_words")


def flag_repeats(rows: DataFrame, digests: DataFrame, total: int, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` (text_sha256, ...) with ``maybe``: false where no other of the ``total`` rows of ``digests`` has the same text."""
    slices, blocks = layout(total, max_bits)
    if slices == 1:
        return _flag(rows, digests, blocks)
    path = scratch(rows.sparkSession, "flagged")
    for s in range(slices):
        own = [x.where(_slice(F.col("text_sha256"), slices) == s) for x in (rows, digests)]
        _flag(*own, blocks).write.mode("append").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _digest() -> Column:
    return F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("text_sha256")


def _digests(docs: DataFrame, path: str, total: int, max_bits: int) -> DataFrame:
    """doc_id and text_sha256 of every row, written: the only reading of the texts in ``assign``."""
    found = docs.select("doc_id", _digest())
    slices, _ = layout(total, max_bits)
    # a slice is then read from a few row groups of each file, without having been shuffled
    return written(found.sortWithinPartitions(_slice(F.col("text_sha256"), slices)) if slices > 1 else found, "digests", path)


def _groups(some: DataFrame) -> DataFrame:
    return some.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def assign(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs`` (doc_id, text)."""
    total = docs.count()
    digests = _digests(docs, scratch(docs.sparkSession, "digests"), total, max_bits)
    rows = written(flag_repeats(digests, digests, total, max_bits), "flagged")
    single = rows.where("not maybe").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    some = rows.where("maybe").select("doc_id", "text_sha256")
    found = single.unionByName(join_groups(some, written(_groups(some), "groups"), "text_sha256", "group_size", total))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the largest doc_id."""
    total, path = docs.count(), scratch(docs.sparkSession, "digests")
    digests = _digests(docs, path, total, max_bits)
    hashed = docs.select(F.struct(*quoted(docs.columns)).alias("_row"), "doc_id", _digest())
    rows = flag_repeats(hashed, digests, total, max_bits)
    some = written(rows.where("maybe").select("_row", "doc_id", "text_sha256"), "repeated")
    won = join_groups(some, written(_groups(some), "groups"), "text_sha256", "group_size", total)
    won = won.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["text_sha256"]).select("_row")
    return rows.where("not maybe").select("_row").unionByName(won).select("_row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
