"""Synthetic mess: clean entities to records as four untidy feeds would hold them.

Every choice is a bucket of a hash of the entity, the feed and the purpose, so that a run can be repeated on any
number of executors and each row is made where it lies: no shuffle, no random state. Nulls stay null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.text import col, digits
from concord.settings import STATES

#: Per cent of the entities that each feed holds.
COVERAGE = {"crm": 90, "claims": 80, "credentialing": 60, "cms_reference": 40}
#: Per cent of the CRM records that are entered twice.
TWICE = 5


def bucket(key: Column, purpose: str, n: int = 100) -> Column:
    """A number from 0 to n - 1, from the first 32 bits of an md5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(purpose)).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def name_variant(name: str | Column, key: Column, feed: str) -> Column:
    """The name as a feed writes it: suffixed, shouted, abbreviated or stripped."""
    c, r = col(name), bucket(key, feed + ":name")
    bare = F.trim(F.regexp_replace(c, r"(?i),?\s*(Inc|LLC|Corp)\.?$", ""))
    if feed == "crm":
        return F.when(r < 10, F.concat(bare, F.lit(", Inc."))).when(r < 20, F.concat(bare, F.lit(" LLC"))).when(r < 30, F.concat(bare, F.lit(" Corp"))).otherwise(c)
    if feed == "claims":
        short = F.regexp_replace(bare, "(?i)Blue Cross Blue Shield", "BCBS")
        return F.when(r < 40, F.upper(c)).when(r < 60, bare).when(r < 80, short).otherwise(c)
    if feed == "credentialing":
        return F.when(r < 25, F.concat(bare, F.lit(" Health Inc."))).otherwise(c)
    return F.trim(F.regexp_replace(c, r",?\s*Inc\.?$", ""))


def address_variant(address: str | Column, key: Column, feed: str) -> Column:
    """Street words abbreviated in four of ten."""
    c, short = col(address), {"Street": "St", "Avenue": "Ave", "Boulevard": "Blvd", "Suite": "Ste"}
    return F.when(bucket(key, feed + ":address") < 40, reduce(lambda a, kv: F.regexp_replace(a, rf"\b{kv[0]}\b", kv[1]), short.items(), c)).otherwise(c)


def single_line(*parts: str | Column) -> Column:
    """Parts of an address in one line; nulls are left out."""
    return F.concat_ws(", ", *[col(p) for p in parts])


def state_variant(state: str | Column, key: Column, feed: str) -> Column:
    """A state's code; in four of ten claims its name, its name in lower case, or the code in lower case."""
    c = col(state)
    if feed != "claims":
        return c
    names = F.create_map(*[F.lit(x) for n, code in STATES.items() for x in (code, n)])
    full, r = F.coalesce(names[c], c), bucket(key, feed + ":state", 1000)
    return F.when(r < 133, full).when(r < 266, F.lower(full)).when(r < 400, F.lower(c)).otherwise(c)


def zip_variant(zip_code: str | Column, key: Column, feed: str) -> Column:
    """Nine digits in three of ten claims and reference records."""
    c = col(zip_code)
    if feed not in ("claims", "cms_reference"):
        return c
    more = F.lpad(bucket(key, feed + ":plus4", 10000).cast("string"), 4, "0")
    return F.when(bucket(key, feed + ":zip") < 30, F.concat(c, F.lit("-"), more)).otherwise(c)


def phone_variant(phone: str | Column, key: Column, feed: str) -> Column:
    """Ten digits in one of five formats; others as they are."""
    d, r = digits(phone), bucket(key, feed + ":phone", 5)
    a, b, c = F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)
    made = (
        F.when(r == 0, F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c)).when(r == 1, F.concat(a, F.lit("-"), b, F.lit("-"), c))
        .when(r == 2, F.concat(a, F.lit("."), b, F.lit("."), c)).when(r == 3, F.concat(F.lit("1-"), a, F.lit("-"), b, F.lit("-"), c)).otherwise(d)
    )
    return F.when(F.length(d) == 10, made).otherwise(col(phone))


def tax_variant(tax_id: str | Column, key: Column, feed: str) -> Column:
    """A dash after the second digit in CRM; two neighbouring digits swapped in one of ten claims."""
    c = col(tax_id)
    if feed == "crm":
        return F.concat(F.substring(c, 1, 2), F.lit("-"), F.substring(c, 3, 100))
    if feed != "claims":
        return c
    at = bucket(key, feed + ":swap", 7) + F.lit(2)
    swapped = F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.lit(1)), F.substring(c, at, F.lit(1)), F.substring(c, at + 2, F.lit(100)))
    return F.when((bucket(key, feed + ":tax") < 10) & (F.length(c) == 9), swapped).otherwise(c)


def maybe_null(value: str | Column, key: Column, purpose: str, percent: int) -> Column:
    return F.when(bucket(key, purpose + ":null") >= percent, col(value))


def maybe_stale(status: str | Column, key: Column, percent: int = 10) -> Column:
    """The status, or active where it was not kept up to date."""
    return F.when(bucket(key, "stale") < percent, F.lit("active")).otherwise(col(status))


def messy_feed(entities: DataFrame, feed: str) -> DataFrame:
    """The records of one feed. ``entities``: entity_id, name, tax_id, state, city, zip, address, phone, status."""
    key = F.col("entity_id")
    held = entities.where(bucket(key, feed + ":held") < COVERAGE[feed])
    if feed == "crm":
        copies = F.when(bucket(key, "twice") < TWICE, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        held = held.withColumn("copy", F.explode(copies))
    else:
        held = held.withColumn("copy", F.lit(0))
    one = F.concat_ws(":", key.cast("string"), F.col("copy").cast("string"))
    return held.select(
        F.lit(feed).alias("feed"), "entity_id", "copy", name_variant("name", one, feed).alias("name"), tax_variant("tax_id", one, feed).alias("tax_id"),
        state_variant("state", one, feed).alias("state"), "city", zip_variant("zip", one, feed).alias("zip"), address_variant("address", one, feed).alias("address"),
        maybe_null(phone_variant("phone", one, feed), one, feed + ":phone", 15).alias("phone"), maybe_stale("status", one).alias("status"),
    )


def orphans(entities: DataFrame, percent: int = 5) -> DataFrame:
    """Claims records of organisations that no other feed knows: the chosen entities under another name, without a tax id."""
    key = F.col("entity_id")
    return entities.where(bucket(key, "orphan") < percent).select(
        F.lit("claims").alias("feed"), (-key).alias("entity_id"), F.lit(0).alias("copy"), F.concat(F.lit("Regional Plan "), key.cast("string")).alias("name"), F.lit(None).cast("string").alias("tax_id"),
        "state", "city", "zip", "address", F.lit(None).cast("string").alias("phone"), "status",
    )


def confusions(entities: DataFrame, families: DataFrame, percent: int = 25) -> DataFrame:
    """Claims records of children under their parents' names. ``families``: entity_id, parent_name."""
    key = F.col("entity_id")
    both = entities.join(families, "entity_id").where(bucket(key, "confused") < percent)
    return both.select(F.lit("claims").alias("feed"), "entity_id", F.lit(2).alias("copy"), F.col("parent_name").alias("name"), "tax_id", "state", "city", "zip", "address", "phone", "status")


def messy(entities: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """All feeds' records, with orphans and, given ``families``, confusions."""
    parts = [messy_feed(entities, f) for f in COVERAGE] + [orphans(entities)] + ([confusions(entities, families)] if families is not None else [])
    return reduce(DataFrame.unionByName, parts)
