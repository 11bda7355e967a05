"""Raw feeds to the unified record, and blocking keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.text import clean_name, digits, state_from_any, zip4, zip5
from concord.settings import UNIFIED


def _unified(df: DataFrame, feed: str, prefix: str, key: str, name: str, rank: int, columns: dict[str, Column]) -> DataFrame:
    text = F.lit(None).cast("string")
    base = {c: text for c in UNIFIED} | {
        "source_record_id": F.concat(F.lit(prefix + ":"), F.col(key).cast("string")),
        "source_system": F.lit(feed),
        "source_id": F.col(key).cast("string"),
        "payor_name": F.trim(name),
        "payor_name_clean": clean_name(name, feed),
        "is_active": F.lit(None).cast("boolean"),
        "effective_date": F.lit(None).cast("date"),
        "termination_date": F.lit(None).cast("date"),
        "source_trust_rank": F.lit(rank),
        "loaded_at": F.col("loaded_at"),
    }
    base |= columns
    return df.select(*[base[c].alias(c) for c in UNIFIED])


def standardize_crm(df: DataFrame) -> DataFrame:
    return _unified(df, "crm", "crm", "src_payor_id", "payor_name", 1, {
        "payor_name_alt": F.trim("payor_name_2"), "tax_id": digits("tax_id"), "npi": F.trim("npi"), "cms_plan_id": F.upper(F.trim("cms_plan_id")),
        "address_line_1": F.trim("address_line_1"), "address_line_2": F.trim("address_line_2"), "city": F.upper(F.trim("city")),
        "state_code": F.upper(F.left(F.trim("state"), F.lit(2))), "zip_code": zip5("zip"), "zip_plus_4": zip4("zip"), "phone": digits("phone"), "website": F.trim("website"),
        "payor_type": F.lower(F.trim("payor_type")), "parent_ref": F.col("parent_payor_id"), "is_active": F.col("status") == "active",
        "effective_date": F.expr("try_cast(cast(effective_date as string) as date)"), "termination_date": F.expr("try_cast(cast(termination_date as string) as date)"),
    })


def standardize_claims(df: DataFrame) -> DataFrame:
    part = lambda n: F.nullif(F.trim(F.split_part("address", F.lit(","), F.lit(n))), F.lit(""))
    return _unified(df, "claims", "claims", "claims_payor_code", "payor_name", 3, {
        "tax_id": digits("tax_id"), "address_line_1": F.when(F.col("city").isNull(), part(1)), "city": F.upper(F.coalesce(F.trim("city"), part(2))),
        "state_code": state_from_any("state"), "zip_code": zip5("zip"), "zip_plus_4": zip4("zip"), "payor_type": F.lower(F.trim("payor_type")),
        "line_of_business": F.col("line_of_business"), "is_active": F.col("is_active"),
    })


def standardize_credentialing(df: DataFrame) -> DataFrame:
    """The layout of this feed is inferred from its columns."""
    return _unified(df, "credentialing", "credentialing", "cred_payor_id", "organization_name", 2, {
        "payor_name_alt": F.trim("doing_business_as"), "tax_id": digits("ein"), "address_line_1": F.trim("street_address"), "address_line_2": F.trim("suite"),
        "city": F.upper(F.trim("city")), "state_code": F.upper(F.left(F.trim("state_code"), F.lit(2))), "zip_code": zip5("postal_code"), "zip_plus_4": zip4("postal_code"),
        "phone": digits("contact_phone"), "payor_type": F.lower(F.trim("plan_type")), "is_active": F.col("network_status") == "in_network",
    })


def standardize_reference(df: DataFrame) -> DataFrame:
    return _unified(df, "cms_reference", "ref", "ref_id", "official_name", 4, {
        "payor_name_alt": F.trim("parent_org_name"), "tax_id": digits("tax_id"), "cms_plan_id": F.upper(F.trim("cms_contract_id")), "state_code": F.upper(F.left(F.trim("state"), F.lit(2))),
        "payor_type": F.lower(F.trim("plan_type")), "parent_ref": F.trim("parent_org_name"), "is_active": F.lit(True),
    })


STANDARDIZE = {"crm": standardize_crm, "credentialing": standardize_credentialing, "claims": standardize_claims, "cms_reference": standardize_reference}


def with_keys(df: DataFrame) -> DataFrame:
    name = F.coalesce("payor_name_clean", F.lit(""))
    return df.withColumns({
        "block_name_key": F.concat(F.left(name, F.lit(6)), F.coalesce("state_code", F.lit("XX"))),
        "block_tax_id": F.col("tax_id"),
        "block_zip3_name4": F.concat(F.coalesce(F.left("zip_code", F.lit(3)), F.lit("XXX")), F.left(name, F.lit(4))),
    })


def union_all(feeds: dict[str, DataFrame]) -> DataFrame:
    """All feeds in the unified layout, with blocking keys."""
    return with_keys(reduce(DataFrame.unionByName, [STANDARDIZE[n](feeds[n]) for n in STANDARDIZE if n in feeds]))
