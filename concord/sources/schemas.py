"""Declared layouts of the raw feeds: types, required columns and defaults, and layers' names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

# fixed values: the columns of each feed in their order
LAYOUTS = {
    "crm": "src_payor_id string not null, payor_name string, payor_name_2 string, tax_id string, npi string, cms_plan_id string, address_line_1 string, address_line_2 string, city string, state string, zip string, "
    "phone string, website string, payor_type string, parent_payor_id string, status string, effective_date date, termination_date date, loaded_at timestamp, source_system string",
    "claims": "claims_payor_code string not null, payor_name string, tax_id string, address string, city string, state string, zip string, payor_type string, line_of_business string, is_active boolean, "
    "loaded_at timestamp, source_system string",
    "credentialing": "cred_payor_id string not null, organization_name string, doing_business_as string, ein string, street_address string, suite string, city string, state_code string, postal_code string, "
    "contact_phone string, contact_email string, plan_type string, network_status string, loaded_at timestamp, source_system string",
    "cms_reference": "ref_id string not null, official_name string, parent_org_name string, tax_id string, cms_contract_id string, plan_type string, state string, enrollment_count int, star_rating double, "
    "source_url string, loaded_at timestamp, source_system string",
}


def declared(feed: str) -> StructType:
    return _parse_datatype_string(LAYOUTS[feed])


def conform(df: DataFrame, feed: str) -> DataFrame:
    """``df`` in the feed's layout: columns in order and cast, missing ones and nulls with a default filled; a null in a required column fails the job."""
    defaults = {"loaded_at": F.current_timestamp(), "source_system": F.lit(feed)}
    out = []
    for f in declared(feed):
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, defaults[f.name])
        if not f.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"{feed}.{f.name} is null")).cast(f.dataType))
        out.append(value.alias(f.name))
    return df.select(out)


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """``df`` with a column of nulls, if it has none of that name."""
    return df if name.lower() in {c.lower() for c in df.columns} else df.withColumn(name, F.lit(None).cast(kind))


def layer_name(custom: str | None, target: str) -> str:
    """The name of a layer: the custom one without spaces around it, else the target's."""
    return custom.strip() if custom and custom.strip() else target
