"""Source feeds: four record layouts derived from ``part``, and readers and writers for files.

Every tenth entity is a group that the ones after it name as their parent, and one of these holds its name in its
own. Claims have slips in tax ids: a wrong last digit, or two digits changed about.

The derivation is plain SQL that Spark and DuckDB read alike (integer modulus, md5, string functions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.settings import STATES

_CODES = "".join(STATES.values())
_NAMES = "".join(n.ljust(20) for n in STATES)

ENTITY = f"""
SELECT p_partkey AS k,
  CASE WHEN p_partkey % 10 = 0 THEN upper(substr(md5(cast(p_partkey as string)), 1, 6)) || ' GROUP OF COMPANIES'
    WHEN p_partkey % 10 = 5 THEN upper(substr(md5(cast(p_partkey - 5 as string)), 1, 6)) || ' GROUP OF COMPANIES ' || upper(p_name) || ' HEALTH PLAN'
    ELSE upper(substr(md5(cast(p_partkey as string)), 1, 6)) || ' ' || upper(p_name) || ' HEALTH PLAN' END AS nm,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE cast(((p_partkey - CASE WHEN p_partkey % 10 = 1 THEN 1 ELSE 0 END) * 104729) % 900000000 + 100000000 as string) END AS tax,
  substr('{_CODES}', cast((p_partkey % 51) * 2 + 1 as int), 2) AS st,
  trim(substr('{_NAMES}', cast((p_partkey % 51) * 20 + 1 as int), 20)) AS st_name,
  cast((p_partkey * 37) % 90000 + 10000 as string) AS zip,
  cast((p_partkey * 7919) % 9000000 + 1000000 as string) AS local7,
  cast(200 + p_partkey % 700 as string) AS area,
  cast(concat('2024-', lpad(cast(1 + p_partkey % 12 as string), 2, '0'), '-', lpad(cast(1 + p_partkey % 28 as string), 2, '0'), ' 00:00:00') as timestamp) AS ts
FROM part
"""

FEEDS = {
    "crm": """
SELECT 'CRM-' || k AS src_payor_id, nm || CASE WHEN k % 10 = 0 THEN '' WHEN k % 4 = 0 THEN ', Inc.' WHEN k % 4 = 1 THEN ' LLC' WHEN k % 4 = 2 THEN ' Corp' ELSE '' END AS payor_name,
  CASE WHEN k % 6 = 0 THEN 'DBA ' || nm END AS payor_name_2, substr(tax, 1, 2) || '-' || substr(tax, 3) AS tax_id,
  CASE WHEN k % 3 = 0 THEN cast(1000000000 + k as string) END AS npi, CASE WHEN k % 2 = 0 THEN 'H' || lpad(cast(k as string), 6, '0') END AS cms_plan_id,
  cast(k % 9000 + 1 as string) || CASE WHEN k % 2 = 0 THEN ' Main St' ELSE ' Oak Avenue' END AS address_line_1,
  CASE WHEN k % 3 = 0 THEN 'Ste ' || cast(k % 100 as string) END AS address_line_2, 'City' || cast(k % 97 as string) AS city, st AS state,
  CASE WHEN k % 5 = 0 THEN zip || '-' || lpad(cast(k % 10000 as string), 4, '0') ELSE zip END AS zip, '(' || area || ') ' || substr(local7, 1, 3) || '-' || substr(local7, 4) AS phone,
  CASE WHEN k % 4 = 0 THEN 'www.p' || k || '.example' END AS website, CASE k % 3 WHEN 0 THEN 'Commercial' WHEN 1 THEN 'Medicaid' ELSE 'Medicare' END AS payor_type,
  CASE WHEN k % 10 <> 0 THEN 'CRM-' || (k - k % 10) END AS parent_payor_id, CASE WHEN k % 8 = 0 THEN 'inactive' ELSE 'active' END AS status,
  cast(concat('20', lpad(cast(10 + k % 10 as string), 2, '0'), '-01-01') as date) AS effective_date, CASE WHEN k % 8 = 0 THEN date '2030-12-31' END AS termination_date, ts AS loaded_at
FROM e WHERE (k * 7919 + 11) % 100 < 90""",
    "claims": """
SELECT 'CLM-' || k AS claims_payor_code, CASE WHEN k % 3 = 0 THEN lower(nm) ELSE nm || ' Inc' END AS payor_name,
  CASE WHEN k % 10 = 3 THEN substr(tax, 1, 8) || cast((cast(substr(tax, 9, 1) as int) + 1) % 10 as string) WHEN k % 10 = 8 THEN substr(tax, 1, 4) || substr(tax, 6, 1) || substr(tax, 5, 1) || substr(tax, 7) ELSE tax END AS tax_id,
  cast(k % 9000 + 1 as string) || ' Main Street, Suite 5, City' || cast(k % 97 as string) || ', ' || st AS address,
  CASE WHEN k % 4 <> 0 THEN 'City' || cast(k % 97 as string) END AS city, CASE k % 5 WHEN 0 THEN st_name WHEN 1 THEN lower(st) ELSE st END AS state, zip,
  CASE k % 3 WHEN 0 THEN 'commercial' WHEN 1 THEN 'medicaid' ELSE 'medicare' END AS payor_type, CASE WHEN k % 2 = 0 THEN 'HMO' ELSE 'PPO' END AS line_of_business,
  k % 9 <> 0 AS is_active, ts AS loaded_at
FROM e WHERE (k * 7919 + 37) % 100 < 80""",
    "credentialing": """
SELECT 'CRED-' || k AS cred_payor_id, nm || CASE WHEN k % 5 = 0 THEN ' Ltd.' ELSE '' END AS organization_name, CASE WHEN k % 2 = 0 THEN 'DBA ' || nm END AS doing_business_as, tax AS ein,
  cast(k % 9000 + 1 as string) || CASE WHEN k % 2 = 0 THEN ' Main Street' ELSE ' Oak Ave' END AS street_address, CASE WHEN k % 3 = 0 THEN 'Suite ' || cast(k % 100 as string) END AS suite,
  'City' || cast(k % 97 as string) AS city, st AS state_code, zip AS postal_code, CASE WHEN k % 7 = 2 THEN NULL ELSE area || '.' || substr(local7, 1, 3) || '.' || substr(local7, 4) END AS contact_phone,
  'info@p' || k || '.example' AS contact_email, CASE k % 3 WHEN 0 THEN 'Commercial' WHEN 1 THEN 'Medicaid' ELSE 'Medicare' END AS plan_type,
  CASE k % 3 WHEN 0 THEN 'in_network' WHEN 1 THEN 'out_of_network' ELSE 'pending' END AS network_status, ts AS loaded_at
FROM e WHERE (k * 7919 + 59) % 100 < 60""",
    "cms_reference": """
SELECT 'REF-' || k AS ref_id, nm || CASE WHEN k % 2 = 0 THEN ' Inc.' ELSE '' END AS official_name,
  upper(substr(md5(cast(k - k % 10 as string)), 1, 6)) || ' GROUP OF COMPANIES' AS parent_org_name, tax AS tax_id, 'H' || lpad(cast(k as string), 6, '0') AS cms_contract_id,
  CASE k % 3 WHEN 0 THEN 'commercial' WHEN 1 THEN 'medicaid' ELSE 'medicare' END AS plan_type, st AS state, cast(k * 13 % 100000 as int) AS enrollment_count,
  cast(k % 5 as double) AS star_rating, 'https://example/' || k AS source_url, ts AS loaded_at
FROM e WHERE (k * 7919 + 83) % 100 < 40""",
}


def feed_sql(name: str) -> str:
    return f"WITH e AS ({ENTITY}) {FEEDS[name]}"


def derive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four raw feeds of the entities in ``part``, whose rows are spread first: many of them fit one split of a file, and all that follows is made of them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return {n: spark.sql(feed_sql(n).replace("FROM part", "FROM {part}"), part=part) for n in FEEDS}


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A feed from CSV with a header and a declared schema; empty fields are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a JSON array of families, each with what it inherits from its family."""
    fam = spark.read.option("multiLine", True).json(path)
    ent = fam.selectExpr("family_id", "parent", "tax_id as family_tax_id", "state as family_state", "city as family_city", "explode(entities) as e")
    has = {f.name for f in ent.schema["e"].dataType.fields}
    pick = lambda c: f"coalesce(e.{c}, family_{c})" if c in has else f"family_{c}"
    return ent.selectExpr("family_id", "parent", "e.name as name", "e.type as type", f"{pick('tax_id')} as tax_id", f"{pick('state')} as state", f"{pick('city')} as city")
