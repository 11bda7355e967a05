"""The engine's registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import similarity as sim
from concord.functions.text import expand
from concord.operators import cluster, master, matching, quality, staging, steward, survivorship
from concord.plans import oracle
from concord.plans.oracle import BOTH, cmp, jac, ngr, nrm, sql, trans
from concord.plans.pipeline import Mastering, mastering, sample_decisions
from concord.settings import ABBREVIATIONS, DEFAULT
from concord.sources import mess, schemas
from concord.storage import stored

_STAGED = "source_record_id source_system source_id payor_name payor_name_clean payor_name_alt tax_id npi cms_plan_id address_line_1 address_line_2 city state_code zip_code zip_plus_4 phone website payor_type line_of_business parent_ref is_active effective_date termination_date source_trust_rank".split()
_KEYS = "source_record_id_a source_record_id_b"
_FIELDS = "payor_name npi tax_id address_line_1 phone website".split()
Query = Callable[[SparkSession, str], DataFrame]


def _staged(feed: str) -> Query:
    return lambda spark, d: staging.STANDARDIZE[feed](mastering(spark, d).raw[feed]).select(_STAGED)


def _pairs(column: str, *fields: str) -> Callable[[SparkSession, str], DataFrame]:
    """Candidate pairs with the two values of ``fields``, as <field>_a and <field>_b."""

    def rows(spark: SparkSession, d: str) -> DataFrame:
        m = mastering(spark, d)
        side = lambda s: m.staged.select(F.col("source_record_id").alias(f"source_record_id_{s}"), *[F.col(f).alias(f"{f}_{s}") for f in fields])
        return m.pairs.join(side("a"), "source_record_id_a").join(side("b"), "source_record_id_b")

    return rows


def _similarity(fields: tuple[str, ...], score) -> Query:  # noqa: ANN001
    def run(spark: SparkSession, d: str) -> DataFrame:
        args = [f"{f}_{s}" for f in fields for s in "ab"]
        return _pairs("score", *fields)(spark, d).select("source_record_id_a", "source_record_id_b", F.round(score(*args), 4).alias("score"))

    return run


def _similarity_sql(fields: tuple[str, ...], expr: str) -> str:
    cols = ", ".join(f"a.{f} AS {f}_a, b.{f} AS {f}_b" for f in fields)
    return sql(f"SELECT source_record_id_a, source_record_id_b, round({expr}, 4) AS score FROM (SELECT p.*, {cols} FROM pairs p JOIN u a ON a.source_record_id = source_record_id_a JOIN u b ON b.source_record_id = source_record_id_b)")


_D = lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"
_name, _addr, _tax, _phone, _cms = ("payor_name_clean",), ("address_line_1",), ("tax_id",), ("phone",), ("cms_plan_id",)
_two = lambda f: (f"{f}_a", f"{f}_b")
_expanded = lambda c: "array_to_string(list_transform(string_split_regex(upper(trim(" + c + ")), '\\s+'), lambda x: coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items()) + "}[x], x)), ' ')"
_jw = lambda a, b: f"CASE WHEN {BOTH(a, b)} THEN jaro_winkler_similarity(upper(trim({a})), upper(trim({b}))) END"


def _when(a: str, b: str, expr: str) -> str:
    return f"CASE WHEN {BOTH(a, b)} THEN {expr} END"


_p, _t, _c = _two("phone"), _two("tax_id"), _two("cms_plan_id")
_PHONE = {k: [_D(x) for x in _p] for k in ("d",)}["d"]
_TAX = [_D(x) for x in _t]

#: name -> (fields, column, SQL or None)
SIMILARITIES: dict[str, tuple[tuple[str, ...], object, str | None]] = {
    "sim_name_jw": (_name, sim.name_jw, _jw(*_two("payor_name_clean"))),
    "sim_name_ngr": (_name, sim.name_ngr, ngr(*_two("payor_name_clean"))),
    "sim_name_abr": (_name, sim.name_abr, _when(*_two("payor_name_clean"), f"jaro_winkler_similarity({_expanded('payor_name_clean_a')}, {_expanded('payor_name_clean_b')})")),
    "sim_name_tsr": (_name, sim.name_tsr, None),
    "sim_name_pho": (_name, sim.name_pho, None),
    "sim_addr_jac": (_addr, sim.addr_jac, jac(*_two("address_line_1"))),
    "sim_addr_nrm": (_addr, sim.addr_nrm, nrm(*_two("address_line_1"))),
    "sim_addr_cmp": (_addr, sim.addr_cmp, cmp(*_two("address_line_1"))),
    "sim_addr_zip": (("address_line_1", "zip_code"), sim.addr_zip, _when(*_two("zip_code"), f"0.5 * CASE WHEN zip_code_a = zip_code_b THEN 1.0 WHEN left(zip_code_a, 3) = left(zip_code_b, 3) THEN 0.5 ELSE 0.0 END + 0.5 * coalesce({jac(*_two('address_line_1'))}, 0.0)")),
    "sim_phone_e164": (_phone, sim.phone_e164, _when(*_p, f"CASE WHEN length({_PHONE[0]}) >= 10 AND length({_PHONE[1]}) >= 10 THEN CASE WHEN right({_PHONE[0]}, 10) = right({_PHONE[1]}, 10) THEN 1.0 ELSE 0.0 END WHEN length({_PHONE[0]}) >= 7 AND length({_PHONE[1]}) >= 7 AND right({_PHONE[0]}, 7) = right({_PHONE[1]}, 7) THEN 1.0 ELSE 0.0 END")),
    "sim_phone_l7": (_phone, sim.phone_l7, _when(*_p, f"CASE WHEN length({_PHONE[0]}) >= 7 AND length({_PHONE[1]}) >= 7 AND right({_PHONE[0]}, 7) = right({_PHONE[1]}, 7) THEN 1.0 ELSE 0.0 END")),
    "sim_phone_ac": (_phone, sim.phone_ac, _when(*_p, f"CASE WHEN length({_PHONE[0]}) < 10 OR length({_PHONE[1]}) < 10 OR left(right({_PHONE[0]}, 10), 3) <> left(right({_PHONE[1]}, 10), 3) THEN 0.0 WHEN right({_PHONE[0]}, 4) = right({_PHONE[1]}, 4) THEN 0.8 ELSE 0.3 END")),
    "sim_tin_exact": (_tax, sim.tin_exact, _when(*_t, f"CASE WHEN {_TAX[0]} <> '' AND {_TAX[0]} = {_TAX[1]} THEN 1.0 ELSE 0.0 END")),
    "sim_tin_trans": (_tax, sim.tin_trans, trans(*_t)),
    "sim_tin_pfx": (_tax, sim.tin_pfx, _when(*_t, f"CASE WHEN length({_TAX[0]}) >= 5 AND length({_TAX[1]}) >= 5 THEN CASE WHEN left({_TAX[0]}, 2) <> left({_TAX[1]}, 2) THEN 0.0 WHEN len(list_filter(range(3, 1 + least(length({_TAX[0]}), length({_TAX[1]}))), lambda i: substr({_TAX[0]}, i::INT, 1) = substr({_TAX[1]}, i::INT, 1))) >= 5 THEN 0.6 ELSE 0.3 END END")),
    "sim_cms_exact": (_cms, sim.cms_exact, _when(*_c, "CASE WHEN upper(trim(cms_plan_id_a)) = upper(trim(cms_plan_id_b)) THEN 1.0 ELSE 0.0 END")),
    "sim_cms_pfx": (_cms, sim.cms_pfx, _when(*_c, "CASE WHEN length(trim(cms_plan_id_a)) >= 5 AND length(trim(cms_plan_id_b)) >= 5 AND left(upper(trim(cms_plan_id_a)), 5) = left(upper(trim(cms_plan_id_b)), 5) THEN 0.85 ELSE 0.0 END")),
}

_SCORE = f"{_KEYS} match_rule score_name score_tax_id score_address score_phone score_cms_plan_id overall_score winning_name_strategy winning_addr_strategy".split()
_CAND = "candidate_id source_record_id_a source_record_id_b overall_score match_rule auto_decision steward_decision final_decision".split()
_GOLD = "master_payor_id payor_name payor_name_alt tax_id npi cms_plan_id address_line_1 address_line_2 city state_code zip_code phone website payor_type line_of_business is_active effective_date termination_date completeness_score source_count record_count confidence_score".split()


def _composite_v1(spark: SparkSession, d: str) -> DataFrame:
    """The earlier weighted score: tax and cms by equality of trimmed text, address by Jaccard, phone by the last seven digits."""
    rows = _pairs("score", "payor_name_clean", "tax_id", "address_line_1", "phone", "cms_plan_id")(spark, d)
    same = lambda f: sim.both(f"{f}_a", f"{f}_b", (F.trim(f"{f}_a") == F.trim(f"{f}_b")).cast("double"))
    scores = {"name": sim.name_jw("payor_name_clean_a", "payor_name_clean_b"), "tax": same("tax_id"), "address": sim.addr_jac("address_line_1_a", "address_line_1_b"), "phone": sim.phone_l7("phone_a", "phone_b"), "cms": same("cms_plan_id")}
    return rows.select("source_record_id_a", "source_record_id_b", F.coalesce(sim.composite(scores), F.lit(0.0)).alias("composite"))


def _composite_v1_sql() -> str:
    s = {"0.35": _jw(*_two("payor_name_clean")), "0.25": _when(*_t, "CASE WHEN trim(tax_id_a) = trim(tax_id_b) THEN 1.0 ELSE 0.0 END"), "0.20": jac(*_two("address_line_1")), "0.10": SIMILARITIES["sim_phone_l7"][2], "0.100": _when(*_c, "CASE WHEN trim(cms_plan_id_a) = trim(cms_plan_id_b) THEN 1.0 ELSE 0.0 END")}
    total = " + ".join(f"CASE WHEN ({e}) IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for w, e in s.items())
    value = " + ".join(f"coalesce(({e}) * {w}::DOUBLE, 0)" for w, e in s.items())
    return _similarity_sql(("payor_name_clean", "tax_id", "address_line_1", "phone", "cms_plan_id"), f"coalesce(({value}) / nullif({total}, 0), 0.0)").replace("AS score FROM (SELECT p", "AS composite FROM (SELECT p")


def _rule(kind: str) -> Query:
    """One field survived by one rule, over the groups of the pipeline."""
    field = {"earliest": "effective_date", "latest": "termination_date", "any_true": "is_active", "most_frequent": "payor_type", "most_complete": "payor_name_alt", "longest_value": "payor_name"}.get(kind, "phone")

    def run(spark: SparkSession, d: str) -> DataFrame:
        m = mastering(spark, d)
        overrides = None
        if kind == "manual":
            overrides = m.groups.where("is_survivor").select("match_group_id", F.lit(field).alias("field"), F.lit("0000000000").alias("value")).where(F.col("match_group_id") < "8")
        return survivorship.survive(m.staged, m.groups, {field: (kind, None, survivorship._PRIORITY)}, overrides=overrides).select("match_group_id", F.col(field).alias("value"))

    return run


def _rule_sql(kind: str) -> str:
    ranked = "first(phone ORDER BY source_trust_rank, source_record_id) FILTER (WHERE phone IS NOT NULL)"
    value = {
        "source_priority": ranked, "any_non_null": ranked, "manual": f"CASE WHEN match_group_id < '8' THEN '0000000000' ELSE {ranked} END",
        "most_recent": "first(phone ORDER BY loaded_at DESC NULLS LAST, source_record_id) FILTER (WHERE phone IS NOT NULL)",
        "most_complete": "first(payor_name_alt ORDER BY -length(payor_name_alt), source_record_id) FILTER (WHERE payor_name_alt <> '')",
        "longest_value": "first(payor_name ORDER BY -length(payor_name), source_record_id) FILTER (WHERE payor_name <> '')",
        "earliest": "min(effective_date)", "latest": "max(termination_date)", "any_true": "bool_or(is_active)",
    }
    if kind == "most_frequent":
        return sql("SELECT match_group_id, first(payor_type ORDER BY n DESC, payor_type) AS value FROM (SELECT match_group_id, payor_type, count(payor_type) AS n FROM u JOIN grp USING (source_record_id) GROUP BY 1, 2) GROUP BY 1")
    return sql(f"SELECT match_group_id, {value[kind]} AS value FROM u JOIN grp USING (source_record_id) GROUP BY match_group_id")


def _golden(spark: SparkSession, d: str) -> DataFrame:
    return mastering(spark, d).golden.withColumn("confidence_score", F.round("confidence_score", 4)).select(_GOLD)


def _field_sources(spark: SparkSession, d: str) -> DataFrame:
    return mastering(spark, d).golden.select("master_payor_id", F.explode("field_sources").alias("field", "source_record_id"))


def _field_sources_sql() -> str:
    """One part for each rule that takes the value from a record."""
    parts = []
    for f, (rule, _, priority) in survivorship.RULES.items():
        if rule in ("any_true", "most_frequent", "latest"):
            continue
        rank = "source_trust_rank"
        if rule == "source_priority" and priority != survivorship._PRIORITY:
            rank = "CASE source_system " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(priority)) + " ELSE 99 END"
        order = {"source_priority": rank, "most_recent": "loaded_at DESC NULLS LAST", "most_complete": f"length({f}) DESC", "earliest": f}[rule]
        held = f"{f} <> ''" if rule == "most_complete" else f"{f} IS NOT NULL"
        parts.append(f"SELECT match_group_id AS master_payor_id, '{f}' AS field, first(source_record_id ORDER BY {order}, source_record_id) AS source_record_id FROM u JOIN grp USING (source_record_id) WHERE {held} GROUP BY 1")
    return sql(" UNION ALL ".join(parts))


def _kpis(spark: SparkSession, d: str) -> DataFrame:
    m = mastering(spark, d)
    candidates = m.decided(DEFAULT.review)
    parts = {"records": m.staged, "golden": m.groups.where("is_survivor"), "candidates": candidates, "pending_reviews": candidates.where("auto_decision = 'review' and steward_decision is null"), "matches": candidates.where("final_decision = 'match'")}
    out = None
    for k, v in parts.items():
        row = v.agg(F.count(F.lit(1)).alias("value")).select(F.lit(k).alias("kpi"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def _review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Stored before it is sorted: the sort reads its input twice. Pairs that are no review need no scores."""
    rows = matching.decide(matching.score_blocks(mastering(spark, d).staged, least=DEFAULT.review, drop=True)).select(_CAND)
    return matching.review_queue(stored(rows.where("auto_decision = 'review'"), "reviews"))


def _dq(spark: SparkSession, d: str) -> DataFrame:
    """Failing rows of each data-quality assertion."""
    m = mastering(spark, d)
    candidates = m.decided(DEFAULT.auto_match)
    checks = {
        "not_null_tax": quality.not_null(m.staged, "tax_id"), "unique_record": quality.unique(m.staged, "source_record_id"), "unique_tax": quality.unique(m.staged, "tax_id"),
        "accepted_decision": quality.accepted(candidates, "final_decision", ["match", "no_match"]), "accepted_rule": quality.accepted(candidates, "match_rule", ["DET-1", "DET-2"]),
        "fk_xref_golden": quality.relationship(m.xref, "master_payor_id", m.golden, "master_payor_id"), "orphans": quality.orphans(m.staged, m.xref),
    }
    out = None
    for k, v in checks.items():
        row = v.agg(F.count(F.lit(1)).alias("failing")).select(F.lit(k).alias("check"), "failing")
        out = row if out is None else out.unionByName(row)
    return out


def _config_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = spark.createDataFrame([(f, r, fb) for f, (r, fb, _) in survivorship.RULES.items()], "field_name string, rule_type string, fallback_rule string")
    new = spark.createDataFrame([("phone", "source_priority", None), ("fax", "most_recent", None)], old.schema)
    return steward.upsert(old, new, "field_name")


def _config_sql() -> str:
    rows = ", ".join(f"('{f}', '{r}', " + (f"'{fb}')" if fb else "NULL)") for f, (r, fb, _) in survivorship.RULES.items() if f != "phone")
    return f"SELECT * FROM (VALUES {rows}, ('phone', 'source_priority', NULL), ('fax', 'most_recent', NULL)) t(field_name, rule_type, fallback_rule)"


def _compare(spark: SparkSession, d: str) -> DataFrame:
    m = mastering(spark, d)
    return steward.compare_fields(m.pairs, m.staged)


_PART = "p_partkey AS entity_id, concat('Blue Cross Blue Shield of ', p_brand, ', Inc.') AS name, lpad(cast(p_partkey AS string), 9, '1') AS tax_id, 'OH' AS state, 'Erie' AS city, '44101' AS zip, concat(cast(p_size AS string), ' Main Street') AS address, concat('312555', lpad(cast(p_partkey % 10000 AS string), 4, '0')) AS phone, 'inactive' AS status"


def _messy(spark: SparkSession, d: str) -> DataFrame:
    """Entities made of ``part``, as four untidy feeds hold them, with orphans and confusions."""
    part = spark.read.parquet(f"{d}/part.parquet")
    families = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("Parent of "), "p_brand").alias("parent_name"))
    return mess.messy(spark.sql(f"SELECT {_PART} FROM {{part}}", part=part), families)


def _messy_sql() -> str:
    """The same, with each choice's bucket from md5 in DuckDB."""
    one, r = "entity_id || ':' || copy", lambda k, p, n=100: f"(('0x' || substr(md5({k} || '|{p}'), 1, 8))::UBIGINT % {n})::INT"
    bare = r"trim(regexp_replace(name, ',?\s*(Inc|LLC|Corp)\.?$', '', 'i'))"
    names = {
        "crm": f"CASE WHEN {r(one, 'crm:name')} < 10 THEN {bare} || ', Inc.' WHEN {r(one, 'crm:name')} < 20 THEN {bare} || ' LLC' WHEN {r(one, 'crm:name')} < 30 THEN {bare} || ' Corp' ELSE name END",
        "claims": f"CASE WHEN {r(one, 'claims:name')} < 40 THEN upper(name) WHEN {r(one, 'claims:name')} < 60 THEN {bare} WHEN {r(one, 'claims:name')} < 80 THEN replace({bare}, 'Blue Cross Blue Shield', 'BCBS') ELSE name END",
        "credentialing": f"CASE WHEN {r(one, 'credentialing:name')} < 25 THEN {bare} || ' Health Inc.' ELSE name END",
        "cms_reference": r"trim(regexp_replace(name, ',?\s*Inc\.?$', ''))",
    }
    swap = r(one, "claims:swap", 7)
    taxes = {"crm": "substr(tax_id, 1, 2) || '-' || substr(tax_id, 3)", "claims": f"CASE WHEN {r(one, 'claims:tax')} < 10 THEN substr(tax_id, 1, {swap} + 1) || substr(tax_id, {swap} + 3, 1) || substr(tax_id, {swap} + 2, 1) || substr(tax_id, {swap} + 4) ELSE tax_id END"}
    state = r(one, "claims:state", 1000)
    parts = []
    for f, share in mess.COVERAGE.items():
        zip_code = f"CASE WHEN {r(one, f + ':zip')} < 30 THEN zip || '-' || lpad({r(one, f + ':plus4', 10000)}::VARCHAR, 4, '0') ELSE zip END" if f in ("claims", "cms_reference") else "zip"
        kind, a, b, c = r(one, f + ":phone", 5), "substr(phone, 1, 3)", "substr(phone, 4, 3)", "substr(phone, 7)"
        phone = f"CASE {kind} WHEN 0 THEN '(' || {a} || ') ' || {b} || '-' || {c} WHEN 1 THEN {a} || '-' || {b} || '-' || {c} WHEN 2 THEN {a} || '.' || {b} || '.' || {c} WHEN 3 THEN '1-' || {a} || '-' || {b} || '-' || {c} ELSE phone END"
        copies = f"SELECT *, 0 AS copy FROM e UNION ALL SELECT *, 1 FROM e WHERE {r('entity_id', 'twice')} < {mess.TWICE}" if f == "crm" else "SELECT *, 0 AS copy FROM e"
        spelt = f"CASE WHEN {state} < 133 THEN 'Ohio' WHEN {state} < 266 THEN 'ohio' WHEN {state} < 400 THEN 'oh' ELSE state END" if f == "claims" else "state"
        parts.append(
            f"SELECT '{f}' AS feed, entity_id, copy, {names[f]} AS name, {taxes.get(f, 'tax_id')} AS tax_id, {spelt} AS state, city, {zip_code} AS zip, CASE WHEN {r(one, f + ':address')} < 40 THEN replace(address, 'Street', 'St') ELSE address END AS address, "
            f"CASE WHEN {r(one, f + ':phone:null')} >= 15 THEN {phone} END AS phone, CASE WHEN {r(one, 'stale')} < 10 THEN 'active' ELSE status END AS status FROM ({copies}) WHERE {r('entity_id', f + ':held')} < {share}"
        )
    parts.append(f"SELECT 'claims', -entity_id, 0, 'Regional Plan ' || entity_id, NULL, state, city, zip, address, NULL, status FROM e WHERE {r('entity_id', 'orphan')} < 5")
    parts.append(f"SELECT 'claims', entity_id, 2, 'Parent of ' || p_brand, tax_id, state, city, zip, address, phone, status FROM e JOIN part ON p_partkey = entity_id WHERE entity_id % 3 = 0 AND {r('entity_id', 'confused')} < 25")
    return f"WITH e AS (SELECT {_PART} FROM part) " + " UNION ALL ".join(parts)


_BANDED = "score_name score_tax_id score_address score_phone overall_score".split()
_PARENT = "(SELECT min(parent_master_id) FROM hier)"
_AUDIT = """SELECT md5(source_record_id_a || '|' || source_record_id_b || '|' || steward_decision || '|2024-06-01 00:00:00') AS change_id, candidate_id AS entity_id, steward_decision AS action FROM cand_d
  WHERE steward_decision IS NOT NULL"""


def _first_parent(m: Mastering) -> str:
    """The golden record that the drill-down queries open: of the parents that with the least id."""
    return m.hierarchy.agg(F.min("parent_master_id")).first()[0] or ""


def _audit_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of confirmed matches, and whether there is a third."""
    rows, more = steward.audit_page(steward.audit_rows(sample_decisions(mastering(spark, d).pairs)), 1, action="confirmed_match")
    return rows.select("change_id", "entity_id", F.lit(more).alias("more"))


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """The strategies before any run: a row of zeros each."""
    rows = spark.createDataFrame([(f, k) for f, ks in matching.STRATEGIES.items() for k in ks], "field_name string, strategy_id string")
    return rows.withColumns({c: F.lit(0).cast("long") for c in ("times_selected", "times_won")})


def _config(spark: SparkSession, d: str) -> DataFrame:
    """The survivorship configuration, its priorities read from JSON."""
    rows = spark.createDataFrame([(f, r, json.dumps(p or [])) for f, (r, _, p) in survivorship.RULES.items()], "field_name string, rule_type string, priority string")
    found = F.from_json("priority", "array<string>")
    return rows.select("field_name", "rule_type", F.size(found).alias("sources"), F.get(found, F.lit(0)).alias("first_source"))


_CELL = "SELECT source_record_id_a, source_record_id_b, '{f}' AS field, nullif(a.{f}, '') AS value_a, nullif(b.{f}, '') AS value_b FROM pairs p JOIN u a ON a.source_record_id = source_record_id_a JOIN u b ON b.source_record_id = source_record_id_b"

_QUERIES: dict[str, tuple[Query, str | None]] = {
    **{f"stg_{n}": (_staged(n), sql(f"SELECT {', '.join(_STAGED)} FROM stg_{n}")) for n in staging.STANDARDIZE},
    "stg_unioned_keys": (lambda s, d: mastering(s, d).records.select("source_record_id", "block_name_key", "block_tax_id", "block_zip3_name4"), sql("SELECT source_record_id, block_name_key, block_tax_id, block_zip3_name4 FROM u")),
    "blocking_pairs": (lambda s, d: mastering(s, d).pairs, sql("SELECT a.source_record_id AS source_record_id_a, b.source_record_id AS source_record_id_b FROM u a JOIN u b ON a.source_record_id < b.source_record_id AND (a.block_name_key = b.block_name_key OR (a.block_tax_id = b.block_tax_id AND a.block_tax_id <> '') OR a.block_zip3_name4 = b.block_zip3_name4)")),
    "block_sizes": (lambda s, d: matching.block_sizes(mastering(s, d).staged), sql(" UNION ALL ".join(f"SELECT '{k}' AS blocking_key, count(*) AS blocks, max(n) AS largest, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS comparisons FROM (SELECT {k}, count(*) AS n FROM u WHERE {k} <> '' GROUP BY 1)" for k in ("block_name_key", "block_tax_id", "block_zip3_name4")))),
    **{n: (_similarity(f, c), _similarity_sql(f, q) if q else None) for n, (f, c, q) in SIMILARITIES.items()},
    "composite_v1": (_composite_v1, _composite_v1_sql()),
    "ensemble_scores": (lambda s, d: mastering(s, d).scored.select(_SCORE), sql(f"SELECT {', '.join(_SCORE)} FROM scored".replace("source_record_id_a source_record_id_b", "source_record_id_a, source_record_id_b"))),
    "match_candidates": (lambda s, d: matching.decide(mastering(s, d).scored).select(_CAND), sql(f"SELECT {', '.join(_CAND)} FROM cand")),
    "candidates_with_decisions": (lambda s, d: matching.decide((m := mastering(s, d, decisions=True)).scored, m.log).select(_CAND), sql(f"SELECT {', '.join(_CAND)} FROM cand_d")),
    "review_queue": (_review_queue, sql(f"SELECT {', '.join(_CAND)} FROM cand WHERE auto_decision = 'review' AND steward_decision IS NULL")),
    "groups_connected": (lambda s, d: mastering(s, d).groups, sql("SELECT match_group_id, source_record_id, is_survivor, group_confidence FROM grp")),
    "groups_connected_uuid": (lambda s, d: mastering(s, d, ids="uuid5").groups, None),
    "groups_three_hop": (
        lambda s, d: (m := mastering(s, d)) and cluster.three_hop(m.staged.select(F.col("source_record_id").alias("node")), cluster.edges(m.candidates)),
        sql("SELECT node, least(c2, coalesce((SELECT min(y.c2) FROM edge JOIN (SELECT x.node, least(c1, coalesce((SELECT min(z.c1) FROM edge JOIN (SELECT source_record_id AS node, coalesce((SELECT min(dst) FROM edge WHERE src = source_record_id), source_record_id) AS c1 FROM u) z ON z.node = dst WHERE src = x.node), c1)) AS c2 FROM (SELECT source_record_id AS node, coalesce((SELECT min(dst) FROM edge WHERE src = source_record_id), source_record_id) AS c1 FROM u) x) y ON y.node = dst WHERE src = w.node), c2)) AS component FROM (SELECT x.node, least(c1, coalesce((SELECT min(z.c1) FROM edge JOIN (SELECT source_record_id AS node, coalesce((SELECT min(dst) FROM edge WHERE src = source_record_id), source_record_id) AS c1 FROM u) z ON z.node = dst WHERE src = x.node), c1)) AS c2 FROM (SELECT source_record_id AS node, coalesce((SELECT min(dst) FROM edge WHERE src = source_record_id), source_record_id) AS c1 FROM u) x) w"),
    ),
    "golden": (_golden, sql(f"SELECT {', '.join('round(confidence_score, 4) AS confidence_score' if c == 'confidence_score' else c for c in _GOLD)} FROM gold")),
    "xref": (lambda s, d: mastering(s, d).xref, sql("SELECT source_record_id, master_payor_id, source_system, source_id, match_confidence FROM xr")),
    "field_sources": (_field_sources, _field_sources_sql()),
    "tax_conflicts": (lambda s, d: survivorship.tax_conflicts((m := mastering(s, d)).staged, m.groups), sql("SELECT match_group_id AS entity_id, 'conflict_detected' AS action, 'tax_id' AS field_name, array_to_string(list_sort(list(DISTINCT tax_id)), ',') AS new_value FROM u JOIN grp USING (source_record_id) WHERE tax_id <> '' GROUP BY 1 HAVING count(DISTINCT tax_id) > 1")),
    **{f"survivorship_rule_{k}": (_rule(k), _rule_sql(k)) for k in survivorship.KINDS},
    "hierarchy_inferred": (lambda s, d: mastering(s, d).hierarchy, sql("SELECT * FROM hier")),
    "payor_hierarchy": (lambda s, d: master.hierarchy(mastering(s, d).hierarchy).select("hierarchy_id", "parent_master_id", "child_master_id", "relationship_type", "source", "steward_confirmed"), sql("SELECT md5(parent_master_id || '|' || child_master_id || '|' || inference_method) AS hierarchy_id, parent_master_id, child_master_id, 'parent_company' AS relationship_type, inference_method AS source, false AS steward_confirmed FROM hier")),
    "unassigned": (lambda s, d: master.unassigned((m := mastering(s, d)).golden.select("master_payor_id", "payor_name"), m.hierarchy), sql("SELECT master_payor_id, payor_name FROM gold WHERE master_payor_id NOT IN (SELECT parent_master_id FROM hier) AND master_payor_id NOT IN (SELECT child_master_id FROM hier)")),
    "kpis": (_kpis, sql("SELECT 'records' AS kpi, count(*) AS value FROM u UNION ALL SELECT 'golden', count(DISTINCT match_group_id) FROM grp UNION ALL SELECT 'candidates', count(*) FROM cand UNION ALL SELECT 'pending_reviews', count(*) FROM cand WHERE auto_decision = 'review' UNION ALL SELECT 'matches', count(*) FROM cand WHERE final_decision = 'match'")),
    "score_histogram": (lambda s, d: quality.histogram(mastering(s, d).scored, "overall_score"), sql("SELECT CASE WHEN overall_score >= 1 THEN 11 ELSE CAST(floor(overall_score * 10) AS BIGINT) + 1 END AS bucket, count(*) AS n FROM scored WHERE overall_score IS NOT NULL GROUP BY 1")),
    "source_share": (lambda s, d: quality.source_share(mastering(s, d).records), sql("SELECT source_system, count(*) AS records, round(count(*) * 100.0 / (SELECT count(*) FROM u), 1) AS pct FROM u GROUP BY 1")),
    "completeness_by_source": (lambda s, d: quality.completeness(mastering(s, d).records, _FIELDS), sql("SELECT source_system, count(*) AS records, " + ", ".join(f"round(sum(CASE WHEN {f} IS NOT NULL AND {f} <> '' THEN 1 ELSE 0 END) * 100.0 / count(*), 1) AS pct_{f}" for f in _FIELDS) + " FROM u GROUP BY 1")),
    "match_rate_by_pair": (lambda s, d: matching.match_rate(matching.decide(mastering(s, d).scored)), sql("SELECT split_part(source_record_id_a, ':', 1) AS system_a, split_part(source_record_id_b, ':', 1) AS system_b, count(*) AS pairs, count(*) FILTER (WHERE final_decision = 'match') AS matches, round(avg(CASE WHEN final_decision = 'match' THEN 1.0 ELSE 0.0 END) * 100, 1) AS rate FROM cand GROUP BY 1, 2")),
    "golden_list": (lambda s, d: steward.golden_list((m := mastering(s, d)).golden.select("master_payor_id", "payor_name"), m.xref), sql("SELECT master_payor_id, payor_name, (SELECT count(*) FROM xr WHERE xr.master_payor_id = gold.master_payor_id) AS records FROM gold")),
    "field_compare": (_compare, sql("SELECT *, CASE WHEN value_a IS NULL AND value_b IS NULL THEN 'neutral' WHEN value_a IS NULL OR value_b IS NULL THEN 'red' WHEN value_a = value_b THEN 'green' WHEN lower(left(value_a, 3)) = lower(left(value_b, 3)) THEN 'yellow' ELSE 'red' END AS colour FROM (" + " UNION ALL ".join(_CELL.format(f=f) for f in steward.COMPARED) + ")")),
    "audit_log": (lambda s, d: steward.audit_rows(sample_decisions(mastering(s, d).pairs)).select("entity_id", "entity_type", "action", "changed_by"), sql("SELECT candidate_id AS entity_id, 'match_candidate' AS entity_type, steward_decision AS action, 'steward' AS changed_by FROM cand_d WHERE steward_decision IS NOT NULL")),
    "dq_checks": (_dq, sql("SELECT 'not_null_tax' AS \"check\", count(*) AS failing FROM u WHERE tax_id IS NULL UNION ALL SELECT 'unique_record', count(*) FROM (SELECT source_record_id FROM u GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unique_tax', count(*) FROM (SELECT tax_id FROM u WHERE tax_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'accepted_decision', 0 UNION ALL SELECT 'accepted_rule', count(*) FROM cand WHERE match_rule NOT IN ('DET-1', 'DET-2') UNION ALL SELECT 'fk_xref_golden', 0 UNION ALL SELECT 'orphans', 0")),
    "strategy_performance": (lambda s, d: matching.strategy_performance(matching.decide((m := mastering(s, d, decisions=True)).scored, m.log)), None),
    "messy_feeds": (_messy, _messy_sql()),
    "config_upsert": (_config_upsert, _config_sql()),
    "name_expansion": (lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", expand(F.concat(F.lit("bcbs of "), "n_name")).alias("expanded")), "SELECT n_nationkey, 'BLUE CROSS BLUE SHIELD OF ' || upper(n_name) AS expanded FROM nation"),
    "hierarchy_named": (lambda s, d: master.named((m := mastering(s, d)).hierarchy, m.golden).select("parent_master_id", "child_master_id", "inference_method", "parent_name", "child_name"), sql("SELECT hier.*, p.payor_name AS parent_name, c.payor_name AS child_name FROM hier JOIN gold p ON p.master_payor_id = parent_master_id JOIN gold c ON c.master_payor_id = child_master_id")),
    "links_of_golden": (lambda s, d: master.links_of((m := mastering(s, d)).hierarchy, _first_parent(m)), sql(f"SELECT hier.* FROM hier WHERE {_PARENT} IN (parent_master_id, child_master_id)")),
    "sources_of_golden": (lambda s, d: master.sources_of((m := mastering(s, d)).xref, m.staged, _first_parent(m)).select("source_record_id", "source_system", "payor_name", "tax_id"), sql(f"SELECT source_record_id, u.source_system, payor_name, tax_id FROM xr JOIN u USING (source_record_id) WHERE master_payor_id = {_PARENT}")),
    "recent_activity": (lambda s, d: steward.recent(steward.audit_rows(sample_decisions(mastering(s, d).pairs))).select("change_id", "entity_id", "action"), sql(f"SELECT change_id, entity_id, action FROM ({_AUDIT}) ORDER BY change_id LIMIT 10")),
    "audit_page": (_audit_page, sql(f"SELECT change_id, entity_id, (SELECT count(*) > 40 FROM ({_AUDIT}) WHERE action = 'confirmed_match') AS more FROM ({_AUDIT}) WHERE action = 'confirmed_match' ORDER BY change_id LIMIT 20 OFFSET 20")),
    "golden_search": (lambda s, d: steward.search(mastering(s, d).golden.select("master_payor_id", "payor_name", "city"), "group of", "master_payor_id"), sql("SELECT master_payor_id, payor_name, city FROM gold WHERE contains(lower(concat_ws(' ', master_payor_id, payor_name, city)), 'group of') ORDER BY master_payor_id LIMIT 20")),
    "score_histogram_clamped": (lambda s, d: quality.histogram(mastering(s, d).scored, "overall_score", clamp=True), sql("SELECT least(CAST(floor(overall_score * 10) AS BIGINT) + 1, 10) AS bucket, count(*) AS n FROM scored WHERE overall_score IS NOT NULL GROUP BY 1")),
    "score_bands": (lambda s, d: mastering(s, d).scored.select("source_record_id_a", "source_record_id_b", *[steward.band(c).alias(c.replace("score", "band")) for c in _BANDED]), sql("SELECT source_record_id_a, source_record_id_b, " + ", ".join(f"CASE WHEN {c} >= 0.8 THEN 'green' WHEN {c} >= 0.5 THEN 'yellow' WHEN {c} IS NOT NULL THEN 'red' END AS {c.replace('score', 'band')}" for c in _BANDED) + " FROM scored")),
    "completeness_bands": (lambda s, d: quality.completeness(mastering(s, d).records, _FIELDS).select("source_system", *[steward.percent_band(f"pct_{f}").alias(f"band_{f}") for f in _FIELDS]), sql("SELECT source_system, " + ", ".join(f"CASE WHEN p_{f} >= 90 THEN 'green' WHEN p_{f} >= 70 THEN 'yellow' ELSE 'red' END AS band_{f}" for f in _FIELDS) + " FROM (SELECT source_system, " + ", ".join(f"round(sum(CASE WHEN {f} <> '' THEN 1 ELSE 0 END) * 100.0 / count(*), 1) AS p_{f}" for f in _FIELDS) + " FROM u GROUP BY 1)")),
    "dq_summary": (lambda s, d: quality.summary((m := mastering(s, d)).staged, m.pairs), sql("SELECT count(DISTINCT source_system) AS sources, count(*) AS records, (SELECT count(*) FROM pairs) AS pairs FROM u")),
    "strategy_registry": (_registry, "SELECT field_name, strategy_id, 0::BIGINT AS times_selected, 0::BIGINT AS times_won FROM (VALUES " + ", ".join(f"('{f}', '{k}')" for f, ks in matching.STRATEGIES.items() for k in ks) + ") t(field_name, strategy_id)"),
    "survivorship_config": (_config, "SELECT field_name, rule_type, len(source_priority)::INT AS sources, source_priority[1] AS first_source FROM (VALUES " + ", ".join(f"('{f}', '{r}', [" + ", ".join(f"'{x}'" for x in p or []) + "]::VARCHAR[])" for f, (r, _, p) in survivorship.RULES.items()) + ") t(field_name, rule_type, source_priority)"),
    "conformed_crm": (lambda s, d: schemas.conform(mastering(s, d).raw["crm"].drop("website"), "crm").select("src_payor_id", "website", "effective_date", "loaded_at", "source_system"), sql("SELECT src_payor_id, CAST(NULL AS VARCHAR) AS website, effective_date, loaded_at, 'crm' AS source_system FROM raw_crm")),
    "groups_three_hop_full": (lambda s, d: mastering(s, d, mode="three_hop").groups, None),
}


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _QUERIES.items() if s}


__all__ = ["oracle", "oracle_sql", "queries"]
