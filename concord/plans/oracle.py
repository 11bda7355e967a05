"""DuckDB SQL for the catalogue, written apart from the DataFrame code."""

from __future__ import annotations

from concord.settings import ADDRESS_STOPS, POSTAL, STATES, SUFFIXES
from concord.sources.feeds import ENTITY, FEEDS

_D = lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"
_CLEAN = lambda c, f: f"upper(trim(regexp_replace({c}, '{SUFFIXES[f]}', '', 'i')))"
_ZIP = lambda c: f"left({_D(c)}, 5) AS zip_code, CASE WHEN length({_D(c)}) > 5 THEN substr({_D(c)}, 6, 4) END AS zip_plus_4"
_N = "CAST(NULL AS VARCHAR)"
_STATE = "map {" + ", ".join(f"'{n.upper()}': '{c}', '{c}': '{c}'" for n, c in STATES.items()) + "}"

STAGE = {
    "crm": f"""
SELECT 'crm:' || src_payor_id AS source_record_id, 'crm' AS source_system, src_payor_id AS source_id, trim(payor_name) AS payor_name, {_CLEAN("payor_name", "crm")} AS payor_name_clean,
  trim(payor_name_2) AS payor_name_alt, {_D("tax_id")} AS tax_id, trim(npi) AS npi, upper(trim(cms_plan_id)) AS cms_plan_id, trim(address_line_1) AS address_line_1, trim(address_line_2) AS address_line_2,
  upper(trim(city)) AS city, upper(left(trim(state), 2)) AS state_code, {_ZIP("zip")}, {_D("phone")} AS phone, trim(website) AS website, lower(trim(payor_type)) AS payor_type, {_N} AS line_of_business,
  parent_payor_id AS parent_ref, status = 'active' AS is_active, effective_date, termination_date, 1 AS source_trust_rank, loaded_at FROM raw_crm""",
    "credentialing": f"""
SELECT 'credentialing:' || cred_payor_id AS source_record_id, 'credentialing' AS source_system, cred_payor_id AS source_id, trim(organization_name) AS payor_name, {_CLEAN("organization_name", "credentialing")} AS payor_name_clean,
  trim(doing_business_as) AS payor_name_alt, {_D("ein")} AS tax_id, {_N} AS npi, {_N} AS cms_plan_id, trim(street_address) AS address_line_1, trim(suite) AS address_line_2, upper(trim(city)) AS city,
  upper(left(trim(state_code), 2)) AS state_code, {_ZIP("postal_code")}, {_D("contact_phone")} AS phone, {_N} AS website, lower(trim(plan_type)) AS payor_type, {_N} AS line_of_business, {_N} AS parent_ref,
  network_status = 'in_network' AS is_active, CAST(NULL AS DATE) AS effective_date, CAST(NULL AS DATE) AS termination_date, 2 AS source_trust_rank, loaded_at FROM raw_credentialing""",
    "claims": f"""
SELECT 'claims:' || claims_payor_code AS source_record_id, 'claims' AS source_system, claims_payor_code AS source_id, trim(payor_name) AS payor_name, {_CLEAN("payor_name", "claims")} AS payor_name_clean,
  {_N} AS payor_name_alt, {_D("tax_id")} AS tax_id, {_N} AS npi, {_N} AS cms_plan_id, CASE WHEN city IS NULL THEN nullif(trim(split_part(address, ',', 1)), '') END AS address_line_1, {_N} AS address_line_2,
  upper(coalesce(trim(city), nullif(trim(split_part(address, ',', 2)), ''))) AS city, coalesce({_STATE}[upper(trim(state))], CASE WHEN length(trim(state)) = 2 THEN upper(trim(state)) END) AS state_code, {_ZIP("zip")},
  {_N} AS phone, {_N} AS website, lower(trim(payor_type)) AS payor_type, line_of_business, {_N} AS parent_ref, is_active, CAST(NULL AS DATE) AS effective_date, CAST(NULL AS DATE) AS termination_date, 3 AS source_trust_rank, loaded_at FROM raw_claims""",
    "cms_reference": f"""
SELECT 'ref:' || ref_id AS source_record_id, 'cms_reference' AS source_system, ref_id AS source_id, trim(official_name) AS payor_name, {_CLEAN("official_name", "cms_reference")} AS payor_name_clean,
  trim(parent_org_name) AS payor_name_alt, {_D("tax_id")} AS tax_id, {_N} AS npi, upper(trim(cms_contract_id)) AS cms_plan_id, {_N} AS address_line_1, {_N} AS address_line_2, {_N} AS city,
  upper(left(trim(state), 2)) AS state_code, {_N} AS zip_code, {_N} AS zip_plus_4, {_N} AS phone, {_N} AS website, lower(trim(plan_type)) AS payor_type, {_N} AS line_of_business, trim(parent_org_name) AS parent_ref,
  true AS is_active, CAST(NULL AS DATE) AS effective_date, CAST(NULL AS DATE) AS termination_date, 4 AS source_trust_rank, loaded_at FROM raw_cms_reference""",
}

_STOPS = "[" + ", ".join(f"'{s}'" for s in ADDRESS_STOPS) + "]"
_POSTAL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in POSTAL.items()) + "}"
_TOK = lambda c: f"list_filter(string_split_regex(upper(trim({c})), '\\s+'), lambda x: x <> '')"
_HAS = lambda c: f"({c} IS NOT NULL AND {c} <> '')"
BOTH = lambda a, b: f"{_HAS(a)} AND {_HAS(b)}"


def jac(a: str, b: str) -> str:
    t = lambda c: f"list_distinct(list_filter(list_transform({_TOK(c)}, lambda x: rtrim(x, '.,')), lambda x: NOT list_contains({_STOPS}, x)))"
    x, y = t(a), t(b)
    return f"CASE WHEN {BOTH(a, b)} THEN CASE WHEN len(list_distinct(list_concat({x}, {y}))) > 0 THEN len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) ELSE 0.0 END END"


def nrm(a: str, b: str) -> str:
    n = lambda c: f"array_to_string(list_transform({_TOK(c)}, lambda x: coalesce({_POSTAL}[x], x)), ' ')"
    return f"CASE WHEN {BOTH(a, b)} THEN CASE WHEN {n(a)} = {n(b)} THEN 1.0 ELSE jaro_winkler_similarity({n(a)}, {n(b)}) END END"


def cmp(a: str, b: str) -> str:
    def parts(c: str) -> tuple[str, str]:
        has = f"regexp_full_match({_TOK(c)}[1], '[0-9-]*[0-9][0-9-]*')"
        num = f"CASE WHEN {has} THEN {_TOK(c)}[1] ELSE '' END"
        name = f"array_to_string(list_filter(CASE WHEN {has} THEN {_TOK(c)}[2:4] ELSE {_TOK(c)}[1:3] END, lambda x: NOT list_contains({_STOPS}, x)), ' ')"
        return num, name

    (na, wa), (nb, wb) = parts(a), parts(b)
    one = lambda x, y: f"CASE WHEN {x} <> '' AND {y} <> '' THEN CASE WHEN {x} = {y} THEN 1.0 ELSE jaro_winkler_similarity({x}, {y}) END END"
    return f"CASE WHEN {BOTH(a, b)} THEN coalesce(list_avg(list_filter([{one(na, nb)}, {one(wa, wb)}], lambda x: x IS NOT NULL)), 0.0) END"


def ngr(a: str, b: str) -> str:
    g = lambda c: f"(CASE WHEN length({c}) < 3 THEN [{c}] ELSE list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i::INT, 3)) END)"
    x, y = g(f"upper({a})"), g(f"upper({b})")
    n = lambda l, v: f"len(list_filter({l}, lambda z: z = {v}))"  # noqa: E731, E741
    dot = f"list_sum(list_transform(list_distinct({x}), lambda g: {n(x, 'g')} * {n(y, 'g')}))"
    norm = lambda l: f"sqrt(list_sum(list_transform(list_distinct({l}), lambda g: {n(l, 'g')} * {n(l, 'g')})))"  # noqa: E731, E741
    return f"CASE WHEN {BOTH(a, b)} THEN {dot} / ({norm(x)} * {norm(y)}) END"


def trans(a: str, b: str) -> str:
    x, y = _D(a), _D(b)
    d = f"len(list_filter(range(1, length({x}) + 1), lambda i: substr({x}, i::INT, 1) <> substr({y}, i::INT, 1)))"
    return f"CASE WHEN {BOTH(a, b)} AND {x} <> '' AND {y} <> '' THEN CASE WHEN {x} = {y} THEN 1.0 WHEN length({x}) <> length({y}) THEN 0.0 WHEN {d} <= 1 THEN 0.9 WHEN {d} = 2 THEN 0.7 ELSE 0.0 END END"


def _cte() -> dict[str, str]:
    c = {"e": ENTITY}
    c |= {f"raw_{n}": s for n, s in FEEDS.items()}
    c |= {f"stg_{n}": s for n, s in STAGE.items()}
    c["u"] = """SELECT *, left(coalesce(payor_name_clean, ''), 6) || coalesce(state_code, 'XX') AS block_name_key, tax_id AS block_tax_id,
  coalesce(left(zip_code, 3), 'XXX') || left(coalesce(payor_name_clean, ''), 4) AS block_zip3_name4 FROM (""" + " UNION ALL BY NAME ".join(f"SELECT * FROM stg_{n}" for n in STAGE) + ")"
    c["pairs"] = " UNION ".join(
        f"SELECT a.source_record_id AS source_record_id_a, b.source_record_id AS source_record_id_b FROM u a JOIN u b ON a.{k} = b.{k} AND a.source_record_id < b.source_record_id WHERE a.{k} <> ''"
        for k in ("block_name_key", "block_tax_id", "block_zip3_name4")
    )
    addr = lambda s: f"{s}.address_line_1 || ' ' || coalesce({s}.city, '') || ' ' || coalesce({s}.state_code, '') || ' ' || coalesce({s}.zip_code, '')"
    c["wide"] = f"""SELECT p.*, a.payor_name_clean na, b.payor_name_clean nb, a.tax_id ta, b.tax_id tb, a.phone pa, b.phone pb, a.cms_plan_id ca, b.cms_plan_id cb, a.state_code sa, b.state_code sb,
  {addr("a")} AS aa, {addr("b")} AS ab FROM pairs p JOIN u a ON a.source_record_id = source_record_id_a JOIN u b ON b.source_record_id = source_record_id_b"""
    digit = lambda x: f"regexp_matches(left(upper(trim({x})), 10), '[0-9]')"
    c["fields"] = f"""SELECT *, round(jaro_winkler_similarity(upper(trim(na)), upper(trim(nb))), 4) AS jw, round({ngr("trim(na)", "trim(nb)")}, 4) AS ng,
  CASE WHEN {digit("aa")} AND {digit("ab")} THEN round({cmp("aa", "ab")}, 4) END AS cm, CASE WHEN {digit("aa")} AND {digit("ab")} THEN round({nrm("aa", "ab")}, 4) ELSE round({jac("aa", "ab")}, 4) END AS nr,
  {trans("ta", "tb")} AS score_tax_id,
  CASE WHEN {BOTH("pa", "pb")} THEN CASE WHEN length(pa) >= 7 AND length(pb) >= 7 AND right(pa, 7) = right(pb, 7) THEN 1.0 ELSE 0.0 END END AS score_phone,
  CASE WHEN {BOTH("ca", "cb")} THEN CASE WHEN ca = cb THEN 1.0 WHEN length(ca) >= 5 AND length(cb) >= 5 AND left(ca, 5) = left(cb, 5) THEN 0.85 ELSE 0.0 END END AS score_cms_plan_id FROM wide"""
    # names of very different length are compared by expanded names, which are the names themselves as the feeds hold no abbreviation
    uneven = "least(length(trim(na)), length(trim(nb))) / greatest(length(trim(na)), length(trim(nb))) < 0.6"
    c["parts"] = f"""SELECT *, CASE WHEN {uneven} THEN jw ELSE greatest(jw, ng) END AS score_name, CASE WHEN {uneven} THEN 'NAME_ABR' WHEN jw >= ng THEN 'NAME_JW' ELSE 'NAME_NGR' END AS winning_name_strategy, greatest(cm, nr) AS score_address,
  CASE WHEN cm IS NULL AND nr IS NULL THEN NULL WHEN cm IS NULL THEN 'ADDR_JAC' WHEN cm >= nr THEN 'ADDR_CMP' ELSE 'ADDR_NRM' END AS winning_addr_strategy,
  CASE WHEN ta = tb THEN 'DET-1' WHEN ca = cb THEN 'DET-2' WHEN na = nb AND sa = sb THEN 'DET-3' ELSE 'FUZZY' END AS match_rule FROM fields"""
    w = {"score_name": 0.35, "score_tax_id": 0.25, "score_address": 0.2, "score_phone": 0.1, "score_cms_plan_id": 0.1}
    total = " + ".join(f"CASE WHEN {k} IS NOT NULL THEN {v}::DOUBLE ELSE 0 END" for k, v in w.items())
    value = " + ".join(f"coalesce({k} * {v}::DOUBLE, 0)" for k, v in w.items())
    c["scored"] = f"SELECT *, CASE WHEN {total} > 0 THEN round(({value}) / ({total}), 4) END AS composite, CASE WHEN match_rule <> 'FUZZY' THEN 1.0 ELSE CASE WHEN {total} > 0 THEN round(({value}) / ({total}), 4) END END AS overall_score FROM parts"
    for name, steward in (("cand", "CAST(NULL AS VARCHAR)"), ("cand_d", "CASE CAST(split_part(source_record_id_a, '-', 2) AS BIGINT) % 10 WHEN 6 THEN 'confirmed_match' WHEN 4 THEN 'confirmed_no_match' END")):
        c[name] = f"""SELECT *, CASE WHEN steward_decision = 'confirmed_match' THEN 'match' WHEN steward_decision = 'confirmed_no_match' THEN 'no_match' WHEN auto_decision = 'auto_match' THEN 'match' ELSE 'no_match' END AS final_decision FROM (
  SELECT *, md5(source_record_id_a || '|' || source_record_id_b) AS candidate_id, CASE WHEN match_rule <> 'FUZZY' OR overall_score >= 0.85 THEN 'auto_match' WHEN overall_score >= 0.6 THEN 'review' ELSE 'auto_no_match' END AS auto_decision, {steward} AS steward_decision FROM scored)"""
    c["edge"] = "SELECT source_record_id_a AS src, source_record_id_b AS dst, overall_score AS score FROM cand WHERE final_decision = 'match' UNION ALL SELECT source_record_id_b, source_record_id_a, overall_score FROM cand WHERE final_decision = 'match'"
    c["reach"] = "SELECT source_record_id AS node, source_record_id AS other FROM u UNION SELECT reach.node, edge.dst FROM reach JOIN edge ON edge.src = reach.other"
    c["comp"] = "SELECT node, min(other) AS component FROM reach GROUP BY node"
    c["conf"] = "SELECT component, nullif(round(avg(score), 4), 0) AS group_confidence FROM edge JOIN comp ON node = src WHERE src < dst GROUP BY component"
    c["surv"] = "SELECT component, first(node ORDER BY source_trust_rank, node) AS survivor FROM comp JOIN u ON node = source_record_id GROUP BY component"
    c["grp"] = "SELECT md5(comp.component) AS match_group_id, node AS source_record_id, node = survivor AS is_survivor, group_confidence FROM comp JOIN surv USING (component) LEFT JOIN conf USING (component)"
    ranked = lambda f, o="source_trust_rank": f"first({f} ORDER BY {o}, source_record_id) FILTER (WHERE {f} IS NOT NULL) AS {f}"
    recent = "loaded_at DESC NULLS LAST"
    c["sv"] = (
        "SELECT match_group_id, " + ", ".join([*[ranked(f) for f in ("payor_name", "tax_id", "npi", "website", "payor_type", "line_of_business")],
        "first(payor_name_alt ORDER BY -length(payor_name_alt), source_record_id) FILTER (WHERE payor_name_alt <> '') AS payor_name_alt",
        ranked("cms_plan_id", "CASE WHEN source_system = 'cms_reference' THEN 1 ELSE source_trust_rank + 10 END"), *[ranked(f, recent) for f in ("address_line_1", "address_line_2", "city", "state_code", "zip_code", "phone")],
        "bool_or(is_active) AS is_active, min(effective_date) AS effective_date, max(termination_date) AS termination_date"]) + " FROM u JOIN grp USING (source_record_id) GROUP BY match_group_id"
    )
    full = "payor_name payor_name_alt tax_id npi cms_plan_id address_line_1 city state_code zip_code phone website payor_type line_of_business is_active effective_date".split()
    done = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN 1 ELSE 0 END" for f in full)
    c["gold"] = f"""SELECT sv.match_group_id AS master_payor_id, sv.* EXCLUDE (match_group_id), round(({done}) / 15.0, 4) AS completeness_score, source_count, record_count, confidence_score FROM sv JOIN (
  SELECT match_group_id, count(DISTINCT source_system) AS source_count, count(*) AS record_count, avg(coalesce(group_confidence, 1.0)) AS confidence_score FROM grp JOIN u USING (source_record_id) GROUP BY 1) USING (match_group_id)"""
    c["xr"] = "SELECT source_record_id, match_group_id AS master_payor_id, source_system, source_id, group_confidence AS match_confidence FROM grp JOIN u USING (source_record_id)"
    c["hier"] = """SELECT DISTINCT p.master_payor_id AS parent_master_id, xr.master_payor_id AS child_master_id, 'name_ref_match' AS inference_method FROM xr JOIN u USING (source_record_id)
  JOIN gold p ON upper(trim(p.payor_name)) = upper(trim(parent_ref)) WHERE parent_ref <> '' AND p.master_payor_id <> xr.master_payor_id
UNION SELECT p.master_payor_id, c.master_payor_id, 'name_substring' FROM gold p JOIN gold c ON contains(upper(trim(c.payor_name)), upper(trim(p.payor_name))) AND p.master_payor_id <> c.master_payor_id
  AND length(trim(p.payor_name)) >= 6 AND length(trim(p.payor_name)) < length(trim(c.payor_name))"""
    return c


def sql(body: str) -> str:
    """``body`` over the tables of the pipeline, with those it needs before it."""
    import re

    ctes, need, todo = _cte(), set(), [body]
    while todo:
        text = todo.pop()
        for n in ctes:
            if n not in need and re.search(rf"\b(FROM|JOIN)\s+{n}\b", text):
                need.add(n)
                todo.append(ctes[n])
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in ctes.items() if n in need) + "\n" + body
