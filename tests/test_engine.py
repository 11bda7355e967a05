import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from concord.functions import batch, kernels
from concord.functions.text import clean_name, state_from_any, uuid5_dns, zip4, zip5
from concord.operators import cluster, master, matching, steward, survivorship
from concord.plans import catalogue
from concord.plans.pipeline import mastering
from concord.plans.service import LAYERS, Service
from concord.settings import ABBREVIATIONS
from concord.sources import feeds, mess, schemas


def test_kernels():
    assert round(kernels.jaro_winkler("MARTHA", "MARHTA"), 5) == 0.96111 and round(kernels.jaro("DIXON", "DICKSONX"), 5) == 0.76667 and kernels.jaro("", "") == 0.0
    for a, b, jw, tsr, ngr in [
        ("MOLINA HEALTHCARE OF OHIO", "MOLINA HEALTHCARE OF CALIFORNIA", 0.9237, 0.7143, 0.7357),
        ("BLUE CROSS BLUE SHIELD OF TEXAS", "BLUE SHIELD BLUE CROSS OF TEXAS", 0.9484, 1.0, 0.9429),
        ("AETNA", "AETNA BETTER HEALTH", 0.8526, 0.4167, 0.4201),
        ("UNITEDHEALTHCARE", "UNITED HEALTH CARE", 0.9778, 0.3529, 0.6682),
    ]:
        assert (round(kernels.jaro_winkler(a, b), 4), round(kernels.token_sort_ratio(a, b), 4), round(kernels.trigram_cosine(a, b), 4)) == (jw, tsr, ngr)
    assert kernels.route_name("BLUE CROSS BLUE SHIELD OF ILLINOIS", "BCBS OF ILLINOIS") == (1.0, "NAME_ABR")
    assert kernels.route_name("AETNA", "AETNA BETTER HEALTH") == (0.8526, "NAME_ABR")
    assert kernels.address_jaccard("12 Main St.", "12 MAIN STREET") == 1.0 and kernels.address_postal("12 Main St.", "12 MAIN STREET") < 1


def test_text(spark):
    rows = spark.createDataFrame([("Acme Co. Inc.", "60601-1234", "new york"), ("Blue Cross of New Mexico", "60601", "Tx"), ("Humana, Inc.", None, "Nowhere")], "n string, z string, s string")
    got = [tuple(r) for r in rows.select(clean_name("n", "crm"), zip5("z"), zip4("z"), state_from_any("s")).collect()]
    assert got == [("ACME CO.", "60601", "1234", "NY"), ("BLUE CROSS OF NEW MEXI", "60601", None, "TX"), ("HUMANA", None, None, None)]
    assert rows.select(clean_name("n", "crm", word_boundary=True)).collect()[1][0] == "BLUE CROSS OF NEW MEXICO"
    name = "claims:CLM-0001|crm:CRM-0001"
    assert rows.select(uuid5_dns(F.lit(name))).first()[0] == "148733b3-e963-5d52-b338-8cde8d8b4562" == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def _graph(spark, pairs):
    nodes = sorted({x for p in pairs for x in p} | {"z"})
    both = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(both, "src string, dst string, score double")


@pytest.mark.parametrize(
    ("pairs", "full", "hops"),
    [
        ([("0", "1"), ("1", "2"), ("2", "3"), ("3", "4"), ("4", "5")], "000000", "000012"),
        ([("0", "1"), ("1", "2"), ("2", "3"), ("3", "0")], "0000", "0000"),
        ([("0", "1"), ("0", "2"), ("0", "3"), ("0", "4")], "00000", "00000"),
        ([("0", "1"), ("2", "3")], "0022", "0022"),
    ],
)
def test_clusters(spark, pairs, full, hops):
    nodes, links = _graph(spark, pairs)
    labels = lambda df: "".join(r.component for r in df.orderBy("node").collect())
    assert labels(cluster.connected(nodes, links)) == full + "z" and labels(cluster.three_hop(nodes, links)) == hops + "z"


def test_survivorship(spark):
    cols = "source_record_id string, source_system string, source_trust_rank int, loaded_at timestamp, phone string, cms_plan_id string, is_active boolean"
    rows = spark.sql("select 1").sparkSession.createDataFrame([
        ("a", "crm", 1, None, None, "H1", None), ("c", "claims", 3, None, "3", None, None), ("b", "claims", 3, None, "2", None, None), ("d", "cms_reference", 4, None, None, "H4", None),
    ], cols).withColumn("loaded_at", F.when(F.col("source_record_id") == "c", F.lit("2024-01-01").cast("timestamp")))
    groups = rows.select(F.lit("g").alias("match_group_id"), "source_record_id")
    by = lambda f, rule, priority=None: survivorship.survive(rows, groups, {f: (rule, None, priority)}).first()[f]
    assert by("phone", "source_priority") == "2" and by("phone", "most_recent") == "3" and by("is_active", "any_true") is None
    assert by("cms_plan_id", "source_priority", ["cms_reference", "crm"]) == "H4" and by("cms_plan_id", "source_priority") == "H1"


def test_hierarchy_tree(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("a", "d"), ("c", "b")], "parent_master_id string, child_master_id string")
    assert {(r.root, r.node, r.depth) for r in master.tree(links).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "d", 1), ("a", "c", 2)}


def test_hierarchy_tree_is_followed_to_its_end(spark):
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)], "parent_master_id string, child_master_id string")
    assert {(r.root, r.node, r.depth) for r in master.tree(links).collect()} == {("n0", f"n{i}", i) for i in range(26)}
    assert master.tree(links, most=5).count() == 6


def test_steward(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in steward.upsert(old, spark.createDataFrame([("b", 3), ("c", 4)], old.schema), "k").collect()} == {("a", 1), ("b", 3), ("c", 4)}
    with pytest.raises(ValueError, match="own parent"):
        steward.add_link("a", "a", "brand", old)


def test_mess(spark):
    ents = spark.range(1, 2001).select(
        F.col("id").alias("entity_id"), F.lit("Blue Cross Blue Shield of Ohio, Inc.").alias("name"), F.when(F.col("id") % 9 != 0, "123456789").alias("tax_id"), F.lit("OH").alias("state"), F.lit("Erie").alias("city"),
        F.lit("44101").alias("zip"), F.lit("1 Main Street").alias("address"), F.lit("3125550100").alias("phone"), F.lit("inactive").alias("status"),
    )
    got = mess.messy(ents, ents.where("entity_id <= 400").select("entity_id", F.lit("Parent").alias("parent_name"))).collect()
    claims = [r for r in got if r.feed == "claims" and r.entity_id > 0 and r.copy == 0]
    assert 1500 < len(claims) < 1700 and {r.state for r in claims} == {"OH", "Ohio", "ohio", "oh"} and len({r.phone for r in claims}) == 6
    swapped = [r.tax_id for r in claims if r.tax_id not in (None, "123456789")]
    assert swapped and all(sorted(x) == sorted("123456789") and sum(a != b for a, b in zip(x, "123456789", strict=True)) == 2 for x in swapped)
    assert {r.tax_id for r in got if r.feed == "crm"} == {None, "12-3456789"} and any(r.name == "Regional Plan 7" or r.entity_id < 0 for r in got)
    assert 50 < sum(r.name == "Parent" for r in got) < 150 and {r.copy for r in got if r.feed == "crm"} == {0, 1}


def test_service(spark, tmp_path):
    raw = feeds.derive(spark, "/root/testdata/sf0.001")
    s = Service(spark, raw, str(tmp_path), ids="md5")
    assert s.alive() and s.rebuild() == list(LAYERS)
    pair = s.sql("SELECT source_record_id_a AS a, source_record_id_b AS b, final_decision FROM candidates ORDER BY 1, 2 LIMIT 1").first()
    other = "no_match" if pair.final_decision == "match" else "match"
    with pytest.raises(ValueError, match="unknown decision"):
        s.write([{"a": pair.a, "b": pair.b, "decision": "confirmed_match"}, {"a": "x", "b": "y", "decision": "maybe"}])
    assert s.audit().count() == 0
    assert s.write([{"a": pair.b, "b": pair.a, "decision": "confirmed_" + other, "user": "u"}]) == 1 and s.audit().count() == 1
    assert s.rebuild("candidates") == list(LAYERS[1:])
    assert s.sql(f"SELECT final_decision AS f FROM candidates WHERE source_record_id_a = '{pair.a}' AND source_record_id_b = '{pair.b}'").first().f == other
    for bad in (lambda: s.sql(" "), lambda: s.rebuild("nothing")):
        with pytest.raises(ValueError):
            bad()


def test_strategy_performance_has_all_strategies_and_columns(spark):
    d = "/root/testdata/sf0.001"
    m = mastering(spark, d, decisions=True)
    won = defaultdict(list)
    for r in matching.decide(m.scored, m.log).collect():
        for k in r.strategies_used:
            won[k].append(r)
    got = {r.strategy_id: r.asDict() for r in catalogue.queries()["strategy_performance"](spark, d).collect()}
    for k, rows in won.items():
        n = lambda f, s: sum(r.final_decision == f and r.steward_decision == s for r in rows)  # noqa: B023, E731
        tp, fp, tn, fn = n("match", "confirmed_match"), n("match", "confirmed_no_match"), n("no_match", "confirmed_no_match"), n("no_match", "confirmed_match")
        want = {"times_won": len(rows), "true_positives": tp, "false_positives": fp, "true_negatives": tn, "false_negatives": fn}
        want |= {"precision_score": tp / (tp + fp) if tp + fp else None, "recall_score": tp / (tp + fn) if tp + fn else None}
        assert {c: got[k][c] for c in want} == want and abs(got[k]["avg_score_when_won"] - sum(r.overall_score for r in rows) / len(rows)) < 1e-4
    assert {k.split("_")[0] for k in won} == {"NAME", "ADDR", "PHONE", "TIN", "CMS"} and {k for k, v in got.items() if v["times_won"]} == set(won)


def _colour(x, y):
    if not x or not y:
        return "neutral" if not x and not y else "red"
    return "green" if x == y else "yellow" if x[:3].lower() == y[:3].lower() else "red"


def test_strategies_without_a_win_have_a_row(spark):
    d = "/root/testdata/sf0.001"
    m = mastering(spark, d, decisions=True)
    tried = defaultdict(int)
    by = {r.source_record_id: r for r in m.records.collect()}
    text = lambda r: None if r.address_line_1 is None else " ".join([r.address_line_1, r.city or "", r.state_code or "", r.zip_code or ""])
    digits = lambda x: "".join(c for c in x or "" if c in "0123456789")
    for a, b in m.pairs.collect():
        x, y = by[a], by[b]
        n, k = x.payor_name_clean, y.payor_name_clean
        if n and k:
            short, long = sorted((len(n.strip()), len(k.strip())))
            abbreviated = any(t in ABBREVIATIONS for t in (n + " " + k).upper().split())
            for s in ("ABR", "JW", "TSR") if abbreviated else ("TSR", "ABR") if short / long < 0.6 else ("JW", "PHO", "NGR") if long <= 20 else ("JW", "NGR"):
                tried["NAME_" + s] += 1
        if text(x) and text(y):
            for s in ("CMP", "NRM") if digits(text(x)[:10]) and digits(text(y)[:10]) else ("JAC",):
                tried["ADDR_" + s] += 1
        if digits(x.tax_id) and digits(y.tax_id):
            for s in ("EXACT",) if digits(x.tax_id) == digits(y.tax_id) else ("EXACT", "TRANS"):
                tried["TIN_" + s] += 1
        for held, names in ((x.phone and y.phone, ("PHONE_E164", "PHONE_L7")), (x.cms_plan_id and y.cms_plan_id, ("CMS_EXACT", "CMS_PFX"))):
            for s in names if held else ():
                tried[s] += 1
    rows = catalogue.queries()["strategy_performance"](spark, d).collect()
    fields = [r.field_name for r in rows]
    assert {f: fields.count(f) for f in fields} == {"name": 5, "address": 4, "phone": 3, "tax_id": 3, "cms_plan_id": 2} and len({r.strategy_id for r in rows}) == 17
    assert {r.strategy_id: r.times_selected for r in rows if r.times_selected} == tried
    assert all((r.times_won, r.avg_score_when_won, r.true_positives, r.precision_score) == (0, None, 0, None) for r in rows if r.strategy_id in ("ADDR_ZIP", "PHONE_AC", "TIN_PFX"))


def test_field_compare_has_all_fields(spark):
    d = "/root/testdata/sf0.001"
    m = mastering(spark, d)
    by = {r.source_record_id: r for r in m.records.collect()}
    fields = "payor_name tax_id npi cms_plan_id address_line_1 city state_code zip_code phone payor_type".split()
    cells = ((a, b, f, by[a][f] or None, by[b][f] or None) for a, b in m.pairs.collect() for f in fields)
    got = [tuple(r) for r in catalogue.queries()["field_compare"](spark, d).collect()]
    assert sorted(got, key=str) == sorted(((*c, _colour(c[3], c[4])) for c in cells), key=str) and {r[5] for r in got} >= {"neutral", "green", "red"}


def test_field_sources_has_all_fields(spark):
    d = "/root/testdata/sf0.001"
    m = mastering(spark, d)
    by, members = {r.source_record_id: r for r in m.records.collect()}, defaultdict(list)
    for r in m.groups.collect():
        members[r.match_group_id].append(by[r.source_record_id])
    trust = lambda r: r.source_trust_rank
    cms = {"cms_reference": 0, "crm": 1, "credentialing": 2, "claims": 3}
    keys = {f: trust for f in "payor_name tax_id npi website payor_type line_of_business".split()}
    keys |= {f: lambda r: (r.loaded_at is None, r.loaded_at and -r.loaded_at.timestamp()) for f in "address_line_1 address_line_2 city state_code zip_code phone".split()}
    keys |= {"cms_plan_id": lambda r: cms[r.source_system], "payor_name_alt": lambda r: -len(r.payor_name_alt), "effective_date": lambda r: r.effective_date}
    want = set()
    for g, rows in members.items():
        for f, key in keys.items():
            if held := [r for r in rows if r[f] is not None and not (f == "payor_name_alt" and r[f] == "")]:
                want.add((g, f, min(held, key=lambda r: (key(r), r.source_record_id)).source_record_id))  # noqa: B023
    got = [tuple(r) for r in catalogue.queries()["field_sources"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want and len({f for _, f, _ in got}) == 15


def test_an_empty_value_has_no_source(spark):
    rows = spark.createDataFrame([("a", "", 1)], "source_record_id string, payor_name_alt string, source_trust_rank int")
    got = survivorship.survive(rows, rows.select(F.lit("g").alias("match_group_id"), "source_record_id"), {"payor_name_alt": ("most_complete", None, None)}).first()
    assert got.payor_name_alt is None and got.field_sources == {}


def test_entry_imports_without_the_optional_part():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "golden" in names and set(entry.oracle_sql()) <= set(names)


def test_feeds_reach_what_they_are_to_reach(spark):
    """Slips and swaps in tax ids, conflicting ids in a group, parents by reference and by name, names of uneven length."""
    m = mastering(spark, "/root/testdata/sf0.001")
    kinds = {round(r.score_tax_id, 1) for r in m.scored.where("score_tax_id is not null").select("score_tax_id").distinct().collect()}
    assert {0.7, 0.9, 1.0} <= kinds and m.scored.where("winning_name_strategy = 'NAME_ABR'").count()
    assert survivorship.tax_conflicts(m.records, m.groups).count()
    assert {r.inference_method for r in m.hierarchy.select("inference_method").distinct().collect()} == {"name_ref_match", "name_substring"}
    assert 0 < master.unassigned(m.golden.select("master_payor_id"), m.hierarchy).count() < m.golden.count()


def test_declared_layouts(spark):
    df = spark.createDataFrame([("1", "5"), ("2", None)], "ref_id string, enrollment_count string")
    got = schemas.conform(df, "cms_reference")
    assert got.columns == schemas.declared("cms_reference").names and [(r.enrollment_count, r.source_system) for r in got.orderBy("ref_id").collect()] == [(5, "cms_reference"), (None, "cms_reference")]
    assert got.where("loaded_at is null").count() == 0
    with pytest.raises(Exception, match="ref_id is null"):
        schemas.conform(spark.createDataFrame([(None,)], "ref_id string"), "cms_reference").collect()
    assert schemas.add_column(df, "REF_ID", "int").columns == df.columns and schemas.add_column(df, "x", "int").columns[-1] == "x"
    assert (schemas.layer_name(" match ", "dev"), schemas.layer_name(None, "dev"), schemas.layer_name(" ", "dev")) == ("match", "dev", "dev")


def test_upsert_replaces_null_and_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("a", 9), (None, 8), ("c", 7)], old.schema)
    assert sorted(map(tuple, steward.upsert(old, new, "k").collect()), key=str) == [("a", 9), ("b", 3), ("c", 7), (None, 8)]


def test_a_large_block_is_dealt_into_cells_without_losing_a_pair(spark):
    # two thirds of the records share one key, some share two, some have none
    rows = [(f"crm:{i}", "HOT" if i % 3 else None, f"T{i % 7}" if i % 2 else "", "Z" if i == 4 else f"Z{i}") for i in range(60)]
    records = spark.createDataFrame(rows, "source_record_id string, block_name_key string, block_tax_id string, block_zip3_name4 string")
    want = {tuple(sorted((a[0], b[0]))) for i, a in enumerate(rows) for b in rows[:i] if any(x and x == y for x, y in zip(a[1:], b[1:], strict=True))}
    for cell in (1, 4, 59, 2000):
        got = [tuple(r) for r in matching.blocking_pairs(records, cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert matching.blocking_pairs(records.limit(0), cell=4).count() == 0


def test_contained_names_equal_brute_force(spark):
    names = ["BLUE CROSS", "BLUE CROSS BLUE SHIELD", "BLUE SHIELD", "BLUE CROSS", "ABCABCABC", "ABCABC", "SHORT", "A SHORT ONE", " blue cross of x", None, "", "ABCABCABCABC", "HEALTH", "HEALTH HEALTH"]
    gold = spark.createDataFrame([(f"g{i}", n) for i, n in enumerate(names)], "master_payor_id string, payor_name string")
    refs = spark.createDataFrame([("r1", "g1"), ("r2", "g8")], "source_record_id string, master_payor_id string")
    records = spark.createDataFrame([("r1", "blue shield "), ("r2", "")], "source_record_id string, parent_ref string")
    clean = {f"g{i}": n.strip().upper() for i, n in enumerate(names) if n is not None}
    want = {(p, c, "name_substring") for p, x in clean.items() for c, y in clean.items() if len(x) >= 6 and len(x) < len(y) and x in y} | {("g2", "g1", "name_ref_match")}
    got = [tuple(r) for r in master.infer_hierarchy(gold, refs, records).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_double_metaphone():
    known = {
        "aubrey": "APR APR", "richard": "RXRT RKRT", "katherine": "K0RN KTRN", "cambrillo": "KMPRL KMPR", "maurice": "MRS MRS", "thumb": "0M TM", "otto": "AT AT", "hugh": "H H",
        "michael": "MKL MXL", "caesar": "SSR SSR", "chemistry": "KMSTR KMSTR", "chorus": "KRS KRS", "architect": "ARKTKT ARKTKT", "arch": "ARX ARK", "smith": "SM0 XMT", "schmidt": "XMT SMT",
        "danger": "TNJR TNKR", "sugar": "XKR SKR", "accident": "AKSTNT AKSTNT", "edge": "AJ AJ", "wright": "RT RT", "jose": "HS HS", "knight": "NT NT", "laugh": "LF LF", "thomas": "TMS TMS", "filipowicz": "FLPTS FLPFX",
    }
    assert {k: " ".join(kernels.metaphones(k)) for k in known} == known
    assert kernels.metaphones("") == kernels.metaphones("12 & 3") == ("", "") and kernels.phonetic("12", "12") == 0.0
    # (p, p), (p, s) and (s, p) count, (s, s) does not; the whole of a text does
    assert kernels.phonetic("SMITH", "SCHMIDT") == 1.0 and kernels.phonetic("SMITH", "SMYTHE") == 1.0
    assert kernels.phonetic("BLUE CROSS OF TEXAS", "BLUE CROSS OF OHIO") == 0.0 and kernels.phonetic("UNITEDHEALTHCARE", "UNITED HEALTH CARE") == 1.0


def test_fallback_rules_fill_what_the_first_rule_leaves_empty(spark):
    rows = spark.createDataFrame([("a", "crm", 1, None, "x"), ("b", "claims", 3, "2", None)], "source_record_id string, source_system string, source_trust_rank int, phone string, website string")
    groups = rows.select(F.lit("g").alias("match_group_id"), "source_record_id")
    rules = {"phone": ("most_complete", "any_non_null", None), "website": ("source_priority", "most_complete", ["claims"])}
    got = survivorship.survive(rows, groups, rules, fallbacks=True, figures=[F.count(F.lit(1)).alias("n")]).first()
    assert (got.phone, got.website, got.n, got.field_sources) == ("2", "x", 2, {"phone": "b", "website": "a"})


def test_kernels_of_many_pairs_are_those_of_one():
    rng = random.Random(1)
    words = "BLUE CROSS SHIELD OF TEXAS HEALTH PLAN GROUP COMPANIES AETNA BCBS LTD MAIN STREET ST AVENUE 12 3445 9-1 # é İ ß x".split(" ")
    texts = [rng.choice(["", " ", "\t"]) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    texts += [t.lower() for t in texts[:500]] + ["A" * n for n in (63, 64, 65)] + ["A\0B", "\0", "AB", "X" * 64 + "é"]
    slip = lambda t: "".join(rng.choice("ABC 1") if rng.random() < 0.1 else c for c in t)
    pairs = [(t, u) for t in texts for u in (t, slip(t), rng.choice(texts)) if t and u]
    a, b = map(list, zip(*pairs, strict=True))
    assert batch.jaro_winkler(a, b).tolist() == [kernels.jaro_winkler(*p) for p in pairs] and batch.trigram_cosine(a, b).tolist() == [kernels.trigram_cosine(*p) for p in pairs]
    assert batch.route_names(a, b) == [(*kernels.route_name(*p), kernels.select_name(*p)) for p in pairs]
    assert batch.route_addresses(a, b) == [(*kernels.route_address(*p), kernels.select_address(*p)) for p in pairs]
    assert batch.route_names([], []) == batch.route_addresses([], []) == []


def test_decisions_are_the_same_without_the_scores_that_do_not_bear_on_them(spark):
    m = mastering(spark, "/root/testdata/sf0.001")
    whole = matching.decide(matching.score_pairs(m.pairs, m.staged)).select(matching.A, matching.B, "match_rule", "overall_score", "auto_decision").collect()
    for least in (0.85, 0.6, 0.0):
        got = matching.decide(matching.score_blocks(m.staged, least=least)).select(matching.A, matching.B, "match_rule", "overall_score", "auto_decision")
        kept = matching.decide(matching.score_blocks(m.staged, least=least, drop=True)).select(*got.columns).collect()
        above = {tuple(r) for r in whole if r.match_rule != "FUZZY" or r.overall_score >= least}
        rows = got.collect()
        assert len(rows) == len(whole) and {r[:3] for r in rows} == {r[:3] for r in whole}
        assert {tuple(r) for r in rows if r.overall_score is not None and r.overall_score >= least} == above
        assert {tuple(r) for r in kept if r.overall_score is not None and r.overall_score >= least} == above and len(kept) == len(set(kept)) <= len(rows)


def _plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_scored_where_they_meet_and_read_one_shuffle(spark):
    """Pairs are not shuffled again to be made distinct or to fetch their records, and a pair that shares several keys is listed once."""
    columns = "source_record_id string, block_name_key string, block_tax_id string, block_zip3_name4 string"
    records = spark.createDataFrame([("a", "N", "T", "Z"), ("b", "N", "T", "Z"), ("c", "M", "T", "Z"), ("d", "N", None, "Z"), (None, "N", "T", "Z")], columns)
    for cell in (1, 2000):
        met = matching._met(records, {"zip": F.col("block_zip3_name4")}, cell=cell)
        assert sorted(map(tuple, met.collect())) == [(x, y, "Z", "Z") for x, y in ("ab", "ac", "ad", "bc", "bd", "cd")]
    assert "Aggregate" not in _plans(met).split("Join")[0]


def test_feeds_are_spread_over_all_cores(spark):
    raw = feeds.derive(spark, "/root/testdata/sf0.001")
    assert all(df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism for df in raw.values())


def test_groups_by_number_are_those_by_id(spark):
    m = mastering(spark, "/root/testdata/sf0.001")
    columns = ["match_group_id", "source_record_id", "is_survivor", "group_confidence"]
    for ids in ("md5", "uuid5"):
        by_id = cluster.groups(m.staged, m.candidates, ids=ids).select(columns).collect()
        by_number = cluster.groups(m.staged, m.decided(0.85, drop=True), ids=ids, ident="number").select(columns).collect()
        assert len(by_id) == len(by_number) and set(by_id) == set(by_number) and m.staged.select("number").distinct().count() == len(by_id)


def test_aggregation_by_group_shuffles_records_once(spark):
    """Buffers of some thirty aggregates are several times a record: they are made where a group's records lie, and source systems are counted there too."""
    m = mastering(spark, "/root/testdata/sf0.001")
    plan = _plans(master.golden(m.staged, m.groups))
    assert plan.count("Exchange hashpartitioning(match_group_id") == 1 and "partial_count(distinct" not in plan
    rows = spark.createDataFrame([("a", "crm", 1), ("b", "crm", 1), ("c", "claims", 3), ("d", None, 9), ("e", None, 9)], "source_record_id string, source_system string, source_trust_rank int")
    for f in {*survivorship.RULES} - {"is_active", "effective_date", "termination_date"}:
        rows = rows.withColumn(f, F.lit("x"))
    rows = rows.withColumns({"is_active": F.lit(True), "effective_date": F.current_date(), "termination_date": F.current_date(), "loaded_at": F.current_timestamp()})
    groups = rows.select(F.when(F.col("source_record_id") == "e", "h").otherwise("g").alias("match_group_id"), "source_record_id", F.lit(None).cast("double").alias("group_confidence"))
    assert {(r.master_payor_id, r.source_count, r.record_count) for r in master.golden(rows, groups).collect()} == {("g", 2, 4), ("h", 0, 1)}


def test_hierarchy_is_made_once(spark, monkeypatch):
    m = mastering(spark, "/root/testdata/sf0.001")
    made = []
    infer = master.infer_hierarchy
    monkeypatch.setattr(master, "infer_hierarchy", lambda *a: made.append(1) or infer(*a))
    assert "Generate" not in _plans(m.hierarchy) and "Generate" not in _plans(master.unassigned(m.golden, m.hierarchy)) and made == [1]
