"""Candidate pairs, scores and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import similarity as sim
from concord.functions.text import digits
from concord.settings import DEFAULT, Settings

A, B = "source_record_id_a", "source_record_id_b"

#: records of a block whose pairs one task lists
CELL = 2000
#: buckets of blocking keys in which large blocks are looked for
BUCKETS = 1 << 16


def _met(records: DataFrame, columns: dict[str, Column], settings: Settings = DEFAULT, cell: int = CELL, ident: str = "source_record_id") -> DataFrame:
    """Every pair (a < b by ``ident``) of records that share a non-empty blocking key, once: ``columns`` of both, as <name>_a and <name>_b.

    One equi-join over the keys of all kinds, of one shuffle that both sides read. A pair is listed where it meets by the first key that it
    shares, so nothing has to be made distinct. A block of more than ``cell`` records is dealt into parts, and the
    pairs of two parts (or within one) are a task's worth of their own: a hot key costs as many tasks as its pairs ask for, and no pair is lost.
    """
    keys = settings.blocking
    kinds = F.inline(F.array(*[F.struct(F.lit(i).alias("t"), F.col(k).cast("string").alias("k")) for i, k in enumerate(keys)]))
    held = F.col("k").isNotNull() & (F.col("k") != "")
    # blocks are counted roughly first, which shuffles next to nothing, and those of full buckets one by one; there is at most one large block for ``cell`` rows
    listed = records.select(kinds).where(held).withColumn("bucket", F.pmod(F.xxhash64("t", "k"), F.lit(BUCKETS)))
    full = listed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select("t", "bucket")
    large = listed.join(F.broadcast(full), ["t", "bucket"], "left_semi").groupBy("t", "k").agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("parts")).where("parts > 1")
    own = records.select(*[c.alias(f"c_{n}") for n, c in columns.items()], F.col(ident).alias("r"), *[F.col(k).cast("string").alias(k) for k in keys])
    own = own.select(*[f"c_{n}" for n in columns], "r", *keys[:-1], kinds).where(held)
    own = own.join(F.broadcast(large), ["t", "k"], "left").withColumn("p", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("r"), "parts").cast("int")).otherwise(0))
    # parts p <= q meet in the cell (p, q)
    cells = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least("p", i).alias("lo"), F.greatest("p", i).alias("hi"))))
    own = own.select("*", F.inline(cells)).drop("parts").withColumn("cell", F.xxhash64("t", "k", "lo", "hi"))
    side = lambda s: own.select("cell", *[F.col(c).alias(f"{c}_{s}") for c in own.columns if c != "cell"])
    # the join sorts by a hash of what a cell is; that it is the same cell is looked at as a range, which does not make it a key to sort by
    same = reduce(lambda x, y: x & y, [(F.col(f"{c}_a") <= F.col(f"{c}_b")) & (F.col(f"{c}_a") >= F.col(f"{c}_b")) for c in ("t", "k", "lo", "hi")])
    apart = (F.col("p_a") != F.col("p_b")) | (F.col("lo_a") == F.col("hi_a"))
    for i, k in enumerate(keys[:-1]):
        x, y = F.col(f"{k}_a"), F.col(f"{k}_b")
        apart &= (F.col("t_a") <= i) | ~F.coalesce((x == y) & (x != ""), F.lit(False))
    met = side("a").join(side("b"), "cell").where((F.col("r_a") < F.col("r_b")) & same & apart)
    return met.select(F.col("r_a").alias(A), F.col("r_b").alias(B), *[F.col(f"c_{n}_{s}").alias(f"{n}_{s}") for n in columns for s in "ab"])


def blocking_pairs(records: DataFrame, settings: Settings = DEFAULT, cell: int = CELL) -> DataFrame:
    """Distinct pairs (a < b) that share a non-empty blocking key."""
    return _met(records, {}, settings, cell).distinct()


def block_sizes(records: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Per blocking key: blocks, largest block and the comparisons it stands for."""
    parts = [
        records.where(F.col(k).isNotNull() & (F.col(k) != "")).groupBy(k).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.lit(1)).alias("blocks"), F.max("n").alias("largest"), F.sum(F.expr("n * (n - 1) div 2")).alias("comparisons")).select(F.lit(k).alias("blocking_key"), "*")
        for k in settings.blocking
    ]
    return reduce(DataFrame.unionByName, parts)


#: the strategies of each field
STRATEGIES = {
    "name": ("NAME_JW", "NAME_TSR", "NAME_PHO", "NAME_ABR", "NAME_NGR"), "address": ("ADDR_JAC", "ADDR_CMP", "ADDR_ZIP", "ADDR_NRM"), "phone": ("PHONE_L7", "PHONE_E164", "PHONE_AC"),
    "tax_id": ("TIN_EXACT", "TIN_TRANS", "TIN_PFX"), "cms_plan_id": ("CMS_EXACT", "CMS_PFX"),
}
_PLACE = ("city", "state_code", "zip_code")


def _scored_columns() -> dict[str, Column]:
    """What scoring reads of a record; digits and address are made once a record, not once a pair."""
    address = F.concat("address_line_1", *[x for c in _PLACE for x in (F.lit(" "), F.coalesce(c, F.lit("")))])
    plain = {c: F.col(c) for c in ("payor_name_clean", "tax_id", "state_code", "phone", "cms_plan_id")}
    return plain | {"address": address, "tax_digits": digits("tax_id"), "phone_digits": digits("phone")}


def score_pairs(pairs: DataFrame, records: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Scores of given pairs."""
    side = lambda s: records.select(F.col("source_record_id").alias(f"source_record_id_{s}"), *[c.alias(f"{n}_{s}") for n, c in _scored_columns().items()])
    return _scores(pairs.join(side("a"), A).join(side("b"), B), settings)


def score_blocks(records: DataFrame, settings: Settings = DEFAULT, least: float | None = None, drop: bool = False, cell: int = CELL, ident: str = "source_record_id") -> DataFrame:
    """Scores of all pairs that share a blocking key, made where the records meet.

    ``least``: the string kernels run on those pairs alone whose overall score depends on them and can reach ``least``; others that fall short of it
    have no overall score or, with ``drop``, no row. Decisions at or above ``least`` are the same as without it. Columns then: both ids, match_rule, overall_score.
    """
    return _scores(_met(records, _scored_columns(), settings, cell, ident), settings, least, drop)


def _scores(both: DataFrame, settings: Settings = DEFAULT, least: float | None = None, drop: bool = False) -> DataFrame:
    """Deterministic rules first, then the ensemble. String kernels run in one Arrow UDF, once for equal strings of a batch."""
    xa, xb = F.col("tax_digits_a"), F.col("tax_digits_b")
    tax_ok = sim.present("tax_id_a") & sim.present("tax_id_b") & (xa != "") & (xb != "")
    tax = F.when(tax_ok, sim.digits_trans(xa, xb))
    pa, pb = F.col("phone_digits_a"), F.col("phone_digits_b")
    e164 = F.when((F.length(pa) >= 10) & (F.length(pb) >= 10) & (F.right(pa, F.lit(10)) == F.right(pb, F.lit(10))), 1.0).otherwise(0.0)
    l7 = sim.both("phone_a", "phone_b", sim.digits_l7(pa, pb))
    phone = F.when(sim.present("phone_a") & sim.present("phone_b"), F.greatest(e164, l7))
    ce, cp = sim.cms_exact("cms_plan_id_a", "cms_plan_id_b"), sim.cms_pfx("cms_plan_id_a", "cms_plan_id_b")
    rule = (
        F.when(F.col("tax_id_a") == F.col("tax_id_b"), "DET-1").when(F.col("cms_plan_id_a") == F.col("cms_plan_id_b"), "DET-2")
        .when((F.col("payor_name_clean_a") == F.col("payor_name_clean_b")) & (F.col("state_code_a") == F.col("state_code_b")), "DET-3").otherwise("FUZZY")
    )
    both = both.withColumns({"score_tax_id": tax, "score_phone": phone, "score_cms_plan_id": F.greatest(ce, cp), "match_rule": rule})
    fields = {"name": F.col("score_name"), "tax": F.col("score_tax_id"), "address": F.col("score_address"), "phone": F.col("score_phone"), "cms": F.col("score_cms_plan_id")}
    read = [F.col(c) for c in ("payor_name_clean_a", "payor_name_clean_b", "address_a", "address_b")]
    if least is not None:
        # what the score would be if names and addresses were alike: no kernel gives more than 1
        best = fields | {k: sim.both(a, b, F.lit(1.0)) for k, a, b in (("name", *read[:2]), ("address", *read[2:]))}
        both = both.withColumn("open", (F.col("match_rule") == "FUZZY") & F.coalesce(sim.composite(best, settings.weights) >= least, F.lit(False)))
        both = both.where(F.col("open") | (F.col("match_rule") != "FUZZY")) if drop else both
        read = [F.when(F.col("open"), c) for c in read]
        found = both.withColumn("r", sim.routed_scores(*read)).withColumns({"score_name": F.col("r.name_score"), "score_address": F.col("r.addr_score")})
        score = F.when(F.col("match_rule") != "FUZZY", 1.0).when(F.col("open"), sim.composite(fields, settings.weights))
        return found.select(A, B, "match_rule", score.alias("overall_score"))
    scored = both.withColumn("r", sim.routed(*read)).withColumns({
        "score_name": F.col("r.name_score"), "score_address": F.col("r.addr_score"), "winning_name_strategy": F.col("r.name_strategy"), "winning_addr_strategy": F.col("r.addr_strategy"),
        "winning_tax_strategy": F.when(tax.isNotNull(), F.when((xa != xb) & (tax > 0), "TIN_TRANS").otherwise("TIN_EXACT")),
        "winning_phone_strategy": F.when(phone.isNotNull(), F.when(e164 >= l7, "PHONE_E164").otherwise("PHONE_L7")),
        "winning_cms_strategy": F.when(ce.isNotNull(), F.when(ce >= cp, "CMS_EXACT").otherwise("CMS_PFX")),
    })
    scored = scored.withColumn("composite", sim.composite(fields, settings.weights))
    won = F.filter(F.array(*[F.col(f"winning_{k}_strategy") for k in ("name", "tax", "addr", "phone", "cms")]), lambda x: x.isNotNull())
    names = lambda *x: F.array(*map(F.lit, x))
    tried = [
        F.col("r.name_selected"), F.when(tax.isNotNull(), F.when(xa == xb, names("TIN_EXACT")).otherwise(names("TIN_EXACT", "TIN_TRANS"))), F.col("r.addr_selected"),
        F.when(F.col("score_phone").isNotNull(), names("PHONE_E164", "PHONE_L7")), F.when(F.col("score_cms_plan_id").isNotNull(), names("CMS_EXACT", "CMS_PFX")),
    ]
    return scored.select(
        A, B, "match_rule", "score_name", "score_tax_id", "score_address", "score_phone", "score_cms_plan_id",
        F.when(F.col("match_rule") != "FUZZY", 1.0).otherwise(F.col("composite")).alias("overall_score"), "composite", "winning_name_strategy", "winning_addr_strategy", won.alias("strategies_used"), F.concat(*[F.coalesce(t, F.array().cast("array<string>")) for t in tried]).alias("strategies_selected"),
    )


def decide(scored: DataFrame, decisions: DataFrame | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Automatic and final decisions; ``decisions`` (a, b, decision, user, at, notes) is an append-only log of which the latest counts."""
    auto = (
        F.when((F.col("match_rule") != "FUZZY") | (F.col("overall_score") >= settings.auto_match), "auto_match")
        .when(F.col("overall_score") >= settings.review, "review").otherwise("auto_no_match")
    )
    out = scored.withColumn("candidate_id", F.md5(F.concat_ws("|", A, B).cast("binary"))).withColumn("auto_decision", auto)
    if decisions is None:
        none = F.lit(None)
        out = out.withColumns({"steward_decision": none.cast("string"), "steward_user": none.cast("string"), "steward_timestamp": none.cast("timestamp"), "steward_notes": none.cast("string")})
    else:
        last = decisions.groupBy(A, B).agg(F.max_by(F.struct("decision", "user", "at", "notes"), F.struct("at", "decision")).alias("d"))
        last = last.select(A, B, F.col("d.decision").alias("steward_decision"), F.col("d.user").alias("steward_user"), F.col("d.at").alias("steward_timestamp"), F.col("d.notes").alias("steward_notes"))
        out = out.join(last, [A, B], "left")
    final = (
        F.when(F.col("steward_decision") == "confirmed_match", "match").when(F.col("steward_decision") == "confirmed_no_match", "no_match")
        .when(F.col("auto_decision") == "auto_match", "match").otherwise("no_match")
    )
    return out.withColumn("final_decision", final)


def review_queue(candidates: DataFrame) -> DataFrame:
    """Pending reviews, best first."""
    return candidates.where((F.col("auto_decision") == "review") & F.col("steward_decision").isNull()).orderBy(F.desc("overall_score"), "candidate_id")


def strategy_performance(candidates: DataFrame) -> DataFrame:
    """Per strategy, used or not: how often it was tried and won, mean overall score when it won, and agreement with stewards."""
    tried = candidates.select(F.explode("strategies_selected").alias("strategy_id"), "strategies_used", "overall_score", "final_decision", "steward_decision")
    rows = tried.withColumn("won", F.array_contains("strategies_used", F.col("strategy_id")))
    hit = lambda m, s: F.sum((F.col("won") & (F.col("final_decision") == m) & (F.col("steward_decision") == s)).cast("long"))
    out = rows.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("times_selected"), F.sum(F.col("won").cast("long")).alias("times_won"), F.round(F.avg(F.when(F.col("won"), F.col("overall_score"))), 4).alias("avg_score_when_won"),
        hit("match", "confirmed_match").alias("true_positives"), hit("match", "confirmed_no_match").alias("false_positives"),
        hit("no_match", "confirmed_no_match").alias("true_negatives"), hit("no_match", "confirmed_match").alias("false_negatives"),
    )
    every = candidates.sparkSession.createDataFrame([(f, k) for f, ks in STRATEGIES.items() for k in ks], "field_name string, strategy_id string")
    out = every.join(out, "strategy_id", "left").fillna(0, ["times_selected", "times_won", "true_positives", "false_positives", "true_negatives", "false_negatives"])
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return out.withColumns({"precision_score": F.when(tp + fp > 0, tp / (tp + fp)), "recall_score": F.when(tp + fn > 0, tp / (tp + fn))})


def match_rate(candidates: DataFrame) -> DataFrame:
    """Pairs, matches and rate per pair of source systems."""
    sys = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(1))
    return candidates.groupBy(sys(A).alias("system_a"), sys(B).alias("system_b")).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum((F.col("final_decision") == "match").cast("long")).alias("matches"), F.round(F.avg((F.col("final_decision") == "match").cast("double")) * 100, 1).alias("rate")
    )


__all__ = ["Window", "block_sizes", "blocking_pairs", "decide", "match_rate", "review_queue", "score_pairs", "strategy_performance"]
