"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (``assign``, ``access``, ``hex``) are always reported. Three weak kinds count only in
company: an access ``identifier`` (client or account id assignments), a ``weak`` secret (a short value
after a key word, or a long mixed-case token) and an ``endpoint`` (URL with a host). Parts lie in
scopes of ``SCOPE`` code points; a weak part is reported when parts of other, complementary kinds
start within ``SCOPE`` of it: a secret beside an identifier or access key, an identifier beside a
secret, an endpoint beside both.

The interval join works on cells of ``SCOPE`` code points: parts are first reduced to one row per
document, cell and role (least and largest start), and each weak part is joined with the rows of its
own and the two neighbouring cells. So a part meets at most three rows per role, and no pairs of
parts are ever made. Two parts of one cell are always within ``SCOPE``; for the neighbours the least
or largest start decides, which makes the test exact.

Nulls and edges: null text is empty; a text without parts has counts of 0 and an empty ``spans``;
repeated doc_ids are told apart by their text, and equal rows give equal results. Positions are
code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import table, written

SCOPE = 400

# fixed values: the base patterns
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

# weak parts
IDENTIFIER = r"(?i:client_?id|account_?id|user_?name|login|user)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}"
WEAK = r"(?i:pwd|pass|key|auth)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}"
ENDPOINT = r"(?i:https?|jdbc:[a-z]{2,12}|mongodb|redis|postgres|mysql|amqp)://[A-Za-z0-9][A-Za-z0-9.-]*(?::[0-9]{1,5})?"

BASE_KINDS = ("assign", "access", "hex")
#: For each kind its role, and for the weak kinds the roles that must be near.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "identifier": "id", "weak": "secret", "endpoint": "place"}
NEEDS = {"identifier": ("secret",), "weak": ("id",), "endpoint": ("id", "secret")}


def _spans(text: Column, pattern: str, kind: str, keep: Column | None = None, group: int = 0) -> Column:
    """array<struct<start, end, kind>> of the leftmost non-overlapping matches of ``pattern``.

    The texts between the matches come from ``split``, the matches from ``regexp_extract_all``; starts are
    running sums of their lengths. Texts that cannot match skip both.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.transform(found, lambda m: F.length(m))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    step = F.aggregate(
        F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), sizes.alias("size")),
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(x["size"], F.lit(0))).cast("long").alias("at"),
            F.when(x["size"].isNull(), acc["out"])
            .otherwise(
                F.concat(
                    acc["out"],
                    F.array(F.struct((acc["at"] + x["gap"]).cast("long").alias("start"), (acc["at"] + x["gap"] + x["size"]).cast("long").alias("end"), F.lit(kind).alias("kind"))),
                )
            )
            .alias("out"),
        ),
    )
    return step["out"]


def base_spans(text: Column) -> Column:
    """The base spans of ``text`` by start, then kind as listed."""
    # runs of the wanted length are the runs of any length that pass: no shorter run hides a longer one
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    hexes = F.when(text.rlike("[0-9a-f]{32}"), _spans(text, "[0-9a-f]{%d,}" % LEAST["hex"], "hex")).otherwise(empty)
    access = F.when(text.contains("AKIA"), _spans(text, "AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4), "access")).otherwise(empty)
    # a failing assignment consumes its text, so all are matched and the short ones dropped
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.when(
        text.rlike(ASSIGN),
        F.transform(
            F.filter(F.arrays_zip(_spans(text, ASSIGN, "assign").alias("s"), values.alias("v")), lambda z: F.length(z["v"]) >= LEAST["assign"]),
            lambda z: z["s"],
        ),
    ).otherwise(empty)
    return _ordered(F.concat(assign, access, hexes))


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = {k: i for i, k in enumerate([*BASE_KINDS, *NEEDS])}
    order = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def weak_spans(text: Column) -> Column:
    """The weak parts of ``text``, not yet linked."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    some = [F.when(text.rlike(p), _spans(text, p, k)).otherwise(empty) for k, p in (("identifier", IDENTIFIER), ("weak", WEAK), ("endpoint", ENDPOINT))]
    return F.concat(*some)


def link(parts: DataFrame, key: str, scope: int = SCOPE) -> DataFrame:
    """The weak parts (``key``, start, end, kind) of ``parts`` that have complementary parts within ``scope``."""
    cells = parts.withColumns({"cell": F.floor(F.col("start") / F.lit(scope)), "role": F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[F.col("kind")]})
    reach = (
        cells.groupBy(key, "cell", "role").agg(F.min("start").alias("low"), F.max("start").alias("high"))
        .withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
        .groupBy(key, "cell").agg(F.collect_list(F.struct("role", "low", "high")).alias("near"))
    )
    weak = cells.where(F.col("kind").isin(*NEEDS)).join(reach, [key, "cell"])

    def has(role: str) -> Column:
        close = lambda x: (x["role"] == role) & (
            (F.abs(x["low"] - F.col("start")) <= scope) | (F.abs(x["high"] - F.col("start")) <= scope) | ((x["low"] <= F.col("start")) & (x["high"] >= F.col("start")))
        )
        return F.exists("near", close)

    kept = F.lit(False)
    for kind, roles in NEEDS.items():
        every = F.lit(True)
        for role in roles:
            every = every & has(role)
        kept = kept | ((F.col("kind") == kind) & every)
    return weak.where(kept).select(key, "start", "end", "kind")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, base, linked (both array<struct<start, end, kind>>): one row per row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    # what tells documents apart is a full digest of doc_id and text: of billions, none share it
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"), 256)
    found = written(docs.select("doc_id", key.alias("_key"), base_spans(text).alias("base"), weak_spans(text).alias("weak")), "spans")
    some = found.where((F.size("weak") > 0) & (F.size(F.concat("base", "weak")) > 1)).dropDuplicates(["_key"])
    parts = some.select("_key", F.explode(F.concat("base", "weak")).alias("p")).select("_key", "p.*")
    linked = link(parts, "_key", scope).groupBy("_key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    return found.join(linked, "_key", "left").select("doc_id", "base", F.coalesce("linked", empty).alias("linked"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        as_text(_ordered(F.concat("base", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
