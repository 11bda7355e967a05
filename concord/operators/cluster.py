"""Clusters of matched records: true components, or labels of three relaxations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.text import uuid5_dns
from concord.operators.matching import A, B
from concord.storage import discard, new_path, stored


def edges(candidates: DataFrame) -> DataFrame:
    """Matched pairs as undirected edges, both ways: src, dst, score."""
    m = candidates.where(F.col("final_decision") == "match")
    one = m.select(F.col(A).alias("src"), F.col(B).alias("dst"), F.col("overall_score").alias("score"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least node that each one reaches. ``links``: src, dst, both ways.

    Nodes are first contracted into the least of themselves and their neighbours, which settles all components but those
    that some link leads out of; of these the contracted nodes alone, and the links between them, go through the rounds.
    """
    spark = links.sparkSession
    path = new_path(spark, "least")
    least = stored(links.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component")), "least", path)
    end = lambda e, c: least.select(F.col("node").alias(e), F.col("component").alias(c))
    between = links.select("src", "dst").join(end("dst", "far"), "dst").join(end("src", "near"), "src").where("near != far").select(F.col("near").alias("src"), F.col("far").alias("dst"))
    between = stored(between.distinct(), "links")
    if between.limit(1).count():
        far = _rounds(between).select(F.col("node").alias("component"), F.col("component").alias("least"))
        least = least.join(far, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
    return nodes.select("node").join(least, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _rounds(links: DataFrame) -> DataFrame:
    """(node, component) of the ends of ``links``: min-label propagation with pointer jumping. Each round is written and the one before it removed."""
    spark = links.sparkSession
    path = new_path(spark, "labels")
    labels = stored(links.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("component")).withColumnRenamed("src", "node"), "labels", path)
    while True:
        near = links.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy("src").agg(F.min("c").alias("near"))
        new = labels.join(near.withColumnRenamed("src", "node"), "node").select("node", "component", F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        last, path = path, new_path(spark, "labels")
        done = stored(new.join(jump, "to").select("node", F.least("to", "far").alias("new"), (F.least("to", "far") != F.col("component")).alias("moved")), "labels", path)
        discard(spark, last)
        labels = done.select("node", F.col("new").alias("component"))
        if not done.where("moved").limit(1).count():
            return labels


def three_hop(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the least label after three relaxations, of which the first leaves the node itself out."""
    links = links.select("src", "dst").distinct()
    first = links.groupBy("src").agg(F.min("dst").alias("m"))
    labels = nodes.select("node").join(first.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
    for _ in range(2):
        near = links.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("near"))
        labels = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
    return labels


def groups(records: DataFrame, candidates: DataFrame, mode: str = "full", ids: str = "uuid5", ident: str = "source_record_id") -> DataFrame:
    """match_group_id, source_record_id, is_survivor, group_confidence.

    ``full``: true components; id is the UUID5 of the sorted members (``ids="md5"``: the MD5 of the least one), the survivor has the least trust rank
    (ties: least id), confidence is the mean score of the group's edges (4 digits; null without edges or 0).
    ``three_hop``: labels of three relaxations; id is the MD5 of the label, the survivor is the label's own
    record, confidence averages the scores of all edges at the members.
    ``ident`` (``full`` alone): the column that the candidates' two ids are of.
    """
    links = edges(candidates)
    if mode == "three_hop":
        labels = three_hop(records.select(F.col("source_record_id").alias("node")), links)
        conf = labels.join(links, F.col("node") == F.col("src")).groupBy("component").agg(F.avg("score").alias("group_confidence"))
        out = labels.join(conf, "component", "left")
        return out.select(F.md5(F.col("component").cast("binary")).alias("match_group_id"), F.col("node").alias("source_record_id"), (F.col("node") == F.col("component")).alias("is_survivor"), "group_confidence")
    # scores are summed by node before they are by component, and all that is known of a component meets where its records do
    nodes = records.select(F.col(ident).alias("node"), F.col("source_record_id").alias("id"), "source_trust_rank")
    sums = links.where("src < dst").groupBy(F.col("src").alias("node")).agg(F.sum("score").alias("total"), F.count("score").alias("n"))
    labels = connected(nodes, links).join(nodes, "node").join(sums, "node", "left").repartition("component")
    key = F.array_join(F.array_sort(F.collect_list("id")), "|") if ids == "uuid5" else F.min("id")
    per = labels.groupBy("component").agg(key.alias("key"), F.min(F.struct("source_trust_rank", "id"))["id"].alias("survivor"), F.nullif(F.round(F.sum("total") / F.sum("n"), 4), F.lit(0.0)).alias("group_confidence"))
    group_id = uuid5_dns(F.col("key")) if ids == "uuid5" else F.md5(F.col("key").cast("binary"))
    out = labels.select("component", "id").join(per.select("component", group_id.alias("match_group_id"), "survivor", "group_confidence"), "component")
    return out.select("match_group_id", F.col("id").alias("source_record_id"), (F.col("id") == F.col("survivor")).alias("is_survivor"), "group_confidence")
