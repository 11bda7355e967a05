"""N-gram Jaccard join with adaptive multi-match prefixes, and the components it links.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of at least ``PERCENT``.
Shingles are ordered by hash. A document of n shingles that overlaps another in enough of them shares at
least l tokens with it in the first n - ceil(t n) + l of either (the l-prefix). Each document's l is
chosen from the cost that its prefix tokens stand for:

* tokens that more than ``HEAVY`` prefixes hold are heavy. With h heavy tokens in its prefix and l = h + g,
  at least g shared tokens are light, so candidates come from light tokens alone and must share g of
  them. The prefix is lengthened until that holds; g grows from 1 to ``MAX_MATCH`` where the estimated
  number of candidates, the sum of (frequency - 1) over light tokens divided by g, gets smaller. Of two
  documents the one with the smaller l decides how many they must share.
* documents whose prefix cannot be lengthened that far (members of large groups of near copies, or texts
  made of common passages) are dense. All their tokens stay in the first index, so that the others find
  them. Among themselves they go through the same once more, now with whole sets and with frequencies
  counted among dense documents alone.
* those that are dense then too keep l = 1, and heavy tokens count for them. In these buckets pairs are
  never listed: each round compares the documents with one leader per token, links merge, and only
  buckets that still hold several components go on. What then remains is compared in blocks, inside one
  task per pair of blocks, that give out links only.

Candidates are verified on their whole texts. Equal shingle sets are merged to one class first, so
copies cost nothing. Every stage is dealt by token, pair or block; no bucket, class or component is
gathered in one task.

Shingle sets are compared as sets of 64-bit hashes of the words themselves. Nulls and edges: a text with
fewer words than five has its whole sequence as its only shingle; null text and text without words has
no shingle and links with nothing (its component is itself); rows with a null doc_id get a null
component; rows that repeat a doc_id are one document, which links as any of its texts does; ties between
documents go to the smaller doc_id; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import workers
from concord.llm.common import discard, fresh, join_groups, scope, scratch, table, written

PERCENT = 75
HEAVY = 48
MAX_MATCH = 3
ROUNDS = 3
#: Tokens that a prefix can be lengthened by, and one more for each 32 of the set.
RESERVE = 8
#: Partners that are compared with one document in one chunk, and shingles that a block holds, about.
CHUNK = 256
#: Bits of the table that tells which rows a step needs: 64 MB.
MAX_BITS = 1 << 29
BLOCK = 500_000


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text, a block at a time."""
    from concord.llm.words import shingle_sets

    workers.state(("jaccard",), lambda: None)
    for _, block in workers.blocks(texts):
        yield from shingle_sets(block)


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, key (of the whole set; null without shingles), tokens (the longest prefix that may be needed)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, tokens = [], [], []
            for s in _sets(b.column("text")):
                size = len(s)
                first = size - (percent * size + 99) // 100 + 1
                n.append(size)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if size else None)
                # 48 bits order the tokens as well as 64 do and take less room in the shuffle
                tokens.append((s[: min(size, first + RESERVE + size // 32)] >> np.uint64(16)).view(np.int64))
            flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
            at = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(at, flat)], ["doc_id", "n", "key", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(part, "doc_id bigint, n bigint, key binary, tokens array<bigint>")


def postings(texts: DataFrame) -> DataFrame:
    """doc, n, pos, tok: the whole sets of ``texts`` (doc, text)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, s in zip(b.column("doc").to_pylist(), _sets(b.column("text")), strict=True):
                size = len(s)
                same = [pa.array(np.full(size, v, np.int64)) for v in (doc, size)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(size, dtype=np.int32)), pa.array((s >> np.uint64(16)).view(np.int64))], ["doc", "n", "pos", "tok"])

    return texts.mapInArrow(part, "doc bigint, n bigint, pos int, tok bigint")


def prefixes(found: DataFrame, percent: int = PERCENT, whole: bool = False) -> DataFrame:
    """Adaptive prefixes: tok, doc, n, l, g, h (heavy tokens in the prefix), light, dense, first (in the 1-prefix).

    ``found``: doc, n, found (array<struct<pos, df, tok>>: the tokens that several prefixes hold). A prefix may grow to the
    whole set if ``whole``, else by the reserve. Dense documents keep all the tokens that they may.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("found")
            flat = col.flatten()
            pos, df, tok = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "df", "tok"))
            ends = np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))
            rows, counts, per = [], [], []
            start = 0
            for doc, n, end in zip(b.column("doc").to_pylist(), b.column("n").to_pylist(), ends.tolist(), strict=True):
                order = start + np.argsort(pos[start:end], kind="stable")
                start = end
                at, often = pos[order], df[order]
                heavy = at[often > HEAVY]
                base = n - (percent * n + 99) // 100
                most = n if whole else min(n, base + 1 + RESERVE + n // 32)
                best = None
                for g in range(1, MAX_MATCH + 1):
                    # the shortest prefix of base + h + g tokens that holds h heavy ones
                    length = base + g
                    while length <= most:
                        h = int(np.searchsorted(heavy, length))
                        if base + h + g <= length:
                            break
                        length = base + h + g
                    if length > most:
                        break
                    head = often[: np.searchsorted(at, length)]
                    cost = int((head[head <= HEAVY] - 1).sum()) / g
                    if best is None or cost < best[0]:
                        best = (cost, length, g)
                dense = best is None
                length, g = (most, 1) if dense else best[1:]
                kept = order[: np.searchsorted(at, length)]
                rows.append(kept)
                counts.append(len(kept))
                per.append((doc, n, length - base, g, int(np.searchsorted(heavy, length)), dense, base + 1))
            chosen = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            doc, n, l, g, h, dense, one = (np.repeat(np.array(x), counts) for x in zip(*per, strict=True)) if per else [np.zeros(0, np.int64)] * 7
            out = (tok[chosen], doc, n, l, g, h, df[chosen] <= HEAVY, dense, pos[chosen] < one)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(out, kinds, strict=True)], ["tok", "doc", "n", "l", "g", "h", "light", "dense", "first"])

    return found.mapInArrow(part, "tok bigint, doc bigint, n bigint, l int, g int, h int, light boolean, dense boolean, first boolean")


def _index(posts: DataFrame, percent: int, whole: bool) -> DataFrame:
    """The prefixes over ``posts`` (tok, doc, n, pos), written."""
    posts = posts.select("tok", "doc", (F.col("n") * F.lit(1 << 31) + F.col("pos")).alias("meta"))
    counts = written(posts.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequent")
    # most tokens are in one prefix only: they are not shuffled for the join
    shared = _marked(posts, F.col("tok"), counts.select(F.col("tok").alias("x")), "maybe").where("maybe").drop("maybe").join(counts, "tok")
    per_doc = shared.groupBy("doc", F.shiftright("meta", 31).alias("n")).agg(F.collect_list(F.struct((F.col("meta").bitwiseAND(F.lit((1 << 31) - 1))).alias("pos"), "df", "tok")).alias("found"))
    return written(prefixes(per_doc, percent, whole), "prefixes")


def candidates(index: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, near: pairs of which one is not dense and that share as many light tokens as the shorter of their prefixes asks for."""
    columns = ("doc", "n", "l", "g", "h", "dense")
    light = index.where("light").select("tok", *columns)
    other = light.select("tok", *[F.col(c).alias(f"{c}2") for c in columns])
    need = F.when(F.col("dense2"), F.col("g")).when(F.col("dense"), F.col("g2")).when(F.col("l") < F.col("l2"), F.col("g")).when(F.col("l2") < F.col("l"), F.col("g2")).otherwise(F.greatest("g", "g2"))
    # what a pair must share in all, less what may lie behind the prefixes or among heavy tokens
    part = lambda n: F.ceil(F.col(n) * percent / 100)
    least = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent)) - F.greatest(part("n") - F.col("l"), part("n2") - F.col("l2")) - F.least("h", "h2")
    return written(
        light.join(other, "tok").where((F.col("doc") < F.col("doc2")) & ~(F.col("dense") & F.col("dense2")) & (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent))
        .select(F.col("doc").alias("a"), F.col("doc2").alias("b"), F.greatest(need.cast("long"), least).alias("need"), (F.col("n") + F.col("n2")).alias("m"))
        .groupBy("a", "b", "need", "m").agg(F.count(F.lit(1)).alias("k")).where("k >= need").select("a", "b", (F.col("k") / F.col("m")).alias("near")), "pairs",
    )


def _marked(rows: DataFrame, key: Column, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column ``name``: false where ``key`` (long) is not in ``ids`` (x), true where it is and for some others. Found
    by a broadcast bit table of at most MAX_BITS, so that rows are not shuffled; of a larger set of ids it marks more others."""
    n = ids.agg(F.approx_count_distinct("x")).first()[0]
    bits = min(MAX_BITS, max(1 << 12, 1 << (16 * max(1, n) - 1).bit_length()))
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(bits))
    block, words = fresh(rows.columns, "_block"), fresh(rows.columns, "_words")
    # blocks of 64 words of 64 bits
    masks = ids.select(place(F.col("x")).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("mask"))
    held = F.map_from_entries(F.collect_list(F.struct(F.col("w").bitwiseAND(F.lit(63)).cast("int").alias("w"), "mask")))
    filled = masks.groupBy(F.shiftright("w", 6).alias(block)).agg(held.alias("held"))
    filled = filled.select(block, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long"))).alias(words))
    at = place(key)
    found = rows.withColumn(block, F.shiftright(at, 12)).join(F.broadcast(filled), block, "left")
    hit = F.getbit(F.element_at(words, (F.shiftright(at, 6).bitwiseAND(F.lit(63)) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    return found.withColumn(name, F.coalesce(hit, F.lit(False))).drop(block, words)


def _among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` (doc, text) whose doc is in ``ids`` (x), and some others: the joins that follow stay exact."""
    return _marked(texts, F.col("doc"), ids, "maybe").where("maybe").select("doc", "text")


def without(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose ``key`` (long) is null or not in ``ids`` (x). Only those that may be are shuffled."""
    maybe, gone = fresh(rows.columns, "_maybe"), fresh(rows.columns, "_gone")
    marked = _marked(rows, key, ids, maybe)
    some = marked.where(F.col(maybe)).join(ids.select(F.col("x").alias(gone)), key == F.col(gone), "left_anti")
    return marked.where(~F.col(maybe)).union(some).drop(maybe)


def verify(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked) for ``pairs`` (a, b), compared on the whole ``texts`` (doc, text).

    The partners of a document a are dealt in chunks; each chunk gets a's text once and its partners' texts
    after it, so a task holds two sets at a time. Texts of documents in no pair are not shuffled.
    """
    pairs = written(pairs, "unchecked")
    texts = _among(texts, pairs.select(F.explode(F.array("a", "b")).alias("x")))
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    dealt = pairs.join(hubs, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("chunk"))
    heads = dealt.select("a", "chunk").distinct().withColumn("doc", F.col("a")).withColumn("b", F.lit(None).cast("long"))
    rows = dealt.withColumn("doc", F.col("b")).select("a", "chunk", "doc", "b").unionByName(heads.select("a", "chunk", "doc", "b"))
    rows = rows.join(texts, "doc").select("a", "chunk", "b", "text")
    rows = rows.repartition(F.col("a"), F.col("chunk")).sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = own = None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out: list[list] = [[], [], []]
            for x, y, s in zip(a, b, _sets(batch.column("text")), strict=True):
                if y is None:
                    head, own = x, s
                elif x != head:
                    raise ValueError("a pair without its first text")
                else:
                    both = _common(own, s)
                    for c, v in zip(out, (x, y, 100 * both >= percent * (len(own) + len(s) - both)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], ["a", "b", "linked"])

    return rows.select("a", "b", "text").mapInArrow(part, "a bigint, b bigint, linked boolean")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def components(links: DataFrame) -> DataFrame:
    """(doc, comp): the smallest document that each linked one can reach. ``links``: a, b.

    Each round every document takes the least label among its neighbours and itself, and then the label of
    that label; rounds are written to the shared folder. Degrees do not matter: labels are pre-aggregated.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "doc"), "labels")
    while True:
        near = edges.join(labels.select(F.col("doc").alias("b"), F.col("comp").alias("other")), "b").groupBy("a").agg(F.min("other").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "doc"), "doc").select("doc", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("doc").alias("new"), F.col("comp").alias("far"))
        new = new.join(jump, "new").select("doc", F.least("new", "far").alias("new"), "comp")
        done = written(new.select("doc", F.col("new").alias("comp"), (F.col("new") != F.col("comp")).alias("moved")), "labels")
        if not done.where("moved").limit(1).count():
            return done.select("doc", "comp")
        labels = done.select("doc", "comp")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (doc, comp) after ``links`` between documents; documents not in ``labels`` are their own."""
    ends = {e: labels.select(F.col("doc").alias(e), F.col("comp").alias(f"c{e}")) for e in ("a", "b")}
    met = links.join(ends["a"], "a", "left").join(ends["b"], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct()
    over = components(met)
    base = labels.unionByName(over.select("doc", F.col("doc").alias("comp"))).distinct()
    new = base.join(over.select(F.col("doc").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("doc", F.coalesce("to", "comp").alias("comp"))
    return written(new.groupBy("doc").agg(F.min("comp").alias("comp")), "merged")


def _dense(posts: DataFrame, labels: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``labels`` after all links between the dense documents of ``posts`` (tok, doc, n: their 1-prefixes)."""
    size_ok = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    known = None

    def annotated() -> DataFrame:
        with_comp = posts.join(labels, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        spread = with_comp.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return with_comp.join(spread.select("tok"), "tok")

    for r in range(ROUNDS):
        open_ = written(annotated(), "open")
        if not open_.limit(1).count():
            return labels
        # one leader a token, another one each round
        lead = open_.groupBy("tok").agg(F.min(F.struct(F.xxhash64("doc", F.lit(r)).alias("h"), F.col("doc").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("m"))).alias("x"))
        pairs = (
            open_.join(lead.select("tok", "x.a", "x.ca", "x.m"), "tok").where((F.col("comp") != F.col("ca")) & size_ok)
            .select("a", F.col("doc").alias("b")).distinct()
        )
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        checked = written(verify(pairs, texts, percent), "checked")
        both = checked.select("a", "b").unionByName(checked.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known = both if known is None else known.unionByName(both)
        links = checked.where("linked").select("a", "b")
        if links.limit(1).count():
            labels = _merged(labels, links)
    # what is left, block against block: in each group of components that open tokens join, the documents
    # outside the group's largest component meet all of the group
    open_ = written(annotated(), "open")
    if not open_.limit(1).count():
        return labels
    spread = open_.select("tok", "comp").distinct()
    group = components(spread.join(spread.groupBy("tok").agg(F.min("comp").alias("b")), "tok").where("comp != b").select(F.col("comp").alias("a"), "b").distinct())
    members = open_.select("doc", "comp", "n").distinct().join(group.select(F.col("doc").alias("comp"), F.col("comp").alias("g")), "comp")
    main = members.groupBy("g", "comp").agg(F.sum("n").alias("k")).groupBy("g").agg(F.sum("k").alias("k"), F.max(F.struct("k", "comp")).alias("x"))
    parts = lambda k: F.ceil(k / BLOCK).cast("int")
    sides = main.select("g", F.col("x.comp").alias("main"), parts(F.col("k") - F.col("x.k")).alias("lefts"), parts(F.col("k")).alias("rights"))
    members = written(members.join(sides, "g"), "blocks")
    placed, every = (lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    left = members.where("comp != main").select("g", placed("lefts").alias("i"), every("rights").alias("j"), F.lit(0).alias("side"), "doc", "comp")
    right = members.select("g", placed("rights").alias("j"), every("lefts").alias("i"), F.lit(1).alias("side"), "doc", "comp")
    keys = ["g", "i", "j"]
    rows = left.unionByName(right).join(_among(texts, members.select(F.col("doc").alias("x"))), "doc")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "side", "doc").select(*keys, "side", "doc", "comp", "text")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, index, root = None, [], None, {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for batch in batches:
            k = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "side", "doc", "comp")), strict=True))
            found: list[list[int]] = [[], []]
            for (*key, side, doc, comp), s in zip(k, _sets(batch.column("text")), strict=True):
                if key != now:
                    now, own, index, root = key, [], None, {}
                if side == 0:
                    own.append((doc, comp, s))
                    continue
                if not own:
                    continue
                index = index or _Block([x for _, _, x in own])
                for t in index.linked(s, percent):
                    x, y = find(own[t][1]), find(comp)
                    if x != y:
                        # links that join what is joined already are not given out again
                        root[max(x, y)] = min(x, y)
                        found[0].append(own[t][0])
                        found[1].append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    links = written(rows.mapInArrow(part, "a bigint, b bigint"), "checked")
    return _merged(labels, links) if links.limit(1).count() else labels


class _Block:
    """An inverted index over a block of sets: the overlaps of one more set with all of them at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        o = np.argsort(tokens, kind="stable")
        self.owner = owner[o]
        self.keys, self.first = np.unique(tokens[o], return_index=True)
        self.count = np.diff(np.append(self.first, len(tokens)))

    def linked(self, s: np.ndarray, percent: int) -> list[int]:
        at = np.searchsorted(self.keys, s)
        at[at == len(self.keys)] = 0
        at = at[self.keys[at] == s]
        n = self.count[at]
        ends = np.cumsum(n)
        if not len(ends):
            return []
        hits = self.owner[np.arange(ends[-1]) + np.repeat(self.first[at] - (ends - n), n)]
        both = np.bincount(hits, minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(s) - both)).tolist()


def link_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs`` (doc_id, text). Written; what led to it is removed."""
    path = scratch(docs.sparkSession, "components")
    with scope(docs.sparkSession, "jaccard"):
        return written(_linked(docs, percent), "components", path)


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    total, spark = docs.count(), docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    path = scratch(spark, "signatures")
    long = written(signatures(docs, percent), "signatures", path)
    sig = written(long.select("doc_id", "n", "key"), "sizes")
    # classes of equal sets
    keyed = sig.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    groups = written(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1"), "classes")
    member = written(join_groups(keyed.select("doc_id", "key"), groups, "key", "size", total).select("doc_id", "rep").distinct(), "members")
    reps = without(long.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()), F.col("doc_id"), member.where("doc_id != rep").select(F.col("doc_id").alias("x")))
    index = _index(reps.select(F.col("doc_id").alias("doc"), "n", F.posexplode("tokens").alias("pos", "tok")), percent, False)
    discard(spark, path)
    pairs = candidates(index, percent)
    dense = written(index.where("dense").select("doc").distinct(), "dense")
    again = None
    if dense.limit(1).count():
        own = _among(texts, dense.select(F.col("doc").alias("x"))).join(dense, "doc", "left_semi")
        again = _index(postings(own), percent, True)
        pairs = pairs.unionByName(candidates(again, percent))
    # each document's nearest candidate first; then the pairs that still join two components
    first = pairs.select(F.col("a").alias("x"), "a", "b", "near").unionByName(pairs.select(F.col("b").alias("x"), "a", "b", "near"))
    first = written(first.groupBy("x").agg(F.max(F.struct("near", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), "nearest")
    labels = components(written(verify(first, texts, percent), "checked").where("linked").select("a", "b"))
    ends = {e: labels.select(F.col("doc").alias(e), F.col("comp").alias(f"c{e}")) for e in ("a", "b")}
    rest = pairs.join(ends["a"], "a", "left").join(ends["b"], "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").join(first, ["a", "b"], "left_anti")
    links = written(verify(rest, texts, percent), "checked").where("linked").select("a", "b")
    if links.limit(1).count():
        labels = _merged(labels, links)
    if again is not None and again.where("dense").limit(1).count():
        labels = _dense(again.where("dense and first").select("tok", "doc", "n"), labels, texts, percent)
    out = sig.select("doc_id", F.col("n").alias("n_shingles")).join(member, "doc_id", "left").withColumn("doc", F.coalesce("rep", "doc_id"))
    return out.join(labels, "doc", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc").alias("component_id"))


def keep_representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the document of smallest doc_id of each component; documents that link with nothing stay.

    A doc_id names a document, so rows that repeat one stay or go together; null doc_ids stay. Columns may have any name.
    """
    away = link_components(docs, percent).where("doc_id != component_id").select(F.col("doc_id").alias("x")).distinct()
    return without(docs, F.col("doc_id").cast("long"), away)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))
