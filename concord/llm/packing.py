"""Best-fit packing of tokenized documents into sequences, by bulk-synchronous successor sweeps.

Documents are cut into pieces of at most ``CAPACITY`` tokens. Lengths of pieces and gaps of open sequences are
whole numbers up to ``CAPACITY``, so their sorted tables are held as runs: ranks of pieces of one length, and
numbers of sequences of one gap. These are tables in the shared folder. A superstep deals both by ranges of
values; in each range, in a task of its own, a sweep matches every gap with the longest piece whose successor
it is, conflicts going to the longer piece and then the lower rank; what finds no partner in its range is swept
over all ranges. Matches become segments (length, first rank, count, first sequence, copies a
sequence, offset), gaps shrink, and the next superstep follows, about 15 in all at any number of documents.

Pieces are ranked within their length while they are made, in their task, and by the counts of the tasks
before; so no length is ever gathered in one task and no row is shuffled for its rank. A sweep adds at most two
segments for each length and one for each run of gaps that it meets, whatever the number of pieces: some 5,000
segments in all, and these are all that is broadcast. The driver sees no run, only whether pieces are left.

Nulls and edges: null text is empty; a document is its ids and an end mark, so none is without a piece;
documents longer than CAPACITY are cut into full pieces, of which the last may be shorter; repeated rows
are packed as often as they occur, null doc_ids too; ties in length are ranked by task, then by the order of
rows in it; an empty table has no pieces; of ``docs`` only doc_id and text are read, so other columns may have
any name.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import workers
from concord.llm.common import discard, scratch, table, written

CAPACITY = 2048
#: Words, and stems of words, that a worker remembers; when full, the memory is emptied.
CACHE_WORDS = 400_000
CACHE_STEMS = 300_000
#: Marks that the pre-tokenizer parts from letters before them. The apostrophe is not among them: contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
END = np.array([0], "<u4").tobytes()
#: Bands of lengths: more than 1/2, 1/3, ... of the capacity.
BANDS = (2, 3, 4, 6, 8, 16)
#: Ranges of values that are swept apart.
RANGES = 8
#: A superstep that places a smaller share of its band is followed by new sequences.
SLOW = 0.2

#: Sweeps over all ranges in a superstep, and supersteps between two writings of the state.
SWEEPS = 4
STEPS = 4

PIECES, GAPS, SEGMENT, SHRUNK, RESTING, STATE = range(6)
#: A run: value and first are a length and a rank (resting: of a band still to come), or a gap and a sequence; a segment has its sequence,
#: copies and gap too. The state is a row: sequences opened, tokens of the band, whether sequences were opened for it.
RUN = ("kind", "value", "first", "count", "sequence", "copies", "at")

class WordEncoder:
    """Ids of texts under a tokenizer that drops white space: each run between white space is encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_stems(self, stems: list[str], size: int = 400) -> list[bytes]:
        """Ids of strings of letters, many in one call: each ends with the only token that closes a word."""
        groups = [stems[i : i + size] for i in range(0, len(stems), size)]
        out: list[bytes] = []
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, "<u4")
            cut = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cut) == len(g) and cut[-1] == 4 * len(ids):
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]
            else:
                out += self._encode(g)
        return out

    def _learn(self, fresh: list[str]) -> None:
        """Puts ``fresh`` words into the cache. Letters with marks after them are two pieces, each encoded apart; letters
        of the Latin blocks without combining marks are lower-cased first, as the tokenizer would."""
        if len(self.stems) > CACHE_STEMS:
            self.stems.clear()
        parts = []
        for w in fresh:
            stem = w.rstrip(MARKS)
            if stem.isalpha():
                if max(stem) < "\u0250" and "\u0130" not in stem:
                    stem = stem.lower()
                parts.append((stem, w[len(stem) :]))
            else:
                parts.append((w, ""))
        new = [x for x in {x for p in parts for x in p if x} if x not in self.stems]
        letters = [x for x in new if x.isalpha()]
        self.stems.update(zip(letters, self._encode_stems(letters), strict=True))
        rest = [x for x in new if not x.isalpha()]
        self.stems.update(zip(rest, self._encode(rest), strict=True))
        get, self.stems[""] = self.stems.get, b""
        self.cache.update((w, get(a) + get(b)) for w, (a, b) in zip(fresh, parts, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        # the information separators count as white space in Python alone, so texts with them are encoded whole
        odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
        words = [[] if o else t.split() for t, o in zip(texts, odd, strict=True)]
        get = self.cache.get
        # by look-ups: taking the keys from a set would walk through all of them
        self._learn([w for w in set().union(*words) if w not in self.cache])
        return [self._encode([t])[0] if o else b"".join(map(get, w)) for t, o, w in zip(texts, odd, words, strict=True)]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for ``path``."""
    return workers.state(("packing", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, _task, _at (rank in its task and length): the pieces of every row of ``docs`` (doc_id, text)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            ids_of = b.column("doc_id").to_pylist()
            for first, block in workers.blocks(b.column("text"), 2 * workers.BLOCK_BYTES):
                for i, ids in enumerate(e.encode([t.decode() for t in block]), first):
                    ids += END
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        n = len(cut) // 4
                        for c, v in zip(cols, (ids_of[i], k, at // 4, n, zlib.crc32(cut), seen[n]), strict=True):
                            c.append(v)
                        seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            cols.insert(5, [task] * len(cols[0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*kinds, pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_at"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(part, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, _task bigint, _at bigint")


def match(runs: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """One successor sweep over ``runs`` (kind, value, first, count, sequence, copies, at) of one range of values.

    Upward through lengths and gaps, each gap takes the longest piece below it that no smaller gap took, as often as
    the gap holds that length: of the pieces whose successor a gap is, the longest wins, and of equal ones the lower
    rank. Gives segments, gaps that shrank (kind SHRUNK), and the pieces and gaps that are left.
    """
    waiting: list[list[int]] = []
    out = []
    for kind, value, first, count, *rest in sorted(runs, key=lambda r: (r[1], r[0], r[2])):
        if kind == PIECES:
            waiting.append([value, first, count])
            continue
        while count and waiting:
            top = waiting[-1]
            copies = value // top[0]
            # sequences that take all they hold of this length; then one that takes fewer, the last of them
            whole = min(count, top[2] // copies)
            for n, q in ((whole, copies), (1, top[2] - whole * copies)):
                if n and q and count:
                    out += [(SEGMENT, top[0], top[1], n * q, first, q, value), (SHRUNK, value - q * top[0], first, n, *rest)]
                    first, count = first + n, count - n
                    top[1], top[2] = top[1] + n * q, top[2] - n * q
            if not top[2]:
                waiting.pop()
        if count:
            out.append((GAPS, value, first, count, *rest))
    return out + [(PIECES, *w, 0, 0, 0) for w in waiting]


def _joined(runs: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """``runs`` with gaps of 0 left out, and runs of one gap whose sequences follow one another made one."""
    out = [r for r in runs if r[0] in (PIECES, SEGMENT)]
    gaps: list[list[int]] = []
    for _, gap, first, count, *_ in sorted((r for r in runs if r[0] in (GAPS, SHRUNK) and r[1]), key=lambda r: r[1:3]):
        if gaps and gaps[-1][0] == gap and gaps[-1][1] + gaps[-1][2] == first:
            gaps[-1][2] += count
        else:
            gaps.append([gap, first, count])
    return out + [(GAPS, *g, 0, 0, 0) for g in gaps]


def _turn(rows: list[tuple[int, ...]], capacity: int) -> list[tuple[int, ...]]:
    """What is left after the sweeps of the ranges: swept as one, ``SWEEPS`` times, with the next band or new sequences after each.

    Bands of lengths come in turn, longest first, so that shorter pieces are left for what longer ones leave. Sequences
    are opened where no gap holds the shortest piece of the band or a sweep placed less than ``SLOW`` of it: first as
    many as the band's tokens fill, then as many as equal pieces would.
    """
    _, _, opened, before, again, _, _ = next((r for r in rows if r[0] == STATE), (STATE, 0, 0, 0, 0, 0, 0))
    placed, rest = [r for r in rows if r[0] == SEGMENT], [r for r in rows if r[0] == RESTING]
    shrunk, open_ = [r for r in rows if r[0] == SHRUNK], [r for r in rows if r[0] in (PIECES, GAPS)]
    for _ in range(SWEEPS):
        swept = _joined(shrunk + match(open_))
        placed += [r for r in swept if r[0] == SEGMENT]
        playing, shrunk = [r for r in swept if r[0] == PIECES], []
        tokens = sum(r[1] * r[3] for r in playing)
        slow = before - tokens < SLOW * before
        if not playing and rest:
            low = max([0, *(capacity // k for k in BANDS if capacity // k < max(r[1] for r in rest))])
            playing = [(PIECES, *r[1:]) for r in rest if r[1] > low]
            rest = [r for r in rest if r[1] <= low]
            tokens, again, slow = sum(r[1] * r[3] for r in playing), 0, False
        # gaps that hold no piece that is still to come go
        least = min((r[1] for r in playing + rest), default=capacity + 1)
        gaps = [r for r in swept if r[0] == GAPS and r[1] >= least]
        if playing and (slow or max((r[1] for r in gaps), default=0) < min(r[1] for r in playing)):
            n = math.ceil(sum(Fraction(r[3], capacity // r[1]) for r in playing)) if again else -(-tokens // capacity)
            gaps.append((GAPS, capacity, opened, n, 0, 0, 0))
            opened, again = opened + n, 1
        before, open_ = tokens, playing + gaps
    return [*open_, *rest, *placed, (STATE, 0, opened, before, again, 0, 0)]


def _swept(runs: DataFrame, work: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """``runs`` after ``work`` on the runs of each partition."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = work([tuple(r.values()) for b in batches for r in b.to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(RUN))], list(RUN))

    return runs.mapInArrow(part, ", ".join(f"{c} bigint" for c in RUN))


def _superstep(state: DataFrame, capacity: int) -> DataFrame:
    """``state`` after the playing pieces met the gaps: near ones within their range of values, then the rest."""
    width = max(1, capacity // RANGES)

    def near(rows: list[tuple]) -> list[tuple]:
        ranges: dict[int, list[tuple]] = defaultdict(list)
        for r in rows:
            if r[0] in (PIECES, GAPS):
                ranges[r[1] // width].append(r)
        return [r for r in rows if r[0] not in (PIECES, GAPS)] + [x for r in ranges.values() for x in match(r)]

    return _swept(_swept(state.repartition(RANGES, F.floor(F.col("value") / width)), near).repartition(1), lambda rows: _turn(rows, capacity))


def segments(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """length, first, count, sequence, copies, offset: places of all pieces of ``counts`` (length, count), by runs of ranks."""
    spark, path = counts.sparkSession, scratch(counts.sparkSession, "runs")
    zero = [F.lit(0).cast("long").alias(c) for c in RUN[4:]]
    begin = counts.select(F.lit(RESTING).cast("long").alias("kind"), F.col("length").alias("value"), zero[0].alias("first"), F.col("count"), *zero)
    state = written(_swept(begin.repartition(1), lambda rows: _turn(rows, capacity)), "runs", path)
    while state.where(F.col("kind").isin(PIECES, RESTING)).limit(1).count():
        old, path = path, scratch(spark, "runs")
        for _ in range(STEPS):
            state = _superstep(state, capacity)
        state = written(state, "runs", path)
        discard(spark, old)
    return state.where(F.col("kind") == SEGMENT).select(F.col("value").alias("length"), "first", "count", "sequence", "copies", (F.lit(capacity) - F.col("at")).alias("offset"))


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows``, as ``pieces`` gives them, with sequence_id and offset in place of their ranks."""
    per = rows.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(per.select("length", "_task", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "ranks")
    found = segments(bases.groupBy("length").agg(F.sum("_n").alias("count")), capacity)
    ranked = rows.join(bases.drop("_n"), ["length", "_task"]).withColumn("_rank", F.col("_base") + F.col("_at"))
    own = F.broadcast(found.select(F.col("length"), F.col("first").alias("_first"), F.col("count").alias("_count"), F.col("sequence").alias("_sequence"), F.col("copies").alias("_copies"), F.col("offset").alias("_offset")))
    met = ranked.join(own, "length").where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count")))
    nth = F.col("_rank") - F.col("_first")
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.floor(nth / F.col("_copies"))).alias("sequence_id"), (F.col("_offset") + nth % F.col("_copies") * F.col("length")).alias("offset")
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` with their places. Tokenizes once: the pieces are written before they are counted."""
    return place(written(pieces(docs, path, capacity), "pieces"), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
