"""Toxicity by a linear-chain conditional random field over words.

Tokens are runs of letters; a token's features are its hash and those of its first 4 and 5 bytes, so that
inflected forms share weights. Documents carry the labels, so tokens are labelled from them: a feature
is toxic when its document frequency in toxic documents exceeds that in the others beyond chance
(log-likelihood ratio against the number of features tried, and a rate ten times as high), and a token
is labelled 1 when it stands in a toxic document and has such a feature. The field has two states; its
emission weights of these features, bias and transitions are fitted by gradient ascent on the
likelihood of the labelled tokens. A document's score is a logistic function of its largest marginal
and of the sum of its marginals; spans are runs of tokens whose marginal is at least one half.

Marginals come from forward-backward over the whole text. Texts are laid out in windows of ``WINDOW``
tokens with ``HALO`` tokens on either side, all windows of a batch in step: the chain forgets its past
geometrically, so the halo stands for the rest of the text.

Training takes at most ``SAMPLE`` labelled rows, those with the smallest hashes of doc_id, and of texts of
more than ``TRAIN_CHARS`` four parts; the fitted
model is a few thousand numbers and is broadcast.

Nulls and edges: null text is empty; a text without tokens gets the score of zero marginals; rows with a
null label are not learned from; without labels of both kinds every score is 0; a doc_id with several labels
or texts is learned from once for each pair; equal texts get equal scores; texts are scored whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import workers
from concord.llm.common import mapped, table
from concord.llm.words import blocks, words

SAMPLE = 6000
#: Characters of a text that training takes.
TRAIN_CHARS = 40_000
WINDOW, HALO = 128, 48
PREFIXES = (4, 5)
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[65:91] = _SEPARATOR[97:123] = _SEPARATOR[128:256] = False


def tokens(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(features, start, end, counts): three feature hashes per token, and the number of tokens of each text."""
    h, start, end, counts, heads = words(texts, _SEPARATOR, PREFIXES)
    return [h, *heads], start, end, counts


def layout(counts: np.ndarray, halo: int) -> np.ndarray:
    """Token numbers of each window, -1 outside its text: rows of halo + WINDOW + halo."""
    n = -(-counts // WINDOW)
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = k[:, None] * WINDOW + np.arange(-halo, WINDOW + halo)[None, :]
    return np.where((at >= 0) & (at < counts[doc][:, None]), at + first[doc][:, None], -1)


class Field:
    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.weights = np.zeros(0)
        self.bias = -6.0
        self.trans = np.array([[0.5, -0.5], [0.0, 0.0]])
        self.doc = np.array([-4.0, 4.0, 1.0])
        self.fitted = False

    def slots(self, features: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each kind of feature the tokens that have a known one, and which."""
        if not hasattr(self, "near"):
            self.near = np.zeros(1 << 16, bool)
            self.near[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        out = []
        for h in features:
            t = np.flatnonzero(self.near[(h & np.uint64(0xFFFF)).astype(np.int64)])
            i = np.searchsorted(self.keys, h[t])
            ok = (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] == h[t]) if len(self.keys) else np.zeros(len(t), bool)
            out.append((t[ok], i[ok]))
        return out

    def emissions(self, slots: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        e = np.full(n + 1, self.bias)
        for t, i in slots:
            e[t] += self.weights[i]
        return e

    def messages(self, e: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward odds of state 1 at every place of ``at``."""
        a = np.exp(self.trans)
        x, inside = np.exp(np.clip(e[at.T], -30, 30)), (at >= 0).T
        fwd, bwd = np.ones(x.shape), np.ones(x.shape)
        r = None
        for t in range(len(x)):
            # before the text begins there is no odds to pass on, just the start of the chain
            r = x[t].copy() if r is None else np.where(inside[t - 1], x[t] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]), x[t])
            fwd[t] = r
        b = np.ones(x.shape[1])
        for t in range(len(x) - 2, -1, -1):
            y = x[t + 1] * b
            b = np.where(inside[t + 1], (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y), 1.0)
            bwd[t] = b
        return fwd.T, bwd.T

    def marginals(self, features: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """The probability of state 1 of each token."""
        n = len(features[0])
        e = self.emissions(self.slots(features), n)
        at = layout(counts, HALO)
        out = np.zeros(n + 1)
        for k in range(0, len(at), 4096):
            fwd, bwd = self.messages(e, at[k : k + 4096])
            core = slice(HALO, HALO + WINDOW)
            odds = fwd[:, core] * bwd[:, core]
            out[at[k : k + 4096, core]] = odds / (1 + odds)
        return out[:n]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 60, rate: float = 0.3) -> None:
        """Token labels from document labels, then the field, then the document's logistic function."""
        total = [int((labels == v).sum()) for v in (0, 1)]
        if not all(total):
            return
        parts, pairs = [], []
        for first, end in blocks(texts):
            features, _, _, counts = tokens(texts[first:end])
            parts.append((features, counts, labels[first:end]))
            owner = np.repeat(np.arange(first, end), counts)
            for h in features:
                o = np.lexsort((owner, h))
                hs, os = h[o], owner[o]
                new = np.ones(len(o), bool)
                new[1:] = (hs[1:] != hs[:-1]) | (os[1:] != os[:-1])
                new &= hs != 0
                pairs.append((hs[new], labels[os[new]]))
        h, y = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
        keys, inverse = np.unique(h, return_inverse=True)
        t = np.bincount(inverse, weights=y)
        c = np.bincount(inverse) - t
        rest0, rest1 = total[0], total[1]
        p1, p0, p = t / rest1, c / rest0, (t + c) / (rest0 + rest1)
        log = lambda k, n, q: k * np.log(np.maximum(q, 1e-12)) + (n - k) * np.log(np.maximum(1 - q, 1e-12))
        gain = log(t, rest1, p1) + log(c, rest0, p0) - log(t, rest1, p) - log(c, rest0, p)
        toxic = (gain > np.log(len(keys)) + np.log(20)) & (p1 > 10 * p0)
        self.keys = keys[toxic]
        self.weights = np.zeros(len(self.keys))
        if hasattr(self, "near"):
            del self.near
        # training windows: those with a labelled token, and as many others
        seqs = []
        for features, counts, lab in parts:
            slots = self.slots(features)
            n = len(features[0])
            hit = np.zeros(n + 1)
            for tk, _ in slots:
                hit[tk] = 1
            hit[:n] *= np.repeat(lab, counts)
            at = layout(counts, 0)
            some = hit[at].max(1) > 0 if len(at) else np.zeros(0, bool)
            seen = np.zeros(n + 1, bool)
            for tk, _ in slots:
                seen[tk] = True
            other = ~some & (seen[at].any(1) | (np.arange(len(at)) % 10 == 0)) if len(at) else some
            seqs.append((slots, hit, at[some | other], n))
        self._ascend(seqs, epochs, rate)
        # the document's function of its marginals
        x = np.concatenate([self.summary(self.marginals(f, c), c) for f, c, _ in parts])
        self.doc = _logistic(x, labels)
        self.fitted = True

    def _ascend(self, seqs: list, epochs: int, rate: float) -> None:
        params = np.concatenate([[self.bias], self.trans[:, 1] - self.trans[:, 0], self.weights])
        m, s = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, epochs + 1):
            self.bias, self.weights = params[0], params[3:]
            self.trans = np.stack([np.zeros(2), params[1:3]], 1)
            g, count = np.zeros_like(params), 0
            for slots, hit, at, n in seqs:
                if not len(at):
                    continue
                e = self.emissions(slots, n)
                fwd, bwd = self.messages(e, at)
                inside = at >= 0
                p = fwd * bwd / (1 + fwd * bwd) * inside
                y = hit[at] * inside
                d = np.zeros(n + 1)
                d[at[inside]] = (y - p)[inside]
                g[0] += d[:n].sum()
                for tk, i in slots:
                    np.add.at(g[3:], i, d[tk])
                # expected transitions into state 1 from each state
                a = np.exp(self.trans)
                x = np.exp(np.clip(e[at], -30, 30))
                into = (x * bwd)[:, 1:]
                f = fwd[:, :-1]
                joint = [a[0, 0] + 0 * f, a[0, 1] * into, a[1, 0] * f, a[1, 1] * f * into]
                z = sum(joint)
                both = inside[:, 1:] & inside[:, :-1]
                g[1] += ((y[:, 1:] * (1 - y[:, :-1]) - joint[1] / z) * both).sum()
                g[2] += ((y[:, 1:] * y[:, :-1] - joint[3] / z) * both).sum()
                count += inside.sum()
            g = g / max(1, count) * 100 - 1e-3 * np.concatenate([[0], params[1:]])
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g**2
            params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        self.bias, self.weights = params[0], params[3:]
        self.trans = np.stack([np.zeros(2), params[1:3]], 1)

    @staticmethod
    def summary(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(1, largest marginal, log of 1 + their sum) of each document."""
        out = np.zeros((len(counts), 3))
        out[:, 0] = 1
        some = np.flatnonzero(counts)
        if len(some):
            first = (np.cumsum(counts) - counts)[some]
            out[some, 1] = np.maximum.reduceat(p, first)
            out[some, 2] = np.log1p(np.add.reduceat(p, first))
        return out

    def scores(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(counts))
        return 1 / (1 + np.exp(-np.clip(self.summary(p, counts) @ self.doc, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Regularised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field learned from at most ``sample`` labelled documents that are not held out."""
    some = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample is bounded, so it is the side that is broadcast
    text, n, parts = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit(""))), TRAIN_CHARS // 4
    # of longer texts four parts, spread over the whole, so that the driver holds SAMPLE x TRAIN_CHARS at most
    cuts = F.concat_ws(" ", *[F.substring(text, ((n - parts) * k / 3 + 1).cast("int"), F.lit(parts)) for k in range(4)])
    texts = docs.select("doc_id", F.when(n > TRAIN_CHARS, cuts).otherwise(text).alias("text"))
    rows = texts.join(F.broadcast(some), "doc_id").select("doc_id", "toxic", "text").orderBy("doc_id", "toxic", "text").limit(sample).collect()
    field = Field()
    field.fit([r["text"].encode() for r in rows], np.array([int(r["toxic"] == 1) for r in rows]))
    return field


def score(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with toxic_score and toxic_spans (array<struct<start, end, score>>; code points), which replace columns of these names; rows and other columns stay."""
    docs = docs.drop("toxic_score", "toxic_spans")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def spans(text: bytes, base: int, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[dict]:
        found = []
        lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        for t in np.flatnonzero(p >= 0.5).tolist():
            s, e, v = int(lead[start[t] - base]), int(lead[end[t] - base]), float(p[t])
            if found and found[-1]["last"] == t - 1:
                found[-1] |= {"end": e, "score": max(v, found[-1]["score"]), "last": t}
            else:
                found.append({"start": s, "end": e, "score": v, "last": t})
        return [{k: x[k] for k in ("start", "end", "score")} for x in found]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        field = workers.state(("toxicity",), lambda: None) or shared.value
        for b in batches:
            values: list[float] = []
            found: list[list[dict]] = []
            for _, block in workers.blocks(b.column(at)):
                features, start, stop, counts = tokens(block)
                p = field.marginals(features, counts)
                values += field.scores(p, counts).tolist()
                base, token = 1, 0
                for t, n in zip(block, counts.tolist(), strict=True):
                    own = slice(token, token + n)
                    found.append(spans(t, base, p[own], start[own], stop[own]) if n and p[own].max() >= 0.5 else [])
                    base, token = base + len(t) + 1, token + n
            yield [*b.columns, pa.array(values, pa.float64()), pa.array(found, kind)]

    return mapped(docs, part, {"toxic_score": "double", "toxic_spans": "array<struct<start:bigint,end:bigint,score:double>>"})


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = train(docs, table(spark, sf_dir, "labels"))
    found = score(docs.select("doc_id", "text"), field)
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans")
    )
