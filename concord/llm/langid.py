"""Language identification by a byte convolutional network trained in numpy.

A text is cut into windows of ``WINDOW`` bytes. Each filter spans 2 or 4 bytes: its value at a position is
the sum of one learned weight per place and byte, max-pooled over the window, rectified and fed to a
softmax. Filters of four bytes are two filters of two, the second looked up two bytes on, so a window
costs table look-ups only. A text's distribution is the mean over its windows, weighted by their letters.

Training learns from text and language of at most ``SAMPLE`` rows (the smallest hashes of doc_id) with
``PER_DOC`` windows each, so the driver holds SAMPLE x PER_DOC x WINDOW bytes at most. Only max-pooled
positions get gradients. The model is small (about 1 MB) and is broadcast.

Nulls and edges: null text, or text without a letter, is ``und`` with score 0; rows without a language are
not learned from; without any labelled row every text is ``und``. White space and digits are one byte
class each; equal texts get equal predictions; of languages that are as likely the first by name is taken; rows that
repeat a doc_id are rows like others, and texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import workers
from concord.llm.common import mapped, table

WINDOW = 256
SAMPLE = 3000
PER_DOC = 4
FILTERS = 24
EPOCHS = 12
_LETTER = re.compile(r"[^\W\d_]")

#: byte classes: letters without case, each byte of longer characters, white space, digits, the rest
_CLASS = np.full(256, 2, np.int32)
_CLASS[[0]] = 0
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 3
_CLASS[65:91] = np.arange(4, 30)
_CLASS[97:123] = np.arange(4, 30)
_CLASS[128:256] = np.arange(30, 158)
CLASSES = 158


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(classes, owner): rows of WINDOW byte classes, zero-padded, and the text that each is of."""
    n = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    owner = np.repeat(np.arange(len(texts)), n)
    buf = b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist(), strict=True))
    return _CLASS[np.frombuffer(buf, np.uint8)].reshape(-1, WINDOW), owner


class Net:
    """t2: (classes^2, filters) of two-byte filters; t4a, t4b: the halves of four-byte filters."""

    def __init__(self, langs: list[str], seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        # one table per place; folded into pair tables for use
        self.w2 = rng.normal(0, 0.3, (2, CLASSES, FILTERS)).astype(np.float32)
        self.w4 = rng.normal(0, 0.3, (4, CLASSES, FILTERS)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (2 * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)
        self.fold()

    def fold(self) -> None:
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        # both widths side by side: the first half of a four-byte filter shares the look-up of the two-byte one
        self.head = np.concatenate([pair(*self.w2), pair(*self.w4[:2])], 1)
        self.tail = pair(*self.w4[2:])

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, positions of the two-byte maxima, of the four-byte maxima)."""
        p = x[:, :-1] * CLASSES + x[:, 1:]
        head = self.head[p]
        two = head[:, :, :FILTERS]
        four = head[:, :-2, FILTERS:] + self.tail[p[:, 2:]]
        i, j = two.argmax(1), four.argmax(1)
        v = np.concatenate([np.take_along_axis(two, i[:, None, :], 1)[:, 0], np.take_along_axis(four, j[:, None, :], 1)[:, 0]], 1)
        return v, i, j

    def maxima(self, x: np.ndarray) -> np.ndarray:
        p = x[:, :-1] * CLASSES + x[:, 1:]
        head = self.head[p]
        return np.concatenate([head[:, :, :FILTERS].max(1), (head[:, :-2, FILTERS:] + self.tail[p[:, 2:]]).max(1)], 1)

    def softmax(self, v: np.ndarray) -> np.ndarray:
        z = np.maximum(v, 0) @ self.out + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 128) -> None:
        """Adam on the cross entropy, classes weighted alike."""
        rng = np.random.default_rng(1)
        share = np.bincount(y, minlength=len(self.langs)).astype(np.float32)
        weight = (len(y) / np.maximum(share, 1) / len(self.langs))[y]
        names = ("w2", "w4", "out", "bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        s = {k: np.zeros_like(getattr(self, k)) for k in names}
        f = np.arange(FILTERS)[None, :]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                r = order[at : at + batch]
                xb = x[r]
                v, i, j = self.pooled(xb)
                d = self.softmax(v)
                d[np.arange(len(r)), y[r]] -= 1
                d *= (weight[r] / len(r))[:, None]
                g = {"out": np.maximum(v, 0).T @ d, "bias": d.sum(0), "w2": np.zeros_like(self.w2), "w4": np.zeros_like(self.w4)}
                dv = (d @ self.out.T) * (v > 0)
                for k in range(2):
                    np.add.at(g["w2"][k], (np.take_along_axis(xb, i + k, 1), f), dv[:, :FILTERS])
                for k in range(4):
                    np.add.at(g["w4"][k], (np.take_along_axis(xb, j + k, 1), f), dv[:, FILTERS:])
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    up = (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - rate * up).astype(np.float32))
                self.fold()

    def predict(self, texts: list[bytes], block: int = 64) -> np.ndarray:
        """The distribution over ``langs`` of each text."""
        total, mass = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        x, owner = windows(texts)
        for at in range(0, len(x), block):
            xb, ob = x[at : at + block], owner[at : at + block]
            w = (xb >= 4).sum(1) + 1e-6
            np.add.at(total, ob, self.softmax(self.maxima(xb)) * w[:, None])
            np.add.at(mass, ob, w)
        return total / np.maximum(mass, 1e-9)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, sample: int = SAMPLE) -> Net | None:
    """A network learned from the labelled rows of ``docs`` (doc_id, text, lang) that are not held out."""
    n = F.length("text")
    # windows spread over the whole text, a fixed number of each document
    cuts = [F.substring("text", F.greatest(F.lit(1), (n - WINDOW) * k / max(1, PER_DOC - 1) + 1).cast("int"), F.lit(WINDOW)) for k in range(PER_DOC)]
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    few = known.where(n > 0).select("h", "lang", F.array_distinct(F.array(*cuts)).alias("cuts"))
    least = lambda rows: rows.orderBy("h", "lang", "cuts").limit(sample).collect()
    # the hashes are even, so nearly always the smallest ones lie in a share of twice the sample: tasks then send that share
    # alone, however many tasks there are
    share = 2 * sample / max(1, known.count())
    rows = least(few.where(F.col("h") < int(share * 2**64) - 2**63)) if share < 1 else least(few)
    if len(rows) < sample and share < 1:
        rows = least(few)
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    some = [(c.encode()[:WINDOW], langs.index(r["lang"])) for r in rows for c in r["cuts"] if _LETTER.search(c)]
    net = Net(langs)
    if some:
        x, _ = windows([c for c, _ in some])
        net.fit(x, np.array([y for _, y in some]))
    return net


def identify(docs: DataFrame, net: Net | None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the language and its score under ``names``, which replace columns of these names; all rows and other columns stay."""
    docs = docs.drop(*names)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        net = workers.state(("langid",), lambda: None) or shared.value
        for b in batches:
            lang, score = ["und"] * len(b), [0.0] * len(b)
            for first, texts in workers.blocks(b.column(at)):
                known = [i for i, t in enumerate(texts) if net and t and _LETTER.search(t.decode())]
                p = net.predict([texts[i] for i in known]) if known else np.zeros((0, 1))
                for i, k, v in zip(known, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    lang[first + i], score[first + i] = net.langs[k], min(1.0, max(0.0, v))
            yield [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return mapped(docs, part, {names[0]: "string", names[1]: "double"})


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs)
    found = identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
