"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The tokenizer is built from a file of ranks: every way of splitting a token into two others is a merge
of that token's rank, as rank-driven merging has it. Text is cut at single spaces that stand between two
characters other than white space; the pre-tokenization pattern always starts a match there, so each
piece is encoded once per worker (a bounded cache) and the ids of a text are those of its pieces in
order. Texts with other uses of white space beside spaces are encoded whole.

``decode`` reverses the byte table: ids map to byte strings, and characters split over several tokens
come together again as their bytes do. ``offsets`` gives each token's place in characters: a token that
begins or ends inside a character covers the whole of it.

Nulls and edges: null text is empty, with no ids; special-token strings in a text are ordinary text; a
text may be arbitrarily long; ids out of range raise an error in ``decode``.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from concord.llm import workers
from concord.llm.common import mapped, table

#: Pieces a worker remembers; when full, the memory is emptied.
CACHE_PIECES = 200_000

def byte_table() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + n))
        n += b not in own
    return out


class Codec:
    """Encoder and decoder of one file of ranks."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_table()
        named = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = []
        for t, _ in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(t)):
                if t[:i] in ranks and t[i:] in ranks:
                    merges.append((named[t[:i]], named[t[i:]]))
        model = models.BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        size = max(ranks.values()) + 1
        self.tokens = [""] * size
        for t, r in ranks.items():
            self.tokens[r] = named[t]
        # the byte table reversed: what each character of a token stands for
        back = {c: b for b, c in enumerate(chars)}
        self.tokens = [bytes(back[c] for c in t) for t in self.tokens]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        pieces: list[list[str] | None] = []
        for t in texts:
            p = t.split(" ")
            p = [p[0], *[" " + x for x in p[1:]]]
            pieces.append(p)
        new = {x for x in set().union(*pieces) if x not in self.cache}
        # irregular: empty, or with white space at a cut
        odd = {x for x in new if x in ("", " ") or x[-1].isspace() or x[:1] != " " and x[0].isspace() or x[0] == " " and x[1].isspace()}
        fresh = list(new - odd)
        self.cache.update(zip(fresh, self._encode(fresh), strict=True))
        get = self.cache.get
        out: list[bytes] = []
        for t, p in zip(texts, pieces, strict=True):
            if not t:
                out.append(b"")
            elif odd and not odd.isdisjoint(p):
                out.append(self._encode([t])[0])
            else:
                out.append(b"".join(map(get, p)))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ``ids`` stand for."""
        x = np.frombuffer(ids, "<u4")
        if not len(x):
            return b""
        n = self.lengths[x]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[x] - (ends - n), n)
        return self.flat[at].tobytes()

    def offsets(self, ids: bytes, data: bytes | None = None) -> np.ndarray:
        """(start, end) of each token in characters of the decoded text, ``data``."""
        x = np.frombuffer(ids, "<u4")
        text = np.frombuffer(self.decode(ids) if data is None else data, np.uint8)
        lead = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        ends = np.cumsum(self.lengths[x])
        first = lead[np.minimum(ends - self.lengths[x] + 1, len(text))] - 1
        return np.stack([first, lead[ends]], 1)


def codec(path: str) -> Codec:
    """This worker's codec for ``path``."""
    return workers.state(("bpe", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<bigint>) of ``text``; other columns stay, an ``ids`` of theirs is replaced."""

    kept = docs.drop("ids")
    at = kept.columns.index(text)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            c = codec(path)
            ids = [x for _, block in workers.blocks(b.column(at)) for x in c.encode([t.decode() for t in block])]
            yield [*b.columns, pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64()))]

    return mapped(kept, part, {"ids": "array<bigint>"})


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codec(path)
            n, ids_sha, text_sha, places = [], [], [], []
            for _, block in workers.blocks(b.column("text"), 2 * workers.BLOCK_BYTES):
                for ids in c.encode([t.decode() for t in block]):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    data = c.decode(ids)
                    text_sha.append(hashlib.sha256(data).hexdigest())
                    places.append(zlib.crc32(c.offsets(ids, data).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(places, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_crc32"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(part, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, offsets_crc32 bigint")
