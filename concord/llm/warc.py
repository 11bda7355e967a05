"""WARC archives with one Zstandard dictionary each, and their reader.

Each archive begins with a skippable frame that holds a dictionary, built from a bounded sample of that
archive's own records; every record after it is a Zstandard frame of its own, compressed with that
dictionary. Of records with equal payloads (SHA-1 and length) the one with the largest page_id is a
``response``, the others are ``revisit`` records without the payload that refer to it.

Groups of equal payloads are found from digests alone and joined back in a skew-proof way. Archives go to
the shared folder under names unique to the task attempt, and only those named by the written manifest
are read, so a lost executor or a repeated task leaves no record twice.

Reading back, digest and length of every response are computed again from its payload, and a difference is
an error.

Nulls and edges: white space and control characters in a URL are percent-encoded; null html is an empty payload and null url an empty target; payloads below ``min_bytes``
are all responses; repeated page_ids with equal payloads are one response each; an empty table writes no
archive and reads back no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import join_groups, scratch, table, written

# fixed value: the magic number of the dictionary's skippable frame
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 32 << 10
#: Records and bytes of each that an archive's dictionary is built from.
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 4 << 10
#: Bytes of records that a task holds before it writes them; a larger record is held alone.
HELD_BYTES = 16 << 20
#: A new archive begins after so many bytes.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
_SPACE = re.compile(r"[\s\x00-\x1f]")
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = _SPACE.sub(lambda m: quote(m[0]), url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    fields += [("X-Page", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields, ``payload`` and ``payload_bytes`` (of the full payload also in a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:40]}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    fields["payload"] = payload
    fields["payload_bytes"] = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    return fields


def check(fields: dict) -> None:
    """Fails on a response whose payload is not the one that its digest and length are of."""
    if fields["WARC-Type"] == "response":
        told = "sha1:" + base64.b32encode(hashlib.sha1(fields["payload"]).digest()).decode()
        if told != fields["WARC-Payload-Digest"] or len(fields["payload"]) != fields["payload_bytes"]:
            raise ValueError(f"a damaged payload in {fields['WARC-Record-ID']}")


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of a sample of ``records``; raw content where they are too few or too small to train on."""
    some = [r[:SAMPLE_BYTES] for r in records[:SAMPLE_RECORDS]]
    raw = b"".join(some)[-DICTIONARY_BYTES:]
    if len(some) < 20:
        return raw
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, some)) // 4), some, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return raw


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    data = stream.read(size)
    pending = b""
    made = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    while True:
        out, reader = [], made.decompressobj()
        started = False
        while not reader.eof:
            if not pending:
                pending = stream.read(1 << 18)
                if not pending:
                    if started:
                        raise ValueError("an archive ends within a record")
                    return
            started = True
            out.append(reader.decompress(pending))
            pending = reader.unused_data
        yield b"".join(out)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_digests(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("_sha1"), F.length(payload).cast("long").alias("_bytes"))


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (hex), refers_to (null: a response)."""
    rows = with_digests(pages)
    n = pages.count()
    key = F.concat_ws(":", "_sha1", F.col("_bytes").cast("string"))
    groups = rows.select(key.alias("_key"), "page_id").groupBy("_key").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    keyed = rows.withColumn("_key", key)
    # which pages are revisits is found from digests alone; the pages then move once, to meet it
    refs = join_groups(keyed.select("_key", "page_id"), groups, "_key", "_size", n).where("page_id < _first").select("page_id", "_key", "_first").distinct()
    found = keyed.join(refs, ["page_id", "_key"], "left")
    return found.select("page_id", "url", "payload", F.col("_sha1").alias("digest"), F.when(F.col("_bytes") >= min_bytes, F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives of ``pages`` to ``folder``; the written manifest: path, records, bytes."""
    decided = decide(pages, min_bytes)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, root = _filesystem(folder)
        target.create_dir(root, recursive=True)
        out = packer = None
        told: list[tuple[str, int, int]] = []
        name, n, size = "", 0, 0
        waiting: list[bytes] = []
        held = 0

        def begin() -> None:
            nonlocal out, packer, name, n, size
            name = f"{uuid.uuid4().hex}.warc.zst"
            out = target.open_output_stream(f"{root}/{name}", compression=None)
            data = dictionary(waiting)
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data))
            n, size = 0, 8 + len(data)

        def flush(last: bool) -> None:
            nonlocal out, n, size
            if waiting and out is None:
                begin()
            for r in waiting:
                frame = packer.compress(r)
                out.write(frame)
                n, size = n + 1, size + len(frame)
            waiting.clear()
            if out is not None and (last or size >= ARCHIVE_BYTES):
                out.close()
                told.append((f"{folder}/{name}", n, size))
                out = None

        for b in batches:
            for page_id, url, payload, digest, ref in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                told_digest = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                waiting.append(record(page_id.as_py(), url.as_py(), payload.as_py(), told_digest, ref.as_py()))
                held += len(waiting[-1])
                if len(waiting) >= SAMPLE_RECORDS or held >= HELD_BYTES:
                    flush(False)
                    held = 0
        flush(True)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in told], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return written(decided.mapInArrow(part, "path string, records bigint, bytes bigint"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """The records of the archives that ``manifest`` names: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null: revisit)."""
    number = lambda x: int(x) if x else None
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [k for k, _ in kinds])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                source, at = _filesystem(path)
                rows, size = [], 0
                with source.open_input_stream(at, compression=None) as stream:
                    for data in frames(stream):
                        f = parse(data)
                        kind = f["WARC-Type"]
                        check(f)
                        rows.append((number(f["X-Page"]), f["WARC-Target-URI"], f["payload_bytes"], f["WARC-Payload-Digest"].removeprefix("sha1:"), kind, number(f.get("X-Refers-To-Page")), f["payload"] if kind == "response" else None))
                        size += len(data)
                        if size >= 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    spark = manifest.sparkSession
    # one task per few archives: the manifest is small, its archives are not
    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return manifest.select("path").repartition(tasks).mapInArrow(part, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
