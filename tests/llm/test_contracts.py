"""The opN_ queries over a small stored table with every edge case, against brute force."""

import base64
import hashlib
import re
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from concord.llm import bpe, fingerprint, jaccard, langid, packing, pii, secret_scan, toxicity, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(odd, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = odd.select("doc_id", "text", "lang", F.lit("web").alias("source"), F.length("text").cast("long").alias("n_chars"))
    more = spark.range(100, 160).select(
        "id", F.when(F.col("id") % 2 == 0, "das haus und der garten von ihr").otherwise("the house and the garden of her").alias("text"),
        F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"), F.lit("web"), F.lit(31).cast("long"),
    )
    docs.union(more).write.parquet(f"{path}/documents.parquet")
    spark.range(0, 160).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (F.col("id") % 2).cast("int").alias("toxic")).write.parquet(f"{path}/labels.parquet")
    pages = [(1, "http://a", "x"), (2, "http://b c", "x"), (3, None, None), (4, "u", ""), (5, "u", "é" * 50_000), (6, "u", "x"), (7, "u", "y")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_op1(spark, folder, rows):
    got = langid.op1_language_id(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    text = dict(rows)
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text[r.doc_id]))
        if r.doc_id is not None:
            assert r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2)
            if r.doc_id >= 100:
                assert r.lang_pred == ("en" if r.doc_id % 2 else "de")


def test_op4(spark, folder, rows):
    got = fingerprint.op4_fingerprint(spark, folder).collect()
    assert len(got) == len(rows)
    # null doc_ids come first; ties go by the text
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(want)
    text = dict(rows)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


def test_op6(spark, folder, rows):
    got = secret_scan.op6_secret_scan(spark, folder).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        told = ",".join(x for _, _, x in sorted(spans))
        want.append((i, *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(told.encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == Counter(want)
    assert all(set(s.split(":")[0] for s in r.spans.split(",") if s) <= {"assign", "access", "hex", "identifier", "weak", "endpoint"} for r in got)


def test_op7(spark, folder, rows):
    got = toxicity.op7_toxicity(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op7_windows_equal_the_whole_chain():
    """Marginals of windows with halos against forward-backward over the whole text, by the field that training gives."""
    import numpy as np

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["bad", "worse", "good", "fine", "the", "and"], 700)).encode() for _ in range(3)]
    clean = [" ".join(rng.choice(["good", "fine", "the", "and"], 700)).encode() for _ in range(40)]
    field = toxicity.Field()
    field.fit(texts * 6 + clean, np.array([1] * 18 + [0] * 40))
    features, _, _, counts = toxicity.tokens(texts)
    got = field.marginals(features, counts)
    e, a, first = field.emissions(field.slots(features), len(features[0])), np.exp(field.trans), 0
    for n in counts.tolist():
        x = np.exp(np.clip(e[first : first + n], -30, 30))
        fwd, bwd = np.zeros((n, 2)), np.ones((n, 2))
        fwd[0] = 1, x[0]
        for t in range(1, n):
            fwd[t] = (fwd[t - 1] @ a) * (1, x[t])
            fwd[t] /= fwd[t].sum()
        for t in range(n - 2, -1, -1):
            bwd[t] = a @ (bwd[t + 1] * (1, x[t + 1]))
            bwd[t] /= bwd[t].sum()
        p = fwd * bwd
        assert np.abs(p[:, 1] / p.sum(1) - got[first : first + n]).max() < 1e-6
        first += n


def test_op8(spark, folder, rows):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert Counter(tuple(r)[:4] for r in bpe.op8_byte_bpe(spark, folder).collect()) == Counter(want)


def test_op9(spark, folder):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    last = {v: max(k for k in pages if pages[k] == v) for v in pages.values()}
    want = {(k, len(v), base64.b32encode(hashlib.sha1(v).digest()).decode(), "response" if last[v] == k else "revisit", None if last[v] == k else last[v]) for k, v in pages.items()}
    assert {tuple(r) for r in warc.op9_warc(spark, folder).collect()} == want


def test_op9_notices_a_damaged_payload():
    good = warc.parse(warc.record(1, "http://b c", b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None))
    warc.check(good)
    assert good["WARC-Target-URI"] == "http://b%20c"
    with pytest.raises(ValueError, match="damaged"):
        warc.check(good | {"payload": b"abd"})


def test_op3_and_op5(spark, folder, rows):
    got = jaccard.op3_jaccard_join(spark, folder).collect()
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(s)) for i, s in sets)
    comp = {i: min(j for j, x in sets if j is not None and (j == i or x and 100 * len(s & x) >= 75 * len(s | x))) for i, s in sets if i is not None}
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == set(comp.items())
    places = packing.op5_best_fit_packing(spark, folder).collect()
    assert Counter(r.doc_id for r in places if r.piece == 0) == Counter(i for i, _ in rows)


def test_columns_of_any_name(odd):
    """Names that operators use themselves, and dots."""
    docs = odd.withColumns({n: F.lit(7) for n in ("x.y", "_gone", "sequence_id", "offset", "_task", "_at", "ids", "tok", "doc", "_row")})
    kept = jaccard.keep_representatives(docs)
    assert kept.columns == docs.columns and {r["x.y"] for r in kept.collect()} == {7}
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(docs).count() == odd.count()
    found = langid.identify(docs, None)
    assert found.columns == [*docs.columns, "lang_pred", "lang_score"] and found.count() == odd.count()
    assert toxicity.score(docs, toxicity.Field()).count() == odd.count()
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
