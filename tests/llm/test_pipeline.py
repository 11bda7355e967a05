"""The pipeline over a small table, against the same five stages in plain Python."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest

import corpus_pipeline
import public_tokenizers
from concord.llm import langid, pii
from concord.llm.common import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = {"en": "the house and garden of her with some water under that old tree where birds sing".split(), "de": "das haus und der garten von ihr mit wasser unter dem alten baum wo vogel singen".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(3), []
    for i in range(80):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + ("" if rng.random() < 0.5 else rng.choice("abcdefg")) for _ in range(60)), lang))
    text = dict((i, t) for i, t, _ in rows)
    rows += [
        (100, text[0], "en"), (101, text[1].upper(), "de"),  # copies: the last one stays
        (102, text[2] + " changed", "en"), (103, "new " + text[3], "de"),  # near copies: the first one stays
        (104, " ".join(rng.choice(WORDS["en"]) for _ in range(40)) + " mail bob@mail.example.org or +49 (30) 1234-567 IBAN DE89 3704 0044 0532 0130 00 for the invoice", "en"),
        (105, "12345 !!", "en"), (106, None, "de"), (107, "", "en"), (108, "zzqx", None),
        (109, " ".join(rng.choice(WORDS["en"]) + str(i) for i in range(2500)), "en"),
    ]
    path = str(tmp_path_factory.mktemp("docs"))
    table = [(i, "web", lang, t, len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(table, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def _language(rows, net, least):
    for d in rows:
        if d["text"] and re.search(r"[^\W\d_]", d["text"]):
            p = net.predict([d["text"].encode()])[0]
            if p.max() >= least:
                yield d | {"lang": net.langs[int(p.argmax())]}


def _exact(rows):
    last = {}
    for d in sorted(rows, key=lambda d: d["doc_id"]):
        last[d["text"].translate(LOWER)] = d
    return list(last.values())


def _near(rows):
    sets = {}
    for d in rows:
        w = d["text"].translate(LOWER).split()
        sets[d["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    gone, parent = set(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    gone = {i for i in sets if find(i) != i}
    return [d for d in rows if d["doc_id"] not in gone]


def _private(rows):
    for d in rows:
        text, spans = d["text"], sorted((s, e, k) for k, v in pii.find(d["text"]).items() for s, e in v)
        groups = []
        for s, e, k in spans:
            if groups and s < groups[-1][1]:
                groups[-1][1] = max(e, groups[-1][1])
            else:
                groups.append([s, e, k])
        for s, e, k in reversed(groups):
            text = f"{text[:s]}<{k.upper()}>{text[e:]}"
        yield d | {"text": text, "n_chars": len(text)}


@pytest.mark.parametrize("least", [corpus_pipeline.LEAST_SCORE, 0.9])
def test_pipeline_equals_its_five_stages_in_plain_python(spark, folder, monkeypatch, least):
    from tokenizers import Tokenizer

    stored = {}

    def keep(df, name):
        stored[name] = written(df, name)
        return stored[name]

    monkeypatch.setattr(corpus_pipeline, "written", keep)
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", least)
    packed = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, want = [r.asDict() for r in docs.collect()], {}
    rows = want["language"] = list(_language(rows, langid.train(docs), least))
    rows = want["exact"] = _exact(rows)
    rows = want["near"] = _near(rows)
    rows = want["private"] = list(_private(rows))
    assert list(stored) == [f"stage-{s}" for s in ("language", "exact", "near", "private", "packed")]
    for name, kept in want.items():
        found = stored[f"stage-{name}"]
        assert found.columns == docs.columns
        assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((tuple(d[c] for c in docs.columns) for d in kept), key=str), name
    held = [{d["doc_id"] for d in want[s]} for s in ("language", "exact", "near")]
    assert {105, 106, 107} & held[0] == set() and {0, 1} & held[1] == set() and {102, 103} & held[2] == set()
    assert any("<EMAIL>" in d["text"] and "<ACCOUNT> for the invoice" in d["text"] for d in rows)
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [encoder.encode(d["text"], add_special_tokens=False).ids + [0] for d in rows]
    pieces = [w[k : k + 2048] for w in ids for k in range(0, len(w), 2048)]
    assert Counter(r.ids_crc32 for r in packed) == Counter(zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for x in pieces)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_op2_query_counts_and_digests(spark, folder):
    rows = {r.doc_id: r for r in pii.op2_pii(spark, folder).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t or "")]
        phone = [m.span() for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", t or "")]
        told = [f"email:{s}:{e}" for s, e in email] + [f"phone:{s}:{e}" for s, e in phone]
        account = [m.span() for m in re.finditer("DE89 3704 0044 0532 0130 00", t or "")]
        assert (rows[i].n_email, rows[i].n_phone, rows[i].n_ip, rows[i].n_card, rows[i].n_url, rows[i].n_account) == (len(email), len(phone), 0, 0, 0, len(account))
        assert rows[i].base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert rows[i].spans == ",".join(told + [f"account:{s}:{e}" for s, e in account])
