"""Personal data by anchor expansion.

One Aho-Corasick pass per text finds anchors: at-signs, digits, plus signs, URL schemes and identifier
cues. From each anchor a deterministic parser expands to the boundaries of the candidate and validates
it; no text away from an anchor is looked at again. Base kinds are ``email``, ``ip``, ``card`` and
``phone``; the method adds ``url`` (scheme, host with a dot or an address, rest up to white space or a
quote) and ``account`` (a value of 6 to 34 letters, digits and dashes with at least 4 digits after a cue
such as IBAN, account, SSN or passport; an IBAN must pass its check digits). Values are looked for in the
34 letters and digits after the cue: an IBAN ends where its check digits hold, its country's length first;
other values are runs of words that hold digits, with capital codes of up to four letters before such words.

Nulls and edges: null text is empty; positions are code points, ends exclusive; digits are ASCII.
A kind's spans never overlap; spans of different kinds may. A run of digits is walked once however
many anchors lie in it, so the work is linear in the text. Equal rows give equal results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from concord.llm import workers
from concord.llm.common import mapped, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

# fixed values: character classes of the base patterns
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGITS = frozenset("0123456789")

SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta")

# parsers; each is anchored, so none of them searches
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_URL = re.compile(r"(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>|]*)?")
_NEAR = r"[ \t]*[.:=#]*[ \t]*([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])"
_VALUE = re.compile(r"(?:[ \t]*(?:number|no|nr|num|id))?" + _NEAR, re.I)
# NO is also the country of an IBAN
_BEFORE_IBAN = re.compile(r"(?:[ \t]*(?:number|no|nr|num|id)(?![A-Za-z0-9]))?" + _NEAR, re.I)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
_WORD = re.compile(r"[A-Za-z0-9-]+")

#: length of an IBAN by country; of the ends at which the check digits hold, it decides
_LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}

def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, (0, 1))
    a.add_word("@", (1, 1))
    a.add_word("+", (2, 1))
    for s in SCHEMES:
        a.add_word(s, (3, len(s)))
    for s in CUES:
        a.add_word(s, (4, len(s)))
    a.make_automaton()
    return a


def _anchors() -> ahocorasick.Automaton:
    return workers.state(("pii",), _automaton)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(value: str) -> bool:
    v = value.replace(" ", "").replace("-", "").upper()
    if not (15 <= len(v) <= 34 and v[:2].isalpha() and v[2:4].isdigit() and v.isascii() and v.isalnum()):
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _iban_end(text: str, at: int) -> int:
    """Where the IBAN that begins at ``at`` ends; 0 without one."""
    m = _IBAN.match(text, at)
    if not m:
        return 0
    ends = [at + i for i, c in enumerate(m[0]) if c in " -"] + [m.end()]
    own = _LENGTHS.get(m[0][:2].upper())
    size = lambda e: sum(c not in " -" for c in text[at:e])
    return next((e for e in sorted(ends, key=lambda e: (size(e) != own, -e)) if iban(text[at:e])), 0)


def _ibans(text: str, at: int) -> list[tuple[int, int]]:
    """IBANs that begin with a word near the cue that ends at ``at``."""
    m, found = _BEFORE_IBAN.match(text, at), []
    for w in _WORD.finditer(text, m.start(1), m.end(1)) if m else ():
        if (not found or w.start() >= found[-1][1]) and (end := _iban_end(text, w.start())):
            found.append((w.start(), end))
    return found


def _values(text: str, at: int) -> list[tuple[int, int]]:
    """Other values near the cue that ends at ``at``: runs of words that hold digits."""
    m, runs, code, start = _VALUE.match(text, at), [], None, None
    for w in _WORD.finditer(text, m.start(1), m.end(1)) if m else ():
        if any(c in DIGITS for c in w[0]):
            if start is None:
                start = w.start() if code is None else code
                runs.append((start, w.end()))
            else:
                runs[-1] = (start, w.end())
            code = None
        elif code is None and len(w[0]) <= 4 and w[0].isupper() and w[0].lower() not in CUES:
            # a code, such as a bank's, if a word with digits follows
            code = w.start()
        else:
            code = start = None
    held = lambda s, e, chars: sum(c in chars for c in text[s:e])
    return [(s, e) for s, e in runs if held(s, e, DIGITS) >= 4 and held(s, e, LABEL - {"-"}) >= 6]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _folded(text: str) -> str:
    """Lower-cased for the cues, with the same positions: lower() lengthens U+0130 alone."""
    return text.replace("\u0130", "i").lower()


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """(start, end) of each kind's spans in ``text``, ascending."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    email_end = card_end = dotted_end = url_end = 0
    emails, ips, cards, phones, urls, accounts = (out[k] for k in KINDS)
    folded = _folded(text)
    for last, (kind, size) in _anchors().iter(folded):
        if kind == 0:
            if last >= dotted_end:
                # a digit run that no earlier chain covers: numbers joined by dots, in fours
                m = _DOTTED.match(text, last)
                dotted_end = m.end()
                if "." in m[0]:
                    at, parts = last, m[0].split(".")
                    for i in range(0, len(parts) - 3, 4):
                        four = parts[i : i + 4]
                        end = at + sum(map(len, four)) + 3
                        # longer than a part can be: compared by length first, so that long runs cost nothing
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                            ips.append((at, end))
                        at = end + 1
            if last >= card_end:
                m = _CHAIN.match(text, last)
                card_end = m.end()
                if card_end - last >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        cards.append((last, card_end))
        elif kind == 1:
            start = last
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                emails.append((start, email_end))
        elif kind == 2:
            if text[last + 1 : last + 2] in DIGITS and (m := _PHONE.match(text, last)):
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    phones.append((last, m.end()))
        elif kind == 3:
            start = last + 1 - size
            if start >= url_end and (m := _URL.match(text, last + 1)):
                url_end = m.end() - (len(m[0]) - len(m[0].rstrip(".,;:!?)")))
                urls.append((start, url_end))
        elif not text[max(0, last - size) : last - size + 1].isalnum():
            # cues are near one another at times, so their values may be the same
            accounts += _ibans(text, last + 1)
            if folded[last + 1 - size : last + 1] != "iban":
                accounts += _values(text, last + 1)
    out["account"] = _merged(accounts)
    return out


def redact(text: str | None) -> str | None:
    """``text`` with each span, overlapping ones merged, replaced by its kind in angle brackets."""
    spans = sorted((s, e, k) for k, v in find(text).items() for s, e in v)
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, array<struct<kind, start, end>> by kind as listed, then start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, v in find(t).items() for s, e in v] for t in map(pa.StringScalar.as_py, b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(part, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced; all columns and rows stay."""
    at = docs.columns.index("text")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for b in batches:
            new = pa.array([redact(t.as_py()) for t in b.column(at)], b.schema.field(at).type)
            yield [new if i == at else c for i, c in enumerate(b.columns)]

    return mapped(docs, part, {})


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t.as_py()) for t in b.column("text")]
            told = [[f"{k}:{s}:{e}" for k in BASE_KINDS for s, e in f[k]] for f in found]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS]
            sums = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in told], pa.string())
            spans = pa.array([",".join(x + [f"{k}:{s}:{e}" for k in KINDS[4:] for s, e in f[k]]) for x, f in zip(told, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts[:4], sums, spans, *counts[4:]], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_url", "n_account"])

    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return docs.mapInArrow(part, f"doc_id bigint, {counts}, base_sha256 string, spans string, n_url bigint, n_account bigint")
