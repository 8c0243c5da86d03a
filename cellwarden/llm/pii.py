"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are reported whenever their validator
holds; added kinds (iban, ssn) only with a score of at least ``LEAST_SCORE``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.common import in_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
NEAR = 48  # characters to each side in which a context word counts
LEAST_SCORE = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from every later digit too.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ALNUM = re.compile("[A-Za-z0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
# Characters of an account by country, from the IBAN registry.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 "
    "FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
    "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
    "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORDS = {
    "email": re.compile(r"mail|contact|write|@", re.I), "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "card": re.compile(r"card|visa|master|credit|pay", re.I), "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta", re.I), "ssn": re.compile(r"ssn|social|security", re.I),
}
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.7, "iban": 0.8, "ssn": 0.4}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A blank and a word or number after an account look like more of it.

    An account ends at its country's length; for a country that is not
    listed every end is tried, the longest first.
    """
    m = _IBAN.search(text)
    while m:
        length = IBAN_LENGTHS.get(m[0][:2])
        ends, plain = [], ""
        for at in range(m.start(), m.end()):
            if text[at] != " ":
                plain += text[at]
                if (len(plain) == length if length else len(plain) >= 15) and not _ALNUM.match(text, at + 1):
                    ends.append((at + 1, plain))
        end = next((e for e, p in reversed(ends) if mod_97(p)), 0)
        if end:
            yield m.start(), end
        # An account may begin inside of a span that is none.
        m = _IBAN.search(text, end or m.start() + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def proposed(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of all spans whose validator holds."""
    if "@" in text:
        for s, e in _emails(text):
            yield s, 0, e
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 3 or len(p.lstrip("0")) == 3 and p.lstrip("0") <= "255" for p in m[0].split(".")):
            yield m.start(), 1, m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                yield m.start(), 2, m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield m.start(), 3, m.end()
    for s, e in _ibans(text):
        yield s, 4, e
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.start(), 5, m.end()


def score(text: str, start: int, kind: int, end: int) -> float:
    """A kind's prior, raised if one of its context words is near."""
    name = KINDS[kind]
    near = text[max(0, start - NEAR):start] + "\n" + text[end:end + NEAR]
    prior = _PRIOR[name]
    return round(prior + (1 - prior) / 2, 3) if _WORDS[name].search(near) else prior


def find(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of a whole text, by start and kind."""
    text = text or ""
    spans = sorted((*x, score(text, *x)) for x in proposed(text))
    return [x for x in spans if x[1] < BASE or x[3] >= LEAST_SCORE]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores for each row of ``docs``.

    spans lists ``kind:start:end`` (code points, end exclusive) by start and
    kind, scores their scores in that order.

    * A null or empty text has no spans.
    * Rows are scanned one by one: repeated rows, null ids, extra columns and
      an empty table need nothing special; texts are scanned whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py()) for t in batch.column("text")]
            text = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)
            base = [text([x for x in f if x[1] < BASE]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 *[pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(BASE)],
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]),
                 pa.array([text(f) for f in found], pa.string()),
                 pa.array([",".join(f"{x[3]:g}" for x in f) for f in found], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_sha256 string, spans string, scores string")
