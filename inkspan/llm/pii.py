"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Four kinds (email, ip, card, phone) are reported whenever their pattern and check agree. Further kinds (iban by
mod-97, ssn by its number rules) are reported from a score of 0.5 on, which a word such as 'account' close before
can lift them to. Offsets are code points of the whole text, end exclusive. A null or empty text has no spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batches, pick, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Code points before a span in which a word of its kind counts.
NEAR = 40
REPORTED_FROM = 0.5
#: Score without and gain with a context word.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3), "iban": (0.8, 0.2), "ssn": (0.3, 0.5)}
# Words that speak of a kind, in the corpus's languages.
CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write|adresse|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|adresse", re.I),
    "card": re.compile(r"card|visa|mastercard|credit|karte|tarjeta|carte|payment", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|anruf|llam|appel", re.I),
    "iban": re.compile(r"iban|bank|account|konto|cuenta|compte", re.I),
    "ssn": re.compile(r"\bssn\b|social security|tax id", re.I),
}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits, as it takes the run it ends in whole: looking behind saves retries.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern ``local@label(.label)+`` matches from the left, but found from each @ outwards, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = done + len(text[done:at].rstrip(_LOCAL)) if at > done else at
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
            at = text.find("@", done)
        else:
            # What stands before this @ is no use to a later one.
            done, at = at + 1, text.find("@", at + 1)


def _ip_ok(span: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in span.split("."))


def _card_ok(span: str) -> bool:
    digits = _NOT_DIGITS.sub("", span)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(span: str) -> bool:
    return 9 <= len(_NOT_DIGITS.sub("", span)) <= 15


def _ssn_ok(m: re.Match) -> bool:
    return m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed, then start."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for kind, pattern, ok in (("ip", _IP, _ip_ok), ("card", _CARD, _card_ok)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if ok(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if _phone_ok(m[0])]
    out += [("iban", *m.span()) for m in _IBAN.finditer(text) if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0].replace(" ", ""))]
    out += [("ssn", *m.span()) for m in _SSN.finditer(text) if _ssn_ok(m)]
    scored = []
    for kind, a, b in out:
        low, gain = SCORES[kind]
        score = low + gain * bool(CONTEXT[kind].search(text, max(0, a - NEAR), a))
        if kind in BASE_KINDS or score >= REPORTED_FROM:
            scored.append((kind, a, b, round(score, 3)))
    return scored


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "found"])


def personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, found): every row's spans with kind, offsets and score."""
    arrow_batches(documents.sparkSession)
    texts = pick(documents, "doc_id", "text")
    return texts.mapInArrow(_scan, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, found array<struct<kind string, start bigint, end bigint, score double>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column(1).to_pylist()
        said = [[f"{s['kind']}:{s['start']}:{s['end']}" for s in row if s["kind"] in BASE_KINDS] for row in rows]
        every = [",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in row) for row in rows]
        counts = [pa.array([sum(s["kind"] == k for s in row) for row in rows], pa.int64()) for k in BASE_KINDS]
        scores = [max((s["score"] for s in row), default=0.0) for row in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in said]), pa.array(every), pa.array(scores, pa.float64())], names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "top_score"])


def op6_digest(documents: DataFrame) -> DataFrame:
    """Counts by kind, digests and the joined spans of each row."""
    found = personal_data(documents)
    return found.mapInArrow(_digest, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, top_score double")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``. Null and empty texts have none; repeated rows stay, each by itself."""
    return op6_digest(table(spark, sf_dir, "documents"))
