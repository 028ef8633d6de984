"""Personal data: patterns propose spans, checksums confirm them, nearby words
adjust the score.

Kinds of the base set (email, ip, card, phone) stay whenever their own check
holds; the further kinds (iban by mod-97, ssn by its number ranges) need a
score of THRESHOLD, which a checksum or a context word near the span gives.

Edge cases: a null text is empty and has no span; repeated rows are answered
each; texts are read whole, in time linear in their length; positions count
code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
THRESHOLD = 0.8
CONTEXT_CHARS = 48

# Starts are tied to the start of a digit run, so that long runs cost linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Proposed at every start, also inside the reach of another; at most 30 more letters or digits are looked at.
IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

# Lengths of account numbers by country (public registry).
IBAN_LENGTH = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
               "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21,
               "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
               "SE": 24, "SI": 19, "SK": 24}
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto", "compte"),
    "ssn": ("ssn", "social security"),
}
#: Score of a span before its context: its check tells how much it says alone.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.7, "iban": 0.9, "ssn": 0.5}
CONTEXT_GAIN = 0.35


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(int(d) * 2 - (9 if d > "4" else 0) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _octet(part: str) -> bool:
    """At most 255; leading zeros go first, as int() refuses thousands of digits."""
    digits = part.lstrip("0")
    return len(digits) < 4 and int(digits or "0") < 256


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _iban_end(m: re.Match) -> int | None:
    """End of the account number when its country's length and mod-97 hold."""
    want, s = IBAN_LENGTH.get(m[1][:2]), m[1]
    seen = 0
    for i, c in enumerate(s):
        seen += c != " "
        if seen == want:
            closed = i + 1 == len(s) or s[i + 1] == " "
            return m.start() + i + 1 if closed and mod97(s[:i + 1].replace(" ", "")) else None
    return None


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += (("email", a, b) for a, b in emails(text))
    if "." in text:
        found += (("ip", *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split("."))))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += (("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15)
    done = 0
    for m in IBAN.finditer(text):
        if m.start() >= done and (end := _iban_end(m)) is not None:
            found.append(("iban", m.start(), end))
            done = end
    if "-" in text:
        found += (("ssn", *m.span()) for m in SSN.finditer(text))
    out = []
    for kind, a, b in found:
        near = text[max(0, a - CONTEXT_CHARS):b + CONTEXT_CHARS].lower()
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * any(w in near for w in CONTEXT[kind]))
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append((kind, a, b, score))
    return out


def _scan(schema: pa.Schema):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t or "")]
                    for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, schema.field(1).type)], schema=schema)
    return scan


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): every row with its spans, ordered by kind, then start."""
    from pyspark.sql.pandas.types import to_arrow_type
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("spans", pa.list_(span))])
    return rows.mapInArrow(_scan(schema), f"doc_id {kind.simpleString()}, "
                           "spans array<struct<kind:string,start:long,end:long,score:double>>")


def redact(text: str) -> str:
    """The text with each span replaced by its kind in angle brackets; of
    overlapping spans the earliest and longest wins."""
    out, done = [], 0
    for kind, a, b, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += (text[done:a], f"<{kind}>")
            done = b
    return "".join((*out, text[done:]))
