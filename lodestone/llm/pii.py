"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed rules: leftmost matches that don't
overlap within a kind, and a match that fails its validator is dropped. Further
kinds: ``iban`` (mod-97), ``ssn`` (digits in groups of 3, 2, 4, valid ranges; it needs a
context word) and ``imei`` (15 digits that pass Luhn; it needs a context word).

Each span has a score: its kind's base score, raised where a context word of the
kind stands in the ``CONTEXT`` characters before or after it, lowered where a word that speaks
against it stands before it. Base spans are always kept and only scored; spans of the further kinds
are kept from ``THRESHOLD`` on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "imei")
BASE = KINDS[:4]
CONTEXT, THRESHOLD = 40, 0.5

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried once, from its first digit: what fails there fails further on.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_IMEI = re.compile(r"(?<![0-9])[0-9]{15}(?![0-9])")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: Base scores, words that raise a kind's score by 0.3, and words that lower it by 0.3.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "imei": 0.3}
RAISE = {
    "email": re.compile(r"(?i)e-?mail|correo|courriel|contact|kontakt|write to"),
    "ip": re.compile(r"(?i)\bip\b|address|adress|adresse|dirección|host|server"),
    "card": re.compile(r"(?i)card|visa|mastercard|amex|carte|tarjeta|karte|credit|kredit"),
    "phone": re.compile(r"(?i)phone|call|tel|mobile|fax|teléfono|téléphone|telefon|handy"),
    "iban": re.compile(r"(?i)iban|account|konto|compte|cuenta|bank"),
    "ssn": re.compile(r"(?i)ssn|social security|taxpayer"),
    "imei": re.compile(r"(?i)imei|device|handset|serial"),
}
LOWER = {
    "ip": re.compile(r"(?i)version|release|\bv$"),
    "card": re.compile(r"(?i)order|invoice|tracking|isbn"),
    "phone": re.compile(r"(?i)isbn|order|invoice"),
    "ssn": re.compile(r"(?i)isbn|part|serial"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Four leading characters to the end, letters as numbers from 10, remainder 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern. Each has just one "@", which only its local part precedes: so look from there."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _AT_DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, confirmed) in the order of the kinds, then of the text."""
    for s, e in emails(text):
        yield "email", s, e, True
    if not re.search("[0-9]", text):
        return
    for m in _IP.finditer(text):
        yield "ip", *m.span(), all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m[0].split("."))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        yield "card", *m.span(), 13 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", *m.span(), 9 <= len(_digits(m[0])) <= 15
    at = 0
    while m := _IBAN.search(text, at):
        end = m.end()  # capital words may follow: cut at spaces until the checksum holds
        while len(compact := text[m.start() : end].replace(" ", "")) >= 15 and not mod97(compact) and " " in text[m.start() : end]:
            end = text.rindex(" ", m.start(), end)
        ok = len(compact) >= 15 and mod97(compact)
        yield "iban", m.start(), end, ok
        at = end if ok else m.start() + 1  # what was cut off, or lies in a match that doesn't hold, may start another
    for m in _SSN.finditer(text):
        yield "ssn", *m.span(), m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
    for m in _IMEI.finditer(text):
        yield "imei", *m.span(), luhn(m[0])


def score(kind: str, text: str, start: int, end: int) -> float:
    before = text[max(0, start - CONTEXT) : start]
    out = SCORES[kind]
    if RAISE[kind].search(before) or RAISE[kind].search(text[end : end + CONTEXT]):
        out += 0.3
    if kind in LOWER and LOWER[kind].search(before):
        out -= 0.3
    return round(min(1.0, max(0.0, out)), 2)


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of each span that is kept; places are code points, the end exclusive."""
    text = text or ""
    found = [(k, s, e, score(k, text, s, e)) for k, s, e, ok in proposals(text) if ok]
    return [x for x in found if x[0] in BASE or x[3] >= THRESHOLD]


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, spans (an array of kind, start, end, score), in the order of ``KINDS``, then of the text.

    A null or empty text has no spans; ids may be null or repeat; an empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), x)) for x in spans_of(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in brackets; where spans overlap, the one that starts first, then the longer one."""
    schema = docs.schema

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for k, s, e, _ in sorted(spans_of(text), key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += [text[at:s], f"[{k}]"]
                at = e
        return text if not at else "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            yield b.set_column(i, "text", pa.array([clean(t) for t in b.column(i).to_pylist()], pa.string()))

    return map_batches(docs, run, schema)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """The spans of each document as counts, digest and text; null and empty texts have none."""
    found = personal_data(table(spark, sf_dir, "documents"))
    written = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), F.concat_ws(":", x["kind"], x["start"], x["end"]).alias("s")))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: x["s"]), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(written, lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(written).alias("spans"))
