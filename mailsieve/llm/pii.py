"""Personal data: patterns propose spans, check sums confirm them, nearby words adjust the score.

Four kinds are found by their form alone (e-mail, IP address, card, phone); a
span of these that passes its check always stays.  Others need a check sum or
words nearby: IBAN (mod 97), social security number, phone without a plus sign.
A text is searched whole; positions are code points, ends exclusive.

Edge cases: a null or empty text has no spans; repeated rows are searched as
often as they occur; an empty table gives no rows; other columns of the input
are ignored by `find_documents` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, release, table, text_slices


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
THRESHOLD = 0.5  # score of an added span that is kept
SLICE = 500_000  # characters of texts that are looked through at once
NEAR = 48  # code points before and after a span in which words count

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile("[0-9]")
# a run of digits without the rest of the pattern after it has no match further on in the run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile("[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")

# (score without any evidence, with its check sum, words that speak for it, words that speak against it)
_EVIDENCE = {
    "email": (0.9, 0.9, ("mail", "contact", "write"), ()),
    "ip": (0.6, 0.6, ("ip", "host", "server", "address", "login"), ("version", "release", "section")),
    "card": (0.3, 0.8, ("card", "visa", "credit", "payment", "cvv"), ("isbn", "tracking", "order")),
    "phone": (0.7, 0.7, ("phone", "call", "tel", "mobile", "fax"), ()),
    "iban": (0.1, 0.8, ("iban", "account", "bank", "konto"), ()),
    "ssn": (0.3, 0.3, ("ssn", "social", "security", "taxpayer"), ("part", "serial", "order")),
    "local_phone": (0.3, 0.3, ("phone", "call", "tel", "telephone", "mobile", "fax"), ("isbn", "version")),
}
_WORD = re.compile("[A-Za-z]+")


def luhn(digits: str) -> bool:
    """Whether the digits end in their Luhn check digit."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number (no spaces) has the remainder 1 by 97."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _scored(text: str, kind: str, start: int, end: int, checked: bool) -> Span:
    plain, confirmed, words_for, words_against = _EVIDENCE[kind]
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR):start] + " " + text[end:end + NEAR])}
    score = confirmed if checked else plain
    score += 0.3 * any(w in near for w in words_for) - 0.4 * any(w in near for w in words_against)
    return Span(kind, start, end, min(1.0, max(0.0, score)))


def find(text: str) -> list[Span]:
    """All spans of a text, by kind as listed and then by start."""
    out = [_scored(text, "email", a, b, True) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(_scored(text, "ip", *m.span(), True))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(_scored(text, "card", *m.span(), True))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(_scored(text, "phone", *m.span(), True))
    added = [_scored(text, "iban", *m.span(), True) for m in _IBAN.finditer(text)
             if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0].replace(" ", ""))]
    added += [_scored(text, "ssn", *m.span(), False) for m in _SSN.finditer(text)
              if m[1] not in ("000", "666") and m[1][0] != "9" and m[2] != "00" and m[3] != "0000"]
    added += [_scored(text, "local_phone", *m.span(), False) for m in _LOCAL_PHONE.finditer(text)]
    base = list(out)
    out += [s for s in added if s.score >= THRESHOLD and not any(b.start < s.end and s.start < b.end for b in base)]
    return out


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += (text[at:s.start], f"[{s.kind.upper()}]")
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def _mapped(docs: DataFrame, columns: list[str], make: Callable[[str], tuple], fields: list[pa.Field], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_slices(batch, "text", SLICE):
                made = list(zip(*(make(t) for t in texts)))
                kept = [batch.column(c).slice(at, len(texts)) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(v, f.type) for v, f in zip(made, fields)]],
                                                 [*columns, *[f.name for f in fields]])
        release()

    return docs.mapInArrow(run, schema)


def find_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array of structs) of every document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    return _mapped(keep_only(docs, "doc_id", "text"), ["doc_id"], lambda t: ([s._asdict() for s in find(t)],),
                   [pa.field("spans", kind)], "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")


def redact(docs: DataFrame) -> DataFrame:
    """The documents, every span of their texts masked; all columns stay, `n_chars` (where there is one) follows the text.

    A null text stays null.
    """
    names, order = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*order)  # names may clash with those used here
    text = order[names.index("text")]
    others = [c for c in order if c != text]  # the text goes to the tasks once and comes back masked
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.select(*others).schema.fields)
    out = _mapped(plain.select(*others, F.col(text).alias("text"), F.col(text).isNull().alias("_none")), [*others, "_none"], lambda t: (mask(t, find(t)),),
                  [pa.field("masked", pa.string())], ", ".join([schema, "_none boolean, masked string"] if others else ["_none boolean, masked string"]))
    clean = F.when(~F.col("_none"), F.col("masked"))
    value = {"text": clean, "n_chars": F.length(clean)}
    return out.select(*[
        (F.coalesce(value[n], F.col(c)) if n == "n_chars" else value[n] if n in value else F.col(c)).cast(docs.schema[i].dataType).alias(n)
        for i, (n, c) in enumerate(zip(names, order))])


def op2_pii_checked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 2: counts and digests of every document's spans."""
    def joined(spans: list[Span]) -> str:
        return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)

    def digests(text: str) -> tuple:
        spans = find(text)
        base = [s for s in spans if s.kind in BASE]
        return (*(sum(s.kind == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    return _mapped(keep_only(table(spark, sf_dir, "documents"), "doc_id", "text"), ["doc_id"], digests,
                   [*[pa.field(f"n_{k}", pa.int64()) for k in BASE], pa.field("base_sha256", pa.string()), pa.field("spans", pa.string())],
                   "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
