"""Secrets by assignment-aware lexing.

Source and configuration text is read as assignments: a name, a mark (`=`, `:`,
`:=`, `=>`) and an expression of literals and names.  A name bound to a literal
is a constant; an expression that uses it carries the literal's place on, also
through concatenation.  A literal is scored by the names it ends up in and by
its own look, so `k = "..."; api_token = k` points at the first line.

Three kinds are found by their form alone and always stay: `assign`, `access`
and `hex`.  The lexer adds spans of kind `literal` where no such span lies.
Positions are code points, ends exclusive.

Edge cases: a null or empty text has no spans; a text of any length is read
whole, line by line; repeated rows are searched as often as they occur; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keep_only, table
from .pii import _mapped


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE, "literal"))}
THRESHOLD = 0.6  # score of a literal that is reported
LEAST = 8  # characters of a literal that can be a secret

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}+")
_BASE_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

# parts of target names, and how far they speak for a secret
_NAME_PARTS = {
    "password": 0.6, "passwd": 0.6, "passphrase": 0.6, "pwd": 0.5, "pass": 0.4, "secret": 0.6, "token": 0.5,
    "apikey": 0.6, "credential": 0.6, "credentials": 0.6, "private": 0.3, "auth": 0.3, "access": 0.2, "api": 0.2,
    "key": 0.3, "signing": 0.3, "encryption": 0.3, "bearer": 0.5,
}
SENSITIVE = 0.4  # score of a name whose literals are looked at
_HARMLESS = re.compile(r"example|change.?me|placeholder|dummy|sample|your|xxxx|\*\*\*|<[^>]*>|\$\{|\{\{|none|null|true|false", re.I)
_MARK = re.compile(r"(?::=|=>|=(?!=)|:(?![:/]))[ \t]*")
_NAME = "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))) + "_.-"  # a name's characters; it begins with a letter or `_`
_PIECE = re.compile(r"""[ \t]*(?:"(?P<d>(?:[^"\\\n]|\\.)*)"|'(?P<s>(?:[^'\\\n]|\\.)*)'|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)(?![A-Za-z0-9+/=-])|(?P<bare>[A-Za-z0-9+/_.=-]+))""")
_PLUS = re.compile(r"[ \t]*[+.][ \t]*(?=[\"'A-Za-z_])")
_PART = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How far a target name speaks for a secret, 0 to 1."""
    parts = [p.lower() for p in _PART.findall(name)]
    parts += [a + b for a, b in zip(parts, parts[1:])]
    return min(1.0, sum(_NAME_PARTS.get(p, 0) for p in set(parts)))


def _may_name(lower: bytes) -> bool:
    """Whether the name parts that occur in a lower-cased text could make a sensitive name; no such name is missed.

    Parts of a name are only ever parted by `_`, `.` and `-`, and a name scores no
    more than all parts that occur in its text.
    """
    close = lower.translate(None, b"_.-")
    return sum(score for part, score in _NAME_PARTS.items() if part.encode() in close) >= SENSITIVE - 1e-9


def value_score(value: str) -> float:
    """How far a literal looks like a secret, -1 to 0.5."""
    if len(value) < LEAST or " " in value.strip() or _HARMLESS.search(value):
        return -1.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    kinds = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(0.5, 0.1 * max(0.0, bits - 2) + 0.1 * (kinds - 1))


def _target(text: str, at: int) -> tuple[str, int] | None:
    """The next assigned name from a place on, plain or between equal quotes, and where its expression begins.

    Names are read back from the marks.  They hold no mark, so each character is
    read once however long the runs between marks are."""
    since = at
    for mark in _MARK.finditer(text, at):
        before = text[since:mark.start()].rstrip(" \t")
        quote = before[-1:] if before[-1:] in ("'", '"') else ""
        before = before[:len(before) - len(quote)]
        run = before[len(before.rstrip(_NAME)):]
        name = run.lstrip("0123456789.-")
        if name and (not quote or name == run and before[:len(before) - len(run)].endswith(quote)):
            return name, mark.end()
        since = mark.end()
    return None


def _literals(text: str) -> list[Span]:
    """Literals that reach a sensitive name, with their scores.

    Every assignment keeps its own literals and refers to the earlier ones whose
    constants it uses, so nothing is copied or left out.  Sensitive names are
    followed back from the highest score, each assignment once: the first name
    that reaches a literal is the one that scores it best.
    """
    own: list[list[tuple[int, int]]] = []  # of each assignment, the places of the literals it holds itself
    uses: list[list[int]] = []  # and the earlier assignments whose constants it uses
    constants: dict[str, int] = {}  # name -> its latest assignment
    sensitive: list[tuple[float, int]] = []
    at = 0
    while found := _target(text, at):
        name, at = found
        places: list[tuple[int, int]] = []
        earlier: list[int] = []
        while p := _PIECE.match(text, at):
            kind = p.lastgroup
            if kind == "name" and p["name"] in constants:
                earlier.append(constants[p["name"]])
            elif kind != "name" or len(p["name"]) >= LEAST:
                places.append(p.span(kind))
            at = p.end()
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        constants[name] = len(own)
        named = name_score(name)
        if named >= SENSITIVE:
            sensitive.append((named, len(own)))
        own.append(places)
        uses.append(earlier)
    out: list[Span] = []
    seen: set[int] = set()
    for named, first in sorted(sensitive, reverse=True):
        todo = [first]
        while todo:
            if (i := todo.pop()) not in seen:
                seen.add(i)
                todo += uses[i]
                scored = ((a, b, named + value_score(text[a:b])) for a, b in own[i])
                out += [Span("literal", a, b, min(1.0, s)) for a, b, s in scored if s > THRESHOLD - 1e-9]
    return sorted(out, key=lambda s: s.start)


def find(text: str) -> list[Span]:
    """All spans of a text, by start and then by kind as listed."""
    lower = text.encode("utf-8", "replace").lower()
    out = []
    if any(w in lower for w in _BASE_WORDS):
        out += [Span("assign", *m.span(), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"akia" in lower:
        out += [Span("access", *m.span(), 1.0) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [Span("hex", *m.span(), 1.0) for m in _HEX.finditer(text)]
    if (b"=" in lower or b":" in lower) and _may_name(lower):
        base = sorted(out, key=lambda s: s.start)
        starts, reach = [s.start for s in base], list(accumulate((s.end for s in base), max))
        for s in _literals(text):
            before = bisect_left(starts, s.end)  # base spans that begin before its end; one that ends after its start overlaps
            if not before or reach[before - 1] <= s.start:
                out.append(s)
    return sorted(out, key=lambda s: (s.start, ORDER[s.kind], s.end))


def find_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array of structs) of every document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    return _mapped(keep_only(docs, "doc_id", "text"), ["doc_id"], lambda t: ([s._asdict() for s in find(t)],),
                   [pa.field("spans", kind)], "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")


def op6_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 6: counts and digests of every document's spans."""
    def joined(spans: list[Span]) -> str:
        return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)

    def digests(text: str) -> tuple:
        spans = find(text)
        base = [s for s in spans if s.kind in BASE]
        return (*(sum(s.kind == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))

    return _mapped(keep_only(table(spark, sf_dir, "documents"), "doc_id", "text"), ["doc_id"], digests,
                   [*[pa.field(f"n_{k}", pa.int64()) for k in BASE], pa.field("base_sha256", pa.string()), pa.field("spans", pa.string())],
                   "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
