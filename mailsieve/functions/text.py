"""Text cleaning, HTML-to-text, tokenisation and display formatting.

All steps are `regexp_replace` / literal `replace` chains.  Character classes are
spelled out so the same pattern text means the same set in Java regex (Spark)
and RE2 (the DuckDB oracle); Python's Unicode-aware `\\s` and `str.strip()`
are reproduced with `PY_SPACE`.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# Characters for which Python's str.isspace() is true.
PY_SPACE = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                  + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
# Control characters (Unicode category C) except '\n'.
CONTROL_EXCEPT_NL = r"[\x00-\x09\x0b-\x1f\x7f-\x{9f}\p{Cf}]"

# HTML constructs whose text is not part of get_text(): comments, script /
# style / template elements (raw text up to their end tag), declarations,
# processing instructions, and tags.  One left-to-right pass: at each '<'
# the first alternative that matches wins, so a comment-like string inside
# a script is script text and a script inside a comment is comment text.
# Comments and raw-text elements also end where the text ends.  The pass is
# given the text up to its last '>' only, so a tag that begins there ends
# there too and the pass is linear.
HTML_DROP = (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
             r"|<template\b.*?(?:</template\s*>|\z)|<![a-z][^>]*>|<\?[^>]*>|</?[a-z][^>]*>")
HTML_HEAD = r"(?s)^(.*>)"
OPEN_COMMENT = r"(?s)<!--.*"
HEAD_END = "\x01"  # follows the head; an element that is still open takes it along

# Character references: names with their semicolon, the older ones also
# without it, and numbers.  The table is the HTML standard's, from the
# standard library; numbers in the range of C1 controls mean Windows-1252.
_NAMED = {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
_BARE = sorted((k for k in html.entities.html5 if not k.endswith(";")), key=len, reverse=True)
REFERENCE = (r"^(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*);|(" + "|".join(_BARE) + "))")
_USUAL = {f"{n};": _NAMED[n] for n in ("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "reg", "middot", "mdash", "ndash", "hellip", "bull",
                                      "lsquo", "rsquo", "ldquo", "rdquo", "laquo", "raquo", "euro")} | {"#39;": "'", "#34;": '"', "#38;": "&", "#160;": "\xa0"}
_WINDOWS = {c: bytes([c]).decode("cp1252") for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}

# Token classes: runs of a script written without spaces (ideographs, kana,
# Thai, Lao, Myanmar, Khmer), words of any other script, digit runs.
UNSPACED_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF), (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF))
UNSPACED = "".join(rf"\x{{{a:04x}}}-\x{{{b:04x}}}" for a, b in UNSPACED_RANGES)
UNSPACED_RUN = rf"([{UNSPACED}]+)"
# first the words of plain letters, which need no look at a character's category
TOKEN_PATTERN = (rf"[a-z]++(?![\p{{L}}\p{{M}}&&[^{UNSPACED}]])|[\p{{L}}\p{{M}}&&[^{UNSPACED}]]++|[{UNSPACED}]++|[\p{{Nd}}&&[^{UNSPACED}]]++")
UNSPACED_FIRST = chr(min(a for a, _ in UNSPACED_RANGES))  # no token that is less begins with such a script


def html_to_text(c: Column) -> Column:
    """Text of an HTML fragment: markup removed without separators,
    non-text elements dropped, character references decoded.  Text without
    '<' / '&' skips the work."""
    head = F.regexp_extract(c, HTML_HEAD, 1)
    tail = F.regexp_replace(F.substr(c, F.length(head) + 1), OPEN_COMMENT, "")
    kept = F.regexp_replace(F.concat(head, F.lit(HEAD_END)), HTML_DROP, "")
    closed = kept.endswith(HEAD_END)
    without = F.when(closed, F.concat(F.substr(kept, F.lit(1), F.length(kept) - 1), tail)).otherwise(kept)
    c = F.when(c.contains("<"), without).otherwise(c)
    return F.when(c.contains("&"), decode_references(c)).otherwise(c)


def decode_references(c: Column) -> Column:
    """Named and numeric character references of a string, as HTML decodes
    them: split at '&', each piece begins with a reference or keeps its '&'."""
    names = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])
    windows = F.create_map(*[F.lit(x) for pair in _WINDOWS.items() for x in pair])

    def group(piece: Column, n: int) -> Column:
        return F.regexp_extract(piece, REFERENCE, n)

    def number(piece: Column) -> Column:
        hexadecimal, decimal = F.ltrim(group(piece, 2), F.lit("0")), F.ltrim(group(piece, 1), F.lit("0"))
        code = (F.when(F.length(hexadecimal) > 6, -1).when(hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("int"))
                .when(F.length(decimal) > 7, -1).when(decimal != "", decimal.cast("int")).otherwise(0))
        bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        mute = (code.between(1, 8) | code.between(14, 31) | code.between(0x7F, 0x9F) | (code == 11) | code.between(0xFDD0, 0xFDEF)
                | (code.bitwiseAND(0xFFFE) == 0xFFFE))
        return (F.when(bad, "\ufffd").when(F.element_at(windows, code).isNotNull(), F.element_at(windows, code))
                .when(mute, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))

    def decoded(piece: Column) -> Column:
        whole, named = F.regexp_extract(piece, REFERENCE, 0), group(piece, 3)
        old = group(piece, 4)
        bare = F.regexp_extract(piece, "^(" + "|".join(_BARE) + ")", 1)  # a longer name that is unknown may begin with an old one
        name = F.when(F.element_at(names, named).isNotNull(), named).when(old != "", old).when(bare != "", bare)
        taken = F.when(F.element_at(names, named).isNotNull(), F.length(whole)).otherwise(F.length(name))
        general = (F.when(piece.startswith("#") & (whole != ""), F.concat(number(piece), F.substr(piece, F.length(whole) + 1)))
                   .when(name.isNotNull(), F.concat(F.element_at(names, name), F.substr(piece, taken + 1)))
                   .otherwise(F.concat(F.lit("&"), piece)))
        cases = F.when(~piece.rlike("^[#A-Za-z]"), F.concat(F.lit("&"), piece))
        for name, text in _USUAL.items():  # by a prefix, before any pattern
            cases = cases.when(piece.startswith(name), F.concat(F.lit(text), F.substr(piece, F.lit(len(name) + 1))))
        return cases.otherwise(general)

    pieces = F.split(c, "&")
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded)
    return F.concat(pieces[0], F.array_join(rest, ""))


def py_strip(c: Column) -> Column:
    """str.strip(): Unicode whitespace removed at both ends (a set trim)."""
    return F.trim(c, F.lit(PY_SPACE_CHARS))


def clean_text_deep(c: Column) -> Column:
    """HTML out; NBSP/tab/CR -> space; control chars except newline dropped;
    space runs collapsed; blank-line runs collapsed; stripped.  Null -> ''."""
    c = html_to_text(F.coalesce(c, F.lit("")))
    for ch in ("\xa0", "\t", "\r"):  # literal replaces: cheaper than translate
        c = F.replace(c, F.lit(ch), F.lit(" "))
    c = F.regexp_replace(c, CONTROL_EXCEPT_NL, "")
    c = F.regexp_replace(c, "  +", " ")  # runs of 2+ (a lone space is already one)
    c = F.regexp_replace(c, rf"\n{PY_SPACE}*\n+", "\n")
    return py_strip(c)


def clean_text_light(c: Column) -> Column:
    """Null/blank -> Empty_Body; HTML out; whitespace runs -> one space; stripped."""
    blank = c.isNull() | (py_strip(c) == "")
    t = py_strip(F.regexp_replace(html_to_text(c), rf"{PY_SPACE}+", " "))
    return F.when(blank | (t == ""), F.lit(K.EMPTY_BODY)).otherwise(t)


def body_or_empty(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit(K.EMPTY_BODY)).otherwise(c)


def default_text(c: Column) -> Column:
    """Header value trimmed; 'Unknown' when absent or blank."""
    t = py_strip(c)
    return F.when(c.isNull() | (t == ""), F.lit(K.UNKNOWN)).otherwise(t)


def mail_text(subject: Column, body: Column, include_subject: bool = True) -> Column:
    """Scoring text: subject, a space, body (the subject is skipped when null)."""
    if not include_subject:
        return body
    return F.concat_ws(" ", subject, body)


def decode_lenient(b: Column) -> Column:
    """UTF-8 decode of bytes with invalid sequences dropped."""
    return F.replace(F.make_valid_utf8(b.cast("string")), F.lit("\ufffd"), F.lit(""))


def tokenize(c: Column) -> Column:
    """Lower-cased tokens: words and digit runs of any script, and overlapping
    bigrams of the runs of scripts written without spaces (a single character
    stays a token)."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), 0)
    return F.flatten(F.transform(runs, lambda t: F.when(
        (t >= UNSPACED_FIRST) & t.rlike("^" + UNSPACED_RUN) & (F.length(t) > 1), char_bigrams(t),
    ).otherwise(F.array(t))))


BIGRAM_PATTERN = r"(?s)(?=(\P{Cs}.))"


def char_bigrams(c: Column) -> Column:
    """Overlapping character bigrams of a string (empty when shorter than 2).

    One JVM regex pass: a zero-width lookahead captures the two code points
    at every position, so the pairs overlap and the cost is linear in the
    length.  A match may not start on a lone surrogate (`\\P{Cs}`): after a
    zero-width match the scan advances one UTF-16 unit, which lands inside
    an astral character; the guard skips that position."""
    return F.regexp_extract_all(c, F.lit(BIGRAM_PATTERN), F.lit(1))


def format_percent(p: Column) -> Column:
    """'51.23%' style text of a probability: two decimals of a percent, from
    its six decimal places, half up."""
    hundredths = F.floor((F.round(p * 1_000_000).cast("bigint") + 50) / 100).cast("bigint")
    return F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("%"))
