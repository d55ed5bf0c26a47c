"""Columns for text with the semantics of the audit: universal newlines, Unicode classes, code points."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import reduce
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that end a line (CR LF counts as one end).
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

#: Decimal digits of all scripts, and those that they stand for.
DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode)) if unicodedata.category(c) == "Nd")
DIGITS = DIGITS, "".join(str(unicodedata.digit(c)) for c in DIGITS)


def rx(pattern: str, *, ignore_case: bool = False, dot_all: bool = False, multiline: bool = False) -> str:
    """A Java pattern with Unicode classes; ``multiline`` anchors only after a line feed."""
    flags = "U" + "iu" * ignore_case + "s" * dot_all + "md" * multiline
    return f"(?{flags}){pattern}"


def decoded(raw: Column) -> Column:
    """Text of bytes: bad sequences are replaced, CR LF and CR become LF."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), r"\r\n?", "\n")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rx(r"^\s+|\s+$"), "")


def cut(x: Column, n: int = 80) -> Column:
    return F.substring(x, 1, n)


def lines(content: Column) -> Column:
    """Array of lines; no empty line after a final line end, no lines in an empty text."""
    parts = F.split(content, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def suffix(name: Column) -> Column:
    """Lower-cased extension with its dot; none for a leading or a final dot."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def needles(pattern: str, least: int = 3) -> list[str]:
    """Texts of which every match contains at least one; none where the pattern doesn't tell."""

    def best(items) -> list[str]:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(value)
                continue
            found, run = [*found, [run]], ""
            if op is _parser.SUBPATTERN:
                found.append(best(value[3]))
            elif op is _parser.BRANCH:
                each = [best(x) for x in value[1]]
                found.append(sum(each, []) if all(each) else [])
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
                found.append(best(value[2]))
        found = [f for f in found if f and min(map(len, f)) >= least]
        return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=[])

    try:
        return list(dict.fromkeys(best(_parser.parse(pattern))))
    except (re.error, OverflowError):
        return []


def matches(line: Column, pattern: str) -> Column:
    """``rlike`` that looks for ``needles`` first: plain searches are far cheaper than patterns with Unicode classes, and nearly always enough."""
    flags, plain = re.fullmatch(r"(?:\(\?([A-Za-z]+)\))?(.*)", pattern, re.DOTALL).groups()
    words, hit = needles(plain), line.rlike(pattern)
    if not words:
        return hit
    fold = "i" in (flags or "")
    seen = [F.contains(F.lower(line), F.lit(w.lower())) if fold else F.contains(line, F.lit(w)) for w in words]
    if fold:  # letters outside ASCII may equal ASCII ones when case is ignored
        seen.append(F.octet_length(line) != F.char_length(line))
    return reduce(Column.__or__, seen) & hit


def first_match(line: Column, pattern: str) -> Column:
    """Text of the first match, cut to 80 characters; null without a match."""
    return F.when(matches(line, pattern), cut(F.regexp_extract(line, pattern, 0)))


def literal(pattern: str) -> str:
    """A word that every match of the pattern contains, or "": the longest outside of groups, classes and alternatives."""
    plain = re.sub(r"\[[^\]]*\]", " ", re.sub(r"\\.", " ", pattern))
    while (shorter := re.sub(r"\([^()]*\)", " ", plain)) != plain:
        plain = shorter
    plain = re.sub(r"[. ][*+?]*", " ", re.sub(r"\{[^}]*\}", " ", plain))
    words = [] if re.search(r"[|?*()]", plain) else re.findall(r"[A-Za-z0-9_]{4,}", plain)
    return max(words, key=len, default="")


def any_of(line: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns occurs, tried in order and only as far as needed."""
    return reduce(Column.__or__, [matches(line, p) for p in patterns])


def near(name: Column, known: list[str], most: int = 2) -> Column:
    """The first entry of ``known`` within ``most`` edits of ``name``, itself included; null if none."""
    return F.get(F.filter(F.array(*map(F.lit, known)), lambda k: F.levenshtein(name, k, most) >= 0), F.lit(0))
