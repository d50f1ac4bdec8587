"""Text helpers over string columns.  All built-ins; the hot ones avoid regexes."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge.functions.regex import SPACE_CLASS, java_regex

# The characters Python's str.strip() removes.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line ends of str.splitlines() besides \n and \r.
EXTRA_LINE_ENDS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Characters outside ASCII that a Java pattern with ``(?iu)`` takes for a letter.
CASE_STAND_INS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}

# Two noncharacters: neither is a letter, digit, blank or line end, so swapping
# one for the other changes no match of any rule.
_MARK = "\ufdd0"
_MARK_STAND_IN = "\ufdd1"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(PY_SPACE))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(f"[^{SPACE_CLASS}]"), F.lit(False))


def universal_newlines(text: Column) -> Column:
    """``\\r\\n`` and ``\\r`` become ``\\n``, as reading a file in text mode does."""
    unified = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(F.contains(text, F.lit("\r")), unified).otherwise(text)


def replaced(text: Column, old: str, new: str) -> Column:
    """``replace`` for texts that seldom hold ``old``: finding that out is much cheaper."""
    return F.when(F.contains(text, F.lit(old)), F.replace(text, F.lit(old), F.lit(new))).otherwise(text)


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def iterated_lines(text: Column) -> Column:
    """Lines met when iterating over a file whose newlines are already ``\\n``."""
    unfinished = (text != "") & ~F.endswith(text, F.lit("\n"))
    return newline_count(text) + unfinished.cast("int")


def split_lines(text: Column) -> Column:
    """Length of ``str.splitlines()`` for text whose newlines are already ``\\n``."""
    # texts with such a character are rare, and looking for one byte for byte is cheap
    counted = F.regexp_count(text, F.lit(f"[{EXTRA_LINE_ENDS}]"))
    extra = F.when(has_any(text, EXTRA_LINE_ENDS), counted).otherwise(0)
    ends = [F.endswith(text, F.lit(end)) for end in "\n" + EXTRA_LINE_ENDS]
    unfinished = (text != "") & ~reduce(operator.or_, ends)
    return newline_count(text) + extra + unfinished.cast("int")


def has_any(text: Column, needed: Iterable[str]) -> Column:
    return reduce(operator.or_, [F.contains(text, F.lit(one)) for one in needed])


def folded(text: Column) -> Column:
    """``text`` with every character a case-blind pattern takes for a letter as that letter."""
    plain = text
    for stand_in, letter in CASE_STAND_INS.items():
        plain = F.replace(plain, F.lit(stand_in), F.lit(letter))
    return F.lower(F.when(has_any(text, CASE_STAND_INS), plain).otherwise(text))


def match_lines(text: Column, pattern: str) -> Column:
    """1-based line of the start of every match, as an ordered ``ARRAY<INT>``.

    Each match gets a marker put in front of it and the marked text is cut into
    lines once, so the cost is linear in the text whatever the number of matches.
    """
    return marked_lines(mark_matches(text, pattern))


def mark_matches(text: Column, pattern: str) -> Column:
    plain = replaced(text, _MARK, _MARK_STAND_IN)
    return F.regexp_replace(plain, F.lit(pattern), F.lit(_MARK + "$0"))


def has_marks(marked: Column) -> Column:
    return F.contains(marked, F.lit(_MARK))


def marked_lines(marked: Column) -> Column:
    """Line numbers of the marks, each line as often as it holds one."""

    def per_line(line: Column, index: Column) -> Column:
        marks = F.length(line) - F.length(F.replace(line, F.lit(_MARK), F.lit("")))
        return F.when(has_marks(line), F.array_repeat(index + 1, marks)).otherwise(no_lines())

    def lines_of(text: Column) -> Column:
        lines = F.flatten(F.transform(F.split(text, "\n", -1), per_line))
        return F.when(has_marks(text), lines).otherwise(no_lines())

    return let(marked, lines_of)


def no_lines() -> Column:
    return F.array().cast("array<int>")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; NULL without a match or for an unused group.

    ``regexp_extract`` yields '' for both, so the whole match is looked at as well.
    """
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


LATIN_1 = "ISO-8859-1"


def decode_dropping(content: Column) -> Column:
    """UTF-8 text of a binary column with undecodable bytes dropped."""
    keep, stand_in = F.lit("\ufffd"), F.lit("\ufdd2")
    raw = content.cast("string")
    repaired = F.make_valid_utf8(F.replace(raw, keep, stand_in))
    dropped = F.replace(F.replace(repaired, keep, F.lit("")), stand_in, keep)
    return F.when(F.is_valid_utf8(raw), raw).otherwise(dropped)


def decode_or_latin1(content: Column) -> Column:
    """UTF-8 text of a binary column, or the whole content read as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, LATIN_1))


__all__ = [
    "PY_SPACE",
    "count_matches",
    "decode_dropping",
    "decode_or_latin1",
    "first_group",
    "folded",
    "has_any",
    "has_marks",
    "is_blank",
    "iterated_lines",
    "java_regex",
    "let",
    "mark_matches",
    "marked_lines",
    "match_lines",
    "newline_count",
    "no_lines",
    "split_lines",
    "strip",
    "universal_newlines",
]
