"""Regex dialect: patterns are stated in Python form, run by ``java.util.regex``.

The two dialects differ in what ``\\w``, ``\\s``, ``\\b``, ``$`` and ``.`` cover and
in what a bare ``[`` inside a class means.  ``java_regex`` rewrites exactly those
constructs, so the result does not depend on the JVM version either.
"""

from __future__ import annotations

import re

# A pattern that starts with blanks at a line start may start in any line of a run of
# blank lines.  If it fails in the first it fails in all, so the others are passed over;
# without this a file of n blank lines costs n * n steps.
_FIRST_OF_BLANK_LINES = r"(?<!\n[ \t]{0,80}\n)"

# ``^\s`` or a first group that has ``\s++`` among its alternatives.
_STARTS_WITH_BLANKS = re.compile(r"\^(?:\\s|\(\?:(?:\w+\|)*\\s\+\+\))")

# ``^\s*`` or ``^\s+``, words that may follow, each with blanks behind it, and how the next
# thing starts: a choice of words, or a plain character that has to be there.
_BLANKS_THEN = re.compile(
    r"\^\\s[*+]((?:\(\?:\w+\\s\+\)\?)*)(?:\(\?:(\w+(?:\|\w+)*)\)|(\\?[\"#]|\w))(?![*?{])"
)

WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\p{Z}"
_SPACE_BUT_NEWLINE = r"\t\x0b-\r\x1c-\x20\x85\p{Z}"

STARTS_WORD = f"(?<![{WORD_CLASS}])"
ENDS_WORD = f"(?![{WORD_CLASS}])"
_EITHER_EDGE = (
    f"(?:(?<![{WORD_CLASS}])(?=[{WORD_CLASS}])|(?<=[{WORD_CLASS}])(?![{WORD_CLASS}]))"
)


def _line_may_start(pattern: str) -> str:
    """A look at one line, to stand behind ``^``: may a match start in it?

    For patterns of blanks and a known character.  What follows the spaces and tabs of the
    line has to be that character or another blank, so a line of anything else is passed
    over at its first character, and the look back for blank lines is spared.
    """
    start = _BLANKS_THEN.match(pattern)
    if not start:
        return ""
    words = re.findall(r"\(\?:(\w)", start[1]) + [word[0] for word in (start[2] or "").split("|") if word]
    return rf"(?=[ \t]*+[{SPACE_CLASS}{''.join(words)}{start[3] or ''}])"


def _is_word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def java_regex(
    pattern: str, *, multiline: bool = False, ignore_case: bool = False, dot_all: bool = False
) -> str:
    """Java text of a Python pattern with the same matches."""
    out: list[str] = []
    in_class = False
    previous_literal = ""  # last plain character, '' after anything else
    i = 0
    if multiline and _STARTS_WITH_BLANKS.match(pattern):
        out.append("^" + ("" if ignore_case else _line_may_start(pattern)) + _FIRST_OF_BLANK_LINES)
        i = 1
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            code = pattern[i + 1]
            following = pattern[i + 2] if i + 2 < len(pattern) else ""
            i += 2
            if code == "w":
                out.append(WORD_CLASS if in_class else f"[{WORD_CLASS}]")
            elif code == "s":
                out.append(SPACE_CLASS if in_class else f"[{SPACE_CLASS}]")
            elif code == "S":
                out.append(f"[^{SPACE_CLASS}]")
            elif code == "d":
                out.append(r"\p{Nd}")
            elif code == "Z":
                out.append(r"\z")
            elif code == "b" and not in_class:
                if _is_word(following):
                    out.append(STARTS_WORD)
                elif previous_literal and _is_word(previous_literal):
                    out.append(ENDS_WORD)
                else:
                    out.append(_EITHER_EDGE)
            else:
                out.append("\\" + code)
            previous_literal = ""
            continue
        if in_class:
            if ch == "]":
                in_class = False
                out.append(ch)
            else:
                out.append("\\" + ch if ch in "[&" else ch)
            previous_literal = ""
        elif pattern.startswith(r"[^\S\n]", i):
            out.append(f"[{_SPACE_BUT_NEWLINE}]")
            previous_literal = ""
            i += len(r"[^\S\n]")
            continue
        elif ch == "[":
            in_class = True
            out.append(ch)
            if i + 1 < len(pattern) and pattern[i + 1] == "^":
                out.append("^")
                i += 1
            previous_literal = ""
        else:
            out.append(ch)
            previous_literal = ch
        i += 1
    flags = "d" + ("m" if multiline else "") + ("iu" if ignore_case else "") + ("s" if dot_all else "")
    return f"(?{flags})" + "".join(out)


def java_quote(text: str) -> str:
    """Escape every character that has a meaning in a Java pattern."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-&~#" else ch for ch in text)
