"""Path columns: name, suffix, ancestors, and the three exclude semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge.functions.regex import java_quote

# Default exclude lists of the three scans.
TRACKED_EXCLUDES = ("node_modules", ".git", "__pycache__", "*.pyc", "vendor", ".venv", "venv")
QUALITY_EXCLUDES = (
    "node_modules", ".git", "__pycache__", "*.pyc", "vendor", ".venv", "venv",
    "dist", "build", "*.min.js", "*.min.css",
)
STRUCTURE_EXCLUDES = (
    "node_modules", ".git", "__pycache__", "*.pyc", "vendor", ".venv", "venv",
    "dist", "build", ".idea", ".vscode",
)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; '' for dotfiles, bare names and a trailing dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)\z", 1))


def glob_regex(pattern: str, within_name: bool = False) -> str:
    """Java body of a shell glob.  ``within_name`` keeps every part of it off ``/``."""
    any_char, no_slash = ("[^/]", "(?!/)") if within_name else (".", "")
    out: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(f"{any_char}*")
        elif ch == "?":
            out.append(any_char)
        elif ch == "[":
            # a ] right after [ or [! belongs to the set
            close = pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))
            if close < 0:
                out.append(r"\[")
                continue
            body = pattern[i:close]
            negated = body.startswith("!")
            members = "".join("\\" + c if c in r"\[]^&" else c for c in body[negated:])
            out.append(f"{no_slash}[{'^' if negated else ''}{members}]")
            i = close + 1
        else:
            out.append(java_quote(ch))
    return "".join(out)


def _any_of(bodies: Sequence[str]) -> str:
    """Alternation; of nothing, a pattern that never matches."""
    return "(?:" + "|".join(bodies) + ")" if bodies else "(?!)"


def _name_globs(patterns: Sequence[str]) -> list[str]:
    """Globs that can cover a name: one with a ``/`` never does."""
    return [glob_regex(p, within_name=True) for p in patterns if "/" not in p]


def tracked_excluded(path: Column, patterns: Sequence[str]) -> Column:
    """The glob has to cover the whole relative path (``*`` crosses ``/``)."""
    if not patterns:
        return F.lit(False)
    return path.rlike(f"(?s)^{_any_of([glob_regex(p) for p in patterns])}\\z")


def quality_excluded(path: Column, patterns: Sequence[str] = ()) -> Column:
    """The glob covers the file name, or its plain text occurs anywhere in the path."""
    patterns = patterns or QUALITY_EXCLUDES
    names = _any_of(_name_globs(patterns))
    texts = _any_of([java_quote(p) for p in patterns])
    return path.rlike(f"(?s)(?:^|/){names}\\z|{texts}")


def structure_excluded(path: Column, patterns: Sequence[str] = ()) -> Column:
    """True when the entry or any of its ancestors is excluded.

    An ancestor is excluded when its name equals or matches the glob, when its
    whole path (rooted at ``/``) matches it, or when ``/pattern`` ends a component
    run in it.  All of it is one search over the rooted path, so no prefix list
    has to be built per row.
    """
    patterns = patterns or STRUCTURE_EXCLUDES
    names = _any_of(_name_globs(patterns) + [java_quote(p) for p in patterns])
    whole = _any_of([glob_regex(p) for p in patterns])
    return F.concat(F.lit("/"), path).rlike(f"(?s)/{names}(?:/|\\z)|^{whole}(?:/.*)?\\z")


def hidden(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.")


def glob_regex_column(pattern: Column) -> Column:
    """``glob_regex`` for patterns that sit in a settings table."""

    def member(token: Column) -> Column:
        body = F.regexp_replace(F.substr(token, F.lit(2), F.length(token) - 2), r"^!", "")
        negation = F.when(F.startswith(token, F.lit("[!")), "^").otherwise("")
        escaped = F.regexp_replace(body, r"([\\\[\]^&])", r"\\$1")
        return F.concat(F.lit("["), negation, escaped, F.lit("]"))

    def regex(token: Column) -> Column:
        return (
            F.when(token == "*", ".*")
            .when(token == "?", ".")
            .when(F.length(token) > 1, member(token))
            .otherwise(F.regexp_replace(token, r"([\\.^$|+(){}\[\]&~#-])", r"\\$1"))
        )

    # a set, closed by the first ] after at least one member, or a single character
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)\[!?+\]?+[^\]]*+\]|."), F.lit(0))
    return F.array_join(F.transform(tokens, regex), "")


def name_regexes(patterns: Column) -> Column:
    """Whole-name regexes of a column of glob lists; computed once for a settings row."""
    return F.transform(patterns, lambda p: F.concat(F.lit("(?s)^(?:"), glob_regex_column(p), F.lit(")\\z")))


def quality_excluded_by(path: Column, patterns: Column, regexes: Column) -> Column:
    """``quality_excluded`` with lists per row: globs, and ``name_regexes`` of them."""
    name = file_name(path)
    return F.exists(patterns, lambda p: F.contains(path, p)) | F.exists(
        regexes, lambda r: F.regexp_like(name, r)
    )
