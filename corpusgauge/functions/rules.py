"""What the quality and structure scans look for.

The patterns are stated in Python form; ``java_regex`` adapts them once, on the
driver, so that every one reaches the executors as a literal.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from corpusgauge.functions.regex import (
    ENDS_WORD,
    STARTS_WORD,
    WORD_CLASS,
    java_quote,
    java_regex,
)

ERROR, WARNING, INFO = "error", "warning", "info"


@dataclass(frozen=True)
class Rule:
    """One line-numbered issue; users may pass their own list to the operators."""

    issue_type: str
    pattern: str
    message: str
    severity: str
    ignore_case: bool = False
    multiline: bool = False
    first: str = ""
    """Members of a character class that holds every first character of a match.

    Optional; it lets the search pass over most positions with one cheap test.
    """
    needs: tuple[str, ...] = ()
    """Texts of which one is in every text the rule hits; others are not searched."""
    needs_folded: tuple[str, ...] = ()
    """The same for ``folded`` texts: lower-case words that come in any letter case."""

    @property
    def java(self) -> str:
        body = java_regex(self.pattern, multiline=self.multiline, ignore_case=self.ignore_case)
        return f"(?=[{self.first}])(?:{body})" if self.first else body


# The nine issue rules.  ``empty_except`` is worded so that there is one way
# only to match a run of blanks: the first newline, then all the rest.
RULES: tuple[Rule, ...] = (
    Rule("long_line", r"^.{121,}$", "Line exceeds 120 characters", WARNING, multiline=True),
    Rule(
        "todo_comment",
        r"#\s*TODO\b|//\s*TODO\b|/\*\s*TODO\b",
        "TODO comment found",
        INFO,
        ignore_case=True,
        first="#/",
        needs=("#", "/"),
        needs_folded=("todo",),
    ),
    Rule(
        "fixme_comment",
        r"#\s*FIXME\b|//\s*FIXME\b|/\*\s*FIXME\b",
        "FIXME comment found",
        WARNING,
        ignore_case=True,
        first="#/",
        needs=("#", "/"),
        needs_folded=("fixme",),
    ),
    Rule(
        "hack_comment",
        r"#\s*HACK\b|//\s*HACK\b|/\*\s*HACK\b",
        "HACK comment found - technical debt indicator",
        WARNING,
        ignore_case=True,
        first="#/",
        needs=("#", "/"),
        needs_folded=("hack",),
    ),
    Rule(
        "hardcoded_password",
        r"(?:password|passwd|pwd)\s*[=:]\s*[\"'][^\"']+[\"']",
        "Potential hardcoded password detected",
        ERROR,
        ignore_case=True,
        first="pP",
        needs=("'", '"'),
        needs_folded=("password", "passwd", "pwd"),
    ),
    Rule(
        "hardcoded_secret",
        r"(?:secret|api_key|apikey|token)\s*[=:]\s*[\"'][^\"']+[\"']",
        "Potential hardcoded secret/API key detected",
        ERROR,
        ignore_case=True,
        first="sSaAtT\u017f",
        needs=("'", '"'),
        needs_folded=("secret", "api_key", "apikey", "token"),
    ),
    Rule(
        "debug_statement",
        r"\bconsole\.log\(|print\s*\(|debugger\b",
        "Debug statement found",
        INFO,
        first="cpd",
        needs=("console.log(", "print", "debugger"),
    ),
    Rule(
        "empty_except",
        r"except\s*:[^\S\n]*\n\s*pass\b|except\s*:[^\S\n]*\n\s*\.\.\.",
        "Empty except block - may hide errors",
        WARNING,
        first="e",
        needs=("except",),
    ),
    Rule(
        "magic_number",
        r"(?<![0-9])[2-9]\d{2,}(?![0-9])",
        "Magic number detected - consider using named constant",
        INFO,
        first="2-9",
    ),
)

# What raises the complexity, by category.  The logical marks count only
# between two word characters, as ``\\b&&\\b`` does.
COMPLEXITY_WORDS: dict[str, tuple[str, ...]] = {
    "conditional": ("if", "elif", "else", "switch", "case"),
    "loop": ("for", "while", "do"),
    "exception": ("try", "catch", "except", "finally"),
    "logical": ("and", "or"),
}
TERNARY = r"\?\s*:"
LOGICAL_MARKS = ("&&", "||")


def _whole_words(words: Iterable[str]) -> str:
    """Any of the words on its own.

    The first letters and the plain characters of a word sort out most positions cheaply.
    """
    words = list(words)
    return f"(?=[{_first_letters(words)}])(?<![a-zA-Z0-9_]){STARTS_WORD}(?:{'|'.join(words)}){ENDS_WORD}"


def _first_letters(words: Iterable[str]) -> str:
    return "".join(sorted({word[0] for word in words}))


def _marks_between_words(marks: Iterable[str]) -> str:
    joined = [java_quote(mark) for mark in marks]
    behind = "|".join(f"{mark}(?<=[{WORD_CLASS}]{mark})" for mark in joined)
    return f"(?:{behind})(?=[{WORD_CLASS}])"


def complexity_patterns() -> dict[str, str]:
    """One Java pattern per category.

    Whole words never overlap each other, the ternary mark or the operators, so
    one alternation finds as many matches as its members do one by one.
    """
    patterns = {category: _whole_words(words) for category, words in COMPLEXITY_WORDS.items()}
    patterns["conditional"] += "|" + java_regex(TERNARY)
    patterns["logical"] += "|" + _marks_between_words(LOGICAL_MARKS)
    return patterns


def total_complexity_pattern() -> str:
    """All categories in one pass."""
    words = [word for words in COMPLEXITY_WORDS.values() for word in words]
    marks = "".join(sorted({TERNARY[1], *"".join(LOGICAL_MARKS)}))
    found = "|".join((_whole_words(words), java_regex(TERNARY), _marks_between_words(LOGICAL_MARKS)))
    return f"(?=[{_first_letters(words)}{java_quote(marks)}])(?:{found})"


# Headers that open a function, by language, and the length limit.  In the
# Java header a run of blanks is taken whole (``\s++``); a type cannot start inside one.
_SCRIPT_FUNCTION = (
    r"^\s*(?:async\s+)?(?:function\s+(\w+)"
    r"|(\w+)\s*[=:]\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))"
)
FUNCTION_HEADERS: dict[str, str] = {
    "Python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",
    "JavaScript": _SCRIPT_FUNCTION,
    "TypeScript": _SCRIPT_FUNCTION,
    "Go": r"^\s*func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(",
    "Java": r"^(?:public|private|protected|static|\s++)+[\w<>[\]]+\s+(\w+)\s*\(",
}
TWO_GROUP_HEADERS = ("JavaScript", "TypeScript")
# Texts of which one is in every text that has such a header.
HEADER_NEEDS: dict[str, tuple[str, ...]] = {
    "Python": ("def",),
    "JavaScript": ("function", "=>"),
    "TypeScript": ("function", "=>"),
    "Go": ("func",),
    "Java": ("(",),
}
LONG_FUNCTION_LINES = 50

# Import statements, by language; group 1 is the module.
_SCRIPT_IMPORTS = (
    r"^\s*import\s+.*?from\s+[\"'](.+?)[\"']",
    r"^\s*(?:const|let|var)\s+\w+\s*=\s*require\([\"'](.+?)[\"']\)",
)
_INCLUDES = (r"^\s*#include\s*[<\"](.+?)[>\"]",)
IMPORTS: dict[str, tuple[str, ...]] = {
    "Python": (r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import"),
    "JavaScript": _SCRIPT_IMPORTS,
    "TypeScript": _SCRIPT_IMPORTS,
    "Go": (
        r"^\s*import\s+[\"'](.+?)[\"']",
        r"^\s*import\s+\w+\s+[\"'](.+?)[\"']",
        r"^\s+\"(.+?)\"",
    ),
    "Java": (r"^\s*import\s+([\w.]+);",),
    "Rust": (r"^\s*use\s+([\w:]+)", r"^\s*extern\s+crate\s+(\w+)"),
    "C": _INCLUDES,
    "C++": _INCLUDES,
    "Ruby": (r"^\s*require\s+['\"](.+?)['\"]", r"^\s*require_relative\s+['\"](.+?)['\"]"),
}

# Entry points, by language and by file name.  What stands before
# ``module.exports`` is looked at within its line; an earlier line start adds no match.
_SCRIPT_ENTRIES = (
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+main\s*\(",
    r"^[^/\n]*module\.exports\s*=",
)
_C_ENTRIES = (r"^\s*int\s+main\s*\(", r"^\s*void\s+main\s*\(")
ENTRY_PATTERNS: dict[str, tuple[str, ...]] = {
    "Python": (r"if\s+__name__\s*==\s*[\"']__main__[\"']\s*:",),
    "JavaScript": _SCRIPT_ENTRIES,
    "TypeScript": _SCRIPT_ENTRIES,
    "Go": (r"^\s*func\s+main\s*\(\s*\)",),
    "Java": (r"public\s+static\s+void\s+main\s*\(\s*String",),
    "Rust": (r"^\s*fn\s+main\s*\(\s*\)",),
    "C": _C_ENTRIES,
    "C++": _C_ENTRIES,
}
ENTRY_NAMES: tuple[str, ...] = (
    "main.py", "app.py", "index.py", "__main__.py",
    "main.js", "index.js", "app.js",
    "main.ts", "index.ts", "app.ts",
    "main.go", "main.rs", "Main.java", "App.java", "main.c", "main.cpp",
)
