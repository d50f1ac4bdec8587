"""Language of a file from its suffix, in the three variants in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge.functions.paths import file_name, suffix

# Suffix -> language.
LANGUAGES: dict[str, str] = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".jsx": "JavaScript (JSX)",
    ".tsx": "TypeScript (TSX)",
    ".java": "Java",
    ".kt": "Kotlin",
    ".go": "Go",
    ".rs": "Rust",
    ".c": "C",
    ".cpp": "C++",
    ".cc": "C++",
    ".cxx": "C++",
    ".h": "C/C++ Header",
    ".hpp": "C++ Header",
    ".cs": "C#",
    ".rb": "Ruby",
    ".php": "PHP",
    ".swift": "Swift",
    ".scala": "Scala",
    ".r": "R",
    ".m": "Objective-C",
    ".mm": "Objective-C++",
    ".pl": "Perl",
    ".pm": "Perl",
    ".sh": "Shell",
    ".bash": "Bash",
    ".zsh": "Zsh",
    ".fish": "Fish",
    ".ps1": "PowerShell",
    ".lua": "Lua",
    ".sql": "SQL",
    ".html": "HTML",
    ".htm": "HTML",
    ".css": "CSS",
    ".scss": "SCSS",
    ".sass": "Sass",
    ".less": "Less",
    ".json": "JSON",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".xml": "XML",
    ".toml": "TOML",
    ".ini": "INI",
    ".cfg": "Config",
    ".md": "Markdown",
    ".rst": "reStructuredText",
    ".txt": "Text",
    ".vue": "Vue",
    ".svelte": "Svelte",
    ".dart": "Dart",
    ".elm": "Elm",
    ".ex": "Elixir",
    ".exs": "Elixir",
    ".erl": "Erlang",
    ".hrl": "Erlang",
    ".hs": "Haskell",
    ".ml": "OCaml",
    ".mli": "OCaml",
    ".clj": "Clojure",
    ".cljs": "ClojureScript",
    ".jl": "Julia",
    ".nim": "Nim",
    ".zig": "Zig",
    ".v": "V",
    ".d": "D",
    ".f90": "Fortran",
    ".f95": "Fortran",
    ".f03": "Fortran",
    ".asm": "Assembly",
    ".s": "Assembly",
    ".proto": "Protocol Buffers",
    ".graphql": "GraphQL",
    ".gql": "GraphQL",
    ".dockerfile": "Dockerfile",
    ".tf": "Terraform",
    ".hcl": "HCL",
    ".makefile": "Makefile",
}
# Names that count as a language without having a suffix.
BARE_NAMES: dict[str, str] = {"makefile": "Makefile", "dockerfile": "Dockerfile"}
BARE_NAMES_EXPLAIN: dict[str, str] = BARE_NAMES | {
    "gemfile": "Ruby",
    "rakefile": "Ruby",
    ".bashrc": "Shell",
    ".bash_profile": "Shell",
    ".zshrc": "Shell",
}


def _literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(item) for pair in entries.items() for item in pair])


def _by_suffix(path: Column) -> Column:
    return F.try_element_at(_literal_map(LANGUAGES), suffix(path))


def _with_bare_names(path: Column, bare: dict[str, str]) -> Column:
    by_name = F.try_element_at(_literal_map(bare), F.lower(file_name(path)))
    return F.when(suffix(path) == "", by_name).otherwise(_by_suffix(path))


def code_language(path: Column) -> Column:
    """Variant of the quality and structure scans: suffix only, else Unknown."""
    return F.coalesce(_by_suffix(path), F.lit("Unknown"))


def stats_language(path: Column) -> Column:
    """Variant of the repository statistics: two bare names, else Other."""
    return F.coalesce(_with_bare_names(path, BARE_NAMES), F.lit("Other"))


def explain_language(path: Column) -> Column:
    """Variant of the file explanations: seven bare names, else Unknown."""
    return F.coalesce(_with_bare_names(path, BARE_NAMES_EXPLAIN), F.lit("Unknown"))
