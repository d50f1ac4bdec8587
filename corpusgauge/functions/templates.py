"""Prompt templates: own texts with ``{slot}`` fields, filled as one ``concat``."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIFF_PART = """## Patch
```diff
{diff}
```

## Surrounding files
{file_context}

"""
_REPLY_FORM = """## Reply format
Answer with a JSON object holding "summary" and "comments". Every comment has
"file", "line", "severity" (INFO, WARNING or ERROR), "category", "message" and
"suggestion".
"""

TEMPLATES: dict[str, str] = {
    "repo": """# Describe this repository

Files: {total_files}
Lines: {total_lines}
Languages: {languages}

## Latest commits
{recent_commits}

In two or three paragraphs say what the project is for, what it is built with and
what has been worked on lately. Write for someone who sees it for the first time.
""",
    "file": """# Explain this file

Path: {file_path}
Language: {language}
Lines: {lines}

```{language}
{content}
```

Reply in Markdown with the sections "### Purpose" (one or two sentences),
"### Key Elements" (a bullet list), "### Details" and "### Usage".
""",
    "architect": "# Design review\n\nJudge module boundaries, coupling, interfaces and "
    "failure handling in the patch.\n\n" + _DIFF_PART + _REPLY_FORM,
    "security": "# Security review\n\nLook for injection, broken access checks, exposed secrets "
    "and unsafe input handling in the patch.\n\n" + _DIFF_PART + _REPLY_FORM,
    "performance": "# Performance review\n\nLook for needless work, memory growth, blocking I/O "
    "and costly queries in the patch.\n\n" + _DIFF_PART + _REPLY_FORM,
    "junior": "# Readability review\n\nComment on naming, structure, tests and documentation as "
    "a patient mentor would.\n\n" + _DIFF_PART + _REPLY_FORM,
    "summary": """# Merge the reviews

Files changed: {files_changed}
Added lines: +{additions}
Removed lines: -{deletions}

{agent_reviews}

Say whether the change can be merged, list what blocks it, what should be fixed and
what is optional, and name the themes that more than one reviewer raised.
""",
}

_SLOT = re.compile(r"\{(\w+)\}")


def slots(name: str) -> list[str]:
    return _SLOT.findall(TEMPLATES[name])


@dataclass(frozen=True)
class Lines:
    """A list value of a slot, an array column; nulls in it are left out."""

    column: Column


def fill(name: str, values: Mapping[str, Column | Lines]) -> Column:
    """The filled template as a string column.

    Slot values are never scanned for further slots, so file contents that hold
    ``{lines}`` stay as they are.  ``Lines`` of an array column puts its elements on
    lines of their own; a missing value raises ``KeyError``.
    """
    if name not in TEMPLATES:
        raise FileNotFoundError(f"no template named {name}")
    parts: list[Column] = []
    for i, piece in enumerate(_SLOT.split(TEMPLATES[name])):
        if i % 2:
            if piece not in values:
                raise KeyError(f"template {name} needs a value for {piece}")
            value = values[piece]
            lines = isinstance(value, Lines)
            parts.append(F.array_join(value.column, "\n") if lines else value.cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)
