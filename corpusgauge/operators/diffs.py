"""Unified diffs as columns: sections, paths, change types, hunks, line counts.

A diff is parsed inside its own row.  Nothing is regrouped afterwards, so no
operator here shuffles, and a blank diff keeps its row with zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.regex import SPACE_CLASS, java_regex
from corpusgauge.functions.rows import explode_items
from corpusgauge.functions.text import first_group, let, strip


def _m(pattern: str) -> str:
    return java_regex(pattern, multiline=True)


# What the parts of a diff look like.
SECTION_START = "diff --git "
SECTION = java_regex(r"^\s*diff --git")
FILE_HEADER = _m(r"^diff --git a/(.*) b/(.*)$")
NEW_FILE = "new file mode"
DELETED_FILE = "deleted file mode"
RENAME_FROM = "rename from "
RENAME_TO = "rename to "
SIMILARITY = _m(r"^similarity index (\d+)%$")
BINARY = _m(r"^Binary files .* differ$")
HUNK_HEADER = _m(r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@(.*)$")
NO_HEADER = "Invalid diff format: no file header found"
HUNK_START = "\n@@ -"

#: What follows ``HUNK_START`` in a hunk's header.
HUNK_NUMBERS = r"\A([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
#: A hunk whose first line with text is indented and then has a sign; stripping the hunk
#: makes it a changed line.
INDENTED_SIGN = rf"(?:\A|\n@@ -)[^\n]*\n[{SPACE_CLASS}]*[{SPACE_CLASS}&&[^\n]][+-]"


def _has_line(section: Column, start: str) -> Column:
    """Some line starts so.  A section's first line is its header, so a plain search does."""
    return F.contains(section, F.lit("\n" + start))


def _rest_of_line(section: Column, start: str) -> Column:
    """What follows ``start`` on the first line that starts so; NULL without one."""
    after = F.substring_index(F.substr(section, F.locate("\n" + start, section) + 1 + len(start)), "\n", 1)
    return F.when(_has_line(section, start), after)


def _is_binary(section: Column) -> Column:
    return _has_line(section, "Binary files ") & section.rlike(BINARY)


def _change_type(section: Column) -> Column:
    similar = _has_line(section, "similarity index ") & section.rlike(SIMILARITY)
    return (
        F.when(_has_line(section, NEW_FILE), "added")
        .when(_has_line(section, DELETED_FILE), "deleted")
        .when(_has_line(section, RENAME_FROM) | similar, "renamed")
        .otherwise("modified")
    )


def _sections(raw: Column) -> Column:
    """The files' parts of a diff: the lines from one header to the next."""
    # a plain text is split for much faster than a pattern; it takes the header's start away
    parts = F.transform(
        F.split(raw, "\n" + SECTION_START, -1),
        lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit(SECTION_START), part)),
    )
    return F.filter(parts, lambda part: part.rlike(SECTION))


def _hunks(section: Column) -> Column:
    def number(header: Column, group: int) -> Column:
        return F.nullif(F.regexp_extract(header, HUNK_NUMBERS, group), F.lit("")).try_cast("int")

    def hunk(part: Column) -> Column:
        return F.struct(
            number(part, 1).alias("old_start"),
            F.coalesce(number(part, 2), F.lit(1)).alias("old_count"),
            number(part, 3).alias("new_start"),
            F.coalesce(number(part, 4), F.lit(1)).alias("new_count"),
            # the rest of the header's line is no content
            strip(F.substr(part, F.locate("\n", F.concat(part, F.lit("\n"))))).alias("content"),
        )

    def build(parts: Column) -> Column:
        # a line that only starts like a header belongs to the hunk before it
        joined = F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda done, part: F.when(part.rlike(HUNK_NUMBERS), F.array_append(done, part))
            .when(F.size(done) == 0, done)
            .otherwise(
                F.array_append(
                    F.slice(done, 1, F.size(done) - 1), F.concat(F.element_at(done, -1), F.lit(HUNK_START), part)
                )
            ),
        )
        plain = F.forall(parts, lambda part: part.rlike(HUNK_NUMBERS))
        return F.transform(F.when(plain, parts).otherwise(joined), hunk)

    # what stands before the first header is no hunk
    return let(F.filter(F.split(section, HUNK_START, -1), lambda part, i: i > 0), build)


def _no_hunks() -> Column:
    return F.array().cast(
        "array<struct<old_start:int,old_count:int,new_start:int,new_count:int,content:string>>"
    )


def _changed_lines(hunks: Column, sign: str) -> Column:
    """Lines that start with the sign but not with three of it."""

    def starting(content: Column, prefix: str) -> Column:
        # every hit makes the text shorter by the length of the prefix
        lines = F.concat(F.lit("\n"), content)
        rest = F.replace(lines, F.lit("\n" + prefix), F.lit("\n"))
        return ((F.octet_length(lines) - F.octet_length(rest)) / len(prefix)).cast("int")

    return F.aggregate(
        hunks,
        F.lit(0),
        lambda n, h: n + starting(h["content"], sign) - starting(h["content"], sign * 3),
    )


def _counts(section: Column) -> Column:
    """``additions, deletions`` of a section, without making its hunks.

    All lines from the first hunk header on are counted at once.  Where the first line that
    starts like a header is none, or stripping a hunk could make a changed line, the hunks
    decide.
    """
    body = F.substr(section, F.locate(HUNK_START, section) + len(HUNK_START))

    def both(additions: Column, deletions: Column) -> Column:
        return F.struct(additions.alias("additions"), deletions.alias("deletions"))

    def plain(b: Column) -> Column:
        whole = F.array(F.struct(b.alias("content")))
        lean = both(_changed_lines(whole, "+"), _changed_lines(whole, "-"))
        exact = let(_hunks(section), lambda h: both(_changed_lines(h, "+"), _changed_lines(h, "-")))
        return F.when(b.rlike(HUNK_NUMBERS) & ~b.rlike(INDENTED_SIGN), lean).otherwise(exact)

    none = _is_binary(section) | ~_has_line(section, "@@ -")
    return F.when(none, both(F.lit(0), F.lit(0))).otherwise(let(body, plain))


def _file_of(section: Column, with_hunks: bool) -> Column:
    parts = {
        "header_path": first_group(section, FILE_HEADER, 2),
        "change_type": _change_type(section),
        "is_binary": _is_binary(section),
        "from_path": _rest_of_line(section, RENAME_FROM),
        "to_path": _rest_of_line(section, RENAME_TO),
        "counts": _counts(section),
    }
    if with_hunks:
        none = _is_binary(section) | ~_has_line(section, "@@ -")
        parts["hunks"] = F.when(none, _no_hunks()).otherwise(_hunks(section))

    def build(f: Column) -> Column:
        moved = (f["change_type"] == "renamed") & f["from_path"].isNotNull() & f["to_path"].isNotNull()
        has_header = f["header_path"].isNotNull()
        return F.struct(
            F.when(has_header & moved, f["to_path"]).otherwise(f["header_path"]).alias("path"),
            f["change_type"].alias("change_type"),
            F.when(moved, f["from_path"]).alias("old_path"),
            f["is_binary"].alias("is_binary"),
            f["counts"]["additions"].alias("additions"),
            f["counts"]["deletions"].alias("deletions"),
            *([f["hunks"].alias("hunks")] if with_hunks else []),
            F.when(~has_header, NO_HEADER).alias("parse_error"),
        )

    return let(F.struct(*[c.alias(name) for name, c in parts.items()]), build)


def file_diffs_of(raw: Column, with_hunks: bool = True) -> Column:
    """``ARRAY<STRUCT>`` of the files in a diff; preamble dropped, empty for a blank diff."""
    return F.transform(_sections(raw), lambda section: _file_of(section, with_hunks))


def file_diffs(diffs: DataFrame, with_hunks: bool = True) -> DataFrame:
    """One row per file of a diff."""
    return explode_items(
        diffs, ["repo_id", "diff_id"], file_diffs_of(F.col("raw"), with_hunks), "file_idx", "f"
    ).select("repo_id", "diff_id", "file_idx", "f.*")


def hunks(diffs: DataFrame) -> DataFrame:
    """One row per hunk."""

    def build(section: Column) -> Column:
        header, move = first_group(section, FILE_HEADER, 2), _rest_of_line(section, RENAME_TO)
        moved = (_change_type(section) == "renamed") & _rest_of_line(section, RENAME_FROM).isNotNull() & move.isNotNull()
        none = _is_binary(section) | ~_has_line(section, "@@ -")
        return F.struct(
            F.when(header.isNotNull() & moved, move).otherwise(header).alias("path"),
            F.when(none, _no_hunks()).otherwise(_hunks(section)).alias("hunks"),
        )

    files = explode_items(diffs, ["diff_id"], F.transform(_sections(F.col("raw")), build), "file_idx", "f")
    files = files.select("diff_id", "file_idx", "f.*")
    return explode_items(files, ["diff_id", "file_idx", "path"], F.col("hunks"), "hunk_idx", "h").select(
        "diff_id", "file_idx", "path", "hunk_idx", "h.*"
    )


def line_totals(raw: Column) -> Column:
    """``files_changed, total_additions, total_deletions`` of a diff, from its lines alone."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("files_changed"), zero.alias("total_additions"), zero.alias("total_deletions"))

    def add(total: Column, section: Column) -> Column:
        return let(
            _counts(section),
            lambda c: F.struct(
                (total["files_changed"] + 1).alias("files_changed"),
                (total["total_additions"] + c["additions"]).alias("total_additions"),
                (total["total_deletions"] + c["deletions"]).alias("total_deletions"),
            ),
        )

    return F.aggregate(_sections(raw), start, add)


def diff_stats(diffs: DataFrame) -> DataFrame:
    """Totals per diff, computed in the row."""
    return diffs.select("diff_id", line_totals(F.col("raw")).alias("s")).select("diff_id", "s.*")


def rebuilt_text(files: Column) -> Column:
    """Diff text from the parsed hunks, for diffs whose raw text is not kept."""

    def hunk_lines(h: Column) -> Column:
        header = F.format_string(
            "@@ -%d,%d +%d,%d @@", h["old_start"], h["old_count"], h["new_start"], h["new_count"]
        )
        return F.array(header, h["content"])

    def file_lines(f: Column) -> Column:
        heads = F.array(F.concat(F.lit("--- a/"), f["path"]), F.concat(F.lit("+++ b/"), f["path"]))
        return F.concat(heads, F.flatten(F.transform(f["hunks"], hunk_lines)))

    readable = F.filter(files, lambda f: f["parse_error"].isNull())
    return F.array_join(F.flatten(F.transform(readable, file_lines)), "\n")
