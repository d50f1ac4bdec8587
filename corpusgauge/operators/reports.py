"""Markdown reports.

Reports of bounded length (a repository summary, a review, a file explanation) are
one text per row, put together from columns of that row.  A quality report lists
every issue of a repository, so it stays a table of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.numbers import grouped, one_decimal
from corpusgauge.functions.paths import file_name
from corpusgauge.operators.quality import quality_report, repo_metrics
from corpusgauge.operators.reviews import _shown


def _lines(*lines: Column | str) -> Column:
    return F.array(*[F.lit(line) if isinstance(line, str) else line for line in lines])


def _block(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(F.array().cast("array<string>"))


def _text(*blocks: Column) -> Column:
    return F.array_join(F.concat(*blocks), "\n")


def _str(value: Column) -> Column:
    return value.cast("string")


def repo_markdown(overview: DataFrame, shown_commits: int = 5) -> DataFrame:
    """The layout of the repository summary."""
    language_rows = F.transform(
        "languages",
        lambda s: F.concat(
            F.lit("| "), s["language"], F.lit(" | "), _str(s["files"]), F.lit(" | "),
            grouped(s["lines"]), F.lit(" | "), one_decimal(s["percentage"]), F.lit("% |"),
        ),
    )
    commit_rows = F.transform(
        F.slice("recent_commits", 1, shown_commits),
        lambda c: F.concat(
            F.lit("- `"), c["short_hash"], F.lit("` "), c["message"], F.lit(" (*"), c["author"],
            F.lit(", "), F.date_format(c["date"], "yyyy-MM-dd"), F.lit("*)"),
        ),
    )
    summary = F.col("summary") if "summary" in overview.columns else F.lit("")
    location = F.col("location") if "location" in overview.columns else F.col("repo_id")
    text = _text(
        _lines(
            F.concat(F.lit("# "), F.col("repo_id")), "",
            F.concat(F.lit("> "), location), "",
            "## Statistics", "",
            F.concat(F.lit("- **Total Files**: "), _str(F.col("total_files"))),
            F.concat(F.lit("- **Total Lines**: "), grouped(F.col("total_lines"))), "",
        ),
        _block(
            F.size("languages") > 0,
            F.concat(
                _lines(
                    "## Languages", "",
                    "| Language | Files | Lines | Percentage |",
                    "|----------|-------|-------|------------|",
                ),
                language_rows,
                _lines(""),
            ),
        ),
        _block(
            F.size("recent_commits") > 0,
            F.concat(_lines("## Recent Commits", ""), commit_rows, _lines("")),
        ),
        _block(summary != "", _lines("## Summary", "", summary, "")),
    )
    return overview.select("repo_id", text.alias("report"))


def _comment_lines(c: Column) -> Column:
    place = F.concat(F.lit("`"), _shown(c["file"]), F.lit("`"))
    line = F.coalesce(c["line"], F.lit(0))
    place = F.when(line != 0, F.concat(place, F.lit(" (line "), _str(line), F.lit(")"))).otherwise(place)
    suggestion = F.coalesce(c["suggestion"], F.lit(""))
    return F.concat(
        _lines(
            F.concat(F.lit("- **["), F.upper(c["severity"]), F.lit("]** "), place),
            F.concat(F.lit("  - "), _shown(c["message"])),
        ),
        _block(suggestion != "", _lines(F.concat(F.lit("  - *Suggestion*: "), suggestion))),
        _lines(""),
    )


def agent_review_markdown(review: Column) -> Column:
    """The layout of one reviewer's section."""
    return _text(
        _lines(
            F.concat(F.lit("### "), review["agent_name"]), "",
            F.concat(F.lit("*"), _str(F.size(review["comments"])), F.lit(" comments*")), "",
        ),
        F.flatten(F.transform(review["comments"], _comment_lines)),
        _block(
            review["summary"] != "",
            _lines(F.concat(F.lit("**Summary**: "), review["summary"]), ""),
        ),
    )


def review_markdown(results: DataFrame) -> DataFrame:
    """The layout of a review report."""
    stats = F.col("diff_summary")
    severity_rows = F.transform(
        F.map_entries("by_severity"),
        lambda e: F.concat(
            F.lit("- **"), F.upper(e["key"]), F.lit("** ["),
            F.when(e["key"] == "error", "X").when(e["key"] == "warning", "!").otherwise("i"),
            F.lit("]: "), _str(e["value"]),
        ),
    )
    text = _text(
        _lines(
            "# Code Review Results", "", "## Diff Statistics", "",
            F.concat(F.lit("- **Files Changed**: "), _str(stats["files_changed"])),
            F.concat(F.lit("- **Additions**: +"), _str(stats["total_additions"])),
            F.concat(F.lit("- **Deletions**: -"), _str(stats["total_deletions"])), "",
        ),
        _block(
            F.size("by_severity") > 0,
            F.concat(_lines("## Issues by Severity", ""), severity_rows, _lines("")),
        ),
        F.transform("agent_reviews", agent_review_markdown),
        _block(F.col("summary") != "", _lines("## Overall Summary", "", F.col("summary"), "")),
    )
    return results.select("diff_id", text.alias("report"))


def explanation_markdown(explanations: DataFrame) -> DataFrame:
    """The layout of a file explanation."""
    text = _text(
        _lines(
            F.concat(F.lit("# "), file_name(F.col("path"))), "",
            F.concat(F.lit("> "), F.col("path")), "",
            F.concat(F.lit("- **Language**: "), F.col("language")),
            F.concat(F.lit("- **Lines**: "), _str(F.col("lines"))), "",
            "## Purpose", "", F.col("purpose"), "",
        ),
        _block(
            F.size("key_elements") > 0,
            F.concat(
                _lines("## Key Elements", ""),
                F.transform("key_elements", lambda e: F.concat(F.lit("- "), e)),
                _lines(""),
            ),
        ),
        _lines("## Explanation", "", F.col("explanation"), ""),
    )
    return explanations.select("repo_id", "path", text.alias("report"))


def quality_markdown(metrics: DataFrame, issues: DataFrame) -> DataFrame:
    """``repo_id, section, path, line_idx, line``: a quality report as lines.

    Fixed values: the layout.  Every part is made row by row; no list of a whole
    repository's issues is ever built.
    """
    reports = quality_report(repo_metrics(metrics))
    has_issues = F.col("errors") + F.col("warnings") + F.col("infos") > 0

    def part(section: int, lines: Column) -> Column:
        return F.transform(
            lines,
            lambda line, i: F.struct(
                F.lit(section).alias("section"),
                F.lit("").alias("path"),
                i.alias("line_idx"),
                line.alias("line"),
            ),
        )

    head = _lines(
        "# Quality Report", "",
        F.concat(
            F.lit("**Complexity Score**: "),
            _str(F.col("complexity_score").cast("bigint")),
            F.lit(".0"),
        ), "",
    )
    table_head = _lines(
        "## Issues", "",
        "| File | Line | Type | Severity | Message |",
        "|------|------|------|----------|---------|",
    )
    frame = reports.select(
        "repo_id",
        F.inline(
            F.concat(
                part(0, head),
                part(1, _block(has_issues, table_head)),
                part(3, _block(has_issues, _lines(""))),
                part(4, _lines("## Summary", "", F.col("summary"), "")),
            )
        ),
    )
    shown_line = F.when(F.coalesce("line", F.lit(0)) != 0, _str(F.col("line"))).otherwise("-")
    rows = issues.select(
        "repo_id",
        F.lit(2).alias("section"),
        "path",
        F.col("issue_idx").alias("line_idx"),
        F.concat(
            F.lit("| "), "path", F.lit(" | "), shown_line, F.lit(" | "), "issue_type",
            F.lit(" | "), "severity", F.lit(" | "), "message", F.lit(" |"),
        ).alias("line"),
    )
    return frame.unionByName(rows)
