"""Quality scan: complexity, line-numbered issues, long functions, score and report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions import rules as R
from corpusgauge.functions.languages import code_language
from corpusgauge.functions.numbers import one_decimal
from corpusgauge.functions.paths import quality_excluded, quality_excluded_by
from corpusgauge.functions.regex import java_regex
from corpusgauge.functions.rows import explode_items
from corpusgauge.functions.text import (
    count_matches,
    folded,
    has_any,
    has_marks,
    let,
    mark_matches,
    marked_lines,
    match_lines,
    newline_count,
    split_lines,
    universal_newlines,
)

MAX_FILE_SIZE_KB = 500


def within_cap(size_bytes: Column, max_kb: int = MAX_FILE_SIZE_KB) -> Column:
    return size_bytes <= max_kb * 1024


def scoped(
    files: DataFrame,
    excludes: Sequence[str] = (),
    max_kb: int = MAX_FILE_SIZE_KB,
    filtered: bool = True,
) -> DataFrame:
    """Adds ``in_scope``, ``language`` and the ``text`` the rules see.

    ``filtered=False`` takes every file as it comes, the way a file that is named
    itself is analysed: no excludes, and any kind of file.

    Rows are not filtered: a repository without a file in scope still gets its
    report.  Out-of-scope and oversize files have the text '', which costs nothing.

    Files that went through ``resolve_settings`` bring their excludes and size limit.
    """
    language = code_language(F.col("path"))
    if "name_regexes" in files.columns:
        excluded = quality_excluded_by(F.col("path"), F.col("analyze.exclude_patterns"), F.col("name_regexes"))
        cap = F.col("size_bytes") <= F.col("analyze.max_file_size_kb") * 1024
    else:
        excluded, cap = quality_excluded(F.col("path"), excludes), within_cap(F.col("size_bytes"), max_kb)
    kept = ~excluded & (language != "Unknown")
    in_scope = kept if filtered else F.lit(True)
    return (
        files.withColumn("language", language)
        .withColumn("in_scope", in_scope)
        .withColumn(
            "text",
            F.when(
                F.col("in_scope") & cap,
                universal_newlines(F.col("content")),
            ).otherwise(F.lit("")),
        )
        .drop("content", "analyze", "name_regexes")
    )


def complexity_of(text: Column) -> dict[str, Column]:
    """Matches per category."""
    return {name: count_matches(text, p) for name, p in R.complexity_patterns().items()}


def total_complexity(text: Column) -> Column:
    """1 plus all matches; 0 for an empty file.  One pass over the text."""
    matches = count_matches(text, R.total_complexity_pattern())
    return F.when(text == "", F.lit(0)).otherwise(matches + 1)


def function_extents(text: Column, language: Column) -> Column:
    """``ARRAY<STRUCT<line, name, lines>>``: each header with the span up to the next one.

    The span is counted from the line where the header match starts, which includes
    blank lines above it, to the start of the next match or the end of the text.
    """

    by_pattern: dict[str, list[str]] = {}
    for name, header in R.FUNCTION_HEADERS.items():
        by_pattern.setdefault(header, []).append(name)

    def per_language(build: Callable[[str, bool], Column]) -> Column:
        chain: Column | None = None
        for header, names in by_pattern.items():
            value = build(java_regex(header, multiline=True), names[0] in R.TWO_GROUP_HEADERS)
            test = language.isin(*names) & has_any(text, R.HEADER_NEEDS[names[0]])
            chain = F.when(test, value) if chain is None else chain.when(test, value)
        return chain

    def names_in(pattern: str, two_groups: bool) -> Column:
        if not two_groups:
            return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda header: F.coalesce(
                F.nullif(F.regexp_extract(header, pattern, 1), F.lit("")),
                F.regexp_extract(header, pattern, 2),
            ),
        )

    def spans(m: Column) -> Column:
        return F.transform(
            m["starts"],
            lambda line, i: F.struct(
                line.alias("line"),
                F.get(m["names"], i).alias("name"),
                (F.coalesce(F.get(m["starts"], i + 1), m["end"]) - line + 1).alias("lines"),
            ),
        )

    def located(marked: Column) -> Column:
        facts = F.struct(
            marked_lines(marked).alias("starts"),
            per_language(names_in).alias("names"),
            (newline_count(text) + 1).alias("end"),
        )
        # names are looked for only in files that have a header at all
        return F.when(has_marks(marked), let(facts, spans))

    marked = per_language(lambda pattern, _: mark_matches(text, pattern))
    return F.coalesce(
        F.when(language.isin(*R.FUNCTION_HEADERS), let(marked, located)),
        F.array().cast("array<struct<line:int,name:string,lines:int>>"),
    )


def long_functions_of(extents: Column) -> Column:
    return F.filter(extents, lambda f: (f["lines"] > R.LONG_FUNCTION_LINES) & (f["name"] != ""))


def _may_hit(text: Column, in_lower_case: Column, rule: R.Rule) -> Column:
    """A cheap test that spares most texts the search."""
    found = F.lit(True)
    if rule.needs:
        found = found & has_any(text, rule.needs)
    if rule.needs_folded:
        found = found & has_any(in_lower_case, rule.needs_folded)
    return found


def _with_folded(scope: DataFrame, rules: Sequence[R.Rule]) -> DataFrame:
    """Adds ``folded``, made once for all rules that look into it."""
    asked = any(rule.needs_folded for rule in rules)
    return scope.withColumn("folded", folded(F.col("text")) if asked else F.lit(""))


def issues_of(
    text: Column, in_lower_case: Column, extents: Column, rules: Sequence[R.Rule] = R.RULES
) -> Column:
    """All issues of a file in rule order, then position, long functions last."""
    no_lines = F.array().cast("array<int>")

    def by_rule(rule: R.Rule) -> Column:
        return F.transform(
            F.when(_may_hit(text, in_lower_case, rule), match_lines(text, rule.java)).otherwise(no_lines),
            lambda line: F.struct(
                line.alias("line"),
                F.lit(rule.issue_type).alias("issue_type"),
                F.lit(rule.message).alias("message"),
                F.lit(rule.severity).alias("severity"),
            ),
        )

    long_ones = F.transform(
        long_functions_of(extents),
        lambda f: F.struct(
            f["line"].alias("line"),
            F.lit("long_function").alias("issue_type"),
            F.format_string(
                f"Function '%s' has %d lines (threshold: {R.LONG_FUNCTION_LINES})",
                f["name"],
                f["lines"],
            ).alias("message"),
            F.lit(R.WARNING).alias("severity"),
        ),
    )
    return F.flatten(F.array(*[by_rule(r) for r in rules], long_ones))


def file_extents(files: DataFrame, excludes: Sequence[str] = ()) -> DataFrame:
    """One row per function header."""
    extents = function_extents(F.col("text"), F.col("language"))
    return explode_items(
        scoped(files, excludes), ["repo_id", "path"], extents, "function_idx", "f"
    ).select("repo_id", "path", "function_idx", "f.line", "f.name", "f.lines")


def _metric_columns(rules: Sequence[R.Rule]) -> list[Column]:
    """Counting needs no positions, so no marked copy of the text is made here."""
    text = F.col("text")
    long_ones = F.size(long_functions_of(function_extents(text, F.col("language"))))

    def severity_count(severity: str) -> Column:
        total = long_ones if severity == R.WARNING else F.lit(0)
        for rule in rules:
            if rule.severity == severity:
                may_hit = _may_hit(text, F.col("folded"), rule)
                total = total + F.when(may_hit, count_matches(text, rule.java)).otherwise(0)
        return total.cast("bigint")

    return [
        F.col("repo_id"),
        F.col("path"),
        F.col("language"),
        F.col("in_scope"),
        split_lines(text).cast("bigint").alias("lines"),
        total_complexity(text).cast("bigint").alias("complexity"),
        severity_count(R.ERROR).alias("errors"),
        severity_count(R.WARNING).alias("warnings"),
        severity_count(R.INFO).alias("infos"),
    ]


def file_metrics(
    files: DataFrame,
    excludes: Sequence[str] = (),
    max_kb: int = MAX_FILE_SIZE_KB,
    rules: Sequence[R.Rule] = R.RULES,
    filtered: bool = True,
) -> DataFrame:
    """One narrow row per file: lines, complexity and issue counts by severity."""
    return _with_folded(scoped(files, excludes, max_kb, filtered), rules).select(*_metric_columns(rules))


def file_results(
    files: DataFrame,
    excludes: Sequence[str] = (),
    max_kb: int = MAX_FILE_SIZE_KB,
    rules: Sequence[R.Rule] = R.RULES,
    filtered: bool = True,
) -> DataFrame:
    """Metrics and issues (``found``) of every file, for jobs that need both."""
    extents = function_extents(F.col("text"), F.col("language"))
    found = issues_of(F.col("text"), F.col("folded"), extents, rules)
    located = _with_folded(scoped(files, excludes, max_kb, filtered), rules).select(
        "repo_id",
        "path",
        "language",
        "in_scope",
        split_lines(F.col("text")).cast("bigint").alias("lines"),
        total_complexity(F.col("text")).cast("bigint").alias("complexity"),
        found.alias("found"),
    )

    def count(severity: str) -> Column:
        return F.size(F.filter("found", lambda i: i["severity"] == severity)).cast("bigint")

    return located.select(
        "*",
        count(R.ERROR).alias("errors"),
        count(R.WARNING).alias("warnings"),
        count(R.INFO).alias("infos"),
    )


def exploded(found: DataFrame) -> DataFrame:
    """One row per issue of ``found``."""
    return explode_items(
        found, ["repo_id", "path"], F.col("found"), "issue_idx", "issue"
    ).select("repo_id", "path", "issue_idx", "issue.*")


def issues(
    files: DataFrame,
    excludes: Sequence[str] = (),
    max_kb: int = MAX_FILE_SIZE_KB,
    rules: Sequence[R.Rule] = R.RULES,
    with_functions: bool = True,
    filtered: bool = True,
) -> DataFrame:
    """One row per issue.  The text never leaves its scan stage."""
    language = F.col("language") if with_functions else F.lit("Unknown")
    extents = function_extents(F.col("text"), language)
    found = issues_of(F.col("text"), F.col("folded"), extents, rules)
    return exploded(
        _with_folded(scoped(files, excludes, max_kb, filtered).filter("in_scope"), rules)
        .select("repo_id", "path", found.alias("found"))
    )


def repo_metrics(metrics: DataFrame) -> DataFrame:
    """Per-repository sums; combined on the map side, so a huge repository is no hot spot."""
    return metrics.groupBy("repo_id").agg(
        F.count_if("in_scope").alias("files_analyzed"),
        F.sum("lines").alias("total_lines"),
        F.sum("complexity").alias("complexity"),
        F.sum("errors").alias("errors"),
        F.sum("warnings").alias("warnings"),
        F.sum("infos").alias("infos"),
    )


def quality_score(
    complexity: Column, lines: Column, errors: Column, warnings: Column, infos: Column
) -> Column:
    per_line = complexity / F.when(lines != 0, lines)
    for_complexity = F.when(
        per_line > 0.5, F.least(F.lit(20.0), (per_line - 0.5) * 40)
    ).otherwise(0.0)
    score = 100.0 - for_complexity - errors * 5 - warnings * 2 - infos * 0.5
    return F.when(lines == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "Excellent")
        .when(score >= 75, "Good")
        .when(score >= 60, "Fair")
        .when(score >= 40, "Needs Improvement")
        .otherwise("Poor")
    )


def with_score(totals: DataFrame) -> DataFrame:
    score = quality_score(*[F.col(c) for c in ("complexity", "total_lines", "errors", "warnings", "infos")])
    return totals.withColumn("score", score).withColumn("grade", grade(F.col("score")))


def quality_report(totals: DataFrame) -> DataFrame:
    """Report row per repository.  ``complexity_score`` is the plain complexity sum."""
    found = F.col("errors") + F.col("warnings") + F.col("infos")
    # Wording of the report.
    summary = F.concat_ws(
        "\n",
        F.concat(
            F.lit("Quality Score: "), one_decimal(F.col("score")), F.lit("/100 ("), "grade", F.lit(")")
        ),
        F.format_string("Files Analyzed: %d", "files_analyzed"),
        F.format_string(
            "Issues Found: %d total (%d errors, %d warnings, %d info)",
            found, "errors", "warnings", "infos",
        ),
        F.when(
            F.col("errors") > 0,
            "\nCritical issues require immediate attention, "
            "particularly potential security concerns.",
        ),
        F.when(
            F.col("warnings") > 5,
            "\nConsider addressing the warnings to improve code maintainability.",
        ),
    )
    return with_score(totals).select(
        "repo_id",
        "files_analyzed",
        "total_lines",
        F.col("complexity").cast("double").alias("complexity_score"),
        F.round("score", 6).alias("score"),
        "grade",
        "errors",
        "warnings",
        "infos",
        summary.alias("summary"),
    )
