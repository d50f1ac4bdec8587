"""Repository statistics: files, languages, lines, recent commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.functions.languages import stats_language
from corpusgauge.functions.numbers import one_decimal
from corpusgauge.functions.paths import TRACKED_EXCLUDES, tracked_excluded
from corpusgauge.functions.templates import fill
from corpusgauge.functions.text import iterated_lines, strip, universal_newlines

RECENT_COMMITS = 10
NO_COMMITS = "No commits found."  # fixed value


def file_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.count("*").alias("files"))


def language_files(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id", stats_language(F.col("path")).alias("language")).agg(
        F.count("*").alias("files")
    )


def _lines(content: Column) -> Column:
    return iterated_lines(universal_newlines(content)).cast("bigint")


def repo_totals(files: DataFrame, excludes: Sequence[str] = TRACKED_EXCLUDES) -> DataFrame:
    """Totals after excludes; a repository with nothing left keeps a zero row."""
    kept = ~tracked_excluded(F.col("path"), excludes)
    return files.groupBy("repo_id").agg(
        F.count_if(kept).alias("total_files"),
        F.coalesce(F.sum(F.when(kept, _lines(F.col("content")))), F.lit(0)).alias("total_lines"),
    )


def _per_language(files: DataFrame, excludes: Sequence[str]) -> DataFrame:
    """Sums per repository and language; languages left without a file have ``files`` 0."""
    kept = ~tracked_excluded(F.col("path"), excludes)
    # The smallest path makes this a sort-based aggregate.  Lines are counted in a step of
    # their own, and used twice so that it stays one: the sort then carries narrow rows
    # and no contents.
    narrow = files.select(
        "repo_id",
        stats_language(F.col("path")).alias("language"),
        F.when(kept, F.col("path")).alias("kept_path"),
        F.when(kept, F.coalesce(_lines(F.col("content")), F.lit(0))).alias("kept_lines"),
    )
    per_language = narrow.groupBy("repo_id", "language").agg(
        F.count("kept_lines").alias("files"),
        F.coalesce(F.sum("kept_lines"), F.lit(0)).alias("lines"),
        F.min("kept_path").alias("first_path"),
    )
    repo = Window.partitionBy("repo_id")
    total = F.sum("lines").over(repo)
    share = F.when(total > 0, F.col("lines") / total * 100).otherwise(0.0)
    # ties keep the order in which the languages are first seen in the sorted file list
    ranked = repo.orderBy(F.desc("percentage"), F.asc_nulls_last("first_path"))
    return (
        per_language.withColumn("percentage", share)
        .withColumn("language_rank", F.row_number().over(ranked))
        .drop("first_path")
    )


def language_stats(files: DataFrame, excludes: Sequence[str] = TRACKED_EXCLUDES) -> DataFrame:
    """Files, lines, share and rank per language.

    One shuffle of per-language partial sums; the share is a window over the
    aggregate, at most one row per known language in each repository.
    """
    return _per_language(files, excludes).filter("files > 0")


def commit_log(commits: DataFrame) -> DataFrame:
    return commits.select(
        "repo_id",
        "hash",
        F.left("hash", F.lit(7)).alias("short_hash"),
        strip(F.col("message")).alias("message"),
        "author",
        "date",
    )


def recent_commits(commits: DataFrame, count: int = RECENT_COMMITS) -> DataFrame:
    """Newest commits per repository.

    Catalyst puts a group limit below the shuffle, so of a repository with a third
    of all commits each task passes on ``count`` rows at most.
    """
    newest = Window.partitionBy("repo_id").orderBy(F.desc("date"), "hash")
    return (
        commit_log(commits)
        .withColumn("commit_rank", F.row_number().over(newest))
        .filter(F.col("commit_rank") <= count)
    )


def displayed_commits(recent: DataFrame, shown: int = 5, width: int = 60) -> DataFrame:
    """The commits a report shows, messages cut to the display width."""
    return recent.filter(F.col("commit_rank") <= shown).select(
        "repo_id",
        "commit_rank",
        "short_hash",
        F.left("message", F.lit(width)).alias("message"),
        "author",
        F.date_format("date", "yyyy-MM-dd").alias("day"),
    )


def repo_overview(
    files: DataFrame, commits: DataFrame, excludes: Sequence[str] = TRACKED_EXCLUDES
) -> DataFrame:
    """One row per repository: totals, ranked languages, recent commits.

    The totals are sums over the same per-language rows, so the contents are read
    once; both lists are bounded (known languages, ten commits).
    """
    listed = F.struct("language_rank", "language", "files", "lines", "percentage")
    by_repo = (
        _per_language(files, excludes)
        .groupBy("repo_id")
        .agg(
            F.sum("files").alias("total_files"),
            F.sum("lines").alias("total_lines"),
            F.array_sort(F.collect_list(F.when(F.col("files") > 0, listed))).alias("languages"),
        )
    )
    entry = F.struct("commit_rank", "hash", "short_hash", "message", "author", "date")
    logs = (
        recent_commits(commits)
        .groupBy("repo_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("recent_commits"))
    )
    none = F.array().cast(logs.schema["recent_commits"].dataType)
    return by_repo.join(logs, "repo_id", "left").withColumn(
        "recent_commits", F.coalesce("recent_commits", none)
    )


def languages_text(languages: Column) -> Column:
    """``Python: 45.2%, Go: 30.1%``"""
    return F.array_join(
        F.transform(
            languages,
            lambda s: F.concat(s["language"], F.lit(": "), one_decimal(s["percentage"]), F.lit("%")),
        ),
        ", ",
    )


def commits_text(commits: Column) -> Column:
    """``- [abc1234] 2024-01-01: message`` per commit."""
    lines = F.transform(
        commits,
        lambda c: F.concat(
            F.lit("- ["), c["short_hash"], F.lit("] "),
            F.date_format(c["date"], "yyyy-MM-dd"), F.lit(": "), c["message"],
        ),
    )
    return F.when(F.size(commits) == 0, NO_COMMITS).otherwise(F.array_join(lines, "\n"))


def repo_prompts(overview: DataFrame) -> DataFrame:
    return overview.select(
        "repo_id",
        fill(
            "repo",
            {
                "total_files": F.col("total_files"),
                "total_lines": F.col("total_lines"),
                "languages": languages_text(F.col("languages")),
                "recent_commits": commits_text(F.col("recent_commits")),
            },
        ).alias("prompt"),
    )
