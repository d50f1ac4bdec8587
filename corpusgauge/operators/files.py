"""File-level projections and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions import languages, paths
from corpusgauge.functions.numbers import kilobytes
from corpusgauge.functions.text import iterated_lines, split_lines, universal_newlines
from corpusgauge.operators.quality import MAX_FILE_SIZE_KB, within_cap


def name_and_suffix(files: DataFrame) -> DataFrame:
    return files.select(
        "repo_id",
        "path",
        paths.file_name(F.col("path")).alias("name"),
        paths.suffix(F.col("path")).alias("suffix"),
    )


def detected_languages(files: DataFrame) -> DataFrame:
    """The three language variants side by side."""
    return files.select(
        "repo_id",
        "path",
        languages.code_language(F.col("path")).alias("code_language"),
        languages.stats_language(F.col("path")).alias("stats_language"),
        languages.explain_language(F.col("path")).alias("explain_language"),
    )


def tracked(files: DataFrame, excludes: Sequence[str] = paths.TRACKED_EXCLUDES) -> DataFrame:
    return files.filter(~paths.tracked_excluded(F.col("path"), excludes))


def quality_scope(files: DataFrame, excludes: Sequence[str] = ()) -> DataFrame:
    return files.filter(~paths.quality_excluded(F.col("path"), excludes))


def code_only(files: DataFrame) -> DataFrame:
    return files.filter(languages.code_language(F.col("path")) != "Unknown")


def structure_scope(files: DataFrame, excludes: Sequence[str] = ()) -> DataFrame:
    return files.filter(~paths.structure_excluded(F.col("path"), excludes))


def visible(files: DataFrame) -> DataFrame:
    return files.filter(~paths.hidden(F.col("path")))


def line_counts(files: DataFrame) -> DataFrame:
    """Both line counts: by iteration and by ``splitlines``."""
    return files.select(
        "repo_id", "path", universal_newlines(F.col("content")).alias("text")
    ).select(
        "repo_id",
        "path",
        iterated_lines(F.col("text")).cast("bigint").alias("lines"),
        split_lines(F.col("text")).cast("bigint").alias("split_lines"),
    )


def by_size(files: DataFrame, max_kb: int = MAX_FILE_SIZE_KB) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: the comparison stays on the bare column, so it is pushed down."""
    cap = within_cap(F.col("size_bytes"), max_kb)
    return files.filter(cap), files.filter(~cap)


def rejection_message(size_bytes: Column, max_kb: int = MAX_FILE_SIZE_KB) -> Column:
    return F.concat(F.lit("file size "), kilobytes(size_bytes), F.lit(f"KB is over the limit of {max_kb}KB"))


def resolve_settings(
    files: DataFrame, settings: DataFrame, base_excludes: Sequence[str], base_max_kb: int
) -> DataFrame:
    """Attach each repository's analyze section, or the base section as a whole.

    ``name_regexes`` holds the section's globs as regexes, made on the settings side.

    The settings side carries no broadcast hint: its size grows with the number of
    repositories, so Catalyst decides by ``autoBroadcastJoinThreshold``, and beyond
    that a sort-merge join runs, where AQE splits the partition of a huge repository
    (the files side of a left join may be split).
    """
    base = F.struct(
        F.array(*[F.lit(p) for p in base_excludes]).alias("exclude_patterns"),
        F.lit(base_max_kb).alias("max_file_size_kb"),
    )
    own = settings.filter("analyze IS NOT NULL").select(
        "repo_id", "analyze", paths.name_regexes(F.col("analyze.exclude_patterns")).alias("name_regexes")
    )
    globs = [f"(?s)^(?:{paths.glob_regex(p)})\\z" for p in base_excludes]
    base_regexes = F.array(*[F.lit(g) for g in globs]).cast("array<string>")
    return (
        files.join(own, "repo_id", "left")
        .withColumn("name_regexes", F.when(F.col("analyze").isNull(), base_regexes).otherwise(F.col("name_regexes")))
        .withColumn("analyze", F.coalesce("analyze", base))
    )


def scoped_by_settings(resolved: DataFrame) -> DataFrame:
    """Files each repository's own settings let through, and whether they are read."""
    return resolved.filter(
        ~paths.quality_excluded_by(F.col("path"), F.col("analyze.exclude_patterns"), F.col("name_regexes"))
    ).select(
        "repo_id",
        "path",
        F.col("analyze.max_file_size_kb").alias("max_file_size_kb"),
        (F.col("size_bytes") <= F.col("analyze.max_file_size_kb") * 1024).alias("is_read"),
    )
