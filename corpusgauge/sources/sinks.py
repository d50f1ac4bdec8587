"""Report sinks: JSON lines and Markdown texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from corpusgauge.operators.positions import LINES_PER_FILE, packed_index, packed_lines
from corpusgauge.session import stored


def report_json(reports: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, report)``: each row as one JSON text, nulls kept."""
    body = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return reports.select(*keys, body.alias("report"))


def iso_timestamp(value: Column, with_zone: bool) -> Column:
    """ISO-8601 with offset; a time without a zone is in UTC."""
    offset = F.date_format(value, "xxx") if with_zone else F.lit("+00:00")
    micros = F.date_format(value, "SSSSSS")
    fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
    return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), fraction, offset)


def _fields(entry: Column, *names: str) -> list[Column]:
    return [entry[n].alias(n) for n in names]


def repository_form(overview: DataFrame) -> DataFrame:
    """The fields of a repository report; ranks and working columns are left out."""
    kind = overview.schema["recent_commits"].dataType.elementType["date"].dataType

    def commit(c: Column) -> Column:
        date = iso_timestamp(c["date"], isinstance(kind, TimestampType)).alias("date")
        return F.struct(*_fields(c, "hash", "short_hash", "message", "author"), date)

    language = lambda s: F.struct(
        *_fields(s, "language", "files", "lines"), F.round(s["percentage"], 6).alias("percentage")
    )
    summary = F.coalesce("summary", F.lit("")) if "summary" in overview.columns else F.lit("")
    return overview.select(
        "repo_id",
        F.struct(
            F.col("repo_id").alias("path"),
            F.col("repo_id").alias("name"),
            "total_files",
            "total_lines",
            F.transform("languages", language).alias("languages"),
            F.transform("recent_commits", commit).alias("recent_commits"),
            summary.alias("summary"),
        ).alias("form"),
    )


def review_form(results: DataFrame) -> DataFrame:
    names = ("diff_summary", "agent_reviews", "total_comments", "by_severity", "summary")
    return results.select("diff_id", F.struct(*names).alias("form"))


def explanation_form(explanations: DataFrame) -> DataFrame:
    names = ("path", "language", "lines", "purpose", "key_elements", "explanation")
    return explanations.select("repo_id", "path", F.struct(*names).alias("form"))


def quality_form(reports: DataFrame, issues: DataFrame) -> DataFrame:
    """``repo_id, part, path, issue_idx, form``: a ``head`` row and a row for each issue.

    A repository may have any number of issues, so they stay rows; together with the
    head they are the report.
    """
    issue = F.struct("path", "line", "issue_type", "message", "severity")
    heads = reports.select(
        "repo_id",
        F.lit("head").alias("part"),
        F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("int").alias("issue_idx"),
        F.to_json(F.struct("complexity_score", "summary"), _KEEP_NULLS).alias("report"),
    )
    rows = issues.select("repo_id", F.lit("issue").alias("part"), "path", "issue_idx", F.to_json(issue, _KEEP_NULLS).alias("report"))
    return heads.unionByName(rows)


_KEEP_NULLS = {"ignoreNullFields": "false"}
_FORMS = {"repository": repository_form, "review": review_form, "explanation": explanation_form}


def json_reports(results: DataFrame, kind: str) -> DataFrame:
    """Keys and ``report``, the JSON text of a repository, review or explanation."""
    form = _FORMS[kind](results)
    keys = [c for c in form.columns if c != "form"]
    return form.select(*keys, F.to_json("form", _KEEP_NULLS).alias("report"))


def write_json(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    reports.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_markdown(texts: DataFrame, path: str, column: str, mode: str = "errorifexists") -> None:
    """One report text per row."""
    texts.select(F.col(column).alias("value")).write.mode(mode).text(path, lineSep="\n")


def write_packed_lines(
    lines: DataFrame, path: str, per_file: int = LINES_PER_FILE, mode: str = "errorifexists"
) -> None:
    """Quality reports in files of ``per_file`` lines below ``path/files``, with an index.

    Small repositories share a file and large ones go on in the next, so the number of files
    follows from the number of lines, not of repositories.  ``path/index`` is a Parquet
    table ``repo_id, file, first_line, n_lines``; file ``k`` is the one in ``file=k``.
    """
    packed = stored(packed_lines(lines, "repo_id", ["repo_id", "section", "path", "line_idx"], per_file), "packed")
    (
        packed.repartition("file")
        .sortWithinPartitions("file", "line_no")
        .select("file", F.col("line").alias("value"))
        .write.mode(mode)
        .partitionBy("file")
        .text(f"{path.rstrip('/')}/files", lineSep="\n")
    )
    packed_index(packed, "repo_id").write.mode(mode).parquet(f"{path.rstrip('/')}/index")


def write_report_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report kept as lines, one folder per repository.

    Lines are range-partitioned in report order, so a report of any length is spread
    over many tasks; its part files, taken by name, are the report.
    """
    order = ["repo_id", "section", "path", "line_idx"]
    (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("repo_id", F.col("line").alias("value"))
        .write.mode(mode)
        .partitionBy("repo_id")
        .text(path)
    )
