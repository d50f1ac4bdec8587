"""The registered queries: every operator over the whole fixture tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions import text as X
from corpusgauge.functions.paths import TRACKED_EXCLUDES
from corpusgauge.operators import agents as A
from corpusgauge.operators import diffs as D
from corpusgauge.operators import explain as E
from corpusgauge.operators import files as FL
from corpusgauge.operators import quality as Q
from corpusgauge.operators import replies as RP
from corpusgauge.operators import repo as RE
from corpusgauge.operators import reports as M
from corpusgauge.operators import reviews as RV
from corpusgauge.operators import structure as S
from corpusgauge.operators.positions import packed_index, packed_lines
from corpusgauge.session import stored
from corpusgauge.sources import bindings as B
from corpusgauge.sources.files import decoded, decoded_for_explain
from corpusgauge.sources.sinks import json_reports, quality_form

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SMALL_CAP_KB = 4  # a cap that some fixture files exceed


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _digest(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Long texts compared by length and hash."""
    return df.select(*keys, *_digest_columns(F.col(column), column))


def _digest_columns(text: Column, name: str) -> list[Column]:
    return [F.length(text).cast("bigint").alias(f"{name}_chars"), F.md5(text).alias(f"{name}_md5")]


# --- files -------------------------------------------------------------------


@query
def name_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return FL.name_and_suffix(B.files(spark, sf))


@query
def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    return FL.detected_languages(B.files(spark, sf))


@query
def tracked_files(spark: SparkSession, sf: str) -> DataFrame:
    return FL.tracked(B.files(spark, sf)).select("repo_id", "path")


@query
def exclude_quality(spark: SparkSession, sf: str) -> DataFrame:
    return FL.quality_scope(B.files(spark, sf)).select("repo_id", "path")


@query
def exclude_structure(spark: SparkSession, sf: str) -> DataFrame:
    return FL.structure_scope(B.files(spark, sf)).select("repo_id", "path")


@query
def visible_files(spark: SparkSession, sf: str) -> DataFrame:
    return FL.visible(B.files(spark, sf)).select("repo_id", "path")


@query
def code_files(spark: SparkSession, sf: str) -> DataFrame:
    return FL.code_only(B.files(spark, sf)).select("repo_id", "path")


@query
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return FL.line_counts(B.files(spark, sf))


@query
def size_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Oversize files count as analysed but bring no lines, complexity or issues."""
    metrics = Q.file_metrics(B.files(spark, sf), max_kb=SMALL_CAP_KB)
    return Q.repo_metrics(metrics)


@query
def rejected_files(spark: SparkSession, sf: str) -> DataFrame:
    return E.rejected_files(B.files(spark, sf), SMALL_CAP_KB)


def _binary_files(spark: SparkSession, sf: str) -> DataFrame:
    """Contents as bytes; of every third file in Latin-1 instead of UTF-8."""
    files = B.files(spark, sf)
    latin = F.encode("content", X.LATIN_1)
    return files.withColumn(
        "content",
        F.when(_latin1_row(), latin).otherwise(F.encode("content", "UTF-8")),
    )


def _latin1_row() -> Column:
    return F.length("path") % 3 == 0


@query
def decode_text(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(decoded(_binary_files(spark, sf)), "content", "repo_id", "path")


@query
def decode_explain(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(decoded_for_explain(_binary_files(spark, sf)), "content", "repo_id", "path")


@query
def settings_resolve(spark: SparkSession, sf: str) -> DataFrame:
    files = B.files(spark, sf).select("repo_id", "path", "size_bytes")
    resolved = FL.resolve_settings(
        files, B.settings(spark, sf), TRACKED_EXCLUDES, Q.MAX_FILE_SIZE_KB
    )
    return FL.scoped_by_settings(resolved)


# --- repository statistics -----------------------------------------------------


@query
def count_files(spark: SparkSession, sf: str) -> DataFrame:
    return RE.file_counts(B.files(spark, sf))


@query
def language_files(spark: SparkSession, sf: str) -> DataFrame:
    return RE.language_files(B.files(spark, sf))


def _language_stats(spark: SparkSession, sf: str) -> DataFrame:
    return RE.language_stats(B.files(spark, sf)).withColumn("percentage", F.round("percentage", 6))


@query
def language_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _language_stats(spark, sf).drop("language_rank")


@query
def language_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _language_stats(spark, sf).select("repo_id", "language_rank", "language", "percentage")


@query
def repo_totals(spark: SparkSession, sf: str) -> DataFrame:
    return RE.repo_totals(B.files(spark, sf))


@query
def commit_log(spark: SparkSession, sf: str) -> DataFrame:
    return _day(RE.commit_log(B.commits(spark, sf)))


def _day(commits: DataFrame) -> DataFrame:
    return commits.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query
def recent_commits(spark: SparkSession, sf: str) -> DataFrame:
    return _day(RE.recent_commits(B.commits(spark, sf)))


@query
def commit_display(spark: SparkSession, sf: str) -> DataFrame:
    return RE.displayed_commits(RE.recent_commits(B.commits(spark, sf)))


def _overview(spark: SparkSession, sf: str) -> DataFrame:
    return RE.repo_overview(B.files(spark, sf), B.commits(spark, sf))


@query
def fmt_languages(spark: SparkSession, sf: str) -> DataFrame:
    return _overview(spark, sf).select(
        "repo_id", RE.languages_text(F.col("languages")).alias("languages")
    )


@query
def fmt_commits(spark: SparkSession, sf: str) -> DataFrame:
    return _overview(spark, sf).select(
        "repo_id", RE.commits_text(F.col("recent_commits")).alias("recent_commits")
    )


@query
def prompts_repo(spark: SparkSession, sf: str) -> DataFrame:
    return RE.repo_prompts(_overview(spark, sf))


@query
def md_repo(spark: SparkSession, sf: str) -> DataFrame:
    return M.repo_markdown(_overview(spark, sf))


# --- quality -------------------------------------------------------------------


@query
def complexity(spark: SparkSession, sf: str) -> DataFrame:
    return Q.file_metrics(B.files(spark, sf)).filter("in_scope").select("repo_id", "path", "complexity")


@query
def complexity_by_category(spark: SparkSession, sf: str) -> DataFrame:
    parts = Q.complexity_of(F.col("text"))
    return (
        Q.scoped(B.files(spark, sf))
        .filter("in_scope")
        .select("repo_id", *[c.cast("bigint").alias(name) for name, c in parts.items()])
        .groupBy("repo_id")
        .agg(*[F.sum(name).alias(name) for name in parts])
    )


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return Q.repo_metrics(Q.file_metrics(B.files(spark, sf)))


@query
def repo_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf).select("repo_id", "complexity", "total_lines")


@query
def issue_severity(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf).select("repo_id", "errors", "warnings", "infos")


@query
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return Q.with_score(_totals(spark, sf)).select("repo_id", F.round("score", 6).alias("score"))


@query
def quality_grade(spark: SparkSession, sf: str) -> DataFrame:
    return Q.with_score(_totals(spark, sf)).select("repo_id", "grade")


@query
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quality_report(_totals(spark, sf))


@query
def pattern_issues(spark: SparkSession, sf: str) -> DataFrame:
    return Q.issues(B.files(spark, sf), with_functions=False)


@query
def function_extents(spark: SparkSession, sf: str) -> DataFrame:
    return Q.file_extents(B.files(spark, sf))


@query
def long_functions(spark: SparkSession, sf: str) -> DataFrame:
    return Q.issues(B.files(spark, sf), rules=()).drop("issue_idx")


@query
def all_issues(spark: SparkSession, sf: str) -> DataFrame:
    return Q.issues(B.files(spark, sf))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics and issues of every file, written: head and lines of a report search no text twice."""
    return stored(Q.file_results(B.files(spark, sf)), "results")


@query
def md_quality(spark: SparkSession, sf: str) -> DataFrame:
    # no job while the query is built; ``jobs.analyze_quality`` reads the contents once
    rows = Q.file_results(B.files(spark, sf))
    return M.quality_markdown(rows.drop("found"), Q.exploded(rows))


@query
def report_index(spark: SparkSession, sf: str) -> DataFrame:
    # written before: the ranges of the order are found in one pass and filled in another
    rows = _results(spark, sf)
    lines = M.quality_markdown(rows.drop("found"), Q.exploded(rows))
    packed = packed_lines(lines, "repo_id", ["repo_id", "section", "path", "line_idx"], 1000)
    return packed_index(packed, "repo_id")


# --- structure -------------------------------------------------------------------


@query
def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return S.tree_nodes(B.files(spark, sf))


@query
def modules(spark: SparkSession, sf: str) -> DataFrame:
    return S.tree_nodes(B.files(spark, sf)).filter("node_type = 'module'").select("repo_id", "path")


@query
def tree_order(spark: SparkSession, sf: str) -> DataFrame:
    return S.ordered_tree(S.tree_nodes(B.files(spark, sf))).select(
        "repo_id", "sort_key", "path", "depth"
    )


@query
def tree_positions(spark: SparkSession, sf: str) -> DataFrame:
    return S.tree_positions(S.tree_nodes(B.files(spark, sf)))


@query
def imports(spark: SparkSession, sf: str) -> DataFrame:
    return S.imports(B.files(spark, sf))


@query
def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return S.dependencies(B.files(spark, sf))


@query
def entry_points(spark: SparkSession, sf: str) -> DataFrame:
    return S.entry_points(B.files(spark, sf))


# --- diffs -----------------------------------------------------------------------


@query
def diff_files(spark: SparkSession, sf: str) -> DataFrame:
    return D.file_diffs(B.diffs(spark, sf), with_hunks=False).select(
        "diff_id", "file_idx", "path", "old_path", "parse_error"
    )


@query
def change_types(spark: SparkSession, sf: str) -> DataFrame:
    return D.file_diffs(B.diffs(spark, sf), with_hunks=False).select("diff_id", "file_idx", "change_type", "is_binary")


@query
def file_changes(spark: SparkSession, sf: str) -> DataFrame:
    return D.file_diffs(B.diffs(spark, sf), with_hunks=False).select("diff_id", "file_idx", "additions", "deletions")


@query
def hunks(spark: SparkSession, sf: str) -> DataFrame:
    return D.hunks(B.diffs(spark, sf))


@query
def diff_stats(spark: SparkSession, sf: str) -> DataFrame:
    return D.diff_stats(B.diffs(spark, sf))


@query
def fmt_diff(spark: SparkSession, sf: str) -> DataFrame:
    return RV.rebuilt_diffs(B.diffs(spark, sf))


# --- reviews ---------------------------------------------------------------------


@query
def review_tasks(spark: SparkSession, sf: str) -> DataFrame:
    chosen = A.select_agents(["Security", "junior", "architect"])
    return A.review_tasks(B.diffs(spark, sf), chosen).select("diff_id", "agent_idx", "agent")


@query
def settings_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews due by each repository's own settings, with unknown reviewers as errors."""
    own = A.with_reviewers(B.diffs(spark, sf), B.settings(spark, sf), ["Performance", "junior"])
    return A.review_tasks(own, A.AGENTS).select("diff_id", "agent_idx", "agent", "error")


@query
def json_locate(spark: SparkSession, sf: str) -> DataFrame:
    return B.responses(spark, sf).select(
        "diff_id", "agent", RP.located_json(F.col("response")).alias("json")
    )


@query
def comments(spark: SparkSession, sf: str) -> DataFrame:
    return RP.comments(B.responses(spark, sf))


@query
def reply_summary(spark: SparkSession, sf: str) -> DataFrame:
    return RP.parsed_replies(B.responses(spark, sf)).select("diff_id", "agent", "own_summary")


def _reviewed(spark: SparkSession, sf: str, fields: Sequence[str] = RV.COMMENT_FIELDS) -> DataFrame:
    return RV.reviewed_diffs(B.diffs(spark, sf), B.responses(spark, sf), A.AGENTS, fields)


@query
def agent_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return RV.agent_reviews(_reviewed(spark, sf, RV.COUNT_FIELDS))


@query
def agent_summary(spark: SparkSession, sf: str) -> DataFrame:
    return RV.agent_reviews(_reviewed(spark, sf, RV.SUMMARY_FIELDS)).select("diff_id", "agent", "summary")


@query
def comment_totals(spark: SparkSession, sf: str) -> DataFrame:
    return RV.comment_totals(_reviewed(spark, sf, RV.COUNT_FIELDS))


@query
def by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return RV.by_severity(_reviewed(spark, sf, RV.COUNT_FIELDS))


@query
def review_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return RV.review_verdict(_reviewed(spark, sf, RV.COUNT_FIELDS))


@query
def review_result(spark: SparkSession, sf: str) -> DataFrame:
    """Flat view of the nested result; ``report_json_review`` holds all of it."""
    severities = F.transform(
        F.map_entries("by_severity"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return RV.review_results(_reviewed(spark, sf)).select(
        "diff_id",
        "diff_summary.*",
        F.array_join(F.transform("agent_reviews", lambda r: r["agent_name"]), ",").alias("reviewers"),
        "total_comments",
        F.array_join(severities, ",").alias("by_severity"),
        "summary",
    )


@query
def fmt_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _reviewed(spark, sf).select("diff_id", RV.reviews_text(F.col("reviews")).alias("agent_reviews"))


@query
def prompts_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _digest(RV.summary_prompts(_reviewed(spark, sf)), "prompt", "diff_id")


@query
def prompts_review(spark: SparkSession, sf: str) -> DataFrame:
    prompts = RV.review_prompts(B.diffs(spark, sf), A.AGENTS)
    return _digest(prompts, "prompt", "diff_id", "agent")


def _context_files(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of the files that the fixture diffs touch, and all other files."""
    parts = B.FILES_CODE.read(spark, sf).select("repo_id", F.expr(B.CONTEXT_PATH).alias("path"), "content")
    for other in (B.FILES_DOCS, B.FILES_PAGES):
        parts = parts.unionByName(other.read(spark, sf))
    return parts


@query
def file_context(spark: SparkSession, sf: str) -> DataFrame:
    return RV.file_contexts(
        B.diffs(spark, sf), _context_files(spark, sf), lambda text: _digest_columns(text, "file_context")
    )


@query
def priority_issues(spark: SparkSession, sf: str) -> DataFrame:
    return RV.priority_issues(B.responses(spark, sf)).select(
        "diff_id", "priority", "file", "line", "agent", "comment_idx", "message"
    )


@query
def shared_issues(spark: SparkSession, sf: str) -> DataFrame:
    return RV.shared_issues(B.responses(spark, sf))


@query
def md_review(spark: SparkSession, sf: str) -> DataFrame:
    return M.review_markdown(RV.review_results(_reviewed(spark, sf)))


@query
def report_json_review(spark: SparkSession, sf: str) -> DataFrame:
    return json_reports(RV.review_results(_reviewed(spark, sf)), "review")


@query
def report_json_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = _results(spark, sf)
    report = Q.quality_report(Q.repo_metrics(rows.drop("found")))
    return quality_form(report, Q.exploded(rows)).drop("issue_idx")


@query
def report_json_repo(spark: SparkSession, sf: str) -> DataFrame:
    return json_reports(_overview(spark, sf), "repository")


# --- explanations ------------------------------------------------------------------


@query
def purpose(spark: SparkSession, sf: str) -> DataFrame:
    return B.replies(spark, sf).select(
        "repo_id", "path", RP.purpose_of(F.col("response")).alias("purpose")
    )


@query
def key_elements(spark: SparkSession, sf: str) -> DataFrame:
    return B.replies(spark, sf).select(
        "repo_id", "path", F.posexplode(RP.key_elements_of(F.col("response"))).alias("idx", "element")
    )


@query
def prompts_file(spark: SparkSession, sf: str) -> DataFrame:
    prompts = E.file_prompts(E.explained_files(B.files(spark, sf)))
    return _digest(prompts, "prompt", "repo_id", "path")


def _stub() -> Callable[[], E.Complete]:
    """Stands in for a model: its answer depends on the prompt alone.

    The client is a local function, so it travels by value and executors need no
    copy of this package.
    """

    def make_client() -> E.Complete:
        def complete(prompt: str) -> str:
            if len(prompt) % 11 == 0:
                raise RuntimeError(f"refused {len(prompt)}")
            return (
                f"### Purpose\nHolds {len(prompt)} characters.\n\n"
                f"### Key Elements\n- first {len(prompt) % 7}\n* second\n\n### Details\nNone."
            )

        return complete

    return make_client


def _answered(spark: SparkSession, sf: str) -> DataFrame:
    return E.complete_batch(E.file_prompts(E.explained_files(B.files(spark, sf))), _stub())


@query
def complete_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _answered(spark, sf)


@query
def file_explanations(spark: SparkSession, sf: str) -> DataFrame:
    return E.explanations(_answered(spark, sf)).withColumn(
        "key_elements", F.array_join("key_elements", "|")
    )


@query
def report_json_file(spark: SparkSession, sf: str) -> DataFrame:
    return json_reports(E.explanations(_answered(spark, sf)), "explanation")


@query
def md_file(spark: SparkSession, sf: str) -> DataFrame:
    return M.explanation_markdown(E.explanations(_answered(spark, sf)))
