"""End-to-end jobs: what a user calls with tables of files, commits and diffs.

``make_client`` is a function without arguments that runs once per task and returns
the function answering one prompt.  Replies are checkpointed before they are used, so
that neither a second consumer nor a lost executor repeats a call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.paths import QUALITY_EXCLUDES, TRACKED_EXCLUDES
from corpusgauge.functions.rules import RULES, Rule
from corpusgauge.operators import agents, diffs, explain, quality, repo, reports, reviews, structure
from corpusgauge.operators.files import resolve_settings
from corpusgauge.session import checkpointed
from corpusgauge.sources.sinks import json_reports, quality_form

MakeClient = Callable[[], explain.Complete]


def summarize_repositories(
    files: DataFrame,
    commits: DataFrame,
    make_client: MakeClient | None = None,
    excludes: Sequence[str] = TRACKED_EXCLUDES,
) -> DataFrame:
    """One row per repository: totals, languages, recent commits, summary.

    A failed call leaves the summary NULL and says why in ``error``.
    """
    overview = repo.repo_overview(files, commits, excludes)
    if make_client is None:
        return overview.withColumn("summary", F.lit("")).withColumn("error", F.lit(None).cast("string"))
    overview = checkpointed(overview)
    answered = explain.complete_batch(repo.repo_prompts(overview), make_client)
    replies = checkpointed(answered).withColumnRenamed("response", "summary")
    return overview.join(replies, "repo_id", "left")


@dataclass(frozen=True)
class QualityResult:
    reports: DataFrame
    issues: DataFrame
    lines: DataFrame
    """The Markdown report as lines, see ``sources.sinks.write_report_lines``."""


def analyze_quality(
    files: DataFrame,
    excludes: Sequence[str] = (),
    max_kb: int = quality.MAX_FILE_SIZE_KB,
    rules: Sequence[Rule] = RULES,
    filtered: bool = True,
    settings: DataFrame | None = None,
) -> QualityResult:
    """Reports, issues and report lines; the contents are read once.

    ``filtered=False`` analyses every file given, whatever its name.  With
    ``settings(repo_id, analyze)`` a repository's own excludes and size limit apply;
    ``excludes`` and ``max_kb`` are those of the others.
    """
    if settings is not None:
        files = resolve_settings(files, settings, excludes or QUALITY_EXCLUDES, max_kb)
    results = checkpointed(quality.file_results(files, excludes, max_kb, rules, filtered))
    found = quality.exploded(results)
    return QualityResult(
        quality.quality_report(quality.repo_metrics(results)),
        found,
        reports.quality_markdown(results, found),
    )


@dataclass(frozen=True)
class StructureResult:
    nodes: DataFrame
    dependencies: DataFrame
    entry_points: DataFrame


def analyze_structure(
    files: DataFrame, excludes: Sequence[str] = (), filtered: bool = True
) -> StructureResult:
    """The tree in display order, internal imports and entry points."""
    return StructureResult(
        structure.ordered_tree(structure.tree_nodes(files, excludes, filtered)),
        structure.dependencies(files, excludes, filtered),
        structure.entry_points(files, excludes, filtered),
    )


def explain_files(
    files: DataFrame,
    make_client: MakeClient,
    max_kb: int = quality.MAX_FILE_SIZE_KB,
    log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(explanations, failures)``; failures hold ``repo_id, path, reason``.

    ``log`` names a folder of replies that outlives the job: see ``explain.complete_logged``.
    """
    complete = partial(explain.complete_logged, log=log) if log else explain.complete_batch
    prompts = explain.file_prompts(explain.explained_files(files, max_kb))
    answered = checkpointed(complete(prompts, make_client))
    failed = answered.filter(F.col("error").isNotNull()).select(
        "repo_id", "path", F.col("error").alias("reason")
    )
    too_large = explain.rejected_files(files, max_kb)
    return explain.explanations(answered), failed.unionByName(too_large)


def review_diffs(
    changes: DataFrame,
    make_client: MakeClient,
    reviewers: Sequence[str] = agents.DEFAULT_AGENTS,
    context_files: DataFrame | None = None,
    summarize: bool = True,
    settings: DataFrame | None = None,
    log: str | None = None,
) -> DataFrame:
    """Nested review results of ``diffs(repo_id, diff_id, raw)``.

    With ``summarize`` the diffs that drew comments get a summary from the model, or
    the fixed verdict text where that call fails.  With ``settings(repo_id, review)`` a
    repository's own reviewers take the place of ``reviewers``; a name that nobody has gives
    a failed review.  ``log`` names a folder of replies that outlives the job: see
    ``explain.complete_logged``.
    """
    complete = partial(explain.complete_logged, log=log) if log else explain.complete_batch
    chosen = agents.select_agents(reviewers)
    if settings is not None:
        changes = agents.with_reviewers(changes, settings, [agent.name for agent in chosen])
        chosen = list(agents.AGENTS)
    contexts = None if context_files is None else reviews.file_contexts(changes, context_files)
    prompts = reviews.review_prompts(changes, chosen, contexts).drop("agent_idx")
    responses = checkpointed(complete(prompts, make_client))
    reviewed = reviews.reviewed_diffs(changes, responses, chosen)
    if not summarize:
        return reviews.review_results(reviewed)
    reviewed = checkpointed(reviewed)
    commented = reviews.with_totals(reviewed).filter("total_comments > 0")
    answered = complete(reviews.summary_prompts(commented), make_client)
    summaries = checkpointed(answered.withColumnRenamed("response", "summary"))
    return reviews.review_results(reviewed, summaries)


def parse_diffs(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(file_diffs, stats)`` of ``diffs(repo_id, diff_id, raw)``."""
    return diffs.file_diffs(changes), diffs.diff_stats(changes)


_MARKDOWN: dict[str, Callable[[DataFrame], DataFrame]] = {
    "repository": reports.repo_markdown,
    "review": reports.review_markdown,
    "explanation": reports.explanation_markdown,
}


def render(results: DataFrame | QualityResult, kind: str, form: str = "markdown") -> DataFrame:
    """Keys and ``report`` text of repository, review or explanation rows.

    Kind ``quality`` takes the result of ``analyze_quality``: its Markdown are lines in
    report order, its JSON a head row for each repository and a row for each issue.
    """
    if kind not in (*_MARKDOWN, "quality"):
        raise ValueError(f"unknown kind {kind}; known: {sorted([*_MARKDOWN, 'quality'])}")
    if form.lower() not in ("json", "markdown"):
        raise ValueError(f"unknown form {form}; known: ['json', 'markdown']")
    if isinstance(results, QualityResult):
        return quality_form(results.reports, results.issues) if form.lower() == "json" else results.lines
    return json_reports(results, kind) if form.lower() == "json" else _MARKDOWN[kind](results)
