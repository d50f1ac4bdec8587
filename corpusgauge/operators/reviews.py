"""Reviews: replies joined to diffs, summaries, verdicts, prompts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.membership import key_bitmap, maybe_among
from corpusgauge.functions.rows import explode_items
from corpusgauge.functions.templates import fill
from corpusgauge.functions.text import is_blank, strip
from corpusgauge.operators.agents import (
    CALL_FAILED,
    REVIEW_FAILED,
    Agent,
    agent_row,
    default_summary,
    review_tasks,
    unknown_reviewer,
)
from corpusgauge.operators.diffs import file_diffs, file_diffs_of, line_totals, rebuilt_text
from corpusgauge.operators.replies import COMMENT, comments, parsed_replies

# Wording of review texts.
NOTHING_TO_REVIEW = "리뷰할 변경사항이 없습니다."
NO_RESPONSE = "no response"
NO_CONTEXT = "No additional file context provided."
TOTAL_TEXT = ("총 ", "개의 코멘트가 발견되었습니다.")
MUST_FIX = "\n병합 전 ERROR 이슈를 해결해야 합니다."
SHOULD_LOOK = "\nWARNING 이슈를 검토하는 것이 좋습니다."
MERGEABLE = "\n특별한 이슈 없이 병합 가능합니다."
PER_SEVERITY = ("- ERROR: ", "- WARNING: ", "- INFO: ")
COUNT_UNIT = "개"

#: What of a reply takes part in the fold, from the narrowest on.
COUNT_FIELDS = ("failed", "errors", "warnings", "infos", "first_error", "first_warning", "first_info")
SUMMARY_FIELDS = (*COUNT_FIELDS, "error", "failure", "own_summary")
COMMENT_FIELDS = (*SUMMARY_FIELDS, "comments")
_COUNTS = ("errors", "warnings", "infos", "first_error", "first_warning", "first_info")


def _no_comments() -> Column:
    return F.array().cast(f"array<{COMMENT}>")


def _review_of(entry: Column, fields: Sequence[str]) -> Column:
    """One reviewer's result, whether it answered, failed or broke on its own reply.

    ``entry`` holds the reviewer (``agent``), its parsed reply (``reply``, maybe NULL) and why
    there can be none (``refused``).
    """
    agent, reply = entry["agent"], entry["reply"]
    answered = ~F.coalesce(reply["failed"], F.lit(True))
    zero = F.lit(0).cast("bigint")
    out = [agent["name"].alias("agent")]
    if "comments" in fields:
        out.append(F.when(answered, reply["comments"]).otherwise(_no_comments()).alias("comments"))
    out += [F.when(answered, reply[f]).otherwise(zero).alias(f) for f in _COUNTS]
    if "own_summary" in fields:
        call_error = F.when(reply.isNull(), F.coalesce(entry["refused"], F.lit(NO_RESPONSE))).otherwise(reply["error"])
        summary = (
            F.when(call_error.isNotNull(), F.concat(F.lit(CALL_FAILED), call_error))
            .when(reply["failure"].isNotNull(), F.concat(F.lit(REVIEW_FAILED), reply["failure"]))
            .when(reply["own_summary"] != "", reply["own_summary"])
            .otherwise(default_summary(agent, reply["errors"], reply["warnings"], reply["infos"]))
        )
        out.append(summary.alias("summary"))
    return F.struct(*out)


def _first_of(severity: str) -> Column:
    """Place, from 1, of a severity's first comment; 0 for none."""
    found = F.array_position(F.transform("comments", lambda c: c["severity"]), severity)
    return found.cast("bigint").alias(f"first_{severity}")


def reviewed_diffs(
    diffs: DataFrame,
    responses: DataFrame,
    agents: Sequence[Agent],
    fields: Sequence[str] = COMMENT_FIELDS,
) -> DataFrame:
    """``diff_id, is_blank, stats, reviews``: one row per diff, blank ones included.

    Replies are parsed where they are read, then folded to one column per reviewer
    (a state of at most one reply each, whatever the number of rows).  Only ``fields``
    are folded, so counts never shuffle texts.  The fold's shuffle by ``diff_id`` also
    serves the join; of the diffs only the stats travel.

    Of several replies of one reviewer to one diff the one of the greatest ``attempt``
    counts, if ``responses`` has that column; then one without an error before one
    with, then the greater by its text, so that every run takes the same.

    Where ``diffs`` has ``reviewers`` (see ``with_reviewers``), each diff is reviewed by those
    only, in their order; one that is not among ``agents`` gives a failed review.
    """
    names = [agent.name for agent in agents]
    attempt = F.col("attempt") if "attempt" in responses.columns else F.lit(0)
    known = responses.filter(F.col("agent").isin(*names)).withColumn("attempt", attempt.cast("bigint"))
    parsed = parsed_replies(known, "attempt", F.xxhash64("response", "error").alias("mark")).select(
        "*",
        F.col("error").isNotNull().alias("failed"),
        *[_first_of(s) for s in ("error", "warning", "info")],
    )
    rank = F.struct("attempt", (~F.col("failed")).alias("ok"), "mark")
    reply = F.struct(rank.alias("rank"), *fields)
    folded = parsed.groupBy("diff_id").agg(
        *[F.max(F.when(F.col("agent") == n, reply)).alias(f"reply_{i}") for i, n in enumerate(names)]
    )
    slim = diffs.select(
        "diff_id",
        is_blank(F.col("raw")).alias("is_blank"),
        line_totals(F.col("raw")).alias("stats"),
        *(["reviewers"] if "reviewers" in diffs.columns else []),
    )
    nothing = F.lit(None).cast("string")
    entries = F.array(
        *[
            F.struct(agent_row(a).alias("agent"), F.col(f"reply_{i}").alias("reply"), nothing.alias("refused"))
            for i, a in enumerate(agents)
        ]
    )
    if "reviewers" in diffs.columns:
        listed = entries

        def entry_of(name: Column) -> Column:
            stranger = F.struct(
                agent_row(Agent("", *[""] * 6)).withField("name", name).alias("agent"),
                F.when(F.lit(False), F.col("reply_0")).alias("reply"),
                unknown_reviewer(name, agents).alias("refused"),
            )
            return F.coalesce(F.get(F.filter(listed, lambda e: e["agent"]["name"] == name), 0), stranger)

        entries = F.transform("reviewers", entry_of)
    due = F.filter(entries, lambda _: ~F.col("is_blank"))
    return slim.join(folded, "diff_id", "left").select(
        "diff_id", "is_blank", "stats", F.transform(due, lambda e: _review_of(e, fields)).alias("reviews")
    )


def agent_reviews(reviewed: DataFrame) -> DataFrame:
    """One row per diff and reviewer."""
    each = explode_items(reviewed, ["diff_id"], F.col("reviews"), "agent_idx", "r")
    with_summary = "summary" in each.select("r.*").columns
    return each.select(
        "diff_id",
        "agent_idx",
        "r.agent",
        (F.col("r.errors") + F.col("r.warnings") + F.col("r.infos")).alias("n_comments"),
        "r.errors",
        "r.warnings",
        "r.infos",
        *(["r.summary"] if with_summary else []),
    )


def _total(field: str) -> Column:
    return F.aggregate("reviews", F.lit(0).cast("bigint"), lambda acc, r: acc + r[field])


def with_totals(reviewed: DataFrame) -> DataFrame:
    """Counts over the reviewers, summed in the row."""
    totals = reviewed.select(
        "*", _total("errors").alias("errors"), _total("warnings").alias("warnings"),
        _total("infos").alias("infos"),
    )
    return totals.withColumn("total_comments", F.col("errors") + F.col("warnings") + F.col("infos"))


def comment_totals(reviewed: DataFrame) -> DataFrame:
    return with_totals(reviewed).select("diff_id", "total_comments")


def severity_map(reviewed: DataFrame) -> DataFrame:
    """``by_severity`` holds only the severities that occur, in the order they first do."""

    def first(severity: str) -> Column:
        """Reviewer and place of the first comment, as one number; NULL for none."""
        at = lambda r, i: F.when(
            r[f"first_{severity}"] > 0, F.shiftleft(i.cast("bigint"), 32) + r[f"first_{severity}"]
        )
        return F.array_min(F.transform("reviews", at))

    columns = {"error": "errors", "warning": "warnings", "info": "infos"}
    placed = F.array(
        *[
            F.struct(first(s).alias("at"), F.lit(s).alias("key"), F.col(c).alias("value"))
            for s, c in columns.items()
        ]
    )
    seen = F.array_sort(F.filter(placed, lambda e: e["at"].isNotNull()))
    counted = F.transform(seen, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return with_totals(reviewed).withColumn("by_severity", F.map_from_entries(counted))


def by_severity(reviewed: DataFrame) -> DataFrame:
    counted = severity_map(reviewed).withColumn("entries", F.map_entries("by_severity"))
    return explode_items(counted, ["diff_id"], F.col("entries"), "idx", "e").select(
        "diff_id", F.col("e.key").alias("severity"), F.col("e.value").alias("n_comments")
    )


def fallback_summary() -> Column:
    def part(prefix: str, column: str) -> Column:
        return F.when(
            F.col(column) > 0, F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(COUNT_UNIT))
        )

    before, after = TOTAL_TEXT
    return F.concat_ws(
        "\n",
        F.concat(F.lit(before), F.col("total_comments").cast("string"), F.lit(after)),
        *[part(p, c) for p, c in zip(PER_SEVERITY, ("errors", "warnings", "infos"), strict=True)],
        F.when(F.col("errors") > 0, MUST_FIX)
        .when(F.col("warnings") > 0, SHOULD_LOOK)
        .otherwise(MERGEABLE),
    )


def review_verdict(reviewed: DataFrame) -> DataFrame:
    """Totals, verdict and the summary text used when no model writes one."""
    verdict = (
        F.when(F.col("errors") > 0, "must_fix")
        .when(F.col("warnings") > 0, "should_look")
        .otherwise("mergeable")
    )
    return (
        with_totals(reviewed.filter(~F.col("is_blank")))
        .select(
            "diff_id", "total_comments", "errors", "warnings", "infos",
            verdict.alias("verdict"), fallback_summary().alias("summary"),
        )
    )


def _published(review: Column) -> Column:
    """A review without its working columns; every comment names its reviewer."""
    fields = ("file", "line", "severity", "category", "message", "suggestion")
    comment = lambda c: F.struct(review["agent"].alias("agent"), *[c[f].alias(f) for f in fields])
    return F.struct(
        review["agent"].alias("agent_name"),
        F.transform(review["comments"], comment).alias("comments"),
        review["summary"].alias("summary"),
    )


def review_results(
    reviewed: DataFrame, model_summaries: DataFrame | None = None
) -> DataFrame:
    """The nested result per diff.

    A blank diff gets the fixed text.  Otherwise the summary is the model's where
    ``model_summaries(diff_id, summary, error)`` has one, the fallback text where its
    call failed, and '' when there is no comment to sum up.
    """
    mapped = severity_map(reviewed)
    if model_summaries is None:
        written = F.lit("")
    else:
        renamed = model_summaries.select(
            "diff_id", F.col("summary").alias("model_summary"), F.col("error").alias("model_error")
        )
        mapped = mapped.join(renamed, "diff_id", "left")
        written = F.when(F.col("model_error").isNotNull(), fallback_summary()).otherwise(
            F.coalesce(strip(F.col("model_summary")), F.lit(""))
        )
    summary = (
        F.when(F.col("is_blank"), NOTHING_TO_REVIEW)
        .when(F.col("total_comments") > 0, written)
        .otherwise("")
    )
    return mapped.select(
        "diff_id",
        F.col("stats").alias("diff_summary"),
        F.transform("reviews", _published).alias("agent_reviews"),
        "total_comments",
        "by_severity",
        summary.alias("summary"),
    )


def reviews_text(reviews: Column) -> Column:
    """All reviews of a diff as the text block of the summary prompt."""

    def comment_lines(c: Column) -> Column:
        place = F.when(
            F.coalesce(c["line"], F.lit(0)) != 0,
            F.concat(_shown(c["file"]), F.lit(":"), c["line"].cast("string")),
        ).otherwise(_shown(c["file"]))
        lines = F.array(
            F.concat(F.lit("- ["), F.upper(c["severity"]), F.lit("] "), place),
            F.concat(F.lit("  "), _shown(c["message"])),
            F.when(
                F.coalesce(c["suggestion"], F.lit("")) != "",
                F.concat(F.lit("  Suggestion: "), c["suggestion"]),
            ),
            F.lit(""),
        )
        return F.filter(lines, lambda line: line.isNotNull())

    def review_lines(r: Column) -> Column:
        heading = F.array(F.concat(F.lit("### "), r["agent"]), F.lit(""))
        body = F.when(
            F.size(r["comments"]) > 0, F.flatten(F.transform(r["comments"], comment_lines))
        ).otherwise(F.array(F.lit("*No issues found.*"), F.lit("")))
        tail = F.when(
            r["summary"] != "",
            F.array(F.concat(F.lit("**Summary**: "), r["summary"]), F.lit("")),
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(heading, body, tail)

    return F.array_join(F.flatten(F.transform(reviews, review_lines)), "\n")


def _shown(value: Column) -> Column:
    """A missing value reads ``None`` in the texts."""
    return F.coalesce(value, F.lit("None"))


def review_prompts(
    diffs: DataFrame, agents: Sequence[Agent], contexts: DataFrame | None = None
) -> DataFrame:
    """One prompt per diff and reviewer; ``contexts(diff_id, file_context)`` is optional.

    Diffs with ``reviewers`` of their own get prompts for those among ``agents``.
    """
    if contexts is None:
        diffs = diffs.withColumn("file_context", F.lit(NO_CONTEXT))
    else:
        diffs = diffs.join(contexts, "diff_id", "left").withColumn(
            "file_context", F.coalesce("file_context", F.lit(NO_CONTEXT))
        )
    values = {"diff": F.col("raw"), "file_context": F.col("file_context")}
    chain: Column | None = None
    for agent in agents:
        prompt = fill(agent.template, values)
        test = F.col("agent") == agent.name
        chain = F.when(test, prompt) if chain is None else chain.when(test, prompt)
    tasks = review_tasks(diffs, agents)
    if "reviewers" in diffs.columns:
        tasks = tasks.filter(F.col("error").isNull())
    return tasks.select("diff_id", "agent_idx", "agent", chain.alias("prompt"))


def summary_prompts(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter(~F.col("is_blank")).select(
        "diff_id",
        fill(
            "summary",
            {
                "files_changed": F.col("stats.files_changed"),
                "additions": F.col("stats.total_additions"),
                "deletions": F.col("stats.total_deletions"),
                "agent_reviews": reviews_text(F.col("reviews")),
            },
        ).alias("prompt"),
    )


def rebuilt_diffs(diffs: DataFrame) -> DataFrame:
    return diffs.select("diff_id", rebuilt_text(file_diffs_of(F.col("raw"))).alias("diff_text"))


def _whole_text(text: Column) -> list[Column]:
    return [text.alias("file_context")]


def file_contexts(
    diffs: DataFrame, files: DataFrame, shown: Callable[[Column], list[Column]] = _whole_text
) -> DataFrame:
    """Current contents of the files a diff touches, as one prompt block per diff.

    Contents travel once per different list of places, not per diff.  Paths come first: each diff is narrowed to the list
    of its places (number and path) that may have a file, by a bitmap of fixed size.  Files
    that no list names are dropped where they are scanned, by another.  The blocks of a path
    are brought together once, and a text is made once for each different list, in place
    order.  At last the diffs are joined to the texts by their lists.

    ``shown`` makes the output columns of a text; they are computed once per different text.
    """
    places = F.struct("file_idx", "repo_id", "path")
    lists = (
        maybe_among(
            file_diffs(diffs, with_hunks=False).select("repo_id", "diff_id", "file_idx", "path"),
            key_bitmap(files, "repo_id", "path"),
            "repo_id",
            "path",
        )
        .filter(F.col("path").isNotNull())
        .groupBy("diff_id")
        .agg(F.sort_array(F.collect_list(places)).alias("places"))
    )
    each = lists.select("places").distinct().select("places", F.explode("places").alias("place"))
    each = each.select("places", "place.*")
    wanted = maybe_among(
        files.select("repo_id", "path", "content"), key_bitmap(each, "repo_id", "path"), "repo_id", "path"
    )
    block = F.concat(F.lit("### "), "path", F.lit("\n```\n"), "content", F.lit("\n```\n"))
    blocks = wanted.groupBy("repo_id", "path").agg(F.collect_list(block).alias("blocks"))

    def numbered(place: Column) -> Column:
        return F.transform(place["blocks"], lambda b: F.struct(place["file_idx"].alias("file_idx"), b.alias("block")))

    in_order = F.sort_array(F.flatten(F.transform("found", numbered)))
    texts = (
        each.join(blocks, ["repo_id", "path"])
        .groupBy("places")
        .agg(F.collect_list(F.struct("file_idx", "blocks")).alias("found"))
        .select("places", F.array_join(F.transform(in_order, lambda b: b["block"]), "\n").alias("file_context"))
        .select("places", *shown(F.col("file_context")))
    )
    return lists.join(texts, "places").drop("places")


def priority_issues(responses: DataFrame) -> DataFrame:
    """Comments by severity, then place: a range-partitioned sort."""
    rank = F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    return (
        comments(responses)
        .withColumn("priority", rank)
        .orderBy("diff_id", "priority", "file", "line", "agent", "comment_idx")
    )


def shared_issues(responses: DataFrame, agents_at_least: int = 2) -> DataFrame:
    """Places that several reviewers of one diff remarked on.

    A place is the file and line, or the file and category where no line is given.
    """
    place = F.coalesce(F.col("line").cast("string"), F.concat(F.lit("#"), "category"))
    return (
        comments(responses)
        .groupBy("diff_id", "file", place.alias("place"))
        .agg(F.count_distinct("agent").alias("n_agents"), F.count("*").alias("n_comments"))
        .filter(F.col("n_agents") >= agents_at_least)
    )
