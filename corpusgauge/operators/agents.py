"""Reviewers as data: a fixed, ordered list that users may extend."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.text import is_blank


@dataclass(frozen=True)
class Agent:
    name: str
    template: str
    none_text: str
    heading: str
    error_label: str
    warning_label: str
    info_label: str


# The four reviewers and the wording of their default summaries.
AGENTS: tuple[Agent, ...] = (
    Agent(
        "architect", "architect",
        "아키텍처 관점에서 특별한 이슈가 발견되지 않았습니다.",
        "아키텍처 리뷰 결과: ", "심각한 이슈", "주의 필요", "개선 제안",
    ),
    Agent(
        "security", "security",
        "보안 관점에서 특별한 취약점이 발견되지 않았습니다.",
        "보안 리뷰 결과: ", "취약점", "보안 주의", "보안 개선 제안",
    ),
    Agent(
        "performance", "performance",
        "성능 관점에서 특별한 이슈가 발견되지 않았습니다.",
        "성능 리뷰 결과: ", "심각한 성능 이슈", "성능 주의", "최적화 제안",
    ),
    Agent(
        "junior", "junior",
        "코드 품질/가독성 관점에서 특별한 이슈가 발견되지 않았습니다.",
        "가독성/품질 리뷰 결과: ", "필수 수정", "권장 수정", "개선 제안",
    ),
)
DEFAULT_AGENTS = ("architect", "security")
COUNT_SUFFIX = "건"
CALL_FAILED = "리뷰 실패: "
REVIEW_FAILED = "리뷰 실행 중 오류 발생: "


def select_agents(
    names: Sequence[str] = DEFAULT_AGENTS, known: Sequence[Agent] = AGENTS
) -> list[Agent]:
    """The named reviewers in the order asked for, each once; case does not matter."""
    by_name = {agent.name: agent for agent in known}
    unknown = [name for name in names if name.lower() not in by_name]
    if unknown:
        raise ValueError(f"unknown reviewers: {unknown}; known: {sorted(by_name)}")
    return [by_name[name] for name in dict.fromkeys(name.lower() for name in names)]


def with_reviewers(
    diffs: DataFrame, settings: DataFrame, base: Sequence[str] = DEFAULT_AGENTS
) -> DataFrame:
    """``diffs`` with ``reviewers``: names of those that review them, each once, in lower case.

    The ``review`` section of a repository in ``settings(repo_id, review STRUCT<default_agents>)``
    counts as a whole, and ``base`` where it has none; a section that names nobody stands
    for ``DEFAULT_AGENTS``.  Catalyst decides how the settings are joined.
    """
    listed = lambda names: F.array(*[F.lit(name.lower()) for name in dict.fromkeys(names)])
    named = F.filter("review.default_agents", lambda name: name.isNotNull())
    lowered = F.array_distinct(F.transform(named, F.lower))
    own = settings.filter("review IS NOT NULL").select(
        "repo_id", F.when(F.size(lowered) > 0, lowered).otherwise(listed(DEFAULT_AGENTS)).alias("reviewers")
    )
    base_names = F.array_distinct(listed(base or DEFAULT_AGENTS))
    return (
        diffs.drop("reviewers")
        .join(own, "repo_id", "left")
        .withColumn("reviewers", F.coalesce("reviewers", base_names))
    )


def unknown_reviewer(name: Column, known: Sequence[Agent]) -> Column:
    """Why the named reviewer cannot review; NULL for a known one."""
    names = [agent.name for agent in known]
    text = F.concat(F.lit("unknown reviewer: "), name, F.lit("; known: " + ", ".join(sorted(names))))
    return F.when(~name.isin(*names), text)


def agent_row(agent: Agent) -> Column:
    """The reviewer as a literal struct, for expressions that serve every reviewer."""
    return F.struct(*[F.lit(value).alias(field) for field, value in asdict(agent).items()])


def default_summary(agent: Column, errors: Column, warnings: Column, infos: Column) -> Column:
    """Summary of a reply that brings none of its own; ``agent`` is an ``agent_row``."""

    def part(label: Column, count: Column) -> Column:
        return F.when(count > 0, F.concat(label, F.lit(" "), count.cast("string"), F.lit(COUNT_SUFFIX)))

    listed = F.concat_ws(
        ", ",
        part(agent["error_label"], errors),
        part(agent["warning_label"], warnings),
        part(agent["info_label"], infos),
    )
    return F.when(errors + warnings + infos == 0, agent["none_text"]).otherwise(
        F.concat(agent["heading"], listed)
    )


def review_tasks(diffs: DataFrame, agents: Sequence[Agent]) -> DataFrame:
    """One row per diff with something to review and per reviewer.

    The reviewers are a literal array that each diff explodes, not a join.  Where ``diffs``
    has ``reviewers`` (see ``with_reviewers``), those of the diff take its place, and
    ``error`` tells which of them are not among ``agents``.
    """
    if "reviewers" in diffs.columns:
        return (
            diffs.filter(~is_blank(F.col("raw")))
            .select("*", F.posexplode("reviewers").alias("agent_idx", "agent"))
            .withColumn("error", unknown_reviewer(F.col("agent"), agents))
        )
    listed = F.array(*[F.lit(agent.name) for agent in agents])
    return diffs.filter(~is_blank(F.col("raw"))).select(
        "*", F.posexplode(listed).alias("agent_idx", "agent")
    )
