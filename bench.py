"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to the ``noop`` sink, so all rows and columns are computed.
Times are of a first run in a session that has already run one small query, and of a
second run, when code is compiled (``second_run``).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpusgauge.plans.queries import QUERIES  # noqa: E402
from corpusgauge.session import build_session  # noqa: E402

HEADLINE = (
    "language_stats",
    "repo_totals",
    "recent_commits",
    "md_repo",
    "complexity_by_category",
    "quality_report",
    "pattern_issues",
    "long_functions",
    "all_issues",
    "tree_nodes",
    "imports",
    "entry_points",
    "file_changes",
    "hunks",
    "diff_stats",
    "comments",
    "agent_reviews",
    "review_verdict",
    "prompts_review",
    "file_explanations",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["count_files"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    again: dict[str, float] = {}
    for times in (seconds, again):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "second_run": again,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
