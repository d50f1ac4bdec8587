from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import brute
import duckdb
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from corpusgauge.llm.queries import LLM_ORACLES, LLM_QUERIES
from tools.check_oracles import TABLES, rows_of

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="fixture tables are not here")


def test_all_are_registered():
    numbers = {int(m[1]) for n in LLM_QUERIES if (m := re.match(r"op(\d+)_", n))}
    assert numbers == set(range(1, 14)) and "pipeline" in LLM_QUERIES
    assert set(LLM_QUERIES) <= set(registry.queries()) and set(LLM_ORACLES) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = LLM_QUERIES[name](spark, str(SF))
    relation = con.sql(LLM_ORACLES[name])
    assert sorted(result.columns) == sorted(relation.columns)
    assert rows_of(result.columns, result.collect()) == rows_of(list(relation.columns), relation.fetchall())


def test_stages_as_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, str(SF)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        old, new = {r.doc_id: r.text for r in before.collect()}, after.collect()
        kept = {r.doc_id for r in new}
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "quality_rules":
            for d, t in old.items():
                n, _, _, _, repeated = brute.base_statistics(t)
                if n < 50 or 100 * repeated > 50 * n:
                    assert d not in kept
        elif name == "jaccard_join":
            assert sorted(r.doc_id for r in new) == sorted({c for _, _, c in brute.components(list(old.items()))})
        elif name == "decontamination":
            plain = [" ".join(brute.words(b.lower())) for b in bench]
            held = {d for d, t in old.items() if any(b in " ".join(brute.words(t.lower())) for b in plain)}
            assert kept == set(old) - held
        elif name == "mixing":
            sizes: Counter = Counter()
            for r in before.collect():
                sizes[r.source] += len(brute.words(r.text))
            taken: Counter = Counter()
            for r in new:
                taken[r.source] += len(brute.words(r.text))
            longest = max(len(brute.words(t)) for t in old.values())
            assert all(abs(taken[s] - t) <= longest for s, t in brute.targets(sizes).items())
            assert max(Counter(r.doc_id for r in new).values()) <= 3
        else:
            assert Counter(r.doc_id for r in new) == Counter(r.doc_id for r in before.collect())
            shards = Counter(r.shard for r in new)
            assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == 24
        before = after


def test_run_gives_all_columns_and_shards(spark):
    rows = corpus_pipeline.run(spark, str(SF))
    assert {"doc_id", "text", "shard", "slot"} <= set(rows.columns) and rows.count() > 0
