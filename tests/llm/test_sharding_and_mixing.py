from __future__ import annotations

import zlib
from collections import Counter

import pytest
from brute import targets, words

from corpusgauge.llm import frames, mixing, sharding

ROWS = [(i, " ".join(["wort"] * (i % 37)) if i % 11 else None, "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
ROWS += [(5, "same same", None), (5, "same same", None), (None, "no id", "s1")]


@pytest.mark.parametrize("bucket", [200_000, 16])
def test_shards_hold_equal_counts_of_every_source(make_docs, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "ROWS_A_BUCKET", bucket)
    got = sharding.shard_plan(make_docs(ROWS), 8).collect()
    wanted = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in ROWS]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(wanted)
    shards = Counter(r.shard for r in got)
    assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 1
    for s, n in shards.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    mixture = Counter((r.shard, r.source) for r in got)
    sources = Counter(s for _, _, s in ROWS)
    for source, n in sources.items():
        # each source is rounded by half a row at a cut, and the cut moves with all of them
        most = 1 + len(sources) * n / len(ROWS)
        assert all(abs(mixture[s, source] - n / 8) <= most for s in range(8))


def test_sharding_reruns_agree_and_keeps_rows(make_docs):
    docs = make_docs(ROWS)
    one, two = (sorted(map(str, sharding.sharded(docs, 8).collect())) for _ in range(2))
    assert one == two and len(one) == len(ROWS)
    assert sharding.sharded(docs, 8).columns == [*docs.columns, "shard", "slot"]
    assert sharding.shard_plan(make_docs([]), 8).collect() == []
    assert sharding.sharded(make_docs([]), 8).collect() == []
    few = sharding.shard_plan(make_docs(ROWS[:3]), 8).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


@pytest.mark.parametrize("bucket", [200_000, 16])
def test_sources_meet_their_targets(make_docs, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", bucket)
    got = mixing.taken_by_document(make_docs(ROWS)).collect()
    sizes: Counter = Counter()
    for _, t, s in ROWS:
        sizes[s] += len(words(t))
    want = targets(sizes)
    taken: Counter = Counter()
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert len(got) == len(ROWS)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_small_sources_are_capped_and_the_rest_reshared():
    plan = mixing.targets([("a", 10), ("b", 1000), ("c", 0), (None, 500)], [1, 2, 3, 1], 1510)
    assert [t.tokens for t in plan] == [30.0, pytest.approx(986.667, abs=1e-3), 0.0, pytest.approx(493.333, abs=1e-3)]


def test_schedule_is_even(spark, make_docs):
    plan = [mixing.Target("a", 90_000, 1, 60_000.0), mixing.Target("b", 90_000, 2, 30_000.0), mixing.Target("c", 9, 3, 0.0)]
    slots = mixing.schedule(spark, plan, 100).orderBy("slot").collect()
    assert sorted((r.src, r["rank"]) for r in slots) == [(s, k) for s, n in ((0, 600), (1, 300)) for k in range(n)]
    assert len({r.slot for r in slots}) == 900
    for at in range(0, 800, 90):
        share = Counter(r.src for r in slots[at : at + 90])
        assert abs(share[0] - 60) <= 3 and share[2] == 0


def test_every_block_has_one_slot_whatever_the_shares(spark):
    for tokens in ([5, 1, 1, 1000], [1], [256 * 7, 3, 3, 3, 3, 3, 3, 3, 3, 3], [0, 900, 0], []):
        plan = [mixing.Target(str(i), 9, 1, float(t)) for i, t in enumerate(tokens)]
        got = mixing.schedule(spark, plan, 4).orderBy("slot").collect()
        wanted = [(s, k) for s, t in enumerate(tokens) for k in range(-(-t // 4))]
        assert sorted((r.src, r["rank"]) for r in got) == wanted
        # ranks follow slots
        assert all([r["rank"] for r in got if r.src == s] == list(range(-(-t // 4))) for s, t in enumerate(tokens))


def test_the_schedule_decides(make_docs, monkeypatch):
    whole = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: whole(*a).limit(0))
    docs = make_docs(ROWS)
    assert mixing.mixed(docs).collect() == []
    assert all(r.taken == 0 and r.first_slot is None for r in mixing.taken_by_document(docs).collect())


def test_mixed_documents_come_near_targets(make_docs):
    docs = make_docs(ROWS)
    got = mixing.mixed(docs).collect()
    sizes: Counter = Counter()
    for _, t, s in ROWS:
        sizes[s] += len(words(t))
    taken: Counter = Counter()
    for r in got:
        taken[r.source] += len(words(r.text))
    assert all(abs(taken[s] - n) <= 40 for s, n in targets(sizes).items())
    assert max(Counter(r.doc_id for r in got if r.doc_id != 5).values()) <= 3
    assert mixing.mixed(make_docs([])).collect() == []
    assert mixing.taken_by_document(make_docs([])).collect() == []
    assert mixing.mixed(docs).columns == docs.columns


def test_running_sum_over_buckets(spark):
    df = spark.range(100).selectExpr("id", "IF(id % 3 = 0, NULL, id % 3) AS k")
    from pyspark.sql import functions as F

    got = frames.with_running_sum(df, F.col("id"), "before", ["k"], F.floor(F.col("id") / 7), [F.col("id")])
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 100
    assert all(r.before == sum(x.id for x in rows.values() if x.k == r.k and x.id < i) for i, r in rows.items())
