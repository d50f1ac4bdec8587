from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgauge.llm import decontamination as D


def plain_tiling(doc: list[int], item: list[int], least: int) -> int:
    """Covered tokens, by comparing all places with all places."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        found = []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and free_d[d + n] and free_i[i + n]:
                    n += 1
                if n >= least:
                    found.append((n, d, i))
        if not found:
            return covered
        top = max(n for n, _, _ in found)
        for n, d, i in sorted(x for x in found if x[0] == top):
            best = (n, d, i)
            if all(free_d[d : d + n]) and all(free_i[i : i + n]):
                free_d[d : d + n] = [False] * n
                free_i[i : i + n] = [False] * n
                covered += n
        assert best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), min_size=1, max_size=20), st.integers(1, 5))
def test_tiling_as_by_brute_force(doc, item, least):
    found = D.tiles(np.array(doc, dtype=np.uint64), np.array(item, dtype=np.uint64), least)
    assert sum(n for _, _, n in found) == plain_tiling(doc, item, least)
    for d, i, n in found:
        assert doc[d : d + n] == item[i : i + n]


@pytest.fixture(scope="module")
def case(spark, make_docs):
    rng = random.Random(2)
    items = [[f"b{i}x{k}" for k in range(40)] for i in range(4)]
    noise = [f"n{rng.randrange(900)}" for _ in range(300)]
    whole, halves = " ".join(items[0]), " ".join(items[1][20:] + noise[:30] + items[1][:20])
    part = " ".join(items[2][:15] + noise[:50])
    docs = [
        (1, f"{' '.join(noise)} {whole.upper()}. {' '.join(noise)}"),
        (2, halves),
        (3, part),
        (4, " ".join(noise)),
        (5, None),
        (6, ""),
        (7, "(tiny, item)"),
    ]
    bench = [(i, ", ".join(x)) for i, x in enumerate(items)] + [(8, None), (9, "--"), (10, "Tiny item"), (0, ", ".join(items[0]))]
    return make_docs(docs), spark.createDataFrame([(*b, 5) for b in bench], "item_id BIGINT, text STRING, doc_id INT")


@pytest.mark.parametrize("size", [D.BLOCK_BYTES, 200])
def test_whole_reordered_and_short_items_are_found(case, monkeypatch, size):
    monkeypatch.setattr(D, "BLOCK_BYTES", size)
    docs, bench = case
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in D.contaminated(docs, bench).collect()}
    assert got == {(1, 0): (1.0, 1), (2, 1): (1.0, 2), (7, 10): (1.0, 1)}
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]


def test_empty_tables(case, make_docs):
    docs, bench = case
    assert D.contaminated(make_docs([]), bench).collect() == []
    assert D.contaminated(docs, bench.limit(0)).collect() == []
    assert D.decontaminated(docs, bench.limit(0)).count() == 7


def plain_table(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """All pairs tiled by comparing all places."""
    cut = lambda t: re.sub(r"[^\w ]+", " ", (t or "").lower()).split()
    out = []
    for d, text in docs:
        for i, passage in items:
            doc, item = cut(text), cut(passage)
            covered = plain_tiling(doc, item, min(5, len(item))) if item else 0
            if item and covered >= (0.8 if len(item) <= 12 else 0.5) * len(item):
                out.append((d, i, covered))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_table_equals_brute_force(spark, make_docs, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice((3, 5, 8, 12, 13, 20))))) for i in range(25)]
    docs = []
    for d in range(40):
        words = [f"w{rng.randrange(60)}" for _ in range(20)]
        for _ in range(2):
            item = rng.choice(items)[1].split()
            at = rng.randrange(len(item))
            words += item[at:] + item[:at] if rng.random() < 0.5 else item[: at + 1]
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    got = sorted((r.doc_id, r.item_id, r.covered) for r in D.contaminated(make_docs(docs), bench).collect())
    assert got == plain_table(docs, items) and got


def test_a_common_phrase_drops_no_clean_document(spark, make_docs):
    phrase = "what is the capital of"
    bench = spark.createDataFrame([(1, f"{phrase} far away Mongolia"), (2, "the answer"), (3, f"{phrase} France")], "item_id BIGINT, text STRING")
    docs = make_docs([(1, f"Tell me, {phrase} Spain? the answer is Madrid"), (2, f"so {phrase} far away Mongolia now"), (3, f"{phrase} France")])
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert {(2, 1), (3, 3), (1, 2)} <= got and (1, 1) not in got
    assert sorted(r.doc_id for r in D.decontaminated(docs, bench).filter("doc_id <> 3").collect()) in ([1], [])


def test_items_that_share_one_phrase_are_not_tiled(monkeypatch):
    rng = random.Random(4)
    shared = "one two three four five"
    texts = pa.array([" ".join([f"n{rng.randrange(5000)}" for _ in range(3000)] + [shared]) for _ in range(20)])
    items = [f"{shared} " + " ".join(f"i{k}x{w}" for w in range(30)) for k in range(800)]
    seeds = D.seeds_of(list(range(800)), pa.array(items))
    calls = []
    monkeypatch.setattr(D, "tiles", lambda *a: calls.append(a) or [])
    assert list(D._matches(texts, seeds)) == [] and not calls


def test_very_long_texts(spark, make_docs):
    item = " ".join(f"b{i}" for i in range(40))
    filler = " ".join(f"n{i}" for i in range(300_000))
    bench = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    docs = make_docs([(1, f"{filler} {item}"), (2, "z" * 3_000_000), (3, f"{'z' * 2_000_000} {item}"), (4, filler)])
    assert sorted(r.doc_id for r in D.contaminated(docs, bench).collect()) == [1, 3]
    assert sorted(r.doc_id for r in D.decontaminated(docs, bench).collect()) == [2, 4]
