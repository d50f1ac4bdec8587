from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import components
from pyspark.sql import functions as F
from test_words import thue_morse

from corpusgauge.llm import jaccard_join as J
from corpusgauge.llm.components import components as linked
from corpusgauge.llm.components import stars_of


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out: list[str | None] = [None, "", " \n", "One two", "one TWO", "one two three four five", "ein zwei drei vier"]
    for n in (8, 30, 90, 300):
        base = rng.choices(vocabulary, k=n)
        for edits in (0, 0, 1, 2, n // 20, n // 12, n // 8, n // 3):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = rng.choice(vocabulary)
            out.append(" ".join(copy))
        out.append(" ".join(base[: n * 4 // 5]))
        out.append(" ".join(base[: n * 3 // 4]))
    # one passage in many otherwise different texts, and texts of hardly more than it
    out += [passage + " " + " ".join(rng.choices(vocabulary, k=k)) for k in (2, 5, 9, 14, 18, 60, 60, 60)]
    return out


def found(docs) -> list[tuple]:
    return sorted(tuple(r) for r in J.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("block", [256, 3])
def test_classes_as_by_brute_force(make_docs, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = list(enumerate(texts(block)))
    assert found(make_docs(rows)) == sorted(components(rows))


def test_second_pass_finds_links_the_first_node_has_not(make_docs):
    """a-b and b-c are far, a shares rare tokens with both; c-d only meet in a's tile."""
    words = [f"k{i}" for i in range(60)]
    a = " ".join(words)
    c = " ".join(words[:44] + ["x"])
    d = " ".join(words[:42] + ["y", "z"])
    rows = [(3, a), (1, c), (2, d), (9, " ".join(words[20:]))]
    assert found(make_docs(rows)) == sorted(components(rows))


def test_repeated_rows_and_empty_table(make_docs):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (7, None)]
    assert found(make_docs(rows)) == [(2, 2, 2), (4, 2, 2), (4, 2, 2), (7, 0, 7)]
    assert found(make_docs([])) == []


def test_one_of_each_class_stays(make_docs):
    same = "p q r s t u v w"
    docs = make_docs([(5, same), (3, same), (3, same), (8, None), (9, ""), (6, "other words in this one here")])
    kept = J.first_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 8, 9]


def test_bitmap_bounds_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = np.unique(rng.integers(0, 400, rng.integers(1, 200), dtype=np.uint64))
        y = np.unique(rng.integers(0, 400, rng.integers(1, 200), dtype=np.uint64))
        maps = [np.frombuffer(J.bitmap_of(s), np.uint8) for s in (x, y)]
        assert J.overlap_bound(len(x), len(y), *maps) >= len(np.intersect1d(x, y))


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in linked(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


def test_prefix_and_near_part(make_docs):
    words = [f"w{i}" for i in range(104)]
    tiles = J._scan(make_docs([(1, " ".join(words)), (2, "a b c d e f")]), b"", "tiles")
    got = sorted((r.near, len(r.tokens)) for r in tiles.collect())
    assert got == [(1, 1), (15, 26)]  # of 2 and of 100 shingles


def test_tokens_are_combined_before_their_shuffle(make_docs):
    text = " ".join(f"w{i}" for i in range(100))
    tiles = J.tile_entries(make_docs([(1, text), (2, text + " more")]), b"")
    assert tiles.count() > 0
    plan = tiles._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(node" in plan and "REPARTITION" not in plan


def test_long_patterned_words_are_told_apart(make_docs):
    one, two = thue_morse(2048)
    rows = [(1, f"{one} b c d e f"), (2, f"{two} b c d e f"), (3, f"{one} b c d e f"), (4, one), (5, two)]
    assert found(make_docs(rows)) == sorted(components(rows))


def hub(n: int, seed: int) -> list[tuple[int, str]]:
    """Texts that differ at random in about a seventh of one base: near the threshold."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(200)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(0, 200, 10), rng.randrange(3, 8)):
            text[at] = f"x{rng.randrange(40)}"
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("block", [256, 7])
def test_groups_near_the_threshold(make_docs, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "STARS", ("lo",))
    rows = hub(60, block)
    assert found(make_docs(rows)) == sorted(components(rows))


def test_rounds_end_with_weak_bitmaps(make_docs, monkeypatch):
    """Bitmaps that let nearly all pass: failed pairs are passed over until none is left."""
    monkeypatch.setattr(J, "overlap_bound", lambda n, m, x, y: min(n, m))
    monkeypatch.setattr(J, "STARS", ("lo",))
    rows = hub(40, 5)
    assert found(make_docs(rows)) == sorted(components(rows))


def test_a_tile_sends_fewer_pairs_than_it_has_nodes():
    pairs = sorted((t, -1.0, a, b) for t in (1, 2) for a in range(30) for b in range(a + 1, 30))
    sent = list(J._forests(pairs, {k: k // 2 for k in range(30)}, 1))
    assert len(sent) == 2 * 14
    assert len(list(J._forests(pairs, {k: k for k in range(30)}, 3))) <= 2 * 3 * 29


def test_a_tile_tells_whether_it_has_more_pairs():
    """Three nodes of one tile in a forest send two of three pairs; in two forests, all."""
    sets = [np.arange(k, k + 90, dtype=np.uint64) for k in range(3)]
    none = pa.array([[]] * 4, pa.list_(pa.int64()))
    maps = [J.bitmap_of(s, J.WIDE) for s in sets]
    rows = pa.table(
        {
            "tile": [1, 1, 1, 2],
            "side": [2] * 4,
            "later": [False] * 4,
            "token": [7, 7, 7, 8],
            "node": [10, 11, 12, 10],
            "root": [10, 11, 12, 10],
            "at": [0] * 4,
            "n": [90] * 4,
            "bitmap": [*maps, maps[0]],
            "failed": none,
        }
    )
    assert [r["more"] for r in J._compared(rows, 1).to_pylist()] == [True, True]
    assert [r["more"] for r in J._compared(rows, 2).to_pylist()] == [False] * 3
    assert J._compared(rows.slice(3), 1).num_rows == 0


def test_stars_of_edges_keep_components():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 60, 4000):
        a, b = (rng.integers(-size, size + 1, size) for _ in range(2))
        up: dict[int, int] = {}

        def top(x, up=up):
            while x in up:
                x = up[x]
            return x

        for u, v in zip(a.tolist(), b.tolist(), strict=True):
            u, v = top(u), top(v)
            if u != v:
                up[max(u, v)] = min(u, v)
        nodes, roots = stars_of(a, b)
        wanted = {x: top(x) for x in {*a.tolist(), *b.tolist()} if top(x) != x}
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == wanted


def test_components_of_a_long_chain(spark):
    edges = spark.range(3000).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b")).repartition(7)
    rows = linked(edges).collect()
    assert len(rows) == len({r.node for r in rows}) == 3001
    assert {r.root for r in rows} == {min(r.node for r in rows)}
