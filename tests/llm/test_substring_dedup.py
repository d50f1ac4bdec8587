from __future__ import annotations

import random

import pytest
from brute import without_repeats

from corpusgauge.llm import substring_dedup as S


def rows(seed: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)

    def some(n: int) -> list[str]:
        return [f"w{rng.randrange(500)}" for _ in range(n)]

    passage, long = some(80), some(400)
    out: list[tuple[int, str | None]] = [(3, None), (4, ""), (5, " \n "), (6, " ".join(some(49)))]
    for i in range(8):
        cut = passage[rng.randrange(20) : 80 - rng.randrange(12)]
        out.append((20 - i, "  ".join(some(rng.randrange(40)) + cut + some(rng.randrange(90)))))
    out += [(40, " ".join(long)), (41, "\n".join(long)), (42, " ".join(long[100:149])), (43, " ".join(long[100:150]))]
    out += [(44, " ".join(["a"] * 130)), (45, " ".join(["a"] * 60)), (40, " ".join(long)), (1, " ".join(long[390:] + some(60)))]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_by_brute_force(make_docs, seed, monkeypatch):
    monkeypatch.setattr(S, "FILTER_BITS", 1 << 20 if seed < 3 else 1 << 15)
    got = sorted(tuple(r) for r in S.digested(make_docs(rows(seed))).collect())
    assert got == sorted(without_repeats(rows(seed)))


def test_kept_text_and_empty_table(make_docs):
    first = " ".join(f"w{i}" for i in range(50))
    docs = make_docs([(1, first), (2, f"é {first}\tende")])
    got = {r.doc_id: r.kept_text for r in S.deduplicated(docs).collect()}
    assert got == {1: first, 2: "é ende"}
    assert S.deduplicated(make_docs([])).collect() == []


def test_null_ids_stand_aside(make_docs):
    text = " ".join(f"w{i}" for i in range(60))
    got = sorted((r.doc_id or -1, r.n_removed) for r in S.digested(make_docs([(None, text), (2, text)])).collect())
    assert got == [(-1, 0), (2, 0)]


@pytest.mark.parametrize("bits", [1 << 15, 1 << 18])
def test_texts_of_one_id_keep_their_own_places(make_docs, bits, monkeypatch):
    monkeypatch.setattr(S, "SEVERAL_BITS", bits, raising=False)
    passage = [f"p{i}" for i in range(60)]
    own = [f"q{i}" for i in range(150)]
    table = [
        (1, " ".join(passage)),
        (7, " ".join(own + passage)),
        (7, " ".join(own)),
        (7, " ".join(own[:20])),
        (7, " ".join(own + passage)),
        (7, None),
        (8, " ".join(passage[5:] + own[:70])),
        (8, " ".join(own[60:])),
    ]
    # one partition: a mark past a short text would fall on the next one's words
    got = sorted(tuple(r) for r in S.digested(make_docs(table).coalesce(1)).collect())
    assert got == sorted(without_repeats(table))
