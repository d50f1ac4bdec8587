from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import encoded
from hypothesis import given, settings
from hypothesis import strategies as st
from test_words import thue_morse

from corpusgauge.llm import token_store as T

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
PLAIN = tokenizers.Tokenizer.from_file(PATH)
ENCODER = T.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aé1²!' \n\tst\xa0\x1c…œ<|endofx>", max_size=40)), max_size=6))
def test_encoder_gives_the_library_s_ids(texts):
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()))
    want = [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_encoder_knows_special_tokens_and_forgets(monkeypatch):
    monkeypatch.setattr(T, "KNOWN_PIECES", 3)
    own = T.Encoder(PATH)
    for text in ("a <|endoftext|> b", "un deux trois quatre", "cinq six sept", "un  deux \n trois"):
        ids, _ = own.encode(pa.array([text, "x y"]))
        assert ids.tolist() == PLAIN.encode(text, add_special_tokens=False).ids + PLAIN.encode("x y").ids


def test_long_patterned_words_keep_their_ids():
    texts = [f"x {w} y" for n in (1024, 4096) for w in thue_morse(n)]
    ids, counts = T.Encoder(PATH).encode(pa.array([" ".join(texts), *texts]))
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in [" ".join(texts), *texts]]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60_000), st.integers(0, 9), st.integers(0, 2**32 - 1)), min_size=1, max_size=600))
def test_block_round_trip(ids):
    values = np.array(ids, dtype=np.uint32)
    assert (T.unpack_block(T.pack_block(values), len(values)) == values).all()


def test_outliers_do_not_widen_a_block():
    values = np.array([7] * 500 + [4_000_000_000] * 5, dtype=np.uint32)
    assert len(T.pack_block(values)) < 8 + 70 + 6 * 5
    assert (T.unpack_block(T.pack_block(values), 505) == values).all()


def test_segment_round_trip():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 900, 20)
    ids = rng.integers(0, 50_257, counts.sum(), dtype=np.uint32)
    back, sizes = T.unpack_segment(T.pack_segment(ids, counts))
    assert (back == ids).all() and (sizes == counts).all()


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_documents_in_order_as_by_brute_force(make_docs, monkeypatch, size):
    monkeypatch.setattr(T, "SEGMENT_TOKENS", size)
    monkeypatch.setattr(T, "chunks", lambda c, _: [(i, c.slice(i, 2)) for i in range(0, len(c), 2)])
    rng = random.Random(3)
    rows = [(i * 7 % 101, " ".join(rng.choices(["één", "zwei", "x", "\n\n", "d's"], k=i % 13))) for i in range(100)]
    rows += [(500, None), (501, "")]
    segments = T.write_segments(make_docs(rows), PATH, partitions=5)
    assert sorted(tuple(r) for r in T.described(segments).collect()) == encoded(rows, PLAIN)


def test_empty_table_and_null_ids(make_docs):
    assert T.described(T.write_segments(make_docs([]), PATH)).collect() == []
    got = T.described(T.write_segments(make_docs([(None, "a"), (3, "b"), (3, "a")]), PATH)).collect()
    assert sorted(((r.doc_id or -1), r.start, r.n_tokens) for r in got) == [(-1, 0, 2), (3, 2, 2), (3, 4, 2)]


def test_known_pieces_are_told_apart_by_their_text(monkeypatch):
    # every piece of one length has one hash; each text is a chunk of its own
    monkeypatch.setattr(T, "code_spans_hashed", lambda codes, starts, ends: (ends - starts).astype(np.uint64))
    monkeypatch.setattr(T, "KNOWN_PIECES", 6)
    own = T.Encoder(PATH)
    words = ["ab", "cd", "abc", "ab", "x", "cde", "y", "cd", "ef", "lengthy", "ab", "x" * 70, "y" * 70, "abc", "z"]
    for word in words:
        ids, counts = own.encode(pa.array([word]))
        assert ids.tolist() == PLAIN.encode(word, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
        found, _ = own.known.ids_of(own.known.entry)
        assert len(found) > 0 and len(own.known) <= 8
