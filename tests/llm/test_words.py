from __future__ import annotations

import numpy as np
import pyarrow as pa
from brute import LOWER, words
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgauge.llm import words as W

TEXT = st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b x,", max_size=40))


@settings(max_examples=120, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(0, 3))
def test_words_of_a_column(texts, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    found = W.words_of(column, lower=True)
    wanted = [words((t or "").translate(LOWER)) for t in column.to_pylist()]
    assert [found.word(i) for i in range(len(found.starts))] == [w for t in wanted for w in t]
    assert found.counts().tolist() == [len(t) for t in wanted]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(1, 4))
def test_window_hashes_tell_windows_apart(texts, size):
    found = W.words_of(pa.array(texts, pa.string()))
    starts, hashes = W.windows_hashed(found.hashes(), found, size)
    wanted = [tuple(t[i : i + size]) for t in map(words, texts) for i in range(len(t) - size + 1)]
    assert len(starts) == len(wanted)
    assert len(set(zip(wanted, hashes.tolist(), strict=True))) == len(set(wanted)) == len(set(hashes.tolist()))
    assert (W.spans_of_words(found.hashes(), starts, starts + size) == hashes).all()


def test_chunks_cover_all_rows():
    column = pa.array(["a" * 10, None, "b" * 100, "", "c"])
    parts = list(W.chunks(column, limit=12))
    assert [t for _, p in parts for t in p.to_pylist()] == column.to_pylist()
    assert [at for at, _ in parts] == [0, 2, 3]


def test_ranges():
    assert W.ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def thue_morse(letters: int) -> tuple[str, str]:
    """A word and its complement, which polynomials modulo 2**64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(letters)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_patterned_words_have_hashes_of_their_own():
    found = [w for n in (512, 1024, 2048, 4096, 8192) for w in thue_morse(n)]
    column = pa.array([" ".join(found)])
    assert len(set(W.words_of(column).hashes().tolist())) == len(found)
    # equal words, at any place of the bytes
    again = W.words_of(pa.array([f"{'x' * i} {w}" for i, w in enumerate(found, 1)])).hashes()[1::2]
    assert again.tolist() == W.words_of(column).hashes().tolist()
    codes = np.frombuffer("".join(found).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum([len(w) for w in found])
    spans = W.code_spans_hashed(codes, ends - np.array([len(w) for w in found]), ends)
    assert len(set(spans.tolist())) == len(found)


def test_words_that_differ_in_trailing_zeros():
    column = pa.array(["a a\x00 a\x00\x00 \x00a \x00 abcdefgh abcdefgh\x00 bcdefgha"])
    assert len(set(W.words_of(column).hashes().tolist())) == 8
