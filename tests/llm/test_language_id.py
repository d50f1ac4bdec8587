"""Hyperdimensional language profiles."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusgauge.llm import language_id as L
from corpusgauge.llm.frames import table
from corpusgauge.llm.queries import op13_language_id

SF = "/root/testdata/sf0.001"


def plain_bundle(text: str) -> np.ndarray:
    """Rolled letter signs multiplied within an n-gram, added over all n-grams."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = np.zeros(L.DIMENSIONS)
    padded = f" {' '.join(letters)} " if letters else ""
    for i in range(len(padded) - L.GRAM + 1):
        gram = np.ones(L.DIMENSIONS)
        for k, c in enumerate(reversed(padded[i : i + L.GRAM])):
            gram = gram * np.roll(L.letter_vector(ord(c)), k)
        out += gram
    return out


TEXTS = ["Der Hund, der bellt", "a", "", None, " 12 34 ", "ÄÖÜ straße 漢字", "x" * 50, "one two\n\nthree"]


def test_bundles_equal_the_definition():
    got = L.bundles(pa.array(TEXTS), np.arange(len(TEXTS)), len(TEXTS))
    for text, vector in zip(TEXTS, got, strict=True):
        assert np.array_equal(vector, plain_bundle(text or "")), text
    both = L.bundles(pa.array(TEXTS), np.array([0, 1] * 4), 2)
    assert np.array_equal(both[0], got[::2].sum(axis=0))


def test_many_kinds_of_letters(monkeypatch):
    text = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 700))
    monkeypatch.setattr(L, "GRAMS_AT_ONCE", 64)
    assert np.array_equal(L.bundles(pa.array([text]), np.zeros(1, dtype=int), 1)[0], plain_bundle(text))


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    got = op13_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    apart = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in apart) >= 0.97 * len(apart) > 20
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_is_the_brute_force_cosine(spark):
    docs = [r for r in table(spark, SF, "documents").collect()]
    train = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 != 2 and len(d.text) < 1500]
    some = spark.createDataFrame(train)
    profiles = L.learn(some)
    sums = {k: sum(plain_bundle(d.text) for d in train if d.lang == k) for k in sorted({d.lang for d in train})}
    raw = np.stack([v / np.linalg.norm(v) for v in sums.values()])
    centred = raw - raw.mean(axis=0)
    centred /= np.linalg.norm(centred, axis=1, keepdims=True)
    for r in L.identified(some, profiles).collect()[:40]:
        v = plain_bundle(next(d.text for d in train if d.doc_id == r.doc_id))
        v = v / np.linalg.norm(v) - raw.mean(axis=0)
        cosines = centred @ v / np.linalg.norm(v)
        assert r.lang_pred == list(sums)[int(cosines.argmax())] and r.score == pytest.approx(max(0, cosines.max()), abs=1e-6)


def test_nulls_empty_texts_repeats_and_empty_tables(spark, make_docs):
    rows = [(1, "the cat and the dog"), (1, "the cat and the dog"), (2, None), (3, ""), (4, " .,-_ 12"), (None, "the cat"), (5, "the")]
    got = L.languages(make_docs(rows)).collect()
    assert len(got) == 7
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"} and all(r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    assert {r.lang_pred for r in got if r.doc_id in (1, 5)} == {"en"}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert L.languages(make_docs([])).collect() == []
    unlabelled = make_docs(rows).drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in L.languages(unlabelled).collect()} == {"und"}


def test_very_long_texts(make_docs):
    long = "the quick brown fox jumps over lazy dogs " * 60_000
    got = L.languages(make_docs([(1, long), (3, "z" * 3_000_000), (4, "the fox")])).collect()
    assert len(got) == 3 and {r.lang_pred for r in got} == {"en"}
