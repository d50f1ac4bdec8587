"""Language of a text, by hyperdimensional profiles of its letter n-grams.

Each letter has a random vector of ``DIMENSIONS`` signs, drawn from its code point alone.
An n-gram binds its letters: the vector of the letter ``k`` places from its end, permuted
``k`` times (rolled by ``k``), multiplied entry by entry with the others.  A text bundles
(adds) the vectors of all its n-grams, a language those of all its labelled texts.  The
language whose prototype has the greatest cosine with the text is predicted.  What all
languages share is taken out first: the mean of the prototypes, each at length 1, is
subtracted from them.

Texts are lower-cased; what is no letter, however long, is one space, and a space stands
before and after.  Prototypes are whole-number sums over all labelled rows that are not
held out, so they do not depend on the order of rows or tasks.  Held out are the rows for
which ``crc32`` of the id as text, modulo 4, is 2.

A null text, or one without a letter, has the language ``und`` and score 0.  Rows with a
null language are not learned from; a null id is not held out.  Where nothing can be
learned, all are ``und``.  Ties go to the language first by code point.  Repeated rows
count as often as they stand.  Very long texts are taken whole, ``words.CHUNK_BYTES`` of
shorter ones at a time.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.frames import map_batches
from corpusgauge.llm.words import chunks

GRAM, DIMENSIONS = 3, 1024
UNKNOWN = "und"
#: Texts, and kinds of n-grams, in one matrix of counts.
TEXTS_AT_ONCE, GRAMS_AT_ONCE = 256, 4_096
_LETTERS = regex.compile(r"\p{L}+")


# --- vectors -------------------------------------------------------------------------------

_known: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    """The signs of a letter, the same in every task and session."""
    if code not in _known:
        if len(_known) > 20_000:
            _known.clear()
        _known[code] = np.random.default_rng([17, code]).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1
    return _known[code]


def gram_vectors(grams: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """A row of signs for each n-gram, as ``grams_of`` numbers them."""
    signs = np.stack([letter_vector(int(c)) for c in alphabet])
    out = signs[grams % len(alphabet)]
    for k in range(1, GRAM):
        out *= np.roll(signs, k, axis=1)[grams // len(alphabet) ** k % len(alphabet)]
    return out


def _present(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each value among them."""
    if below > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(below, dtype=bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[values]


def grams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all texts, the index of each one's text, and the letters in use.

    An n-gram is a number with the places of its letters in ``alphabet`` as digits, the
    last letter lowest.  Texts without a letter have none.
    """
    found = [_LETTERS.findall((t or "").lower()) for t in texts.to_pylist()]
    spaced = [f" {' '.join(words)} " if words else "" for words in found]
    codes = np.frombuffer("".join(spaced).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(spaced)), [len(s) for s in spaced])
    alphabet, digit = _present(codes, 0x110000)
    n = max(0, len(codes) - GRAM + 1)
    out = np.zeros(n, dtype=np.int64)
    for k in range(GRAM):
        out = out * len(alphabet) + digit[k : k + n]
    whole = text[:n] == text[len(text) - n :]
    return out[whole], text[:n][whole], alphabet


def bundles(texts: pa.Array, groups: np.ndarray, n_groups: int) -> np.ndarray:
    """The sum of the n-gram vectors of each group of texts; whole numbers."""
    grams, text, alphabet = grams_of(texts)
    kinds, at = _present(grams, len(alphabet) ** GRAM)
    group = groups[text]
    out = np.zeros((n_groups, DIMENSIONS))
    for begin in range(0, len(kinds), GRAMS_AT_ONCE):
        block = kinds[begin : begin + GRAMS_AT_ONCE]
        mine = slice(None) if len(block) == len(kinds) else (at >= begin) & (at < begin + len(block))
        counts = np.bincount(group[mine] * len(block) + at[mine] - begin, minlength=n_groups * len(block))
        out += counts.reshape(n_groups, len(block)).astype(np.float32) @ gram_vectors(block, alphabet)
    return out


# --- languages -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Profiles:
    """Languages in order, their prototypes less what all share, at length 1, and that."""

    languages: list[str]
    prototypes: np.ndarray
    shared: np.ndarray

    def scores(self, texts: np.ndarray) -> np.ndarray:
        """Cosines of bundled texts with every prototype."""
        return _unit(_unit(texts) - self.shared) @ self.prototypes.T


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def profiles_of(languages: list[str], sums: np.ndarray) -> Profiles:
    raw = _unit(sums)
    # of one language nothing is shared
    shared = raw.mean(axis=0) if len(raw) > 1 else np.zeros(DIMENSIONS)
    return Profiles(languages, _unit(raw - shared), shared)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    for at, texts in chunks(column):
        for more in range(0, len(texts), TEXTS_AT_ONCE):
            yield at + more, texts.slice(more, TEXTS_AT_ONCE)


def learn(labelled: DataFrame) -> Profiles | None:
    """Profiles of the languages of ``labelled(text, lang)``, of all its rows.

    Every task adds up its texts; a row for each language and dimension is combined before
    the shuffle, and one vector for each language comes to the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, texts in _slices(batch.column("text")):
                names = batch.column("lang").slice(at, len(texts)).to_pylist()
                kinds = sorted(set(names))
                group = np.array([kinds.index(n) for n in names])
                for name, vector in zip(kinds, bundles(texts, group, len(kinds)), strict=True):
                    sums[name] = sums.get(name, 0) + vector
        for name, vector in sums.items():
            yield pa.record_batch(
                [
                    pa.array([name] * DIMENSIONS),
                    pa.array(np.arange(DIMENSIONS), pa.int32()),
                    pa.array(vector.astype(np.int64)),
                ],
                names=["lang", "i", "v"],
            )

    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    parts = map_batches(rows, add, "lang STRING, i INT, v BIGINT").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in parts.collect():
        found.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["v"]
    languages = sorted(name for name, vector in found.items() if vector.any())
    return profiles_of(languages, np.stack([found[name] for name in languages])) if languages else None


def identified(docs: DataFrame, profiles: Profiles | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs(doc_id, text)``.

    ``score`` is the cosine with the predicted language, 0 where it is negative.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _slices(batch.column("text")):
                vectors = bundles(texts, np.arange(len(texts)), len(texts))
                known = vectors.any(axis=1) & (profiles is not None)
                names, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                if known.any():
                    cosines = profiles.scores(vectors[known])
                    best = cosines.argmax(axis=1)
                    names[known] = [profiles.languages[b] for b in best]
                    score[known] = np.clip(cosines[np.arange(len(best)), best], 0, 1)
                yield pa.record_batch(
                    [
                        *[batch.column(c).slice(at, len(texts)) for c in ("doc_id", "held_out")],
                        pa.array(names, pa.string()),
                        pa.array(score),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, predict, "doc_id BIGINT, held_out BOOLEAN, lang_pred STRING, score DOUBLE")


def languages(docs: DataFrame) -> DataFrame:
    """Languages of ``docs``, learned from those of its rows that are not held out."""
    return identified(docs, learn(docs.filter(~held_out(F.col("doc_id")))))
