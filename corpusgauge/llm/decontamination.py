"""Find documents that hold benchmark texts, whole, in part or in another order.

Greedy string tiling: tokens are the lower-cased words without leading and trailing
marks.  The seeds of a benchmark item are all its runs of ``MIN_MATCH`` tokens; a
document that shares seeds with an item is tiled against it, if the item's tokens under
shared seeds, which no tiling exceeds, reach the coverage asked for.  The longest common run of
unmarked tokens is marked in both, again and again, until none of ``MIN_MATCH`` tokens is
left; runs are found by running Karp-Rabin hashes of the seed length and extended along
the diagonal.  The coverage is the share of the item's tokens that are marked, so a
passage whose sentences were put in another order is still found.  An item is held by a
document from ``MIN_COVERAGE`` on, one of ``SHORT_ITEM`` tokens or fewer from
``SHORT_COVERAGE`` on, since a common phrase may be half of it.

The benchmark is taken in blocks of bounded size, each sent to the tasks that scan the
documents, so the seed join needs no shuffle and no document's size or number of hits
moves between tasks.

Null texts hold nothing and are held by nothing; items of fewer than ``MIN_MATCH`` tokens
have one seed, all their tokens; such a phrase is reported, but no document is dropped for
it.  Items without tokens are left out.  Rows of one id are rows of their own; repeated
items are one.  Very long texts are tiled whole.  Columns other than the two ids and texts
are not read, or kept as they are.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.frames import map_batches
from corpusgauge.llm.words import Words, chunks, ranges, spans_of_words, windows_hashed, words_of

MIN_MATCH, MIN_COVERAGE = 5, 0.5
#: Items of so few tokens need more of them.
SHORT_ITEM, SHORT_COVERAGE = 12, 0.8
#: Bytes of benchmark text in one block, on average.
BLOCK_BYTES = 16 << 20


@dataclass
class Seeds:
    """A block of the benchmark: token hashes of the items and their sorted seeds."""

    ids: np.ndarray
    tokens: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    """Place of each seed in its item."""
    short: dict[int, list[int]]
    """Items shorter than a seed by their length."""


def _normal(texts: pa.Array) -> pa.Array:
    """Marks before and after words become blanks; what is inside a word stays."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return pc.replace_substring_regex(lowered, r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", " ")


def seeds_of(ids: list[int], texts: pa.Array) -> Seeds:
    words = words_of(_normal(texts))
    hashes = words.hashes()
    starts, found = windows_hashed(hashes, words, MIN_MATCH)
    counts = words.counts()
    short: dict[int, list[int]] = {}
    more_hash, more_item = [], []
    for i in np.flatnonzero((counts > 0) & (counts < MIN_MATCH)):
        at, end = words.first[i], words.first[i + 1]
        short.setdefault(int(counts[i]), []).append(int(i))
        more_hash.append(spans_of_words(hashes, np.array([at]), np.array([end]))[0])
        more_item.append(i)
    every = np.concatenate([found, np.array(more_hash, dtype=np.uint64)])
    item = np.concatenate([words.text[starts], np.array(more_item, dtype=np.int64)])
    at = np.concatenate([starts - words.first[words.text[starts]], np.zeros(len(more_item), dtype=np.int64)])
    order = np.argsort(every, kind="stable")
    return Seeds(np.array(ids, dtype=np.int64), hashes, words.first, every[order], item[order], at[order], short)


def least_covered(tokens: np.ndarray) -> np.ndarray:
    """Tokens that must be covered of items of so many."""
    share = np.where(tokens <= SHORT_ITEM, SHORT_COVERAGE, MIN_COVERAGE)
    return np.ceil(share * tokens - 1e-9).astype(np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(document position, item position, length)`` of the greedy tiling.

    ``doc`` and ``item`` are token hashes.
    """
    free_doc, free_item = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool)
    found: list[tuple[int, int, int]] = []
    while True:
        best = _longest(doc, item, free_doc, free_item, least)
        if not best:
            return found
        for d, i, n in best:
            # an earlier tile of this round may have taken part of it
            if free_doc[d : d + n].all() and free_item[i : i + n].all():
                free_doc[d : d + n] = False
                free_item[i : i + n] = False
                found.append((d, i, n))


def _longest(
    doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, least: int
) -> list[tuple[int, int, int]]:
    """All matches of the greatest length among the unmarked tokens."""
    d_at, d_hash = _free_windows(doc, free_doc, least)
    i_at, i_hash = _free_windows(item, free_item, least)
    order = np.argsort(i_hash, kind="stable")
    lo = np.searchsorted(i_hash[order], d_hash, side="left")
    hi = np.searchsorted(i_hash[order], d_hash, side="right")
    many = hi - lo
    if not many.sum():
        return []
    d = np.repeat(d_at, many)
    i = i_at[order][np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    # seeds that follow each other on a diagonal make one match
    sort = np.lexsort((d, d - i))
    d, i = d[sort], i[sort]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] - i[1:] != d[:-1] - i[:-1]) | (d[1:] != d[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(d))) - 1 + least
    top = length.max()
    at = begin[length == top]
    return sorted((int(a), int(b), int(top)) for a, b in zip(d[at], i[at], strict=True))


def _free_windows(tokens: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return at, spans_of_words(tokens, at, at + size)


def _matches(texts: pa.Array, seeds: Seeds) -> Iterator[tuple[int, int, int, int, int]]:
    """``(text, item, covered tokens, tokens of the item, tiles)`` of all held items."""
    words = words_of(_normal(texts))
    hashes = words.hashes()
    for text, i in _promising(words, hashes, seeds):
        item = seeds.tokens[seeds.first[i] : seeds.first[i + 1]]
        doc = hashes[words.first[text] : words.first[text + 1]]
        # words the item does not have cannot be in a tile
        found = tiles(doc, item, min(MIN_MATCH, len(item)))
        covered = sum(n for _, _, n in found)
        if covered >= least_covered(np.array(len(item))):
            yield text, i, covered, len(item), len(found)


def _promising(words: Words, hashes: np.ndarray, seeds: Seeds) -> list[tuple[int, int]]:
    """``(text, item)`` in order, where the item's tokens under shared seeds suffice."""
    texts, items, places, widths = [], [], [], []
    for size in (MIN_MATCH, *sorted(seeds.short)):
        starts, found = windows_hashed(hashes, words, size)
        lo = np.searchsorted(seeds.hashes, found, side="left")
        inside = lo < len(seeds.hashes)
        inside[inside] = seeds.hashes[lo[inside]] == found[inside]
        text, first = words.text[starts[inside]], lo[inside]
        # a seed that a text has several times counts once
        text, first = np.unique(np.stack([text, first]), axis=1) if len(text) else (text, first)
        many = np.searchsorted(seeds.hashes, seeds.hashes[first], side="right") - first
        seed = ranges(first, many)
        texts.append(np.repeat(text, many))
        items.append(seeds.item[seed])
        places.append(seeds.at[seed])
        widths.append(np.full(len(seed), size))
    text, item, place, width = (np.concatenate(x) for x in (texts, items, places, widths))
    if not len(text):
        return []
    order = np.lexsort((place, item, text))
    text, item, place, width = text[order], item[order], place[order], width[order]
    last = np.ones(len(text), dtype=bool)
    last[:-1] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    # each seed covers its tokens up to the next one of the pair
    covers = width.copy()
    covers[:-1] = np.where(last[:-1], width[:-1], np.minimum(width[:-1], place[1:] - place[:-1]))
    group = np.cumsum(np.concatenate([[0], last[:-1]]))
    total = np.bincount(group, weights=covers).astype(np.int64)
    held = item[last]
    keep = total >= least_covered(seeds.first[held + 1] - seeds.first[held])
    return list(zip(text[last][keep].tolist(), held[keep].tolist(), strict=True))


def _blocks(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The benchmark's seeds, block by block of bounded size, for the tasks to share."""
    items = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = part.orderBy("item_id", "text").toArrow()
        seeds = seeds_of(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks())
        yield benchmark.sparkSession.sparkContext.broadcast(seeds)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, covered, item_tokens, n_tiles, coverage`` of all held items."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id BIGINT, item_id BIGINT, covered BIGINT, item_tokens BIGINT, n_tiles BIGINT"
    found = None
    for shared in _blocks(benchmark):

        def scan(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, texts in chunks(batch.column("text")):
                    hits = list(_matches(texts, shared.value))
                    text, item, *counts = (np.array([h[k] for h in hits], dtype=np.int64) for k in range(5))
                    yield pa.record_batch(
                        [
                            batch.column("doc_id").take(pa.array(text + at)),
                            pa.array(shared.value.ids[item], pa.int64()),
                            *[pa.array(c) for c in counts],
                        ],
                        names=["doc_id", "item_id", "covered", "item_tokens", "n_tiles"],
                    )

        of_block = map_batches(rows, scan, schema)
        found = of_block if found is None else found.unionByName(of_block)
    return found.withColumn("coverage", F.round(F.col("covered") / F.col("item_tokens"), 6))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; nothing is shuffled."""
    for shared in _blocks(benchmark):

        def clean(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for at, texts in chunks(batch.column("text")):
                    keep[[at + hit[0] for hit in _matches(texts, shared.value) if hit[3] >= MIN_MATCH]] = False
                yield batch.filter(pa.array(keep))

        docs = map_batches(docs, clean, docs.schema)
    return docs
