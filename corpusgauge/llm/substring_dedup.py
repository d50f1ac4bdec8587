"""Remove long word runs that an earlier document has already.

A window is ``WINDOW`` consecutive words.  A window of a document goes if the same
words also start somewhere in a document of a smaller id; a word goes if a window that
covers it goes.  Windows are judged on the input, not on what is left.

Fixed-block anchors find the repeats.  Every document's aligned, non-overlapping blocks
of ``BLOCK`` words are the index; every rolling window of ``BLOCK`` words of every
document probes it.  Any ``WINDOW`` words hold a whole aligned block of their own
document, so of two equal windows in two documents both hold a block that the index and
another document share.  Such hits are extended to all windows around them, and the
windows are compared in full by their hashes, the smallest id winning; the removed runs
are the union of the windows, that is the maximal repeats.

Before probes are shuffled, a filter of fixed size over the index drops those that hit
nothing; where it fills up it drops less, and results stay the same.  A hot passage
costs no more than its occurrences: minima are combined before the shuffle, no pairs
are formed.

A null text counts as empty.  Rows of one id are one document for the question "in a
smaller id", whatever their texts; the places of a window are those of one text, so they
go back to the rows of that id and text only.  Rows of a null id remove nothing from
others and lose nothing.  Equal rows give equal results.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm import frames
from corpusgauge.llm.words import Words, chunks, ranges, spans_of_words, windows_hashed, words_of

WINDOW = 50
BLOCK = 25
#: Bits of the filters over block hashes (32 MB each).
FILTER_BITS = 1 << 28
#: Bits of the filter over ids of several texts (4 KB, a literal of the plan).
SEVERAL_BITS = 1 << 15


def _scanned(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Words, np.ndarray]]:
    for at, texts in chunks(batch.column("text")):
        ids = batch.column("doc_id").slice(at, len(texts)).to_numpy(zero_copy_only=False)
        words = words_of(texts)
        yield ids, words, words.hashes()


def _hash_rows(ids: np.ndarray, hashes: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    columns = {"h": pa.array(hashes.view(np.int64)), "doc_id": pa.array(ids, pa.int64())}
    return pa.record_batch(columns | {k: pa.array(v) for k, v in more.items()})


def with_text_key(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_key``: which of its id's texts a row has.

    The key is the text's hash where the id may have several texts and 0 elsewhere, so
    that the many windows of all other ids carry no bits for it.  Where the filter over
    such ids fills up, more keys are hashes and results stay the same.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = rows.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t"))
    several = hashed.groupBy("doc_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi")
    known = frames.membership_bits(several.select(F.xxhash64("doc_id").alias("h")), "h", SEVERAL_BITS)
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(SEVERAL_BITS - 1)).cast("int")
    byte = F.substr(F.lit(known), F.shiftright(place, 3) + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), place.bitwiseAND(F.lit(7)))
    return rows.withColumn("text_key", F.when(bit == 1, F.xxhash64("text")).otherwise(F.lit(0).cast("long")))


def index_blocks(docs: DataFrame) -> DataFrame:
    """``h``: hashes of the aligned blocks of all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, hashes in _scanned(batch):
                per_text = words.counts() // BLOCK
                starts = ranges(np.zeros(len(per_text), dtype=np.int64), per_text) * BLOCK
                starts += np.repeat(words.first[:-1], per_text)
                found = spans_of_words(hashes, starts, starts + BLOCK)
                yield pa.record_batch({"h": pa.array(found.view(np.int64))})

    return frames.map_batches(docs.select("doc_id", "text"), scan, "h BIGINT")


def probes(docs: DataFrame, index: bytes) -> DataFrame:
    """``h, doc_id, anchor``: rolling blocks that may be in the index."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, hashes in _scanned(batch):
                starts, found = windows_hashed(hashes, words, BLOCK)
                keep = frames.maybe_members(index, found)
                starts, found = starts[keep], found[keep]
                text = words.text[starts]
                yield _hash_rows(ids[text], found, anchor=(starts - words.first[text]) % BLOCK == 0)

    return frames.map_batches(docs.select("doc_id", "text"), scan, "h BIGINT, doc_id BIGINT, anchor BOOLEAN")


def shared_anchors(found: DataFrame) -> DataFrame:
    """``h`` of the blocks that are in the index and in two documents."""
    grouped = found.groupBy("h").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max("anchor").alias("anchor")
    )
    return grouped.filter("anchor AND lo <> hi").select("h")


def candidate_windows(docs: DataFrame, anchors: bytes) -> DataFrame:
    """``h, doc_id, text_key, start``: the windows that hold an anchor block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            row = 0
            for ids, words, hashes in _scanned(batch):
                key, row = keys[row : row + len(ids)], row + len(ids)
                blocks, found = windows_hashed(hashes, words, BLOCK)
                hits = blocks[frames.maybe_members(anchors, found)]
                # a window at s holds the block at b if s <= b <= s + WINDOW - BLOCK
                marks = np.zeros(len(hashes) + 1, dtype=np.int64)
                np.add.at(marks, np.maximum(hits - (WINDOW - BLOCK), 0), 1)
                np.add.at(marks, hits + 1, -1)
                near = np.cumsum(marks[:-1]) > 0
                starts, found = windows_hashed(hashes, words, WINDOW)
                keep = near[starts] if len(starts) else np.zeros(0, dtype=bool)
                starts, found = starts[keep], found[keep]
                text = words.text[starts]
                at = (starts - words.first[text]).astype(np.int32)
                yield _hash_rows(ids[text], found, text_key=key[text], start=at)

    schema = "h BIGINT, doc_id BIGINT, text_key BIGINT, start INT"
    return frames.map_batches(docs.select("doc_id", "text", "text_key"), scan, schema)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``id, key, starts``: of each id's texts (see ``with_text_key``) the windows that a smaller id has, too."""
    docs = docs.filter("doc_id IS NOT NULL")
    index = frames.membership_bits(index_blocks(docs), "h", FILTER_BITS)
    anchors = frames.membership_bits(shared_anchors(probes(docs, index)), "h", FILTER_BITS)
    # scanned twice rather than written: minima are combined before their shuffle, and the
    # join may split a window that very many documents have; one table, so that executors
    # get the filter once
    windows = candidate_windows(docs, anchors)
    least = windows.groupBy(F.col("h").alias("g")).agg(F.min("doc_id").alias("owner"))
    late = windows.join(least, F.col("h") == F.col("g")).filter("doc_id > owner")
    texts = late.groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    return texts.agg(F.sort_array(F.collect_set("start")).alias("starts"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row of ``docs(doc_id, text)``.

    ``kept_text`` holds the kept words, joined by one space.
    """
    rows = with_text_key(docs)
    late = repeated_windows(rows)
    same = (F.col("doc_id") == F.col("id")) & (F.col("text_key") == F.col("key"))
    met = rows.join(late, same, "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text")):
                words = words_of(texts)
                starts = batch.column("starts").slice(at, len(texts))
                counts = np.array([0 if s is None else s for s in starts.value_lengths().to_pylist()], dtype=np.int64)
                flat = starts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = flat + np.repeat(words.first[:-1], counts)
                marks = np.zeros(len(words.starts) + 1, dtype=np.int64)
                np.add.at(marks, flat, 1)
                np.add.at(marks, flat + WINDOW, -1)
                gone = np.cumsum(marks[:-1]) > 0
                removed = np.bincount(words.text[gone], minlength=len(texts))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(words.counts(), pa.int64()),
                        pa.array(removed, pa.int64()),
                        _joined(words, ~gone),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return frames.map_batches(met, cut, "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, kept_text STRING")


def _joined(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by a space, put together without a loop."""
    lengths = (words.ends - words.starts)[kept]
    text = words.text[kept]
    last = np.ones(len(text), dtype=bool)
    last[:-1] = text[1:] != text[:-1]
    spaced = lengths + ~last
    data = np.full(int(spaced.sum()), 0x20, dtype=np.uint8)
    begins = np.cumsum(spaced) - spaced
    data[ranges(begins, lengths)] = words.data[ranges(words.starts[kept], lengths)]
    sizes = np.bincount(text, weights=spaced, minlength=words.n_texts).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(words.n_texts, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def digested(docs: DataFrame) -> DataFrame:
    """``deduplicated`` with the SHA-256 of the kept text in its place."""
    return deduplicated(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )
