"""Token ids in a packed binary format, written in document order and read back.

The ids of a document are those of a given tokenizer, then an end id.  Segments of about
``SEGMENT_TOKENS`` ids hold the documents in ascending id order.  A segment is one
binary value:

    magic ``PFR1``, then as little-endian uint32: documents, tokens, blocks;
    the documents' token counts; where each block begins; the blocks.

A block is a patched frame of reference of up to ``BLOCK_TOKENS`` ids: uint32 least id,
uint8 width, uint8 unused, uint16 exceptions, the low ``width`` bits of (id - least id)
packed, and the exceptions as uint16 places and uint32 high parts.  The width is that of
the ``PERCENTILE`` of the block's differences, so a few large ids do not widen all; the
block index lets a reader unpack any block alone.

Spark writes and reads the segments as rows of a Parquet table, so a lost executor's
segments are written again and the files may lie in any store.

A null text counts as empty: one end id.  Rows of one id follow each other by text, null
ids come first.  Very long texts fill segments of their own.  An empty table gives no
segment.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.frames import map_batches
from corpusgauge.llm.words import chunks, code_spans_hashed, ranges
from corpusgauge.session import stored

END_ID = 2
BLOCK_TOKENS, SEGMENT_TOKENS, PERCENTILE = 512, 1 << 20, 95
MAGIC = b"PFR1"
#: Blocks packed or unpacked in one go.
_AT_ONCE = 256

# --- encoding texts -----------------------------------------------------------------

#: Pieces a worker remembers at most before it begins anew, and encodes at once.
KNOWN_PIECES, PIECES_AT_ONCE = 1_000_000, 4_096
#: Characters of the longest piece that is kept.
LONGEST_KNOWN = 64
#: Bytes of text encoded at once.
CHUNK_BYTES = 1 << 20
_LETTER, _NUMBER, _SPACE, _OTHER, _ASK = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point; those outside plain Latin text are left to the library."""
    kinds = np.full(0x110000, _ASK, dtype=np.uint8)
    for cp in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20BE)]:
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        kinds[cp] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _SPACE if c.isspace() else _OTHER
    # separators that the two sides may class differently, and contractions
    kinds[[0x1C, 0x1D, 0x1E, 0x1F, ord("'")]] = _ASK
    return kinds


class _Grown:
    """An array that grows at its end."""

    def __init__(self, values: np.ndarray) -> None:
        self.data, self.n = values, len(values)

    def add(self, values: np.ndarray) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            wider = np.empty(max(end, 2 * len(self.data)), dtype=self.data.dtype)
            wider[: self.n] = self.data[: self.n]
            self.data = wider
        self.data[self.n : end] = values
        self.n = end

    def held(self) -> np.ndarray:
        return self.data[: self.n]


class _Known:
    """Pieces and their ids in flat arrays, found by hash and then compared by their text."""

    def __init__(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.codes, self.ids = _Grown(np.zeros(0, np.uint32)), _Grown(np.zeros(0, np.uint32))
        self.code_ends, self.id_ends = _Grown(np.zeros(1, np.int64)), _Grown(np.zeros(1, np.int64))

    def __len__(self) -> int:
        return self.code_ends.n - 1

    def find(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 for none."""
        if not len(self):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        entry = np.where(self.hashes[place] == hashes, self.entry[place], -1)
        ends = self.code_ends.held()
        entry[ends[entry + 1] - ends[entry] != sizes] = -1
        some = np.flatnonzero(entry >= 0)
        if len(some):
            n = sizes[some]
            other = codes[ranges(starts[some], n)] != self.codes.data[ranges(ends[entry[some]], n)]
            entry[some[np.add.reduceat(other, np.cumsum(n) - n, dtype=np.int64) > 0]] = -1
        return entry

    def ids_of(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of entries in order, and how many each has."""
        begin = self.id_ends.data[entry]
        lengths = self.id_ends.data[entry + 1] - begin
        return self.ids.data[ranges(begin, lengths)], lengths

    def add(self, hashes: np.ndarray, codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """New entries by rising hash; of two with one hash the earlier stays."""
        place = np.searchsorted(self.hashes, hashes)
        entry = np.arange(len(self), len(self) + len(hashes))
        fresh = np.ones(len(hashes), dtype=bool)
        if len(self):
            fresh = self.hashes[np.minimum(place, len(self.hashes) - 1)] != hashes
        self.hashes = np.insert(self.hashes, place[fresh], hashes[fresh])
        self.entry = np.insert(self.entry, place[fresh], entry[fresh])
        self.code_ends.add(self.codes.n + np.cumsum(sizes))
        self.id_ends.add(self.ids.n + np.cumsum(lengths))
        self.codes.add(codes)
        self.ids.add(ids)

    def forget(self, n: int) -> None:
        """The ``n`` oldest entries go."""
        for flat, ends in ((self.codes, self.code_ends), (self.ids, self.id_ends)):
            cut = ends.data[n]
            flat.data, flat.n = flat.held()[cut:].copy(), flat.n - int(cut)
            ends.data, ends.n = ends.held()[n:] - cut, ends.n - n
        kept = self.entry >= n
        self.hashes, self.entry = self.hashes[kept], self.entry[kept] - n


@dataclass
class Encoder:
    """Encodes columns; a piece that came before is not encoded again.

    A byte-level tokenizer splits a text by its pattern first and encodes the pieces
    one by one, so the ids of a piece do not depend on its neighbours.  Pieces of plain
    texts are found for all texts of a chunk at once; texts with contractions, special
    tokens or characters outside Latin go to the library whole.
    """

    path: str
    tokenizer: object = None
    known: _Known = field(default_factory=_Known)

    def __post_init__(self) -> None:
        # a task has one core; threads of its own would take those of other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_piece = "ByteLevel" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as uint32."""
        for at in range(0, len(texts), PIECES_AT_ONCE):
            for e in self.tokenizer.encode_batch(texts[at : at + PIECES_AT_ONCE], add_special_tokens=False):
                yield array("I", e.ids).tobytes()

    def _words(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of pieces that are a blank and letters.

        Put one behind the other these pieces are a text that is cut back into them, so
        thousands are encoded in one call; the tokenizer tells which piece an id is of.
        """
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            group = pieces[at : at + PIECES_AT_ONCE]
            found = self.tokenizer.encode("".join(group), add_special_tokens=False)
            of = np.array(found.word_ids, dtype=np.int64)
            if len(of) and of[-1] + 1 != len(group):
                raise ValueError("the tokenizer does not cut pieces as its pattern says")
            cuts = (4 * np.searchsorted(of, np.arange(len(group) + 1))).tolist()
            ids = array("I", found.ids).tobytes()
            yield from (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        plain = [len(p) > 1 and p[0] == " " and p[1].isalpha() for p in pieces]
        words = self._words([p for p, x in zip(pieces, plain, strict=True) if x])
        others = self._whole([p for p, x in zip(pieces, plain, strict=True) if not x])
        return [next(words) if x else next(others) for x in plain]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column in order, and how many each text has."""
        texts = pc.fill_null(column, "").to_pylist()
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        kinds = _classes()[codes]
        ask = np.zeros(len(texts), dtype=bool)
        odd = np.repeat(np.arange(len(texts)), sizes)[kinds == _ASK]
        ask[odd] = True
        for i, t in enumerate(texts):
            if not self.by_piece or any(s in t for s in self.special):
                ask[i] = True
        starts, ends, text = _pieces(codes, kinds, sizes, ask)
        index, table, begin, lengths = self._looked_up(joined, codes, starts, ends)
        flat = table[ranges(begin[index], lengths[index])] if len(index) else np.zeros(0, dtype=np.uint32)
        counts = np.bincount(text, weights=lengths[index], minlength=len(texts)).astype(np.int64)
        if ask.any():
            whole = self._whole([t for t, a in zip(texts, ask, strict=True) if a])
            ends_at = np.cumsum(counts)
            parts = [
                np.frombuffer(next(whole), np.uint32) if a else flat[e - n : e]
                for a, e, n in zip(ask, ends_at, counts, strict=True)
            ]
            return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        return flat, counts

    def _looked_up(
        self, joined: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which different piece each piece is; a table of ids; where in it the ids of
        each different piece begin, and how many they are."""
        hashes, first, back = np.unique(code_spans_hashed(codes, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_PIECES:
            # the older half goes; what is frequent soon comes again
            self.known.forget(len(self.known) // 2)
        # compared by their text, so that no hash decides over ids of another chunk
        starts, sizes = starts[first], ends[first] - starts[first]
        entry = self.known.find(hashes, codes, starts, sizes)
        old, new = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0)
        table, lengths = self.known.ids_of(entry[old])
        if len(new):
            begin_at, n = starts[new], sizes[new]
            texts = [joined[s:e] for s, e in zip(begin_at.tolist(), (begin_at + n).tolist(), strict=True)]
            pieces = self._encoded(texts)
            n_ids = np.array([len(x) // 4 for x in pieces], dtype=np.int64)
            ids = np.frombuffer(b"".join(pieces), dtype=np.uint32)
            short = n <= LONGEST_KNOWN
            kept_ids = ids if short.all() else ids[np.repeat(short, n_ids)]
            self.known.add(hashes[new][short], codes[ranges(begin_at[short], n[short])], n[short], kept_ids, n_ids[short])
            table, lengths = np.concatenate([table, ids]), np.concatenate([lengths, n_ids])
        order = np.empty(len(hashes), dtype=np.int64)
        order[np.concatenate([old, new])] = np.arange(len(hashes))
        begin = np.cumsum(lengths) - lengths
        return back, table, begin[order], lengths[order]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The worker's encoder, which later tasks of the same worker find filled."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(
    codes: np.ndarray, kinds: np.ndarray, sizes: np.ndarray, skip: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the pieces that the byte-level pattern cuts.

    A run of letters, numbers or other marks is a piece, with one blank before it.  Of a
    longer run of white space all but the last character are a piece; the last one is a
    piece, too, unless it is a blank.  White space that ends a text is one piece.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.zeros(n + 1, dtype=bool)
    begin[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    space = kinds == _SPACE
    before = np.empty(n, dtype=kinds.dtype)
    before[1:] = kinds[:-1]
    before[begin[:n]] = 255
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = codes[:-1] == 0x20
    blank_before[begin[:n]] = False
    after = np.zeros(n, dtype=bool)  # a character of this text follows, and is no space
    after[:-1] = ~space[1:] & ~begin[1:n]
    start = begin[:n] | np.where(space, (before != _SPACE) | after, (kinds != before) & ~blank_before)
    at = np.flatnonzero(start)
    ends = np.append(at[1:], n)
    keep = ~skip[text[at]] if n else np.zeros(0, dtype=bool)
    return at[keep], ends[keep], text[at][keep]


# --- the format ---------------------------------------------------------------------


def _kind(width: int) -> np.dtype:
    return np.dtype("<u2" if width <= 16 else "<u4")


def _pack_equal(blocks: np.ndarray) -> list[bytes]:
    """Blocks of equally many ids, one a row; those of one width are packed at once."""
    least = blocks.min(axis=1)
    over = blocks - least[:, None]
    place = -(-PERCENTILE * blocks.shape[1] // 100) - 1
    typical = np.partition(over, place, axis=1)[:, place]
    widths = np.array([max(1, int(t).bit_length()) for t in typical])
    out: list[bytes] = [b""] * len(blocks)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        mine, kind = over[rows], _kind(width)
        low = (mine & np.uint32((1 << width) - 1)).astype(kind)
        bits = np.unpackbits(low.view(np.uint8).reshape(*low.shape, -1), axis=2, bitorder="little")[:, :, :width]
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        high = mine >> np.uint32(width) if width < 32 else np.zeros_like(mine)
        n_odd = np.count_nonzero(high, axis=1)
        for k, row in enumerate(rows.tolist()):
            head = np.array([least[row]], "<u4").tobytes() + bytes([width, 0]) + int(n_odd[k]).to_bytes(2, "little")
            odd = np.flatnonzero(high[k]) if n_odd[k] else np.zeros(0, dtype=np.int64)
            out[row] = head + packed[k].tobytes() + odd.astype("<u2").tobytes() + high[k][odd].astype("<u4").tobytes()
    return out


def pack_block(ids: np.ndarray) -> bytes:
    return _pack_equal(ids.astype(np.uint32).reshape(1, -1))[0]


def _unpack_equal(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Blocks of ``n`` ids each that begin at ``starts``, one a row."""
    heads = data[starts[:, None] + np.arange(8)]
    least = heads[:, :4].copy().view("<u4").astype(np.uint32)
    n_odd = heads[:, 6:8].copy().view("<u2").ravel()
    out = np.empty((len(starts), n), dtype=np.uint32)
    for width in np.unique(heads[:, 4]).tolist():
        rows = np.flatnonzero(heads[:, 4] == width)
        size, kind = -(-n * width // 8), _kind(width)
        packed = data[starts[rows][:, None] + 8 + np.arange(size)]
        wide = np.zeros((len(rows), n, 8 * kind.itemsize), dtype=np.uint8)
        wide[:, :, :width] = np.unpackbits(packed, axis=1, count=n * width, bitorder="little").reshape(-1, n, width)
        over = np.packbits(wide, axis=2, bitorder="little").view(kind)[:, :, 0].astype(np.uint32)
        for k in np.flatnonzero(n_odd[rows]).tolist():
            at, many = int(starts[rows[k]]) + 8 + size, int(n_odd[rows[k]])
            places = data[at : at + 2 * many].view("<u2")
            over[k, places] |= data[at + 2 * many : at + 6 * many].view("<u4").astype(np.uint32) << np.uint32(width)
        out[rows] = over + least[rows]
    return out


def unpack_block(data: bytes, n: int) -> np.ndarray:
    return _unpack_equal(np.frombuffer(data, np.uint8), np.zeros(1, dtype=np.int64), n)[0]


def pack_segment(ids: np.ndarray, counts: np.ndarray) -> bytes:
    whole = len(ids) // BLOCK_TOKENS * BLOCK_TOKENS
    blocks: list[bytes] = []
    for at in range(0, whole, _AT_ONCE * BLOCK_TOKENS):
        blocks += _pack_equal(ids[at : min(whole, at + _AT_ONCE * BLOCK_TOKENS)].reshape(-1, BLOCK_TOKENS))
    if whole < len(ids):
        blocks.append(pack_block(ids[whole:]))
    starts = np.cumsum([0, *map(len, blocks)])[: len(blocks)]
    head = np.array([len(counts), len(ids), len(blocks), *counts, *starts], dtype="<u4")
    return MAGIC + head.tobytes() + b"".join(blocks)


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, counts)`` of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids, n_blocks = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
    counts = np.frombuffer(data, "<u4", n_docs, 16).astype(np.int64)
    starts = np.frombuffer(data, "<u4", n_blocks, 16 + 4 * n_docs).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=16 + 4 * (n_docs + n_blocks))
    whole = n_ids // BLOCK_TOKENS
    parts = [
        _unpack_equal(body, starts[at : min(whole, at + _AT_ONCE)], BLOCK_TOKENS).ravel()
        for at in range(0, whole, _AT_ONCE)
    ]
    if n_blocks > whole:
        parts.append(_unpack_equal(body, starts[whole:], n_ids - whole * BLOCK_TOKENS)[0])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)), counts


# --- writing and reading ----------------------------------------------------------------

_SEGMENTS = "part INT, segment INT, first BIGINT, n_tokens BIGINT, doc_ids ARRAY<BIGINT>, data BINARY"


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` as segments in id order; the table as read back.

    ``part`` numbers the ranges of ids, ``segment`` the segments within one, ``first`` is
    the number of the part's ids before the segment.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = [F.asc_nulls_first("doc_id")]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size, number, first = 0, 0, 0

        def flush(part: int) -> pa.RecordBatch:
            ids, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            names = pa.concat_arrays([h[2] for h in held])
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            values = [part, number, first, len(ids), names.to_pylist(), pack_segment(ids, counts)]
            return pa.record_batch(
                [pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                names=["part", "segment", "first", "n_tokens", "doc_ids", "data"],
            )

        part = 0
        for batch in batches:
            for at, texts in chunks(batch.column("text"), CHUNK_BYTES):
                part = batch.column("part")[0].as_py()
                ids, counts = encoder.encode(texts)
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                held.append((ids, counts + 1, batch.column("doc_id").slice(at, len(texts))))
                size += len(ids)
                if size >= SEGMENT_TOKENS:
                    yield flush(part)
                    held, first, size, number = [], first + size, 0, number + 1
        if held:
            yield flush(part)

    return stored(map_batches(ordered, pack, _SEGMENTS), "tokens")


def described(segments: DataFrame, of_document: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the segments.

    One number for each range of ids, its tokens, comes to the driver to place the
    ranges behind each other.
    """
    crc = of_document or (lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, at = {}, 0
    for r in totals:
        starts[r["part"]] = at
        at += r["n"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, names, data in zip(*(batch.column(c) for c in ("part", "first", "doc_ids", "data")), strict=True):
                ids, counts = unpack_segment(data.as_py())
                ends = np.cumsum(counts)
                base = starts[part.as_py()] + first.as_py()
                marks = [crc(ids[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.record_batch(
                    [names.values, pa.array(base + ends - counts), pa.array(counts), pa.array(marks, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = segments.select("part", "first", "doc_ids", "data")
    return map_batches(
        rows, read, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"
    )
