"""Exact similarity join of documents on 5-word shingles, and its classes.

Two documents are linked when the Jaccard similarity of their shingle sets is at least
``PERCENT`` / 100.  Documents of equal sets are one node.  The join is exact:

1. *Tiles.*  A linked pair shares a token among the first ``n - ceil(0.75 n) + 1`` of
   each set in a common token order, so the nodes that share such a token make a tile.
   Rare tokens come first in the order: tokens that are frequent in a sample of the
   documents, one of ``SAMPLE_EVERY``, are put last.  The sample steers only the order, never the result.
2. *Links to a few nodes* of each tile are checked, and joined to components: the least
   and the greatest node, in two orders of the digests.  That makes most groups of near
   copies one component, however many there are.
3. *Tiles of more than one component* are banded by set size, with bands of the ratio
   4/3: sizes of a linked pair differ by no more, so a band is compared with itself and
   the next one.  Large ones are cut into blocks of about ``BLOCK`` nodes, so that no task
   holds a whole hot tile.  A pair is taken only if its token may be the first the two
   have in common: the tokens that follow must suffice for a link.  Of a linked pair, the
   smaller set has that token among its first ``n - ceil(6 n / 7) + 1``, so a tile needs
   such a member.
4. A pair is held against sizes, then against the *bitmap* of each set (the parity of its
   hashed tokens; every differing bit stands for a differing token, so the bit count bounds
   the overlap from above).  Of the pairs that pass, a tile sends a *forest* over its
   components, nearest pairs first: fewer pairs than it has nodes.  These are verified by
   the exact intersection of both sorted arrays.  Where all hold, whatever else the tile
   has is connected, too.  Tiles of which a pair failed and that have pairs not sent yet go
   into another round, without that pair and with ``MORE_FORESTS`` times as many forests,
   until none is left.

Shingles are 63-bit hashes and nodes 64-bit digests of the sorted set.  A null text or
one without words has an empty set and is linked with nothing.  Repeated rows and ids
give a row each; the smallest id names a class, and a null one only where it has no other.
Very long texts have large sets, which are cut nowhere.  An empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are not read, or kept as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm import frames
from corpusgauge.llm.components import components
from corpusgauge.llm.words import chunks, lists, words_of, windows_hashed, spans_of_words
from corpusgauge.session import stored

SHINGLE, PERCENT = 5, 75
#: Nodes of a tile compared at once in one task.
BLOCK = 256
#: Bits of a bitmap for each token: those that tiles are compared by, and of a first look.
WIDE, NARROW = 2, 1
#: How many forests more a tile sends in each round.
MORE_FORESTS = 16
#: One document of so many is sampled to find frequent tokens; how often these stand there.
SAMPLE_EVERY, FREQUENT_FROM = 8, 4
#: Bits of the filters that tell a scan which texts are wanted, and tokens frequent (4 MB).
FILTER_BITS = 1 << 25

_TOP = np.uint64(1 << 63)
#: Nodes of a tile that all others are compared with first.
STARS = ("lo", "hi", "lo2", "hi2")
_OTHER_ORDER = 0x2D51C6A7F3098B4E


def shingle_sets(column: pa.Array, frequent: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of all texts, and how many each text has.

    A token is the hash of five words (or of all words of a shorter text) without its
    lowest bit; frequent ones have the top bit set, and so come last.
    """
    words = words_of(column, lower=True)
    hashes = words.hashes()
    starts, grams = windows_hashed(hashes, words, SHINGLE)
    text = words.text[starts]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = spans_of_words(hashes, words.first[short], words.first[short + 1])
    tokens, text = np.concatenate([grams, whole]) >> np.uint64(1), np.concatenate([text, short])
    if len(frequent) and len(tokens):
        tokens = np.where(frames.maybe_members(frequent, tokens), tokens | _TOP, tokens)
    order = np.lexsort((tokens, text))
    tokens, text = tokens[order], text[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    return tokens[new], np.bincount(text[new], minlength=len(column))


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (PERCENT * n + 99) // 100 + 1


def bitmap_of(tokens: np.ndarray, wide: int = NARROW) -> bytes:
    """Parity bits of the hashed tokens; about ``wide`` bits a token."""
    bits = 1 << max(6, int(wide * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def overlap_bound(n: int, m: int, x: np.ndarray, y: np.ndarray) -> int:
    """No more tokens than these are common to two sets of bitmaps ``x`` and ``y``."""
    # a larger bitmap folds onto a smaller one, since both take the hash by a power of two
    while len(x) > len(y):
        x = _folded(x)
    while len(y) > len(x):
        y = _folded(y)
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2


def _folded(x: np.ndarray) -> np.ndarray:
    half = x.shape[-1] // 2
    return x[..., :half] ^ x[..., half:]


def needed(n: int, m: int) -> int:
    """Least overlap of linked sets: 100 i >= 75 (n + m - i)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _scan(
    docs: DataFrame, frequent: bytes, what: str, wanted: bytes = b"", tag: str | None = None
) -> DataFrame:
    """One pass over the texts, giving for each document what ``what`` names.

    ``nodes``: ``doc_id, tag, t, n, node``, with the text's hash ``t``.  ``tiles``: ``node,
    near, tokens``, the prefix and the part of it that counts for the smaller set.
    ``maps``: ``node, n, narrow, bitmap`` and ``sets``: ``node, tokens`` of the texts whose
    hash may be in the filter ``wanted``; other texts are not cut into shingles.
    """
    schema = {
        "nodes": "doc_id BIGINT, tag BIGINT, t BIGINT, n BIGINT, node BIGINT",
        "tiles": "node BIGINT, near INT, tokens ARRAY<BIGINT>",
        "maps": "node BIGINT, n BIGINT, narrow BINARY, bitmap BINARY",
        "sets": "node BIGINT, tokens BINARY",
    }[what]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if what in ("maps", "sets"):
                hashes = batch.column("t").to_numpy().view(np.uint64)
                batch = batch.filter(pa.array(frames.maybe_members(wanted, hashes), pa.bool_()))
            for at, texts in chunks(batch.column("text")):
                tokens, counts = shingle_sets(texts, frequent)
                ends = np.cumsum(counts)
                full = np.flatnonzero(counts)
                nodes = np.array([node_of(tokens[ends[i] - counts[i] : ends[i]]) for i in full], dtype=np.int64)
                if what == "nodes":
                    column = np.zeros(len(texts), dtype=np.int64)
                    column[full] = nodes
                    yield pa.record_batch(
                        [
                            batch.column("doc_id").slice(at, len(texts)),
                            batch.column("tag").slice(at, len(texts)),
                            batch.column("t").slice(at, len(texts)),
                            pa.array(counts, pa.int64()),
                            pa.array(column, mask=counts == 0),
                        ],
                        names=["doc_id", "tag", "t", "n", "node"],
                    )
                    continue
                if what == "tiles":
                    sizes = prefix_length(counts[full])
                    firsts = [tokens[ends[i] - counts[i] :][:k] for i, k in zip(full, sizes, strict=True)]
                    flat = np.concatenate(firsts) if firsts else np.zeros(0, dtype=np.uint64)
                    yield pa.record_batch(
                        [
                            pa.array(nodes),
                            pa.array(counts[full] - (6 * counts[full] + 6) // 7 + 1, pa.int32()),
                            lists(flat.view(np.int64), sizes, pa.int64()),
                        ],
                        names=["node", "near", "tokens"],
                    )
                    continue
                sets = [tokens[ends[i] - counts[i] : ends[i]] for i in full]
                columns = {"node": pa.array(nodes)}
                if what == "maps":
                    columns["n"] = pa.array(counts[full], pa.int64())
                    columns["narrow"] = pa.array([bitmap_of(s) for s in sets], pa.binary())
                    columns["bitmap"] = pa.array([bitmap_of(s, WIDE) for s in sets], pa.binary())
                else:
                    columns["tokens"] = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.record_batch(columns)

    columns = [F.col("text")]
    if what != "tiles":
        columns.append(F.xxhash64("text").alias("t"))
    if what == "nodes":
        named = F.col(tag) if tag else F.lit(None)
        columns += [F.col("doc_id").cast("long").alias("doc_id"), named.cast("long").alias("tag")]
    return frames.map_batches(docs.select(*columns), scan, schema)


def frequent_tokens(docs: DataFrame) -> bytes:
    """A filter over the tokens that are frequent in a sample of ``docs``.

    Tokens it holds by chance come last in the order, too, in all documents alike.
    """
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_EVERY)) == 0)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column("text")):
                found, _ = shingle_sets(texts, b"")
                yield pa.record_batch([pa.array(found.view(np.int64))], names=["token"])

    counted = frames.map_batches(sample.select("text"), tokens, "token BIGINT").groupBy("token").count()
    return frames.membership_bits(counted.filter(F.col("count") >= FREQUENT_FROM), "token", FILTER_BITS)


def _both(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``pairs(a, b)`` with the columns of both nodes, as ``a_...`` and ``b_...``."""
    for side in ("a", "b"):
        named = [F.col(c).alias(f"{side}_{c}") for c in columns]
        pairs = pairs.join(rows.select(F.col("node").alias(side), *named), side)
    return pairs


def _bounded(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sizes and bit counts allow a link."""
    met = _both(pairs, maps, "n", "narrow")
    met = met.filter((F.col("a_n") * 100 >= F.col("b_n") * PERCENT) & (F.col("b_n") * 100 >= F.col("a_n") * PERCENT))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("a_n", "b_n", "a_narrow", "b_narrow"))
            keep = [
                overlap_bound(n, m, np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) >= needed(n, m)
                for n, m, x, y in zip(*columns, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return frames.map_batches(met, bound, "a BIGINT, b BIGINT")


def _texts_of(wanted: DataFrame, nodes: DataFrame) -> bytes:
    """A filter over the hashes of the texts that have one of the ``node``s wanted."""
    named = wanted.select(F.col("node").alias("w")).distinct()
    return frames.membership_bits(nodes.join(named, F.col("node") == F.col("w"), "left_semi").select("t"), "t", FILTER_BITS)


def _linked(pairs: DataFrame, docs: DataFrame, frequent: bytes, nodes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are linked, by intersecting their sorted arrays.

    The arrays of the nodes in question are taken from their texts in one more scan.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _scan(docs, frequent, "sets", _texts_of(ends, nodes)).dropDuplicates(["node"])
    met = _both(pairs, stored(sets.join(ends, "node", "left_semi"), "sets"), "tokens")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("a_tokens"), batch.column("b_tokens"), strict=True):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                keep.append(int((merged[1:] == merged[:-1]).sum()) >= needed(len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(frames.map_batches(met, check, "a BIGINT, b BIGINT"), "links")


def _tile_rows(tiles: DataFrame) -> DataFrame:
    """The rows of each group of nodes to compare: ``tile, token, side, later, node, root, at, n``.

    ``tiles`` has ``token, node, root, place, n``.  A group is a size band of a tile
    with the next one, whose rows are ``later``; a large one is cut into blocks by node
    hash, and each pair of blocks is a group.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT)).cast("int")
    rows = tiles.withColumn("band", band)
    held = rows.groupBy(F.col("token").alias("t"), "band").agg(
        F.count(F.lit(1)).alias("n"), F.max("place").alias("near"), F.min("root").alias("lo"), F.max("root").alias("hi")
    )
    # an entry for each band, of which there are as many as powers of 4/3
    held = held.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("n", "near", "lo", "hi")))).alias("held"))
    of = lambda b: F.try_element_at("held", b)
    total = lambda b: F.coalesce(of(b)["n"], F.lit(0)) + F.coalesce(of(b + 1)["n"], F.lit(0))
    # rows of its own band, a member whose place counts for the smaller set, two components
    worth = lambda g: (
        of(g).isNotNull()
        & (F.greatest(of(g)["near"], of(g + 1)["near"]) >= 0)
        & (F.least(of(g)["lo"], of(g + 1)["lo"]) < F.greatest(of(g)["hi"], of(g + 1)["hi"]))
    )
    groups = F.filter(F.array("band", F.col("band") - 1), worth)
    rows = rows.join(held, F.col("token") == F.col("t")).withColumn("group", F.explode(groups))
    blocks = F.ceil(total(F.col("group")) / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(
        F.xxhash64("token", "group", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"),
        # rows of the lesser block are 0, of the greater 1, of a block with itself 2
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        (F.col("group") != F.col("band")).alias("later"),
        "token",
        "node",
        "root",
        F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("at"),
        "n",
    )


def _tile_pairs(rows: DataFrame, maps: DataFrame, failed: DataFrame | None, forests: int) -> DataFrame:
    """``tile, token, a, b, more``: pairs of components that pass size, place and bitmap bounds.

    Of these each tile sends ``forests`` forests over its components; ``more`` tells that
    it has others.  Pairs ``failed`` are passed over.
    """
    none = F.array().cast("array<bigint>")
    if failed is None:
        rows = rows.withColumn("failed", none)
    else:
        # a node has few of these: at most the forests' edges of earlier rounds
        partners = failed.groupBy(F.col("a").alias("f")).agg(F.collect_set("b").alias("partners"))
        rows = rows.join(partners, F.col("node") == F.col("f"), "left")
        rows = rows.withColumn("failed", F.coalesce("partners", none)).drop("f", "partners")
    # bitmaps are the widest column, so they come last
    rows = rows.join(maps.select(F.col("node").alias("m_"), "bitmap"), F.col("node") == F.col("m_")).drop("m_")
    ordered = rows.repartition("tile").sortWithinPartitions("tile", "n", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            tile = table.column("tile").to_numpy()
            # the last tile may go on in the next batch
            whole = int(np.argmax(tile == tile[-1])) if len(tile) else 0
            held = table.slice(whole)
            yield _compared(table.slice(0, whole), forests)
        if held is not None:
            yield _compared(held, forests)

    return frames.map_batches(ordered, compare, "tile BIGINT, token BIGINT, a BIGINT, b BIGINT, more BOOLEAN")


def _compared(rows: pa.Table, forests: int) -> pa.RecordBatch:
    """The pairs sent by the tiles of ``rows``, which lie by tile and size."""
    tile, side, later, node, root, at, n = (
        rows.column(c).to_numpy() for c in ("tile", "side", "later", "node", "root", "at", "n")
    )
    maps = rows.column("bitmap").to_pylist()
    failed = [frozenset(f) for f in rows.column("failed").to_pylist()]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    left, step = np.arange(len(tile)), 0
    while True:
        # every row with the one ``step`` places on, as long as tile and size allow it
        step += 1
        left = left[left + step < len(tile)]
        right = left + step
        left = left[(tile[right] == tile[left]) & (100 * n[left] >= PERCENT * n[right])]
        if not len(left):
            break
        right = left + step
        least = -(-PERCENT * (n[left] + n[right]) // (100 + PERCENT))
        good = (root[left] != root[right]) & ((side[left] == 2) | (side[left] != side[right]))
        # two of the next band meet in the group of their own
        good &= ~(later[left] & later[right])
        good &= np.minimum(n[left] - at[left], n[right] - at[right]) >= least
        pairs.append((left[good], right[good]))
    x = np.concatenate([a for a, _ in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    y = np.concatenate([b for _, b in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    # a pair that several tiles hold is looked at in the first of them
    a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
    _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
    passed: list[tuple[int, float, int, int]] = []
    for k in first.tolist():
        i, j = int(x[k]), int(y[k])
        bound = overlap_bound(int(n[i]), int(n[j]), np.frombuffer(maps[i], np.uint8), np.frombuffer(maps[j], np.uint8))
        if bound >= needed(int(n[i]), int(n[j])) and int(b[k]) not in failed[i] and int(b[k]) not in failed[j]:
            # the failed partners of a pair's lesser node are its greater ones
            passed.append((int(tile[i]), -bound / (int(n[i]) + int(n[j])), int(a[k]), int(b[k])))
    root_of = dict(zip(node.tolist(), root.tolist(), strict=True))
    token_of = dict(zip(tile.tolist(), rows.column("token").to_pylist(), strict=True))
    sent = list(_forests(sorted(passed), root_of, forests))
    unsent = Counter(p[0] for p in passed)
    unsent.subtract(t for t, _, _ in sent)
    columns = zip(*[(t, token_of[t], u, v) for t, u, v in sent], strict=True) if sent else [()] * 4
    return pa.record_batch(
        [*(pa.array(c, pa.int64()) for c in columns), pa.array([unsent[t] > 0 for t, _, _ in sent], pa.bool_())],
        names=["tile", "token", "a", "b", "more"],
    )


def _forests(
    pairs: list[tuple[int, float, int, int]], root_of: dict[int, int], forests: int
) -> Iterator[tuple[int, int, int]]:
    """``tile, a, b`` of each tile's pairs that join two trees of one of its forests."""
    at: int | None = None
    parents: list[dict[int, int]] = []
    for tile, _, a, b in pairs:
        if tile != at:
            at, parents = tile, [{} for _ in range(forests)]
        for parent in parents:
            u, v = _top(parent, root_of[a]), _top(parent, root_of[b])
            if u != v:
                parent[u] = v
                yield tile, a, b
                break


def _top(parent: dict[int, int], x: int) -> int:
    while x in parent:
        up = parent[x]
        if up in parent:
            parent[x] = parent[up]
        x = up
    return x


def tile_entries(docs: DataFrame, frequent: bytes) -> DataFrame:
    """``token, node, place`` of the tiles of two nodes and more, with their ``lo, hi``."""
    # a node's prefix once, however many documents have the set
    tiles = _scan(docs, frequent, "tiles").dropDuplicates(["node"])
    entries = tiles.select("node", "near", F.posexplode("tokens").alias("at", "token"))
    # a place in the near part is written as it is, one beyond it as -1 - place
    place = F.when(F.col("at") < F.col("near"), F.col("at")).otherwise(-1 - F.col("at")).alias("place")
    entries = entries.select("token", "node", place)
    # combined before the shuffle, and joined in a way that Spark may split: a token may be
    # in a third of all sets
    shared = entries.groupBy(F.col("token").alias("t")).agg(
        F.min("node").alias("lo"),
        F.max("node").alias("hi"),
        F.max("place").alias("near"),
    )
    shared = shared.filter("lo <> hi AND near >= 0").select("t", "lo", "hi")
    return entries.join(shared, F.col("token") == F.col("t")).drop("t")


def star_pairs(tiles: DataFrame) -> DataFrame:
    """``a, b``: each node of a tile with the tile's ``STARS``, each pair once.

    Those of the other order are sought among the tiles only, not among all tokens, of
    which most are in one set.
    """
    other = F.col("node").bitwiseXOR(F.lit(_OTHER_ORDER))
    second = tiles.groupBy(F.col("token").alias("t")).agg(
        F.min(other).bitwiseXOR(F.lit(_OTHER_ORDER)).alias("lo2"),
        F.max(other).bitwiseXOR(F.lit(_OTHER_ORDER)).alias("hi2"),
    )
    met = tiles.join(second, F.col("token") == F.col("t")).select("node", F.explode(F.array(*STARS)).alias("s"))
    pairs = met.filter("node <> s").select(F.least("node", "s").alias("a"), F.greatest("node", "s").alias("b"))
    return pairs.distinct()


def linked_nodes(docs: DataFrame, frequent: bytes, nodes: DataFrame) -> DataFrame:
    """``node, root`` of every node that has a link; ``nodes`` are those of all documents."""
    tiles = stored(tile_entries(docs, frequent), "tiles")
    wanted = _texts_of(tiles, nodes)
    maps = stored(_scan(docs, frequent, "maps", wanted).dropDuplicates(["node"]), "maps")
    links = _linked(stored(_bounded(star_pairs(tiles), maps), "pairs"), docs, frequent, nodes)
    roots = stored(components(links), "roots")
    failed = open_ = None
    forests = 1
    while True:
        rooted = tiles.drop("lo", "hi").join(roots, "node", "left")
        rooted = rooted.select("token", "node", "place", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy(F.col("token").alias("t")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        left = rooted.join(mixed.filter("lo <> hi").select("t"), F.col("token") == F.col("t")).drop("t")
        rows = _tile_rows(left.join(maps.select("node", "n"), "node"))
        if open_ is not None:
            rows = rows.join(open_, "tile", "left_semi")
        sent = stored(_tile_pairs(rows, maps, failed, forests), "pairs")
        if sent.isEmpty():
            return roots
        found = _linked(sent.select("a", "b").distinct(), docs, frequent, nodes)
        if not found.isEmpty():
            # the stars so far stand for all earlier links
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
            roots = stored(components(links), "roots")
        wrong = stored(sent.join(found, ["a", "b"], "left_anti"), "failed")
        # a tile that has sent all its pairs is done, whichever failed
        going = wrong.filter("more")
        if going.isEmpty():
            return roots
        open_ = going.select("tile").distinct()
        tiles = stored(tiles.join(going.select("token").distinct(), "token", "left_semi"), "tiles")
        wrong = wrong.select("a", "b").distinct()
        failed = wrong if failed is None else failed.unionByName(wrong)
        forests *= MORE_FORESTS


def near_duplicates(docs: DataFrame, tag: str | None = None) -> DataFrame:
    """``doc_id, tag, n_shingles, root, component_id`` of every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest id that links reach; rows without shingles have
    their own.  ``root`` names the class, ``tag`` is the column of that name, or null.
    """
    frequent = frequent_tokens(docs)
    nodes = stored(_scan(docs, frequent, "nodes", tag=tag), "nodes")
    roots = linked_nodes(docs, frequent, nodes).select(F.col("node").alias("n_"), "root")
    # one row for each node from here on, however many documents have it
    least = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, F.col("node") == F.col("n_"), "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy(F.col("root").alias("r_")).agg(F.min("least").alias("component_id"))
    labels = stored(rooted.join(named, F.col("root") == F.col("r_")).select(F.col("node").alias("n_"), "root", "component_id"), "labels")
    # a join that Spark may split: very many documents may have one node
    met = nodes.join(labels, F.col("node") == F.col("n_"), "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return met.select("doc_id", "tag", F.col("n").alias("n_shingles"), "root", own.alias("component_id"))


def first_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, the one of the smallest id, of each class.

    Rows without shingles stay.  Rows equal in all columns count as one row; of rows of
    one id and different contents in a class, one stays.
    """
    tag = frames.fresh(docs, "tag")
    tagged = docs.withColumn(tag, frames.row_key(docs)["a"])
    rated = near_duplicates(tagged, tag)
    empty = rated.filter("n_shingles = 0").select("tag")
    first = rated.filter("n_shingles > 0").groupBy("component_id", "root")
    first = first.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("best"))
    chosen = empty.unionByName(first.select("best.tag")).distinct().withColumnRenamed("tag", "wanted")
    met = tagged.join(chosen, F.col(tag) == F.col("wanted"), "left_semi")
    return met.dropDuplicates([tag]).select(*docs.columns)
