"""File sources: a directory tree, a single file, or a table of files."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions.text import decode_dropping, decode_or_latin1
from corpusgauge.session import stored

#: Bytes of contents a scan task hands on at once.
BATCH_BYTES = 16 << 20
#: Entries that one folder's listing goes on for; folders left then are listed next round.
LIST_ENTRIES = 20_000
#: Entries of one batch of a listing.
BATCH_ENTRIES = 5_000


def _filesystem(root: str) -> tuple[FileSystem, str]:
    """The store of ``root`` and the path within it; a plain path is a local one."""
    if "://" in root:
        return FileSystem.from_uri(root)
    return LocalFileSystem(), os.path.abspath(root.removeprefix("file:"))


def listed_files(spark: SparkSession, store: FileSystem, base: str) -> DataFrame:
    """``full, size_bytes`` of every file below the folder ``base``.

    A table of folders goes through rounds.  A task lists each of its folders and, breadth
    first, what lies below, until ``LIST_ENTRIES`` are found; the folders it has not come to
    by then are dealt out anew in the next round.  So a deep or narrow tree takes few rounds
    and a broad one is spread over all tasks.  Each round is written, so that a lost
    executor costs one round at most, and no listing comes to the driver.
    """
    cores = spark.sparkContext.defaultParallelism

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column("full").to_pylist():
                waiting, seen = deque([start]), 0
                while waiting and seen < LIST_ENTRIES:
                    entries = store.get_file_info(FileSelector(waiting.popleft()))
                    seen += max(1, len(entries))
                    waiting.extend(e.path for e in entries if e.type == FileType.Directory)
                    files = [(e.path, e.size, False) for e in entries if e.type == FileType.File]
                    for at in range(0, len(files), BATCH_ENTRIES):
                        yield rows(files[at : at + BATCH_ENTRIES])
                yield rows([(folder, None, True) for folder in waiting])

    def rows(found: list[tuple[str, int | None, bool]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.int64(), pa.bool_())
        return pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["full", "size_bytes", "folder"]
        )

    frontier = spark.createDataFrame([(base,)], "full STRING")
    rounds: list[DataFrame] = []
    while True:
        found = stored(frontier.mapInArrow(level, "full STRING, size_bytes BIGINT, folder BOOLEAN"), "listing")
        rounds.append(found.filter("NOT folder").select("full", "size_bytes"))
        frontier = found.filter("folder").select("full")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        frontier = frontier.repartition(4 * cores, "full")


def scan_files(
    spark: SparkSession,
    root: str,
    repo_id: str | None = None,
    max_kb: int | None = None,
    filesystem: FileSystem | None = None,
) -> DataFrame:
    """``files(repo_id, path, size_bytes, content BINARY)`` of everything below ``root``.

    Every regular file comes, whatever its name (Spark's own listing leaves out names
    that begin with ``_`` or ``.``).  ``root`` may be a single file; its path is then
    its name.  With ``max_kb`` the contents of larger files are not read, but their rows
    stay, with NULL content.

    Only ``root`` leaves the driver: folders are listed in rounds of tasks (see
    ``listed_files``), then files are read by tasks of their own.  ``root`` has to be
    readable from the executors; ``filesystem`` opens stores that its URI does not name
    (``root`` is then a path within it).
    """
    store, base = (filesystem, root) if filesystem else _filesystem(root)
    base = base.rstrip("/") or "/"
    whole = store.get_file_info(base)
    single = whole.type == FileType.File
    prefix = len(base.rpartition("/")[0] if single else base.rstrip("/")) + 1
    cores = spark.sparkContext.defaultParallelism
    cap = None if max_kb is None else max_kb * 1024
    if single:
        listed = spark.createDataFrame([(base, whole.size)], "full STRING, size_bytes BIGINT")
    else:
        listed = listed_files(spark, store, base).repartition(4 * cores, "full")

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[str, int, bytes | None]] = []
            size = 0
            for full, length in zip(*(batch.column(c).to_pylist() for c in ("full", "size_bytes")), strict=True):
                content = None
                if cap is None or length <= cap:
                    with store.open_input_stream(full) as stream:
                        content = stream.read()
                held.append((full[prefix:], length, content))
                size += len(content or b"")
                if size > BATCH_BYTES:
                    yield _file_batch(held)
                    held, size = [], 0
            yield _file_batch(held)

    def _file_batch(held: list[tuple[str, int, bytes | None]]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.int64(), pa.binary())
        return pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "size_bytes", "content"]
        )

    found = listed.mapInArrow(reading, "path STRING, size_bytes BIGINT, content BINARY")
    name = repo_id or root.rstrip("/").rsplit("/", 1)[-1]
    return found.select(F.lit(name).alias("repo_id"), "path", "size_bytes", "content")


def decoded(files: DataFrame) -> DataFrame:
    """Binary contents as the scans read them: UTF-8, bad bytes dropped."""
    return files.withColumn("content", decode_dropping(F.col("content")))


def decoded_for_explain(files: DataFrame) -> DataFrame:
    """Binary contents as explanations read them: UTF-8, else all of it as Latin-1."""
    return files.withColumn("content", decode_or_latin1(F.col("content")))


def read_files_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A table of files; only the columns the job needs reach the scan."""
    return spark.read.format(format).load(path).select("repo_id", "path", "size_bytes", "content")
