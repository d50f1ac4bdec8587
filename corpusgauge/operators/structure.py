"""Structure scan: tree nodes, imports, dependencies, entry points."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions import rules as R
from corpusgauge.functions.languages import code_language
from corpusgauge.functions.paths import file_name, hidden, structure_excluded
from corpusgauge.functions.regex import java_regex
from corpusgauge.functions.rows import explode_items
from corpusgauge.functions.text import let, universal_newlines
from corpusgauge.operators.positions import with_positions

MODULE_FILE = "__init__.py"


def in_tree(path: Column, excludes: Sequence[str] = (), filtered: bool = True) -> Column:
    """``filtered=False`` is for files that are named themselves: all of them are in."""
    return ~hidden(path) & ~structure_excluded(path, excludes) if filtered else F.lit(True)


def tree_nodes(
    files: DataFrame, excludes: Sequence[str] = (), filtered: bool = True
) -> DataFrame:
    """Every file in the tree and every directory above one.

    A file emits a row per ancestor; equal rows collapse in the map-side aggregate,
    so the root of a huge repository is no hot spot.  The module flag travels in the
    same aggregate instead of a join: a ``__init__.py`` marks its directory even when
    the file itself is not in the tree.  The root (path '') always stays.
    """
    parts = F.split("path", "/")

    def node(depth: Column, seen: Column) -> Column:
        is_file = depth == F.size(parts)
        marks_module = (depth == F.size(parts) - 1) & (file_name(F.col("path")) == MODULE_FILE)
        return F.struct(
            F.array_join(F.slice(parts, 1, depth), "/").alias("path"),
            depth.alias("depth"),
            is_file.alias("is_file"),
            (seen | (depth == 0)).alias("seen"),
            marks_module.alias("marks_module"),
        )

    emitted = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda depth: node(depth, F.col("visible"))
    )
    # files outside the tree only matter for the root and for module flags
    relevant = F.when(F.col("visible"), emitted).otherwise(
        F.filter(emitted, lambda n: n["seen"] | n["marks_module"])
    )
    return (
        files.select("repo_id", "path", in_tree(F.col("path"), excludes, filtered).alias("visible"))
        .select("repo_id", F.explode(relevant).alias("n"))
        .groupBy("repo_id", F.col("n.path").alias("path"), F.col("n.depth").alias("depth"))
        .agg(
            F.bool_or("n.is_file").alias("is_file"),
            F.bool_or("n.seen").alias("seen"),
            F.bool_or("n.marks_module").alias("is_module"),
        )
        .filter("seen")
        .select(
            "repo_id",
            "path",
            F.when(F.col("depth") > 0, parent_of(F.col("path"))).alias("parent"),
            F.when(F.col("depth") == 0, F.col("repo_id"))
            .otherwise(file_name(F.col("path")))
            .alias("name"),
            F.when(F.col("is_file"), "file")
            .when(F.col("is_module"), "module")
            .otherwise("directory")
            .alias("node_type"),
            F.col("depth").cast("int").alias("depth"),
        )
    )


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"(?:^|/)[^/]*\z", "")


def sort_key(path: Column, node_type: Column) -> Column:
    """Binary order of the keys is depth-first order, directories before files."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    return F.array_join(
        F.transform(
            parts,
            lambda part, i: F.concat(
                F.when((i == last) & (node_type == "file"), "1").otherwise("0"), F.lower(part)
            ),
        ),
        "\x01",
    )


def ordered_tree(nodes: DataFrame) -> DataFrame:
    """Nodes in display order: a range-partitioned sort, no single-task numbering."""
    key = F.when(F.col("depth") == 0, "").otherwise(sort_key(F.col("path"), F.col("node_type")))
    return nodes.withColumn("sort_key", key).orderBy("repo_id", "sort_key", "path")


def tree_positions(nodes: DataFrame) -> DataFrame:
    """``repo_id, path, position``: the place of every node in display order, from 1."""
    key = F.when(F.col("depth") == 0, "").otherwise(sort_key(F.col("path"), F.col("node_type")))
    keyed = nodes.select("repo_id", "path", key.alias("sort_key"))
    return with_positions(keyed, ["repo_id"], ["sort_key", "path"]).drop("sort_key")


def _with_text(files: DataFrame, excludes: Sequence[str], filtered: bool) -> DataFrame:
    return files.filter(in_tree(F.col("path"), excludes, filtered)).select(
        "repo_id",
        "path",
        code_language(F.col("path")).alias("language"),
        universal_newlines(F.col("content")).alias("text"),
    )


def imports_of(text: Column, language: Column) -> Column:
    """Distinct modules a file imports, over all patterns of its language."""
    chain: Column | None = None
    for name, patterns in R.IMPORTS.items():
        found = [
            F.regexp_extract_all(text, F.lit(java_regex(p, multiline=True)), F.lit(1))
            for p in patterns
        ]
        modules = F.array_distinct(F.flatten(F.array(*found)))
        chain = F.when(language == name, modules) if chain is None else chain.when(
            language == name, modules
        )
    return chain


def imports(
    files: DataFrame, excludes: Sequence[str] = (), filtered: bool = True
) -> DataFrame:
    modules = imports_of(F.col("text"), F.col("language"))
    return explode_items(
        _with_text(files, excludes, filtered), ["repo_id", "path", "language"], modules, "idx", "module"
    ).drop("idx")


def dependencies(
    files: DataFrame, excludes: Sequence[str] = (), filtered: bool = True
) -> DataFrame:
    """Edges to modules of the same project; the target stays symbolic."""
    internal = F.startswith("module", F.lit(".")) | F.contains("module", F.lit("/"))
    return (
        imports(files, excludes, filtered)
        .filter(internal)
        .select(
            "repo_id",
            F.col("path").alias("source"),
            F.col("module").alias("target"),
            F.lit("import").alias("dependency_type"),
        )
    )


def entry_points(
    files: DataFrame, excludes: Sequence[str] = (), filtered: bool = True
) -> DataFrame:
    """Files with a known entry name, or with an entry pattern of their language."""

    def is_entry(f: Column) -> Column:
        chain: Column | None = None
        for name, patterns in R.ENTRY_PATTERNS.items():
            hits = [f["text"].rlike(java_regex(p, multiline=p.startswith("^"))) for p in patterns]
            found = reduce(operator.or_, hits)
            test = f["language"] == name
            chain = F.when(test, found) if chain is None else chain.when(test, found)
        return file_name(f["path"]).isin(*R.ENTRY_NAMES) | F.coalesce(chain, F.lit(False))

    # the filter is pushed below the projection, so it has to hold its inputs once
    return (
        _with_text(files, excludes, filtered)
        .filter(let(F.struct("path", "language", "text"), is_entry))
        .select("repo_id", "path", "language")
    )
