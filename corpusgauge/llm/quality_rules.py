"""Quality rules learned as a decision list, applied as one Spark expression.

Sequential covering on labelled statistics: a rule is a conjunction of thresholds that
is grown by FOIL gain on two thirds of the labelled rows and pruned on the other third;
rows it covers are taken out and the next rule is grown, until no rule of the wanted
precision is left.  The list is an ordered ``CASE WHEN`` over statistics of the whole
text, all of them built-in functions.

A null text counts as empty.  Labels that are null are left out, of several labels of
one document the most frequent counts (0 at a tie).  Without labels, or without both
classes, the list is empty and keeps every document that the base rules pass.  An empty
table gives no rows; columns of the caller are kept and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.frames import WORD, fresh

#: Labelled rows the list is learned from at most, those with the smallest id hashes.
MAX_TRAINING_ROWS = 6_000
MIN_WORDS = 50
MAX_RULES, MAX_TERMS, THRESHOLDS = 12, 3, 48
#: What a rule must reach on the rows it was not grown on.
MIN_PRECISION, MIN_COVERED = 0.9, 5

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_HAS_WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, by sorting the windows' hashes."""

    def of_hashes(h: Column) -> Column:
        windows = F.when(
            F.size(h) >= 3,
            F.transform(
                F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))
            ),
        ).otherwise(F.array().cast("array<bigint>"))
        return let(windows, of_windows)

    def of_windows(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(placed, of_sorted))

    def of_sorted(s: Column) -> Column:
        def twin(e: Column, i: Column) -> Column:
            before = F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
            return before | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))

        starts = F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            zero,
            lambda a, p: F.struct(
                (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")
            ),
            lambda a: a["n"],
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes).cast("long")


#: Columns of ``statistics``.
STATISTICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_marks",
    "n_digits",
)


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text, see ``STATISTICS``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_HAS_WORD))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"))

    def of_lines(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        )

    whole = F.char_length(text).cast("long")
    counted = F.struct(
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
    )
    return let(
        counted,
        lambda c: F.struct(
            c["w"]["n_words"].alias("n_words"),
            _without(text, _SPACES).alias("word_chars"),
            (whole - _without(text, _SYMBOLS)).alias("n_symbols"),
            c["l"]["n_dup_lines"].alias("n_dup_lines"),
            c["w"]["n_repeat_words"].alias("n_repeat_words"),
            c["l"]["n_lines"].alias("n_lines"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            (whole - _without(text, "!?")).alias("n_marks"),
            (whole - _without(text, "0123456789")).alias("n_digits"),
        ),
    )


def _per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def features(s: Column) -> dict[str, Column]:
    """What rules may test, by name; of a ``statistics`` struct."""
    return {
        "words": s["n_words"].cast("double"),
        "word_length": _per(s["word_chars"], s["n_words"]),
        "symbols_per_word": _per(s["n_symbols"], s["n_words"]),
        "duplicate_lines": _per(s["n_dup_lines"], s["n_lines"]),
        "repeated_words": _per(s["n_repeat_words"], s["n_words"]),
        "upper_case": _per(s["n_upper"], s["word_chars"]),
        "marks_per_word": _per(s["n_marks"], s["n_words"]),
        "digits": _per(s["n_digits"], s["word_chars"]),
        "words_per_line": _per(s["n_words"], s["n_lines"]),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


# --- learning ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Term, ...]
"""A conjunction; a document it covers is rejected."""


def _covers(rule: Sequence[Term], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for t in rule:
        hit &= (x[t.feature] > t.threshold) == t.above
    return hit


def _cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds at quantiles, each half way to the next value that occurs."""
    known = np.unique(values)
    at = np.unique(np.searchsorted(known, np.quantile(values, np.linspace(0, 1, THRESHOLDS + 2)[1:-1], method="lower")))
    at = at[at < len(known) - 1]
    return (known[at] + known[at + 1]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Term]:
    """Add the term of most FOIL gain until only bad rows are covered."""
    rule: list[Term] = []
    live = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_TERMS and (live & ~bad).any():
        p0, n0 = (live & bad).sum(), (live & ~bad).sum()
        best, gain = None, 1e-9
        for name in sorted(x):
            values = x[name]
            for cut in _cuts(values[live]):
                over = values > cut
                for above in (True, False):
                    hit = live & (over == above)
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    if p == 0:
                        continue
                    g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if g > gain:
                        best, gain = (Term(name, above, float(cut)), hit), g
        if best is None:
            break
        rule.append(best[0])
        live = best[1]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The ordered rules; row order decides which rows prune (every third)."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    prune = np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES and (left & ~prune & bad).any():
        at = left & ~prune
        rule = _grow({k: v[at] for k, v in x.items()}, bad[at])
        held = left & prune
        hx, hb = {k: v[held] for k, v in x.items()}, bad[held]

        def worth(r: Sequence[Term], hx: dict = hx, hb: np.ndarray = hb) -> tuple[float, int]:
            hit = _covers(r, hx, len(hb))
            p, n = int((hit & hb).sum()), int((hit & ~hb).sum())
            return ((p + 1) / (p + n + 2), p)

        if rule:
            rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        hit = _covers(rule, hx, len(hb))
        if not rule or hit.sum() < MIN_COVERED or hb[hit].mean() < MIN_PRECISION:
            break
        rules.append(tuple(rule))
        left &= ~_covers(rule, x, len(bad))
    return rules


def labelled(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> DataFrame:
    """Features and ``bad`` of at most ``limit`` labelled documents.

    Those that fail the base rules are left out: the list never judges them.
    """
    votes = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    votes = votes.agg((2 * F.count_if(F.col("quality") == 0) >= F.count(F.lit(1))).alias("bad"))
    chosen = votes.orderBy(F.xxhash64("id"), "id").limit(limit)
    # at most ``limit`` ids, so the side is bounded
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    counted = met.select("id", "bad", F.explode(F.array(statistics(F.col("text")))).alias("s"))
    counted = counted.filter(~base_failed(F.col("s")))
    return counted.select("id", "bad", *[c.alias(k) for k, c in features(F.col("s")).items()])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING_ROWS) -> list[Rule]:
    """Learn the list from a bounded number of labelled rows of ``docs``."""
    # repeated ids come repeatedly; the limit keeps the driver's share bounded
    rows = labelled(docs, labels, limit).orderBy(F.xxhash64("id"), "id", *_feature_names()).limit(limit).collect()
    bad = np.array([r["bad"] for r in rows], dtype=bool)
    if not bad.any() or bad.all():
        return []
    return learn({k: np.array([r[k] for r in rows]) for k in _feature_names()}, bad)


def _feature_names() -> tuple[str, ...]:
    return (
        "words",
        "word_length",
        "symbols_per_word",
        "duplicate_lines",
        "repeated_words",
        "upper_case",
        "marks_per_word",
        "digits",
        "words_per_line",
    )


def verdict(rules: Sequence[Rule], s: Column) -> Column:
    """Index of the first rule that covers the document, null if none does."""
    named = features(s)
    found = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        hit = F.lit(True)
        for t in rule:
            hit = hit & ((named[t.feature] > t.threshold) if t.above else (named[t.feature] <= t.threshold))
        found = F.when(hit, F.lit(i)).otherwise(found)
    return found


def judged(docs: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, str]:
    """``docs`` with one struct column more, and its name.

    Its fields: ``STATISTICS``, ``base_failed``, ``rule`` (index of the rule that rejects,
    or null) and ``kept``.
    """
    stats, name = fresh(docs, "statistics"), fresh(docs, "judged")
    # a generator, so that no later filter makes Spark compute the statistics again
    counted = docs.withColumn(stats, F.explode(F.array(statistics(docs["text"]))))
    s = F.col(stats)
    rule = verdict(rules, s)
    found = F.struct(
        *[s[c].alias(c) for c in STATISTICS],
        base_failed(s).alias("base_failed"),
        rule.alias("rule"),
        (~base_failed(s) & rule.isNull()).alias("kept"),
    )
    return counted.withColumn(name, found).drop(stats), name


def accepted(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The documents that the base rules and the list keep."""
    rated, name = judged(docs, rules)
    return rated.filter(F.col(name)["kept"]).select(*docs.columns)
