from __future__ import annotations

import random

import numpy as np
from brute import base_statistics
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgauge.llm import quality_rules as Q

FIXED = [None, "", " \n\t", "a b c a b c", "a a a a a", "x y z\nx y z\n\n \nx y z", "# * $ ok", "é ü z", "w " * 5000]


def check(make_docs, texts):
    rated, name = Q.judged(make_docs(list(enumerate(texts))), [])
    got = {r.doc_id: r[name] for r in rated.collect()}
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, t in enumerate(texts):
        want = base_statistics(t)
        assert tuple(got[i][f] for f in fields) == want, (t, got[i])
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert got[i]["kept"] == (not got[i]["base_failed"])


def test_statistics_of_odd_texts(make_docs):
    check(make_docs, FIXED)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abA \n#!1\t", max_size=60), min_size=1, max_size=12))
def test_statistics_as_by_brute_force(make_docs, texts):
    check(make_docs, texts)


def corpus(n: int = 300):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [f"w{rng.randrange(9000)}{'%%' if bad and rng.random() < 0.7 else ''}" for _ in range(90)]
        docs.append((i, " ".join(words), "s"))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_learned_list_on_held_out_documents(spark, make_docs):
    docs, labels = corpus()
    table = spark.createDataFrame([*labels[:200], (0, None, 0), (None, 1, 0)], "doc_id BIGINT, quality INT, toxic INT")
    frame = make_docs(docs)
    rules = Q.fit(frame, table)
    assert rules
    kept = {r.doc_id for r in Q.accepted(frame, rules).collect()}
    assert kept == {i for i, q, _ in labels if q}
    assert Q.accepted(frame, rules).columns == frame.columns
    plan = Q.judged(frame, rules)[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_without_labels_the_list_is_empty(spark, make_docs):
    docs, labels = corpus(40)
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    assert Q.fit(make_docs(docs), none) == []
    good = spark.createDataFrame([x for x in labels if x[1]], "doc_id BIGINT, quality INT, toxic INT")
    assert Q.fit(make_docs(docs), good) == []
    assert Q.accepted(make_docs([]), []).collect() == []


def test_rules_are_grown_and_pruned():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "noise": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] > 0.5)) | (x["b"] < 0.05)
    rules = Q.learn(x, bad)
    hit = np.zeros(3000, dtype=bool)
    for r in rules:
        hit |= Q._covers(r, x, 3000)
    assert (hit & bad).sum() / bad.sum() > 0.9 and (hit & bad).sum() / hit.sum() > 0.95
    assert not any(t.feature == "noise" for t in rules[0])
