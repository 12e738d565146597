import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabshift.llm import quality as Q


def good(rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 200))) + "."


def bad(rng):
    return rng.choice([lambda: "SPAM!! " * 50, lambda: "word " * 90, lambda: " | ".join(good(rng).split()), lambda: "%%% ".join(good(rng).split())])()


def corpus(n=400):
    rng = random.Random(1)
    return [(i, good(rng) if i % 3 else bad(rng)) for i in range(n)]


def test_held_out_accuracy(spark, make_docs):
    docs = corpus()
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in docs] + [(None, 1), (1, None), (99_999, 0)], "doc_id long, quality int")
    table = make_docs([*docs, (1000, None), (1001, ""), (None, "x"), docs[0]])
    got = Q.classify(table, Q.fit(table, labels)).collect()
    assert len(got) == len(docs) + 4
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert 60 < len(held) < 140 and np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark, make_docs):
    docs = corpus(120)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in docs], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    table = make_docs(docs)
    moved = table.withColumn("lang", F.lit("zz")).withColumn("source", F.col("doc_id").cast("string"))
    a, b = Q.fit(table, labels), Q.fit(moved, flipped)
    assert np.allclose(a.weights, b.weights) and a.threshold == pytest.approx(b.threshold)


def test_one_class_and_empty_tables(spark, make_docs):
    table = make_docs([(1, "a b"), (2, "c d")])
    only = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert [r.score for r in Q.classify(table, Q.fit(table, only)).collect()] == [pytest.approx(0.7)] * 2
    empty = Q.fit(make_docs([]), only.limit(0))
    assert Q.classify(make_docs([]), empty).collect() == []
    assert Q.accepted(table, empty).columns == table.columns


def test_ranking_and_quantile():
    rng = np.random.default_rng(0)
    g, b = rng.normal(2, 1, (900, 3)), rng.normal(0, 1, (100, 3))
    r = Q.rank(g, b)
    both = r.score(np.concatenate([g, b]))
    assert np.mean(both >= Q.CUT) == pytest.approx(0.9, abs=0.01)
    assert len(Q.features("x " * 10)) == len(Q.NAMES) == len(Q.features(None))
    assert np.isfinite(np.array([Q.features(t) for t in ("", "\n", "!", "a" * 100_000, "漢" * 9)])).all()


def test_weights_against_gradient_descent():
    """The same loss over all pairs, minimised by small steps."""
    rng = np.random.default_rng(4)
    g, b = rng.normal(0.7, 1, (12, 4)), rng.normal(0, 1.5, (9, 4))
    r = Q.rank(g, b, max_pairs=10**6)
    both = np.concatenate([g, b])
    means, scales = both.mean(axis=0), both.std(axis=0) + 1e-6
    pairs = np.array([(x - y) / scales for x in g for y in b])
    w = np.zeros(4)
    for _ in range(200_000):
        step = pairs.T @ (1 / (1 + np.exp(-(pairs @ w))) - 1) / len(pairs) + Q.RIDGE * w
        w -= 0.3 * step
        if np.abs(step).max() < 1e-10:
            break
    assert np.allclose(r.weights, w, atol=1e-6) and np.allclose(r.means, means)
    raw = (both - means) / scales @ w
    assert r.threshold == pytest.approx(np.quantile(raw, 9 / 21)) and r.score(both)[np.argmax(raw)] == r.score(both).max()


def test_repeated_ids_add_no_rows(spark, make_docs):
    docs = corpus(90)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in docs] * 3, "doc_id long, quality int")
    once, often = Q.fit(make_docs(docs), labels), Q.fit(make_docs(docs * 5), labels)
    assert np.allclose(once.weights, often.weights) and once.threshold == pytest.approx(often.threshold)
