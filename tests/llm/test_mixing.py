import random
import re
from collections import defaultdict

import pytest

from tabshift.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Resharing as stated: deal by weight, cap, and deal the excess again among those below their cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, rest = {}, set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if rest * weight[s] / total > most * sizes[s]}
        if not full:
            return out | {s: rest * weight[s] / total for s in free}
        for s in full:
            out[s] = most * sizes[s]
        rest -= sum(out[s] for s in full)
        free -= full
    return out


def corpus():
    rng = random.Random(1)
    docs = [(i, " ".join("w" for _ in range(rng.randrange(0, 60))), rng.choice(["big"] * 5 + ["a", "b", "é", "Z", None])) for i in range(600)]
    return [*docs, (1000, None, "a"), (1001, " \t ", "empty"), (None, "x y", "b"), docs[0], (5, "other words", "b"), (2000, "w " * 3_000, "big")]


def test_targets_and_amounts(spark, make_docs):
    docs = corpus()
    got = mixing.mix(make_docs(docs), with_source=True).collect()
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = targets(sizes), defaultdict(int)
    assert len(got) == len(docs)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(60, 0.02 * t), s


def test_reruns_and_partitions_agree(spark, make_docs):
    docs = make_docs(corpus())
    rows = lambda d: sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(d).collect())
    assert rows(docs) == rows(docs.repartition(7))


def test_one_source_empty_table_and_clashing_columns(spark, make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([(i, "a b c", "only") for i in range(10)]).withColumn("size", F.lit("x")).withColumn("taken", F.lit(1)).withColumn("h", F.lit(2))
    got = mixing.mix(docs).collect()
    assert sum(r.taken for r in got) == 45 and got[0].target == 45.0
    assert mixing.mix(make_docs([])).collect() == []
    assert {r.taken for r in mixing.mix(make_docs([(1, None), (2, "")])).collect()} == {0}


def test_rows_are_repeated(spark, make_docs):
    docs = make_docs([(i, "a b c", "only") for i in range(10)] + [(99, "", "only")])
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts.pop(99) == 1 and set(counts) == set(range(10)) and sum(counts.values()) == 15


def test_threshold_and_filler_against_brute_force(spark, make_docs):
    """The taken documents themselves: those below a hash threshold, of those that fit, and the one nearest to what is left."""
    from pyspark.sql import functions as F

    docs = make_docs([d for d in corpus() if d[0] is not None][:600])
    rows = docs.select("doc_id", "text", "source", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - mixing.BITS * mixing.LEVELS).alias("h")).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size[r.doc_id]
    want = targets(sizes)
    got = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    for source, target in want.items():
        own = [r for r in rows if r.source == source]
        whole = min(int(target // sizes[source]), 2) if sizes[source] else 0
        rest = 0 if whole == 2 else target - whole * sizes[source]
        fit, chosen, left = sorted((r.h, r.doc_id) for r in own if 0 < size[r.doc_id] <= rest), set(), rest
        for _, i in fit:
            if left < size[i]:
                break
            chosen.add(i)
            left -= size[i]
        others = sorted((abs(size[r.doc_id] - left), r.doc_id) for r in own if size[r.doc_id] and r.doc_id not in chosen)
        filled = {i for miss, i in others if left > 0 and miss == others[0][0] <= left}
        extra = {r.doc_id for r in own if size[r.doc_id] and got[r.doc_id] == (whole + 1) * size[r.doc_id]}
        assert all(got[r.doc_id] in (whole * size[r.doc_id], (whole + 1) * size[r.doc_id]) for r in own)
        assert chosen <= extra and len(extra - chosen) == bool(filled) and extra - chosen <= filled, source


def test_all_columns_stay_whatever_their_names(spark, make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([(i, "a b c", "only") for i in range(10)])
    for name in ("m_n", "m_times", "_mix_size", "_MIX_h", "size", "times", "target"):
        docs = docs.withColumn(name, F.lit(name))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == 15 and out.first()["_mix_size"] == "_mix_size"
    assert mixing.mixed(make_docs([])).collect() == []


def test_many_sources_and_one_hot_one(spark, make_docs):
    rng = random.Random(3)
    docs = [(i, "w " * rng.randrange(1, 30), "hot" if i % 3 == 0 else f"s{rng.randrange(400)}") for i in range(3000)]
    taken, target = defaultdict(int), {}
    for r in mixing.mix(make_docs(docs), with_source=True).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert abs(taken["hot"] - target["hot"]) <= 30 and all(abs(taken[s] - t) <= 30 for s, t in target.items())
