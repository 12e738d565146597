import hashlib
import random
import re

from tabshift.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(D.UPPER, D.LOWER)))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    found |= windows[tuple(w[j : j + k])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def run(spark, make_docs, docs, items):
    got = D.contamination(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]


def test_against_brute_force(spark, make_docs):
    rng = random.Random(4)
    vocabulary = ["the", "of"] * 8 + [f"w{i}" for i in range(30)] + ["É", "ß漢"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(10, 40))) for i in range(15)] + [(100, "Just FIVE words, in-all"), (101, ""), (102, None), (103, "the the the the the the the the the the the"), (2, "w1 w2 w3"), (None, text(12))]
    docs = []
    for i in range(80):
        own = words(rng.choice(items)[1])
        cut = own[rng.randrange(3) : len(own) - rng.randrange(3)]
        docs.append((i, text(rng.randrange(40)) + ". " + "-".join(cut).upper() + "\n" + text(rng.randrange(30)) + " the" * rng.choice([0, 0, 14])))
    docs += [(500, None), (501, ""), (502, "w1 w2 w3"), (3, "same id " + items[0][1]), docs[5], (None, items[1][1]), (503, (items[3][1] + " ") * 300)]
    assert sorted(run(spark, make_docs, docs, items), key=str) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark, make_docs):
    assert run(spark, make_docs, [], [(1, "a b")]) == []
    assert run(spark, make_docs, [(1, "a b")], [(1, None)]) == brute([(1, "a b")], [])
    assert run(spark, make_docs, [(1, "a b")], [])[0][5] is False


def test_filter_and_proximity(spark, make_docs):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = make_docs([(1, "so alpha, BETA gamma!"), (2, "alpha gamma beta"), (3, None)]).withColumn("h", F.lit(1)).withColumn("m_id", F.lit(2))
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    terms = spark.createDataFrame([("alpha",), ("gamma",)], "term string")
    stored = D.postings(docs, terms)
    asked = terms.withColumn("query", F.lit("q"))
    assert sorted((r.id, r.at) for r in D.proximity(stored, asked, 2).collect()) == [(2, 1)]
    assert sorted(r.id for r in D.proximity(stored, asked, 3).collect()) == [1, 2]


def test_no_python_in_the_plan(spark, make_docs):
    plan = D.contamination(make_docs([(1, "a b")]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_python_in_the_plan(spark, make_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = make_docs([(1, "zero one two three four five six seven eight nine ten end")])
    found = D.contamination(docs, items)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and found.first().n_hit == 10
