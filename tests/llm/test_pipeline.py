import os
import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tabshift.llm import simhash  # noqa: E402
from tabshift.llm.shingles import LOWER  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, SF), "test")
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(now) <= ids, name
        assert len(now) == len(set(now)) or name.startswith("mixing")
        ids = set(now)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count()
    ends = sorted((r.start, r.n_tokens) for r in last)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_stage_results_against_brute_force(spark):
    from tests.llm.test_decontaminate import brute

    sources = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = corpus_pipeline.STAGES[2][1](spark, sources, SF)
    want = {r[0] for r in brute([tuple(r) for r in sources.select("doc_id", "text").collect()], items) if not r[5]}
    assert {r.doc_id for r in clean.collect()} == want


def shingle_groups(docs, width=5, least=0.8):
    """Smallest id of each document's group by all pairs of shingle sets."""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().translate(LOWER).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else {()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and (both := len(x & y)) >= least * (len(x) + len(y) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_copies_against_all_pairs(spark):
    """The stage keeps the first document of each group that all pairs of whole texts give; recall of links is 0.9 or more."""
    rows = [r for sf in (SF, SF.replace("0.001", "0.01")) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 600").select("doc_id", "text").collect()]
    docs = list({r.doc_id: (r.doc_id, r.text) for r in rows}.values())
    want = shingle_groups(docs)
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), similarity=0.8, distance=4, width=5).collect()}
    firsts = set(want.values())
    assert firsts <= kept  # no document goes that is not alike to one that stays
    dropped = set(want) - firsts
    assert len(dropped) > 20 and len(dropped - kept) >= 0.9 * len(dropped)


def test_whole_run_against_brute_force(spark):
    """run() from end to end: the ranker's decisions are taken as they are, all that follows is worked out by hand."""
    from tabshift.llm import mixing, quality
    from tests.llm.test_decontaminate import brute
    from tests.llm.test_mixing import WORD, targets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id: r for r in quality.accepted(docs, quality.fit(docs, labels)).collect()}
    groups = shingle_groups([(i, r.text) for i, r in good.items()])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    first = sorted(set(groups.values()))
    clean = [r[0] for r in brute([(i, good[i].text) for i in first], items) if not r[5]]
    size = {i: len(WORD.findall(good[i].text or "")) for i in clean}
    sources = {}
    for i in clean:
        sources[good[i].source] = sources.get(good[i].source, 0) + size[i]
    goal = targets(sources)

    got = corpus_pipeline.run(spark, SF).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    times = {}
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        ids = [*plain.encode(good[r.doc_id].text or "", add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert set(times) <= set(clean) and max(times.values()) <= 2
    largest = max(size.values())
    for source, target in goal.items():
        taken = sum(n * size[i] for i, n in times.items() if good[i].source == source)
        assert abs(taken - target) <= largest / 2
        if target >= sources[source]:
            assert {i for i in clean if good[i].source == source} <= set(times)
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)
    assert mixing.LEVELS


def test_stages_with_odd_tables(spark, make_docs):
    """Nulls, repeated ids and rows, an empty table and columns with the operators' own names go through every stage."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(10**5)}" for _ in range(60)) + "."
    same = text()
    odd = make_docs([(None, None), (None, text(), None), (3, ""), (3, text()), (4, same), (4, same), (5, same), (6, " \n"), (7, "long " * 50_000), (8, text(), None)])
    for name in ("id", "fp", "h", "size", "times", "bucket", "root", "score"):
        odd = odd.withColumn(name, F.lit(name))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            kept = {(r.doc_id, r.text) for r in out.collect()}
            assert kept <= {(r.doc_id, r.text) for r in docs.collect()}, name
            if name.startswith("SimHash") and docs is odd:
                assert (4, same) in kept and (5, same) not in kept
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_registry():
    found = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
    assert "pipeline" in found and len(corpus_pipeline.STAGES) == 5
