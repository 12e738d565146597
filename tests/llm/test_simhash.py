import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tabshift.llm import simhash
from tabshift.llm.components import components


def brute(text, width=4):
    words = (text or "").encode().lower().split() if (text or "").isascii() else (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(docs):
    fps = [brute(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, f"{fps[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(docs)]


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = [(7, None), (3, ""), (9, " \t\n"), (11, "one"), (12, "ONE"), (13, "one two three four"), (None, "ÉCOLE é É")]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(40, 400))]
        docs.append((100 + 10 * i, " ".join(base)))
        for k in range(rng.randrange(4)):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            docs.append((101 + 10 * i + k, "\n".join(near)))
    docs += [docs[10], (5, docs[20][1]), (1_000_000, "x " * 100_000)]
    return docs


def test_against_brute_force(spark, make_docs):
    docs = corpus()
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs(docs)).collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert order(got) == order(brute_components(docs))


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    other = fps.copy()
    for i in range(len(other)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    a, b = simhash.keys_of(fps), simhash.keys_of(other)
    for x, y in zip(fps, other, strict=True):
        assert set(a["key"][a["fp"] == x].tolist()) & set(b["key"][b["fp"] == y].tolist())


def test_large_groups_keep_their_links():
    rng = np.random.default_rng(2)
    centre = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(np.array([centre] + [centre ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))], np.uint64))
    found = simhash.shard_links(simhash.keys_of(fps))
    assert len(found) == len(fps) - 1 and len(np.unique(found[:, 0])) == 1


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_components_with_hot_nodes(spark, monkeypatch):
    from tabshift.llm import components as C

    rng = random.Random(3)
    pairs = [(0, i) for i in range(1, 120)] + [(i, 1000 + i) for i in range(0, 120, 7)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)] + [(3000, i) for i in range(3001, 3040)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {i: find(i) for a, b in pairs if a != b for i in (a, b)}
    edges = spark.createDataFrame(pairs, "a long, b long")
    monkeypatch.setattr(C, "HOT_DEGREE", 5)
    monkeypatch.setattr(C, "HOT_SHARE", 100)
    assert {r.node: r.root for r in C.components(edges, "a", "b").collect()} == want


def test_empty_table_and_extra_columns(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []
    from pyspark.sql import functions as F

    docs = make_docs([(1, "a b c"), (2, "a b c")]).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit("y")).withColumn("id", F.lit(0))
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {1}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_similarity_finds_what_four_bits_miss(spark, make_docs):
    rng = random.Random(5)
    docs, pairs = [], []
    for i in range(40):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(400)]
        near = list(base)
        for at in range(20, 400, 60):
            near[at] = "edit"
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
        pairs.append((2 * i, 2 * i + 1))
    got = {r.doc_id: r.component_id for r in simhash.groups(make_docs(docs), similarity=0.8).collect()}
    assert all(got[a] == got[b] == a for a, b in pairs)
    assert len(set(got.values())) == 40


def copies_of_one(n, similarity, words=1000, seed=7):
    """An original and n copies edited independently, each alike to it by ``similarity`` or a little more."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    shingles = words - 4
    edits = int((1 - similarity) / (1 + similarity) * shingles / 5)
    docs = [(0, " ".join(base))]
    for i in range(1, n + 1):
        near = list(base)
        for j, at in enumerate(rng.sample(range(1, words // 5 - 1), edits)):
            near[5 * at] = f"e{i}_{j}"
        docs.append((i, " ".join(near)))
    return docs


def test_copies_that_hang_on_one_original(spark, make_docs):
    for n in (300, 2000):
        got = [r.component_id for r in simhash.groups(make_docs(copies_of_one(n, 0.82)), similarity=0.8).collect()]
        assert len(got) == n + 1 and sum(c != 0 for c in got) <= n // 200  # keys miss one pair in a thousand


def test_blocks_link_as_one_family():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    sets = [base] + [np.unique(np.r_[base[rng.permutation(400)[:370]], rng.integers(0, 1 << 62, 20, dtype=np.uint64)]) for _ in range(60)]
    block = np.arange(len(sets)) % 3
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for low in range(3):
        for high in range(low, 3):
            at = np.flatnonzero((block == low) | (block == high))
            for a, b in simhash.set_links([sets[i] for i in at], (block[at] != low).astype(int), 0.8):
                x, y = sets[at[a]], sets[at[b]]
                both = len(np.intersect1d(x, y))
                assert both >= 0.8 * (len(x) + len(y) - both)
                root[find(at[a])] = find(at[b])
    assert len({find(i) for i in range(len(sets))}) == 1


def all_pairs(docs, width=5, least=0.8):
    sets = [{tuple(t.split()[i : i + width]) for i in range(max(1, len(t.split()) - width + 1))} for _, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    first = {}
    for i in range(len(sets)):
        first[find(i)] = min(first.get(find(i), docs[i][0]), docs[i][0])
    return {docs[i][0]: first[find(i)] for i in range(len(sets))}


@pytest.mark.parametrize("block", [3000, 12_000, 1 << 20])
def test_large_families_by_hubs_and_blocks(spark, make_docs, monkeypatch, block):
    """Copies of two originals, a chain, a template without a centre and loose texts: the groups of all pairs, whatever the blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(21)
    docs = [(i, t) for i, (_, t) in enumerate(copies_of_one(60, 0.83, words=300, seed=1))]
    docs += [(100 + i, t) for i, (_, t) in enumerate(copies_of_one(50, 0.83, words=300, seed=2))]
    docs += [(200 + i, t) for i, (_, t) in enumerate(copies_of_one(40, 0.87, words=300, seed=3)[1:])]
    chain = [f"c{rng.randrange(10**6)}" for _ in range(300)]
    for i in range(40):
        docs.append((300 + i, " ".join(chain)))
        chain = chain[4:] + [f"n{i}_{k}" for k in range(4)]
    docs += [(400 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(100))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in simhash.groups(make_docs(docs), similarity=0.8).collect()}
    want = all_pairs(docs)
    assert got == want and sum(want[i] == 0 for i in range(61)) == 61


def test_hot_band_keys_leave_a_batch_once():
    rng = np.random.default_rng(6)
    hot = rng.integers(0, 1 << 62, 8, dtype=np.uint64)
    variants = np.arange(1, 501, dtype=np.uint64)
    bands = [np.r_[hot, rng.integers(0, 1 << 62, 4, dtype=np.uint64)].astype("<u8").tobytes() for _ in variants]
    batch = pa.RecordBatch.from_arrays([pa.array(variants.view("<i8")), pa.array(bands, pa.binary())], names=["variant", "bands"])
    found = next(iter(simhash._met_here(iter([batch])))).to_pydict()
    stars = {b for a, b, d in zip(found["a"], found["b"], found["d"], strict=True) if not d and a == 1}
    assert stars == set(range(2, 501)) and max(found["d"]) == 8 * 499
    records = simhash._band_records(batch)
    assert len(records[simhash._runs(records["key"])[0]]) == 8 + 4 * 500


def test_documents_of_one_template_stay_apart(spark, make_docs):
    docs = copies_of_one(300, 0.856)[1:]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    assert len({find(i) for i in range(len(sets))}) > 290
    assert simhash.deduplicated(make_docs(docs), similarity=0.8).count() == len({find(i) for i in range(len(sets))})


def test_one_row_of_each_group_whatever_the_ids(spark, make_docs):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    twin, other = text(), text()
    docs = [(None, text()) for _ in range(5)] + [(4, text()) for _ in range(3)] + [(None, twin), (8, twin), (9, twin), (None, other), (None, other), (6, text()), (6, twin)]
    for similarity in (None, 0.8):
        kept = [(r.doc_id, r.text) for r in simhash.deduplicated(make_docs(docs), similarity=similarity).collect()]
        want = docs[:8] + [(None, other), (6, docs[13][1]), (6, twin)]
        order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        assert order(kept) == order(want)


def test_texts_of_one_simhash_have_links_of_their_own(spark, make_docs):
    rng = random.Random(11)
    words = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    first, second = words(), words()
    # one shingle decides all bits of 1 and 2; 3 has nearly the shingles of 2 and bits of its own
    docs = [(1, "x " * 300 + first), (2, "x " * 300 + second), (3, "x " * 5 + second)]
    fps = [simhash.fingerprint(t, 5) for _, t in docs]
    assert fps[0] == fps[1] and (fps[0] ^ fps[2]).bit_count() > 4
    # equal fingerprints make candidates, likeness makes links
    assert {r.doc_id: r.component_id for r in simhash.groups(make_docs(docs), similarity=0.8).collect()} == {1: 1, 2: 2, 3: 2}


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_deduplicated_keeps_columns_of_any_name(spark, similarity):
    text = "one two three four five six seven eight nine ten"
    names = ["k_id", "k_row", "_kept_row", "_id", "_ROW", "id", "row", "fp", "first_id", "root", "component_id"]
    rows = [(1, text, *map(str, range(len(names)))), (1, text, *map(str, range(len(names)))), (2, text, *"x" * len(names)), (3, "something else", *"y" * len(names))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    kept = simhash.deduplicated(docs, similarity=similarity, width=5)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[3]]
