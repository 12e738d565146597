import hashlib
import random

import numpy as np
import pytest

from tabshift.llm import factors

WINDOW = 13


def brute(docs):
    rank = lambda i: float("inf") if i is None else i
    split = lambda t: (t or "").encode().split()
    least = {}
    for i, t in docs:
        w = split(t)
        for k in range(len(w) - WINDOW + 1):
            s = tuple(w[k : k + WINDOW])
            least[s] = min(least.get(s, rank(i)), rank(i))
    out = []
    for i, t in docs:
        w = split(t)
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1):
            if least[tuple(w[k : k + WINDOW])] < rank(i):
                gone[k : k + WINDOW] = [True] * WINDOW
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def block_of(docs):
    return factors.Block([factors.Member.of(factors.Document.of(*d)) for d in docs])


def held(spark, make_docs, docs, parts=3):
    got = factors.duplicated_words(make_docs(docs).repartition(parts)).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == order(brute(docs))
    return got


def random_docs(rng, n):
    word = lambda: rng.choice(["a", "b", "é", "Ü", "the", "THE", "x.", "—"])
    words = lambda n: [word() for _ in range(n)]
    passages = [words(k) for k in (12, 13, 14, 30, 200, 1500)]
    gap = lambda: rng.choice([" ", "  ", "\n", "\t \x0b", "\r\n\x0c"])
    docs = []
    for i in range(n):
        p, q = rng.choice(passages), rng.choice(passages)
        a, b = rng.randrange(len(p)), rng.randrange(len(q))
        text = words(rng.randrange(40)) + p[a : a + rng.randrange(10, 300)] + words(rng.randrange(3)) + q[b:] + words(rng.randrange(20))
        docs.append((i - 20, "".join(w + gap() for w in text)))
    docs += [(500, None), (501, ""), (502, "  \n"), (503, "w " * 12), (504, "w " * 13), (505, "w " * 400), (506, "w " * 90), docs[5], docs[5], (7, docs[9][1]), (7, docs[11][1]), (None, docs[3][1]), (None, docs[3][1]), (-900, docs[8][1] * 2)]
    docs += [(600, "u v w\x85x " * 20), (601, "u v w\x85x " * 13), (602, "\x1c " * 30)]
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark, make_docs):
    held(spark, make_docs, random_docs(random.Random(1), 90))


def test_copies_of_one_text(spark, make_docs):
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(300))
    got = held(spark, make_docs, [(i, text) for i in range(60)] + [(100, "other words " + text + " end"), (99, text[200:500])], parts=8)
    assert sum(r.n_removed == 0 for r in got) == 1


def test_colliding_fingerprints_are_found_by_words(spark, make_docs, monkeypatch):
    # six bits: nearly every window shares its fingerprint with others
    narrow = np.uint64(0x7)
    real = factors.Block.__init__

    def init(self, docs):
        real(self, docs)
        self.prints = (self.prints & narrow) | (self.prints & narrow) << np.uint64(50)

    monkeypatch.setattr(factors.Block, "__init__", init)
    block = block_of([(1, " ".join(map(str, range(60))))])
    assert len(set(block.prints.tolist())) <= 8
    docs = random_docs(random.Random(5), 30)
    settled = block_of(docs).parse()
    assert settled.any() and not settled.all()


def test_denied_claims_are_compared_by_words(spark, make_docs, monkeypatch):
    monkeypatch.setattr(factors, "mix64", lambda x: (x & np.uint64(0xF)) | (x & np.uint64(0xF)) << np.uint64(48))
    rng = random.Random(6)
    docs = random_docs(rng, 25)
    source = factors.collided
    seen = []
    monkeypatch.setattr(factors, "collided", lambda *a: seen.append(1) or source(*a))
    held_with_weak(spark, make_docs, docs, seen)


def held_with_weak(spark, make_docs, docs, seen):
    """The tasks load the module anew, so the weak fingerprints go with the closure that they run."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(factors)
    try:
        held(spark, make_docs, docs, parts=4)
    finally:
        cloudpickle.unregister_pickle_by_value(factors)
    assert seen


def test_long_words_and_texts(spark, make_docs, monkeypatch):
    rng = random.Random(7)
    long = [rng.choice("pqrs") * rng.randrange(1, 5) for _ in range(40_000)]
    docs = [(1, " ".join(long[5000:5300])), (2, " ".join(long)), (3, "x" * 3_000_000 + " " + " ".join(long[100:140])), (4, " ".join(long[90:130]) + " " + "x" * 3_000_000)]
    held(spark, make_docs, docs)


def test_word_prints_by_blocks(monkeypatch):
    data = b"aa bb aa cccccccccccccccccccccccccccccc bb aa cccccccccccccccccccccccccccccc "
    x = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(x == 32)
    starts = np.r_[0, ends[:-1] + 1]
    whole = factors.word_prints(x, starts, ends)
    monkeypatch.setattr(factors, "CHUNK", 8)
    parts = factors.word_prints(x, starts, ends)
    for prints in (whole, parts):
        assert len(set(prints.tolist())) == 3 and prints[0] == prints[2] == prints[5] and prints[3] == prints[6] and prints[1] == prints[4]


def test_empty_table_and_other_columns(spark, make_docs):
    assert factors.duplicated_words(make_docs([])).collect() == []
    words = " ".join(map(str, range(20)))
    table = spark.createDataFrame([(1, words, 5, "k", 0), (2, words, 6, "k", 0)], "id long, text string, tag long, kind string, dest int")
    assert sorted((r.id, r.n_removed) for r in factors.duplicated_words(table, id_col="id").collect()) == [(1, 0), (2, 20)]


@pytest.mark.parametrize("extreme", [[], [(0, 0, 0)], [(-(2**63), 1, 2), (2**63 - 1, 2**32 - 1, 2**32 - 1), (0, 5, 5)]])
def test_packing(extreme):
    x = np.array(extreme, factors.SOURCE)
    assert factors.unpack(factors.pack(x), factors.SOURCE).tolist() == x.tolist()
