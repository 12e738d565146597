import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from tabshift.llm import fingerprints as fp


def own_minhash(text):
    """The definition, one hash and one bin at a time."""
    words = re.findall("[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return b""
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42) for i in range(max(1, len(words) - 4))]
    least = {}
    for h in hashes:
        least[h >> 56] = min(h, least.get(h >> 56, h))

    def probe(b, t):
        x = (b * 2**32 + t + 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return (x ^ x >> 31) >> 56

    filled = [least[b] if b in least else least[next(p for p in (probe(b, t) for t in itertools.count(1)) if p in least)] for b in range(256)]
    return bytes((filled[2 * i] & 15) << 4 | filled[2 * i + 1] & 15 for i in range(128))


def own_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum((x >> 4 == y >> 4) + (x & 15 == y & 15) for x, y in zip(a, b, strict=True)) / 256
    return min(1.0, max(0.0, (same - 1 / 16) / (15 / 16)))


def test_edits_against_brute_force(spark, make_docs):
    rng = random.Random(1)
    docs = [(i * 5, " ".join(rng.choice(["ab", "é", "漢字", "x"]) + str(rng.randrange(40)) for _ in range(rng.randrange(0, 200)))) for i in range(120)]
    docs += [(1, None), (2, ""), (3, "a"), (10_000, "long " * 60_000), (7, "same"), (7, "other"), (None, "no id"), docs[4]]
    got = fp.edits(make_docs(docs)).collect()
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own_minhash(text).hex(), own_minhash(edited).hex(), own_likeness(own_minhash(text), own_minhash(edited)), own_likeness(own_minhash(text), own_minhash(after))))
    key = lambda r: (str(r[0]), r[2])
    assert sorted(want, key=key) == sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got], key=key)
    assert all(0 <= r.near_edited <= 1 for r in got)


def test_one_document_follows_itself(spark, make_docs):
    row = fp.edits(make_docs([(1, "abcdef")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0
    assert fp.edits(make_docs([])).collect() == []


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    errors = []
    for shared in (0, 50, 100, 200, 400):
        for _ in range(10):
            word = lambda: str(rng.randrange(10**9))
            common = [word() for _ in range(shared)]
            a, b = common + [word() for _ in range(100)], common + [word() for _ in range(100)]
            sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
            errors.append(fp.likeness(fp.minhash(" ".join(a)), fp.minhash(" ".join(b))) - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.15


def test_empty_and_short_texts():
    assert fp.minhash(None) == fp.minhash(" \n") == b""
    assert fp.likeness(b"", b"") == 1.0 and fp.likeness(b"", fp.minhash("a")) == 0.0
    assert fp.minhash("One two") == fp.minhash("one  TWO") and len(fp.minhash("x")) == 128
    assert fp.likeness(fp.minhash("x"), fp.minhash("x")) == pytest.approx(1.0)


def test_extra_columns_and_many_buckets(spark, make_docs):
    from pyspark.sql import functions as F

    docs = [(i * i - 500, f"text number {i} of some") for i in range(200)]
    table = make_docs(docs)
    for name in ("id", "bucket", "ahead", "top", "fingerprint", "goes"):
        table = table.withColumn(name, F.lit(name))
    rows = {r.doc_id: r.edited_sha256 for r in fp.edits(table).collect()}
    order = sorted(docs, reverse=True)
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        assert rows[doc_id] == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
