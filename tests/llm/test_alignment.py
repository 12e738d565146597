import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tabshift.llm import alignment  # noqa: E402

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    return a, b


def pieces_of(both, text):
    """Tokens of both as (id, bytes), or none; whole texts go to the libraries."""
    a, b = both
    if not text:
        return [], []
    found = a.encode(" " + text, add_special_tokens=False)
    mine = [(i, alignment.byte_level(t)) for i, t in zip(found.ids, found.tokens, strict=True)]
    theirs = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (mine, theirs) if b"".join(x for _, x in mine) == b"".join(x for _, x in theirs) == whole else ([], [])


def brute(both, texts):
    docs = []
    for text in texts:
        mine, theirs = pieces_of(both, text)
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (mine, theirs)]
        groups = []
        for k, side in enumerate((mine, theirs)):
            at, n = 0, 0
            for i, x in side:
                while len(groups) <= n:
                    groups.append(([], []))
                groups[n][k].append(i)
                at += len(x)
                n += at in ends[0] & ends[1]
        docs.append((mine, theirs, groups))
    count = Counter(p for _, _, groups in docs for p in {(i, j) for a, b in groups for i in a for j in b})
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for mine, theirs, groups in docs:
        links = [(i, j) for a, b in groups for i in a for j in b]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((len(mine), len(theirs), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def held(spark, make_docs, both, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    got = alignment.aligned(make_docs(list(zip(ids, texts, strict=True))), byte_tokenizer=BYTES, piece_tokenizer=PIECES).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, *(r[c] for c in FIELDS)) for r in got) == order((i, *x) for i, x in zip(ids, brute(both, texts), strict=True))
    return got


ODD = [
    None, "", " ", "  ", "a", " lead", "trail ", "two  spaces", "\n", "line\nbreak\r\n\ttab", "déjà vu, Straße", "日本語のテキスト 漢字", "🙂🙂 x", "▁ mark", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "nul\x00 byte", "﻿bom",
    "ﬁ ligature   　 wide", "don't won't I'll", "1234567 3.14 1e9", "x" * 3000, "ab" * 2000 + " c", "é composed", "​zero width", "'" * 40, "= = = ====", "Repeat Repeat Repeat",
]


def test_odd_texts(spark, make_docs, both):
    held(spark, make_docs, both, ODD)


def test_against_brute_force(spark, make_docs, both, monkeypatch):
    rng = random.Random(3)
    syllables = ["er", "ing", "tion", "sch", "ü", "é", "ко", "中", "the", "Str", ",", ".", "-", "_x", "42"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    texts = [rng.choice([" ", " ", " ", "\n", "  "]).join(word() for _ in range(rng.randrange(0, 80))) for _ in range(150)]
    texts += [texts[3]] * 20 + texts[:10]
    held(spark, make_docs, both, texts)
    monkeypatch.setattr(alignment, "BATCH", 700)  # many batches: counts meet in the shards
    monkeypatch.setattr(alignment, "PAIRS", 90)
    monkeypatch.setattr(alignment, "LARGE", 3)
    held(spark, make_docs, both, texts, ids=[i // 2 for i in range(len(texts))])


def test_given_documents(spark, both):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = alignment.aligned(docs, byte_tokenizer=BYTES, piece_tokenizer=PIECES).collect()
    want = brute(both, [r.text for r in rows])
    assert sorted((r.doc_id, *(r[c] for c in FIELDS)) for r in got) == sorted((r.doc_id, *x) for r, x in zip(rows, want, strict=True))


def test_empty_table_and_other_columns(spark, make_docs):
    assert alignment.aligned(make_docs([]), byte_tokenizer=BYTES, piece_tokenizer=PIECES).collect() == []
    table = spark.createDataFrame([("x", "one two", 1, 2, b"3")], "id string, text string, batch int, kind int, payload binary")
    got = alignment.aligned(table, byte_tokenizer=BYTES, piece_tokenizer=PIECES, id_col="id").collect()
    assert [(r.id, r.n_groups) for r in got] == [("x", 2)]


def test_intervals_of_tokens_that_never_end_together():
    g = alignment.groups_of(np.array([2, 2, 2, 1]), np.array([1, 2, 2, 2]))
    assert [x.tolist() for x in g] == [[0], [4], [0], [4]]
    group, pair, times = alignment.links_of(g, np.array([5, 5, 6, 7]), np.array([1, 2, 1, 3]), 10)
    assert sorted(Counter(pair.tolist()).items()) == [(51, 4), (52, 2), (53, 2), (61, 2), (62, 1), (63, 1), (71, 2), (72, 1), (73, 1)]


def test_word_by_word_is_whole_text(both):
    encoder = alignment.PieceEncoder(PIECES)
    assert encoder.cuts
    texts = [t or "" for t in ODD] + ["a b c d", "one two  three", "x y ", "z"]
    flat, sizes = encoder.encode(pa.array(texts))
    assert flat.tolist() == [i for t in texts for i in both[1].encode(t)] and sizes.tolist() == [len(both[1].encode(t)) for t in texts]
