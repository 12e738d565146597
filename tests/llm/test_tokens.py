import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from tabshift.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(encoder, texts):
    return [np.frombuffer(ids, encoder.dtype).tolist() for ids in encoder.encode(pa.array(texts, pa.string()))]


TEXTS = ["", " ", "a", "Hello, world. It's 3.14!", "two  spaces", " lead", "trail ", "line\nline two,\n\nlines", "tab\tx", "a b", "don't 'll ...", "x.,.,y 1,000.", "\r\n", "é ü 漢字 😀.", "a. b.\nC, d", "<|endoftext|> x", "a \nb", "\x85 x\x85", "é. é,", "²., ½."]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_gives_the_tokenizers_ids(special_as_text):
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = special_as_text
    encoder = tokens.Encoder(PATH, special_as_text)
    assert encoder.cuts
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choice(["a", "The", " ", " ", "\n", ".", ",", "'s", "9", "é", "\t", "<|endoftext|>"]) for _ in range(30)) for _ in range(3000)]
    for _ in range(2):  # with and without remembered pieces
        for text, ids in zip(texts, ids_of(encoder, texts), strict=True):
            assert ids == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert ids_of(encoder, [None]) == [[]] and ids_of(encoder, []) == []


def test_special_token_is_the_librarys(plain):
    text = "a <|endoftext|> b"
    assert ids_of(tokens.Encoder(PATH), [text]) == [plain.encode(text, add_special_tokens=False).ids]
    assert 50256 in plain.encode(text, add_special_tokens=False).ids and 50256 not in ids_of(tokens.Encoder(PATH, True), [text])[0]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_settings_of_a_file_are_kept_to(tmp_path, change):
    said = json.loads(Tokenizer.from_file(PATH).to_str())
    said.update(change)
    (tmp_path / "own.json").write_text(json.dumps(said))
    plain, encoder = Tokenizer.from_file(str(tmp_path / "own.json")), tokens.Encoder(str(tmp_path / "own.json"))
    texts = ["Hello World. Ab", "  The\tEnd", ""]
    assert not encoder.cuts and ids_of(encoder, texts) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_many_words_and_scripts(plain):
    rng = random.Random(5)
    letters = "abcXYZ019éßœЖ漢字😀'.,-&$\u0301\u200d\u00a0\u3000\u2028\x1c\x85"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(60)) for _ in range(300)]
    texts.append(" ".join(f"w{i}" for i in range(5001)))
    assert ids_of(tokens.Encoder(PATH), texts) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_printable_characters_are_no_white_space():
    chars = [chr(c) for c in range(33, 0x110000) if not 0xD800 <= c < 0xE000]
    printable = pc.utf8_is_printable(pa.array(chars)).to_numpy(zero_copy_only=False)
    assert not any(c.isspace() for c, ok in zip(chars, printable, strict=True) if ok)


def test_texts_are_encoded_in_bounded_slices(monkeypatch, spark, make_docs, plain):
    monkeypatch.setattr(tokens, "ENCODE_BYTES", 30)
    docs = [(i, "some words " * (i % 9) + f"x{i}") for i in range(50)] + [(90, None), (91, "")]
    got = {r.id: np.frombuffer(r.ids, "<u2").tolist() for r in tokens.encoded(make_docs(docs), tokenizer=PATH, end_id=2).collect()}
    assert got == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}


def test_round_trip(spark, make_docs, plain):
    docs = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(-5, "minus"), (4, None), (6, "again"), (6, "again"), (None, "none"), (1 << 40, "word " * 30_000)]
    manifest = tokens.write_shards(make_docs(docs), tokenizer=PATH)
    got = tokens.read_shards(manifest, with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    packed = lambda t: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u2").tobytes()
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0, packed(d[1])))
    start = 0
    for (doc_id, text), row in zip(docs, got, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    asked = spark.createDataFrame([(6,), (3,), (5,), (-5,), (1 << 40,)], "doc_id long")
    found = sorted((r.doc_id, len(r.ids)) for r in tokens.lookup(spark, manifest, asked).collect())
    sizes = {r.doc_id: r.n_tokens for r in got}
    assert sorted(found) == sorted([(6, n.n_tokens) for n in got if n.doc_id == 6] + [(k, sizes[k]) for k in (3, -5, 1 << 40)])


def test_empty_table(spark, make_docs):
    assert tokens.read_shards(tokens.write_shards(make_docs([]), tokenizer=PATH)).collect() == []


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_blocks_index_and_bloom_filter(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 200)
    out = Source()
    writer = tokens.ShardWriter(out, 2)
    keys = sorted([*range(0, 3000, 7), 70, 70, 70, *[1400] * 60])
    for n, k in enumerate(keys):
        writer.add(tokens.key_of(k), np.array([n], "<u2").tobytes())
    writer.add(tokens.key_of(None), b"\x01\x00")
    writer.close()
    reader = tokens.ShardReader(out)
    assert len(reader.index) > 10 and reader.n_docs == len(keys) + 1
    assert [tokens.id_of(k) for k, _ in reader] == [*keys, None]
    for k in {*keys, 1, 2, 2999, -1, 10**9}:
        assert [int(np.frombuffer(v, "<u2")[0]) for v in reader.get(k)] == [n for n, x in enumerate(keys) if x == k]
    assert reader.get(None) == [b"\x01\x00"]
    assert sum(reader.may_have(tokens.key_of(k)) for k in range(10**6, 10**6 + 1000)) < 60
    with pytest.raises(ValueError):
        tokens.ShardReader(Source(out.getvalue()[:-9] + b"x" * 9))


def test_null_ids_are_found(spark, make_docs):
    manifest = tokens.write_shards(make_docs([(1, "one"), (None, "two words"), (None, "three"), (4, None)]), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    asked = spark.createDataFrame([(None,), (4,), (9,)], "doc_id long")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in tokens.lookup(spark, manifest, asked).collect()) == [(0, 2), (0, 3), (4, 1)]
