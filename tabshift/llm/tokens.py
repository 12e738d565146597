"""Token-ID output as sorted-string-table shards.

Texts are encoded where they are read; their ids, not the texts, are dealt into order buckets of the identifier, and each bucket
becomes one shard file with its documents in ascending order. A shard is written front to back:

    data blocks | block index | Bloom filter | footer

* A data block holds entries in key order: varint(shared), varint(unshared), varint(value length), the key's unshared end, the
  value. Keys share prefixes with the entry before, anew at every RESTART-th entry; the places of these restarts close the
  block, so a lookup searches them by halves. Blocks are compressed one by one.
* The index is sparse: first key, place and length of each block. A lookup asks the Bloom filter, then searches the index by
  halves, then one block (or the next few, where a key repeats across blocks).
* The footer has fixed length: places of index and filter, counts, a checksum of the index, and a mark.

A key is 0x01 and the id as a big-endian integer with its sign bit flipped, so byte order is id order; a null id is 0x02 and
comes last. A value is the ids as little-endian 16-bit integers (32-bit if the vocabulary needs them).

Files are named in a manifest only when whole: a lost or repeated task leaves a file that nothing names.

Defined results: a null or empty text has the end id alone; rows with equal ids stay, in order of their token ids' bytes, and a
lookup returns all of them; an empty table gives an empty result. Columns other than id and text are ignored. Strings of the
tokenizer's special tokens in a text become those tokens, as the library does by itself; ``special_as_text`` makes them text.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabshift.llm.common import MAX_BUCKETS, fresh_path, order_cuts, shard_count, staged, with_order_bucket

MAGIC = b"TSSST01\n"
FOOTER = struct.Struct("<QQQQQQII8s")
RESTART = 16
BLOCK_BYTES = 1 << 16
BLOOM_BITS_A_KEY, BLOOM_HASHES = 10, 7
ENCODE_BYTES = 16 << 20  # text encoded at a time
#: Fixed value: how a byte-level vocabulary writes a space.
SPACE = "\u0120"


def key_of(doc_id: int | None) -> bytes:
    return b"\x02" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x02" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard to an open binary stream; entries must come in key order."""

    def __init__(self, stream, id_bytes: int):
        self.stream, self.id_bytes, self.at = stream, id_bytes, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_docs = self.n_ids = 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.count, self.last, self.first = bytearray(), [], 0, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.count % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), min(len(key), len(self.last)))
        if not self.count:
            self.first = key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        if not self.keys or key != self.keys[-1]:
            self.keys.append(key)
        self.last = key
        self.count += 1
        self.n_docs += 1
        self.n_ids += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
            packed = self.pack.compress(raw)
            self.stream.write(packed)
            self.index.append((self.first, self.at, len(packed)))
            self.at += len(packed)
            self._open()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits = max(64, BLOOM_BITS_A_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.stream.write(index + bytes(bloom))
        self.stream.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.n_docs, self.n_ids, self.id_bytes, zlib.crc32(index), MAGIC))


class ShardReader:
    """Reads a shard from a random-access file: all entries in order, or those of one key."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        self.index_at, index_len, self.bloom_at, self.bits, self.n_docs, self.n_ids, self.id_bytes, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        source.seek(self.index_at)
        raw = source.read(index_len)
        if magic != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError("not a whole shard")
        self.index: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QI", raw, at + n)))
            at += n + 12
        self.bloom: bytes | None = None
        self.unpack = zstandard.ZstdDecompressor()

    def block(self, i: int) -> tuple[bytes, list[int]]:
        _, at, n = self.index[i]
        self.source.seek(at)
        raw = self.unpack.decompress(self.source.read(n))
        (count,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * count
        return raw[:end], list(struct.unpack_from(f"<{count}I", raw, end))

    @staticmethod
    def entries(data: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + length]
            at += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.entries(self.block(i)[0])

    def may_have(self, key: bytes) -> bool:
        if self.bloom is None:
            self.source.seek(self.bloom_at)
            self.bloom = self.source.read((self.bits + 7) // 8)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits))

    def get(self, doc_id: int | None) -> list[bytes]:
        key = key_of(doc_id)
        if not self.index or not self.may_have(key):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the last block whose first key is smaller; the key may begin in it
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for i in range(max(0, low - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            data, restarts = self.block(i)
            a, b = 0, len(restarts)
            while a < b:
                mid = (a + b) // 2
                a, b = (mid + 1, b) if next(self.entries(data, restarts[mid]))[0] < key else (a, mid)
            for k, v in self.entries(data, restarts[max(0, a - 1)]):
                if k > key:
                    break
                if k == key:
                    found.append(v)
        return found


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Pieces(NamedTuple):
    """The ids of numbered pieces in one array; an unknown piece has size 0."""

    flat: np.ndarray
    sizes: np.ndarray
    unknown: np.ndarray

    def begins(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


class Encoder:
    """The tokenizer, called once for each distinct word of a batch.

    The byte-level pre-tokenizer's pattern lets a token begin with a space but never go on after one, so a text may be cut before
    any single space between two characters that aren't white space, and around any single newline between such characters; its
    ids are those of the pieces in order. Full stops and commas after a letter or digit are a token run of their own, so a piece
    that ends in them is put together from its word and them. A text with other white space, or with the string of an added token,
    goes to the tokenizer whole. So do all texts if the file names another pre-tokenizer, a normalizer or the like.

    Arrow cuts the texts and numbers the distinct pieces; words are encoded many at a time as one text, whose tokens that begin with
    a space part the ids again; the ids of all pieces are then gathered by number. Only pieces with line breaks are seen one by one.
    """

    WORDS = 2000

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.apart = [t.content for t in added if not (special_as_text and t.special)]
        self.spaced = np.zeros(max(1 << 16, self.tokenizer.get_vocab_size()), bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == SPACE]] = True
        self.cuts = self._cuttable(json.loads(self.tokenizer.to_str()))
        self.newline = self._ids(["\n"])[0]

    @staticmethod
    def _cuttable(said: dict) -> bool:
        """Whether the file's settings are those that the cuts rely on."""
        before, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        plain = not any(said.get(k) for k in ("normalizer", "truncation", "padding"))
        pattern = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        return plain and pattern and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbered(self, found: list[np.ndarray | None]) -> Pieces:
        sizes = np.array([0 if v is None else len(v) for v in found], np.int64)
        return Pieces(np.concatenate([v for v in found if v is not None] or [np.empty(0, self.dtype)]), sizes, np.array([v is None for v in found], bool))

    def _words(self, words: pa.Array) -> Pieces:
        """The ids of each word with a space before it; a word has no white space."""
        n = len(words)
        offsets = pa.array(np.r_[np.arange(0, n, self.WORDS), n].astype(np.int32))
        texts = [" " + t for t in pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ").to_pylist()] if n else []
        flat = np.concatenate([*self._ids(texts), np.empty(0, self.dtype)])
        starts = np.flatnonzero(self.spaced[flat])
        if len(starts) != n:  # a vocabulary that parts words in another way
            return self._numbered(self._ids([" " + w for w in words.to_pylist()]))
        return Pieces(flat, np.diff(np.r_[starts, len(flat)]), np.zeros(n, bool))

    def _tails(self, pieces: pa.Array, cores: pa.Array) -> tuple[np.ndarray, Pieces]:
        """A number for what each piece has after its core, and the ids by number."""
        ends = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1, 4 * pieces.offset)[1:]
        long = pc.binary_length(pieces).to_numpy() - pc.binary_length(cores).to_numpy()
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        known: dict[str, int] = {"": 0, ".": 1, ",": 2}
        number = np.zeros(len(pieces), np.int64)
        one = long == 1
        number[one] = np.where(data[ends[one] - 1] == ord("."), 1, 2)
        for i in np.flatnonzero(long > 1).tolist():
            number[i] = known.setdefault(bytes(data[ends[i] - long[i] : ends[i]]).decode(), len(known))
        return number, self._numbered([np.empty(0, self.dtype), *self._ids(list(known)[1:])])

    def _is_plain(self, pieces: pa.Array) -> pa.Array:
        """Whether a piece without spaces has no other white space either, and nothing of an added token."""
        plain = pc.and_(pc.utf8_is_printable(pieces), pc.greater(pc.binary_length(pieces), 0))
        for t in self.apart:
            plain = pc.and_not(plain, pc.match_substring(pieces, t))
        return plain

    def _later(self, pieces: pa.Array) -> Pieces:
        """The ids of distinct pieces that follow a space."""
        plain = self._is_plain(pieces)
        own, others = pieces.filter(plain), pieces.filter(pc.invert(plain)).to_pylist()
        broken = [p.split("\n") if "\n" in p else None for p in others]
        heads = pa.array([x[0] for x in broken if x], pa.string())
        begun = self._begin([x for lines in broken if lines for x in lines[1:]])

        cores = pc.utf8_rtrim(own, ".,")
        ended = pc.and_(pc.less(pc.binary_length(cores), pc.binary_length(own)), pc.utf8_is_alnum(pc.utf8_slice_codeunits(cores, -1)))
        cores = pc.if_else(pc.and_(ended, pc.greater(pc.binary_length(cores), 0)), cores, own)
        tail, tails = self._tails(own, cores)
        known = self._is_plain(heads)
        words = pa.concat_arrays([cores, heads.filter(known)]).dictionary_encode()
        of, ids = words.indices.to_numpy(), self._words(words.dictionary)
        n, begins = len(own), ids.begins()

        # each plain piece is a word and a tail
        at = np.stack([begins[of[:n]], len(ids.flat) + tails.begins()[tail]], axis=1)
        each = np.stack([ids.sizes[of[:n]], tails.sizes[tail]], axis=1)
        flat = _gather(np.concatenate([ids.flat, tails.flat]), at.ravel(), each.ravel())

        head = iter(of[n:].tolist())
        told, rest = iter(known.to_pylist()), iter(begun)
        found: list[np.ndarray | None] = []
        for lines in broken:
            value = None
            if lines:
                parts = [ids.flat[begins[k] : begins[k] + ids.sizes[k]] if next(told) and (k := next(head)) >= 0 else None]
                parts += itertools.islice(rest, len(lines) - 1)
                value = self._joined(parts)
            found.append(value)
        other = self._numbered(found)

        sizes, unknown = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), bool)
        mask = plain.to_numpy(zero_copy_only=False)
        sizes[mask], sizes[~mask] = each.sum(axis=1), other.sizes
        unknown[~mask] = other.unknown
        both = np.concatenate([flat, other.flat])
        begins = np.zeros(len(pieces), np.int64)
        begins[mask], begins[~mask] = np.cumsum(each.sum(axis=1)) - each.sum(axis=1), len(flat) + other.begins()
        return Pieces(_gather(both, begins, sizes), sizes, unknown)

    def _joined(self, parts: list[np.ndarray | None]) -> np.ndarray | None:
        """Lines with newlines between them."""
        if any(p is None for p in parts):
            return None
        return np.concatenate([x for p in parts for x in (self.newline, p)][1:])

    def _begin(self, pieces: list[str]) -> list[np.ndarray | None]:
        """The ids of pieces without line breaks at the beginning of a text or line; None where one isn't plain."""
        distinct = list(dict.fromkeys(pieces))
        plain = self._is_plain(pa.array(distinct, pa.string())).to_pylist()
        kept = [p for p, ok in zip(distinct, plain, strict=True) if ok]
        known = dict(zip(kept, self._ids(kept), strict=True))
        return [known.get(p) for p in pieces]

    def _first(self, pieces: list[str]) -> Pieces:
        """The ids of the texts' first pieces."""
        lines = [p.split("\n") for p in pieces]
        begun = iter(self._begin([x for own in lines for x in own]))
        return self._numbered([self._joined(list(itertools.islice(begun, len(own)))) for own in lines])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, packed."""
        if not self.cuts:
            return [v.tobytes() for v in self._ids([t or "" for t in texts.to_pylist()])]
        n = len(texts)
        if not n:
            return []
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        starts = cut.offsets.to_numpy()
        starts = starts - starts[0]
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        first = self._first(coded.dictionary.take(pa.array(codes[starts[:-1]])).to_pylist())
        later = self._later(coded.dictionary)
        codes += n
        codes[starts[:-1]] = np.arange(n)
        all_sizes = np.concatenate([first.sizes, later.sizes])
        sizes = all_sizes[codes]
        ids = _gather(np.concatenate([first.flat, later.flat]), (np.cumsum(all_sizes) - all_sizes)[codes], sizes).tobytes()
        bounds = (np.r_[0, np.cumsum(sizes)][starts] * self.dtype.itemsize).tolist()
        odd = np.add.reduceat(np.concatenate([first.unknown, later.unknown])[codes].astype(np.int64), starts[:-1]) > 0
        for t in self.apart:  # its string may hold a space or a newline, so that no piece shows it
            odd |= pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False)
        out = [ids[a:b] for a, b in itertools.pairwise(bounds)]
        whole = np.flatnonzero(odd).tolist()
        for i, v in zip(whole, self._ids([texts[i].as_py() or "" for i in whole]), strict=True):
            out[i] = v.tobytes()
        return out


    def encode_after_space(self, texts: pa.Array) -> list[bytes]:
        """The ids of a space and each text, packed: then all its pieces follow a space."""
        whole = lambda at: [" " + (texts[i].as_py() or "") for i in at]
        if not self.cuts:
            return [v.tobytes() for v in self._ids(whole(range(len(texts))))]
        if not len(texts):
            return []
        cut = pc.split_pattern(pc.fill_null(texts, ""), " ")
        starts = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        later = self._later(coded.dictionary)
        sizes = later.sizes[codes]
        ids = _gather(later.flat, later.begins()[codes], sizes).tobytes()
        bounds = (np.r_[0, np.cumsum(sizes)][starts - starts[0]] * self.dtype.itemsize).tolist()
        odd = np.add.reduceat(later.unknown[codes].astype(np.int64), starts[:-1] - starts[0]) > 0
        for t in self.apart:
            odd |= pc.fill_null(pc.match_substring(texts, t), False).to_numpy(zero_copy_only=False)
        out = [ids[a:b] for a, b in itertools.pairwise(bounds)]
        at = np.flatnonzero(odd).tolist()
        for i, v in zip(at, self._ids(whole(at)), strict=True):
            out[i] = v.tobytes()
        return out


@cache
def encoder(path: str, special_as_text: bool) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, special_as_text)


def _open(path: str):
    store, inner = pyarrow.fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pyarrow.fs.LocalFileSystem(), path)
    return store, inner


def encoded(docs: DataFrame, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """(id, wide, ids) of every row: its ids and the end id as packed little-endian integers, ``wide`` bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special_as_text)
        wide, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, max(1, int(np.searchsorted(upto, ENCODE_BYTES + (upto[at - 1] if at else 0))) - at))
                at += part.num_rows
                values = [v + end for v in enc.encode(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([wide] * len(values), pa.int32()), pa.array(values, pa.binary())], names=["id", "wide", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, wide int, ids binary")


def write_shards(docs: DataFrame, *, tokenizer: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Write the shards below ``path`` (a folder that all executors see) and return the manifest.

    (bucket, path, n_docs, n_ids, first_id, last_id, start): start counts the ids of all shards before.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    n = shard_count(docs, 64 << 20, MAX_BUCKETS)
    cuts = order_cuts(docs, id_col, n)
    rows = with_order_bucket(encoded(docs, tokenizer=tokenizer, end_id=end_id, id_col=id_col, text_col=text_col, special_as_text=special_as_text), "id", cuts)
    rows = rows.withColumn("bucket", F.coalesce("bucket", F.lit(n + 1)))  # null ids come last
    ordered = rows.repartitionById(n + 2, "bucket").sortWithinPartitions("bucket", F.col("id").asc_nulls_last(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _open(path)
        store.create_dir(folder, recursive=True)
        writer = name = bucket = stream = None
        done, ids = [], []

        def finish() -> None:
            writer.close()
            stream.close()
            done.append({"bucket": bucket, "path": f"{path}/{name}", "n_docs": writer.n_docs, "n_ids": writer.n_ids, "first_id": ids[0], "last_id": ids[1]})

        for batch in batches:
            for b, i, wide, value in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "id", "wide", "ids")), strict=True):
                if writer is None or b != bucket:
                    if writer is not None:
                        finish()
                    name, bucket, ids = f"{b:06d}-{uuid.uuid4().hex}.sst", b, [i, i]
                    stream = store.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(stream, wide)
                writer.add(key_of(i), value)
                ids[1] = i
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pylist(done, schema=MANIFEST)

    manifest = staged(ordered.mapInArrow(write, "bucket int, path string, n_docs long, n_ids long, first_id long, last_id long"), "manifest")
    # one row a shard, at most as many as buckets
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


MANIFEST = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def read_shards(manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every document of the shards: (id, start, n_tokens, ids_crc32), and the ids themselves if asked for."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = manifest.repartitionById(n, F.pmod("bucket", F.lit(n)))
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] if with_ids else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, inner = _open(row["path"])
                with store.open_input_file(inner) as source:
                    shard = ShardReader(source)
                    dtype, start = f"<u{shard.id_bytes}", row["start"]
                    entries = iter(shard)
                    while part := list(itertools.islice(entries, 2048)):
                        found = [np.frombuffer(value, dtype) for _, value in part]
                        sizes = np.array([len(ids) for ids in found], np.int64)
                        ends = start + np.cumsum(sizes)
                        columns = [[id_of(key) for key, _ in part], ends - sizes, sizes, [zlib.crc32(ids.astype("<u4")) for ids in found]]
                        columns += [[ids.astype(np.int64) for ids in found]] if with_ids else []
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                        start = int(ends[-1])

    return dealt.mapInArrow(read, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def lookup(spark: SparkSession, manifest: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) for the asked identifiers: each is dealt to the one shard whose range holds it and searched there by halves.

    A null id is looked up like any other, in the shards that hold null ids. The driver gets the manifest's rows with ids: two numbers
    and a path for each shard, MAX_BUCKETS at most.
    """
    nameless = [s.path for s in manifest.filter("first_id is null").select("path").orderBy("path").collect()]
    shards = manifest.filter("first_id is not null").select("path", "first_id", "last_id").orderBy("first_id").collect()
    firsts, lasts, paths = np.array([s.first_id for s in shards], np.int64), np.array([s.last_id for s in shards], np.int64), [s.path for s in shards] + nameless

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(firsts, asked, side="right") - 1
            held = (at >= 0) & (asked <= lasts[np.maximum(at, 0)]) if len(firsts) else np.zeros(len(asked), bool)
            yield pa.RecordBatch.from_arrays([pa.array(at[held].astype(np.int32)), pa.array(asked[held])], names=["shard", "asked"])

    asked = ids.select(F.col(id_col).cast("long").alias("asked")).distinct()
    met = asked.filter("asked is not null").mapInArrow(deal, "shard int, asked long")
    if nameless:
        null_shards = F.array(*[F.lit(len(shards) + i).cast("int") for i in range(len(nameless))])
        met = met.unionByName(asked.filter("asked is null").select(F.explode(null_shards).alias("shard"), "asked"))
    found_schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, ShardReader] | None = None
        for batch in batches:
            out = []
            for shard, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if opened is None or opened[0] != shard:
                    store, inner = _open(paths[shard])
                    opened = (shard, ShardReader(store.open_input_file(inner)))
                out += [{id_col: doc_id, "ids": np.frombuffer(v, f"<u{opened[1].id_bytes}").tolist()} for v in opened[1].get(doc_id)]
            yield pa.RecordBatch.from_pylist(out, schema=found_schema)

    return met.repartition("shard").sortWithinPartitions("shard", "asked").mapInArrow(find, f"`{id_col}` long, ids array<long>")
