"""Substring dedup of words by relative Lempel-Ziv parsing.

Every word covered by a WINDOW-word sequence that also starts in a document with a smaller id is removed. A factor is a run of words
that stands, word for word, in an earlier document; documents are parsed greedily, each factor as long as its source goes on, and
factors of WINDOW words or more are the duplicate spans. Reference blocks are indexed by fingerprints of their windows.

1. A task's batch of documents is the first reference block for its own documents: they are parsed against its index, factors are
   compared with the words they stand for, and what is settled so, such as copies of one passage, leaves the batch no more.
2. The other windows' fingerprints go to shards, each an index of all reference blocks for its share of the fingerprints. A shard
   answers a window with the place at which the smallest document holds it, and tells that document that it is a source.
3. Documents meet their answers and are parsed greedily: a factor takes in window after window as long as the answers point to
   consecutive places of one source, and at its boundary a new factor begins with the next window's own answer, so that a match
   that reaches across a boundary is found by the windows that straddle it. Each factor claims its source's words by a digest
   (BLAKE2b, 128 bits); sources hand over the passages that others point to.
4. Claims are checked against the sources' words, each different claim once. One that is denied shows fingerprints that collide:
   the windows behind it are then compared by their words, with all that point to the same places, and their documents parsed anew.

Claims of a batch are put together before they travel, a passage leaves a batch once, and an index entry costs a shard some nine
bytes, so that a passage which a third of all documents hold loads no task. Words are separated by ASCII white space and compared
unchanged.

Defined results: a null text has no words; texts of fewer words than a window lose nothing; rows with equal ids are never sources
for each other, and repeated rows get the same result each; a null id counts as larger than all; an empty table gives an empty
result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm.common import discard, shard_count, staged
from tabshift.llm.shards import mix64
from tabshift.llm.suffixes import CHUNK, LAST_ID, Hashes, _intervals, bucket_of, tag_of

WINDOW = 13
BATCH, SHARD = 6 << 20, 8 << 20
#: Bits of a fingerprint beside its shard's number.
KEY_BITS = 48
BASE = np.uint64(0x9E3779B97F4A7C15)

PLACE = [("id", "<i8"), ("tag", "<u4"), ("pos", "<u4")]
WINDOWS_OF = np.dtype([("key", "<u8"), *PLACE])
SOURCE = np.dtype(PLACE)
SPAN = np.dtype([*PLACE, ("n", "<u4")])
POINTER = np.dtype([*PLACE, ("src_id", "<i8"), ("src_tag", "<u4"), ("src_pos", "<u4")])
CLAIM = np.dtype([*PLACE, ("n", "<u4"), ("a", "<u8"), ("b", "<u8")])

WINDOWS, SPANS, POINTERS, SOURCES, STRUCK, REFERENCE, CLAIMS, RESULTS, DOCUMENT = range(1, 10)
ROWS = pa.schema([("kind", pa.int32()), ("dest", pa.int32()), ("payload", pa.binary())])
ROWS_SQL = "kind int, dest int, payload binary"
RESULT = [("id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
MET = pa.schema([("kind", pa.int32()), ("dest", pa.int32()), ("payload", pa.binary()), *RESULT])
MET_SQL = "kind int, dest int, payload binary, id long, tag long, n_words long, n_removed long, kept_sha256 string"


def pack(x: np.ndarray) -> bytes:
    """Records by columns: fingerprints as they are, in the bytes they need, all else as differences, compressed."""
    keys, rest = b"", []
    for name in x.dtype.names:
        column = np.ascontiguousarray(x[name])
        if name == "key":
            keys = np.ascontiguousarray(column.view("u1").reshape(len(x), 8)[:, : KEY_BITS // 8]).tobytes()
        else:
            rest.append(np.diff(column, prepend=column.dtype.type(0)).tobytes())
    return np.int64(len(x)).tobytes() + keys + zlib.compress(b"".join(rest), 1)


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = int(np.frombuffer(blob, "<i8", 1)[0]), 8
    x = np.empty(n, dtype)
    if "key" in dtype.names:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : KEY_BITS // 8] = np.frombuffer(blob, np.uint8, KEY_BITS // 8 * n, at).reshape(n, KEY_BITS // 8)
        x["key"] = wide.view("<u8")[:, 0]
        at += KEY_BITS // 8 * n
    data, at = zlib.decompress(memoryview(blob)[at:]), 0
    for name in dtype.names:
        if name != "key":
            column = np.frombuffer(data, dtype[name], n, at)
            x[name] = np.cumsum(column, dtype=dtype[name])
            at += column.nbytes
    return x


def _rows(found: Iterable[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, dests, payloads = zip(*found, strict=True) if (found := list(found)) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(dests, pa.int32()), pa.array(payloads, pa.binary())], schema=ROWS)


def _dealt(kind: int, to: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows of records by destination, in order of document and place."""
    order = np.lexsort((records["pos"], records["tag"], records["id"], to))
    to, records = to[order], records[order]
    starts = _groups(to)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(to)], strict=False):
        yield kind, int(to[s]), pack(records[s:e])


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs in which all keys stay equal."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Document(NamedTuple):
    id: int | None
    words: list[bytes]
    tag: int

    @classmethod
    def of(cls, doc_id: int | None, text: str | None) -> Document:
        data = (text or "").encode("utf-8", "surrogatepass")
        return cls(doc_id, data.split(), tag_of(data))

    @property
    def key(self) -> int:
        return LAST_ID if self.id is None else self.id


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A fingerprint of each word of a buffer, by blocks of the buffer."""
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > CHUNK)
    for base in range(0, len(data), CHUNK):
        i, j = np.searchsorted(starts, [base, base + CHUNK])
        if i < j:
            part = data[base : base + 2 * CHUNK]
            out[i:j] = Hashes(part).ranges(starts[i:j] - base, np.minimum(ends[i:j] - base, len(part)))
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return out


class Member(NamedTuple):
    """A document of a block: its words with one space after each."""

    key: int
    tag: int
    n_words: int
    data: bytes

    @classmethod
    def of(cls, doc: Document) -> Member:
        return cls(doc.key, doc.tag, len(doc.words), b" ".join([*doc.words, b""]))


class Block:
    """An indexed batch of documents: their words in one buffer, and a fingerprint of each window."""

    def __init__(self, docs: list[Member]) -> None:
        self.bytes = b"".join(d.data for d in docs)
        data = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.flatnonzero(data == 32)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        counts = np.array([d.n_words for d in docs], np.int64)
        doc = np.repeat(np.arange(len(docs)), counts)
        n = max(0, len(doc) - WINDOW + 1)
        words = word_prints(data, self.starts, self.ends)
        prints = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            prints = prints * BASE + words[i : i + n]
        #: The windows' first words, and their documents.
        self.at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :]) if n else np.empty(0, np.int64)
        self.doc = doc[self.at]
        self.prints = mix64(prints[self.at])
        self.id = np.array([d.key for d in docs], np.int64)[self.doc]
        self.tag = np.array([d.tag for d in docs], np.uint32)[self.doc]
        self.pos = self.at - (np.cumsum(counts) - counts)[self.doc]

    def places(self, which: np.ndarray, dtype: np.dtype) -> np.ndarray:
        out = np.empty(len(which), dtype)
        for name in ("id", "tag", "pos"):
            out[name] = getattr(self, name)[which]
        return out

    def same(self, i: int, j: int, n: int) -> bool:
        """Whether n windows from numbers i and j on hold the same words."""
        a, b = self.at[i], self.at[j]
        last = n + WINDOW - 2
        return self.bytes[self.starts[a] : self.ends[a + last]] == self.bytes[self.starts[b] : self.ends[b + last]]

    def parse(self) -> np.ndarray:
        """Which windows the block's own earlier documents hold, found by greedy factors and compared word for word."""
        settled = np.zeros(len(self.at), bool)
        source = earliest(self.prints, self.id, self.tag, self.pos)
        later = np.flatnonzero((source >= 0) & (self.id > self.id[source]))
        source = source[later]
        for s, e in factors(later, source, self.doc[later], self.doc[source]):
            i, j = int(later[s]), int(source[s])
            if self.same(i, j, e - s):
                settled[i : i + e - s] = True
            else:
                settled[i : i + e - s] = [self.same(i + k, j + k, 1) for k in range(e - s)]
        return settled


def earliest(keys: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """For each record the number of the first by document and place that has its key; -1 where no other has it."""
    out = np.full(len(keys), -1)
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.r_[False, ordered[1:] == ordered[:-1], False]
    often = order[same[1:] | same[:-1]]
    often = often[np.lexsort((pos[often], tags[often], ids[often], keys[often]))]
    starts = _groups(keys[often])
    out[often] = np.repeat(often[starts], np.diff(np.r_[starts, len(often)]))
    return out


def factors(at: np.ndarray, source: np.ndarray, *same: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the greedy factors: runs in which windows and their sources go on by one, and all of ``same`` stay as they are."""
    starts = _groups(at - np.arange(len(at)), source - np.arange(len(at)), *same)
    return zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=False)


def _digest(words: list[bytes]) -> tuple[int, int]:
    data = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(data[:8], "little"), int.from_bytes(data[8:], "little")


def _runs(pos: np.ndarray) -> list[tuple[int, int]]:
    """(first window, windows) of the runs of consecutive places."""
    pos = np.unique(pos).astype(np.int64)
    starts = _groups(pos - np.arange(len(pos)))
    return [(int(pos[s]), e - s) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(pos)], strict=False)]


class Marks:
    """What a bucket's documents are told, by document."""

    def __init__(self) -> None:
        self.kinds = {SPANS: SPAN, POINTERS: POINTER, SOURCES: SOURCE, STRUCK: SOURCE}
        self.parts: dict[int, list[np.ndarray]] = {k: [] for k in self.kinds}
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, kind: int, payload: bytes) -> None:
        self.parts[kind].append(unpack(payload, self.kinds[kind]))

    def of(self, kind: int, doc: Document) -> np.ndarray:
        if kind not in self.found:
            x = np.concatenate(self.parts[kind] or [np.empty(0, self.kinds[kind])])
            x = x[np.lexsort((x["pos"], x["tag"], x["id"]))]
            self.found[kind] = x, np.ascontiguousarray(x["id"])
            self.parts[kind] = []
        x, ids = self.found[kind]
        part = x[ids.searchsorted(doc.key, "left") : ids.searchsorted(doc.key, "right")]
        return part[part["tag"] == doc.tag]


def _result(doc: Document, spans: np.ndarray) -> dict:
    kept, at = [], 0
    for a, b in spans.tolist():
        kept += doc.words[at:a]
        at = b
    kept += doc.words[at:]
    return {"kind": RESULTS, "id": doc.id, "tag": doc.tag, "n_words": len(doc.words), "n_removed": len(doc.words) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}


#: A passage that others point to: its document and first word, and its bytes.
PASSAGE = np.dtype([*PLACE, ("size", "<i8")])


def _passages(doc: Document, sources: np.ndarray) -> list[tuple[tuple[int, int, int, int], bytes]]:
    out = []
    for first, n in _runs(sources["pos"]):
        blob = b" ".join(doc.words[first : first + n + WINDOW - 1])
        out.append(((doc.key, doc.tag, first, len(blob)), blob))
    return out


def denied(passages: Iterable[bytes], claims: np.ndarray) -> np.ndarray:
    """The claims whose digest isn't that of the source's words."""
    known: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for payload in passages:
        n = int(np.frombuffer(payload, "<i8", 1)[0])
        heads, at = np.frombuffer(payload, PASSAGE, n, 8), 8 + n * PASSAGE.itemsize
        for doc_id, tag, first, size in heads.tolist():
            known.setdefault((doc_id, tag), []).append((first, payload[at : at + size]))
            at += size
    for runs in known.values():
        runs.sort(key=lambda r: r[0])
    wrong = np.zeros(len(claims), bool)
    last: tuple | None = None
    words: list[bytes] = []
    for i, (doc_id, tag, pos, n, a, b) in enumerate(claims.tolist()):
        runs = known[doc_id, tag]
        first, blob = runs[bisect_right(runs, pos, key=lambda r: r[0]) - 1]
        if last != (doc_id, tag, first):
            last, words = (doc_id, tag, first), blob.split(b" ")
        wrong[i] = _digest(words[pos - first : pos - first + n + WINDOW - 1]) != (a, b)
    return claims[wrong]


def duplicated_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shards = shard_count(docs, SHARD)
    buckets = shards | 1
    key_mask = np.uint64((1 << KEY_BITS) - 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Member] = []
        size = 0

        def flush() -> pa.RecordBatch:
            block = Block(waiting)
            settled = block.parse()
            own = np.flatnonzero(settled)
            starts = _groups(own - np.arange(len(own)), block.doc[own])
            spans = block.places(own[starts], SPAN)
            spans["n"] = np.diff(np.r_[starts, len(own)]) + WINDOW - 1
            others = np.flatnonzero(~settled)
            windows = block.places(others, WINDOWS_OF)
            windows["key"] = block.prints[others] & key_mask
            shard = ((block.prints[others] >> np.uint64(KEY_BITS)) % np.uint64(shards)).astype(np.int32)
            return _rows([*_dealt(SPANS, bucket_of(spans["id"], spans["tag"], buckets), spans), *_dealt(WINDOWS, shard, windows)])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc = Document.of(doc_id.as_py(), text.as_py())
                if len(doc.words) >= WINDOW:
                    waiting.append(Member.of(doc))
                    size += len(waiting[-1].data)
                    if size >= BATCH:
                        yield flush()
                        waiting, size = [], 0
        if waiting:
            yield flush()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            passing = []
            for kind, dest, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind == WINDOWS:
                    held.setdefault(dest, []).append(unpack(payload, WINDOWS_OF))
                else:
                    passing.append((kind, dest, payload))
            if passing:
                yield _rows(passing)
        for dest in list(held):
            x = np.concatenate(held.pop(dest))
            at = earliest(*(np.ascontiguousarray(x[c]) for c in ("key", "id", "tag", "pos")))
            told = np.flatnonzero((at >= 0) & (at != np.arange(len(x))))
            of = x[at[told]]
            out = np.empty(len(told), POINTER)
            for c in ("id", "tag", "pos"):
                out[c], out[f"src_{c}"] = x[c][told], of[c]
            # a place that shares its fingerprint with one of the same id has no source there, but is known to the shard
            earlier = out["src_id"] < out["id"]
            sources = np.unique(of[["id", "tag", "pos"]][earlier].astype(SOURCE))
            yield _rows([*_dealt(POINTERS, bucket_of(out["id"], out["tag"], buckets), out), *_dealt(SOURCES, bucket_of(sources["id"], sources["tag"], buckets), sources)])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks()
        for batch in batches:
            out: list[dict] = []
            claims: set[tuple] = set()
            passages: list[tuple[tuple, bytes]] = []
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("kind", "payload", "id", "text"))
            for kind, payload, doc_id, text in zip(*columns, strict=True):
                if (kind := kind.as_py()) != DOCUMENT:
                    marks.add(kind, payload.as_py())
                    continue
                doc = Document.of(doc_id.as_py(), text.as_py())
                spans, pointers = marks.of(SPANS, doc), marks.of(POINTERS, doc)
                pointers = pointers[pointers["src_id"] < pointers["id"]]
                if len(struck := marks.of(STRUCK, doc)):
                    pointers = pointers[~np.isin(pointers["pos"], struck["pos"])]
                pos, there = pointers["pos"].astype(np.int64), pointers["src_pos"].astype(np.int64)
                low, high = [spans["pos"].astype(np.int64)], [spans["pos"].astype(np.int64) + spans["n"]]
                for s, e in factors(pos, there, pointers["src_id"], pointers["src_tag"]):
                    p = pointers[s]
                    words = doc.words[pos[s] : pos[s] + e - s + WINDOW - 1]
                    claims.add((int(p["src_id"]), int(p["src_tag"]), int(there[s]), e - s, *_digest(words)))
                    low.append(pos[s : s + 1])
                    high.append(pos[s : s + 1] + len(words))
                out.append(_result(doc, _intervals(np.concatenate(low), np.concatenate(high))))
                if len(sources := marks.of(SOURCES, doc)):
                    passages += _passages(doc, sources)
            if claims:
                x = np.array(sorted(claims), CLAIM)
                out += [{"kind": k, "dest": d, "payload": b} for k, d, b in _dealt(CLAIMS, bucket_of(x["id"], x["tag"], buckets), x)]
            for head, blob in passages:
                dest = int(bucket_of(np.array([head[0]]), np.array([head[1]]), buckets)[0])
                out.append({"kind": REFERENCE, "dest": dest, "payload": np.int64(1).tobytes() + np.array([head], PASSAGE).tobytes() + blob})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=MET)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, claims = [], []
        for batch in batches:
            for kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if kind == REFERENCE:
                    passages.append(payload)
                else:
                    claims.append(unpack(payload, CLAIM))
        if claims:
            x = denied(passages, np.unique(np.concatenate(claims)))
            yield pa.RecordBatch.from_arrays([pa.array(x[c].astype(np.int64)) for c in ("id", "tag", "pos", "n")], names=["src_id", "src_tag", "low", "n"])

    tag = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))
    key = F.coalesce("id", F.lit(LAST_ID))
    bucket = F.pmod(F.pmod(key, F.lit(buckets)) + F.pmod(tag, F.lit(buckets)), F.lit(buckets)).cast("int")

    def parsed(rows: DataFrame, told: DataFrame) -> DataFrame:
        """Results, claims and passages of documents and what they are told."""
        both = told.select("kind", "dest", "payload").unionByName(rows.select(F.lit(DOCUMENT).alias("kind"), bucket.alias("dest"), "id", "text"), allowMissingColumns=True)
        return both.repartitionById(buckets, "dest").sortWithinPartitions("kind").mapInArrow(parse, MET_SQL)

    sent = source.mapInArrow(first, ROWS_SQL)
    marks = staged(sent.repartitionById(shards, F.pmod("dest", F.lit(shards))).mapInArrow(look_up, ROWS_SQL), "factor-marks")
    met = staged(parsed(source, marks), "factor-met")
    claimed = met.filter(F.col("kind").isin(REFERENCE, CLAIMS)).select("dest", "kind", "payload").repartitionById(buckets, "dest").select("kind", "payload")
    wrong = staged(claimed.mapInArrow(check, "src_id long, src_tag long, low long, n long"), "factor-denied")
    out = met.filter(F.col("kind") == RESULTS)
    if not wrong.isEmpty():
        struck = staged(collided(source.withColumns({"key": key, "tag": tag}), marks, wrong), "factor-struck")
        who = struck.select(F.col("id").alias("w_key"), F.col("tag").alias("w_tag")).distinct()
        again = source.join(who, (key == who["w_key"]) & (tag == who["w_tag"]), "left_semi")
        rows = struck.groupBy("id", "tag", F.pmod(F.pmod("id", F.lit(buckets)) + F.pmod("tag", F.lit(buckets)), F.lit(buckets)).cast("int").alias("dest")).agg(F.array_sort(F.collect_set("pos")).alias("pos"))
        rows = rows.select(F.lit(STRUCK).alias("kind"), "dest", "id", "tag", "pos").mapInArrow(_struck, ROWS_SQL)
        anew = staged(parsed(again, marks.unionByName(rows)).filter(F.col("kind") == RESULTS), "factor-anew")
        out = out.join(who, (key == who["w_key"]) & (out["tag"] == who["w_tag"]), "left_anti").unionByName(anew)
    discard(marks, wrong)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")


def _pointer_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(0):
            x = unpack(payload.as_py(), POINTER)
            yield pa.RecordBatch.from_arrays([pa.array(x[c].astype(np.int64)) for c in POINTER.names], names=list(POINTER.names))


def _struck(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, dest, id, tag, pos) -> rows that tell documents which pointers are none."""
    for batch in batches:
        out = []
        for kind, dest, doc_id, tag, pos in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            x = np.zeros(len(pos), SOURCE)
            x["id"], x["tag"], x["pos"] = doc_id, tag, pos
            out.append((kind, dest, pack(x)))
        yield _rows(out)


def collided(keyed: DataFrame, marks: DataFrame, wrong: DataFrame) -> DataFrame:
    """(id, tag, pos) of pointers behind denied claims whose words no document with a smaller id holds.

    All places with one fingerprint point to one place, so that the pointers to it and itself are all that can hold equal words.
    """
    told = marks.filter(F.col("kind") == POINTERS).select("payload").mapInArrow(_pointer_rows, ", ".join(f"{c} long" for c in POINTER.names))
    bad = wrong.distinct().withColumnsRenamed({"src_id": "b_id", "src_tag": "b_tag"})
    suspect = told.join(bad, (told["src_id"] == bad["b_id"]) & (told["src_tag"] == bad["b_tag"]) & (told["src_pos"] >= bad["low"]) & (told["src_pos"] < bad["low"] + bad["n"])).select(told["*"]).distinct()
    itself = suspect.select(*[F.col(f"src_{c}").alias(c) for c in ("id", "tag", "pos")], "src_id", "src_tag", "src_pos")
    places = suspect.unionByName(itself).distinct()
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "").alias("words")
    texts = keyed.select(F.col("key").alias("t_key"), F.col("tag").alias("t_tag"), words).dropDuplicates(["t_key", "t_tag"])
    said = places.join(texts, (places["id"] == texts["t_key"]) & (places["tag"] == texts["t_tag"])).select(places["*"], F.slice("words", (F.col("pos") + 1).cast("int"), WINDOW).alias("window"))
    least = said.groupBy("src_id", "src_tag", "src_pos", "window").agg(F.min("id").alias("least"), F.collect_list(F.struct("id", "tag", "pos")).alias("holders"))
    alone = least.select(F.explode(F.filter("holders", lambda h: h["id"] == F.col("least"))).alias("h"))
    return alone.select("h.id", "h.tag", "h.pos").distinct()
