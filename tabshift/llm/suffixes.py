"""Suffix-array dedup of long byte matches with a logarithmic family of sparse suffix arrays.

Every byte covered by a MATCH-byte string that also starts in a document with a smaller id is removed. Of the GRAM-byte strings in
each MATCH-byte window, the one with the least hash (the leftmost of equals) is the window's anchor, so equal windows have equal
anchors and about one suffix in sixteen, that from an anchor on, is indexed: no match is lost. A suffix's context are the bytes
from the first to the last window that it anchors.

1. Batches of documents get suffix arrays: their sparse suffixes in order of their letters. Runs with equal first GRAM letters
   meet; a suffix whose whole context stands at a smaller id in the batch is settled there, so that a string which a third of all
   documents hold leaves a batch once. One suffix for each GRAM-byte string not yet met travels on.
2. Shards keep a family of levels, sorted runs of (string, place). A new batch's run is scanned against every level and finds
   which strings stand in other documents; then it becomes a level, and levels of like size merge, so that n batches leave at
   most log2(n) levels. An ``Index`` keeps the levels of all calls as tables (``suffix_levels``): a later call is scanned against
   them where they lie, becomes a level itself, and writes no other again but those that it merges with.
3. Documents meet the places that were met and give their contexts, bytes and all, after settling again what is equal at hand.
   Contexts of one string meet in one shard; those of strings that are met more than HOT times (counted in step 2) go as single
   windows instead, dealt by all their bytes, so that no shard gets a large group.
4. Shards sort the contexts by their letters and compare bytes: equal contexts first, then, within runs of equal first GRAM
   letters, window by window. Fingerprints only find what is then compared.
5. Documents meet the answers, a bit for each window.

Offsets are bytes of the UTF-8 text; matches never cross documents.

Defined results: null texts are empty; texts shorter than MATCH lose nothing; rows with equal ids are never sources for each
other, and repeated rows get the same result each; a null id counts as larger than all; documents of earlier calls come before
all of this one, whatever their ids, and their results stay; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm.common import discard, shard_count, staged
from tabshift.llm.shards import mix64

MATCH, GRAM = 50, 20
WINDOW = MATCH - GRAM + 1
CHUNK, BATCH = 1 << 20, 16 << 20
HOT, MOST_HOT = 50_000, 1_000_000
LAST_ID = (1 << 63) - 1
LOW40 = np.uint64((1 << 40) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
PLACE_BITS = 24
TOLD = np.uint8(128)  # of a suffix that needs no answer

#: A suffix's place: the first window that it anchors, how many there are, and the anchor's distance from the first one's start.
PLACE = [("call", "<u2"), ("id", "<i8"), ("tag", "<u4"), ("low", "<u4"), ("size", "u1"), ("left", "u1")]
MARK = np.dtype(PLACE)
SUFFIX = np.dtype([("key", "<u8"), *PLACE])
ANSWER = np.dtype([("id", "<i8"), ("tag", "<u4"), ("low", "<u4"), ("mask", "<u4")])
HOT_KEY = np.dtype([("code", "<u8"), ("n", "<i8")])


@cache
def _bytes_table() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + (1 << 17))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class Hashes:
    """Fingerprints of any range of a byte buffer from one running sum."""

    def __init__(self, data: np.ndarray):
        up, down = _power(len(data) + 1)
        self.up = up
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_bytes_table()[data] * down[: len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.up[starts] + (ends - starts).astype(np.uint64))

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.up[:n] + np.uint64(size))


def prints_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Fingerprints of ranges of at most twice MATCH bytes, by blocks of the buffer so that running sums stay small."""
    order = np.argsort(start, kind="stable")
    begins, out = start[order], np.empty(len(start), np.uint64)
    for base in range(0, len(data), CHUNK):
        i, j = np.searchsorted(begins, [base, base + CHUNK])
        if i < j:
            at, where = begins[i:j] - base, order[i:j]
            out[where] = Hashes(data[base : base + CHUNK + 2 * MATCH]).ranges(at, at + length[where])
    return out


class Suffixes(NamedTuple):
    """Places in a buffer: where each context starts, how many windows it has, where its anchor is, and a fingerprint of GRAM bytes from there."""

    start: np.ndarray
    size: np.ndarray
    at: np.ndarray
    key: np.ndarray


def suffixes(data: np.ndarray, ends: np.ndarray) -> Suffixes:
    """The sparse suffixes of a buffer of documents that end at ``ends``, in order of place."""
    n = len(data) - MATCH + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return Suffixes(none, none, none, none.astype(np.uint64))
    grams = Hashes(data).all_of(GRAM)
    if len(grams) >= 1 << PLACE_BITS:
        least = _sliding_places(grams)
    else:
        mask = np.uint64((1 << PLACE_BITS) - 1)
        ordered = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        least = (_sliding_min(ordered) & mask).astype(np.int64)
    inside = np.ones(n, bool)
    for end in ends.tolist():
        inside[max(0, end - MATCH + 1) : end] = False
    at = np.flatnonzero(inside)
    anchor = least[at]
    if not len(at):
        return Suffixes(none, none, none, none.astype(np.uint64))
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    return Suffixes(at[first], np.diff(np.r_[first, len(at)]), anchor[first], grams[anchor[first]])


def _sliding_min(x: np.ndarray) -> np.ndarray:
    """Minimum of each WINDOW neighbours."""
    span = 1
    while span * 2 <= WINDOW:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = WINDOW - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _sliding_places(grams: np.ndarray) -> np.ndarray:
    """Places of the minima of a buffer too long for packed places, piece by piece."""
    mask, step, out = np.uint64((1 << PLACE_BITS) - 1), (1 << PLACE_BITS) - WINDOW, []
    for i in range(0, len(grams) - WINDOW + 1, step):
        part = grams[i : i + step + WINDOW - 1]
        out.append((_sliding_min((part & ~mask) | np.arange(len(part), dtype=np.uint64)) & mask).astype(np.int64) + i)
    return np.concatenate(out)


def tag_of(data: bytes) -> int:
    """Tells rows with one id apart."""
    return xxhash.xxh64_intdigest(data, 42) & 0xFFFFFFFF


def bucket_of(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    return ((np.mod(ids, buckets) + tags.astype(np.int64) % buckets) % buckets).astype(np.int32)


def order_by_letters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of the GRAM bytes that begin there, and the starts of the runs in which these are equal."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    parts = [np.ascontiguousarray(words[at + off]).view(">u8")[:, 0].astype(np.uint64) for off in range(0, GRAM, 8)]
    parts[-1] >>= np.uint64(64 - 8 * (GRAM - 16))
    order = np.lexsort(tuple(reversed(parts)))
    new = np.zeros(len(at), bool)
    new[:1] = True
    for p in parts:
        p = p[order]
        new[1:] |= p[1:] != p[:-1]
    return order, np.flatnonzero(new)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ranges of equal length, from MATCH to twice MATCH bytes, hold equal bytes: their first and their last MATCH bytes do."""
    windows, out = np.lib.stride_tricks.sliding_window_view(data, MATCH), np.ones(len(a), bool)
    for i in range(0, len(a), 1 << 16):
        part = slice(i, i + (1 << 16))
        x, y, more = a[part], b[part], length[part] - MATCH
        same = (windows[x] == windows[y]).all(axis=1)
        tail = same & (more > 0)
        same[tail] = (windows[x[tail] + more[tail]] == windows[y[tail] + more[tail]]).all(axis=1)
        out[part] = same
    return out


def equal_groups(data: np.ndarray, start: np.ndarray, length: np.ndarray, kind: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each range so that those of one number have equal bytes and kind, and how many numbers there are.

    Ranges with equal fingerprints are compared with the first of them; any that differ are grouped by their bytes alone.
    """
    order = np.argsort(prints, kind="stable")
    known = prints[order]
    new = np.r_[True, known[1:] != known[:-1]] if len(order) else np.empty(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    n = int(new.sum())
    first = order[np.flatnonzero(new)][group]
    check = np.flatnonzero(first != np.arange(len(order)))
    a, b = check, first[check]
    same = (length[a] == length[b]) & (kind[a] == kind[b])
    same[same] = _same_bytes(data, start[a[same]], start[b[same]], length[a[same]])
    others: dict[tuple, int] = {}
    for i in check[~same].tolist():
        group[i] = others.setdefault((int(prints[i]), int(kind[i]), data[start[i] : start[i] + length[i]].tobytes()), n + len(others))
    return group, n + len(others)


def settle(data: np.ndarray, x: Suffixes, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes with the ranks of their documents: which have their whole context at a smaller rank, and the numbers of equal contexts."""
    length, left = x.size + MATCH - 1, x.at - x.start
    prints = prints_of(data, x.start, length) ^ mix64(left.astype(np.uint64) + np.uint64(1))
    group, n = equal_groups(data, x.start, length, left, prints)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, group, rank)
    return rank > least[group], group


def removed_windows(data: np.ndarray, x: Suffixes, rank: np.ndarray) -> np.ndarray:
    """A bit for each window of each suffix: whether its bytes stand at a smaller rank among the suffixes given."""
    masks = np.zeros(len(x.start), np.uint64)
    if not len(masks):
        return masks
    settled, group = settle(data, x, rank)
    whole = (np.uint64(1) << x.size.astype(np.uint64)) - np.uint64(1)
    masks[settled] = whole[settled]
    left = np.flatnonzero(~settled)
    _, one = np.unique(group[left], return_index=True)
    reps = left[one]  # of equal contexts at one rank, one is compared
    order, runs = order_by_letters(data, x.at[reps])
    run = np.repeat(np.arange(len(runs)), np.diff(np.r_[runs, len(order)]))
    ranks = rank[reps[order]]
    low, high = np.full(len(runs), np.iinfo(np.int64).max), np.full(len(runs), -1)
    np.minimum.at(low, run, ranks)
    np.maximum.at(high, run, ranks)
    large = np.zeros(len(runs), bool)
    np.logical_or.at(large, run, x.size[reps[order]] > 1)
    edge = (low != high) & large
    mine, of_run = reps[order[edge[run]]], run[edge[run]]
    sizes = x.size[mine]
    # whole runs at a time, of about a million windows together
    begun = (np.cumsum(sizes) - sizes)[np.searchsorted(of_run, of_run)] >> 20
    for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(begun)) + 1) if len(mine) else ():
        n = sizes[part]
        of = np.repeat(mine[part], n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        at, length = x.start[of] + step, np.full(len(of), MATCH)
        numbers, many = equal_groups(data, at, length, np.zeros(len(at), np.int64), prints_of(data, at, length))
        least = np.full(many, np.iinfo(np.int64).max)
        np.minimum.at(least, numbers, rank[of])
        gone = rank[of] > least[numbers]
        np.bitwise_or.at(masks, of[gone], np.uint64(1) << step[gone].astype(np.uint64))
    of_group = np.zeros(int(group.max()) + 1, np.uint64)
    of_group[group[reps]] = masks[reps]
    masks[left] = of_group[group[left]]
    return masks


class Levels:
    """Sorted runs of SUFFIX records whose sizes at least double from one to the next; ``add`` scans a new run against all, then merges it in.

    A record is met if its key stands in another document, of its own run or of a level.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, run: np.ndarray) -> None:
        run = run[np.argsort(run["key"], kind="stable")]
        keys = np.ascontiguousarray(run["key"])
        met = (run["left"] & TOLD) != 0
        starts = _groups(keys)
        low, high = (f.reduceat(run["id"], starts) for f in (np.minimum, np.maximum)) if len(run) else (keys, keys)
        met |= np.repeat(low != high, np.diff(np.r_[starts, len(run)]))
        for other, other_met in self.levels:
            there = np.ascontiguousarray(other["key"])
            a, b = there.searchsorted(keys, "left"), there.searchsorted(keys, "right")
            found = b > a
            met |= found
            change = np.zeros(len(other) + 1, np.int32)
            np.add.at(change, a[found], 1)
            np.add.at(change, b[found], -1)
            other_met |= np.cumsum(change[:-1]) > 0
        while self.levels and len(self.levels[-1][0]) < 2 * len(run):
            run, met = self._merge(*self.levels.pop(), run, met)
        self.levels.append((run, met))

    @staticmethod
    def _merge(a: np.ndarray, a_met: np.ndarray, b: np.ndarray, b_met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([a, b])
        order = np.argsort(both["key"], kind="stable")
        return both[order], np.concatenate([a_met, b_met])[order]


def _groups(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


# Records on their way to a shard are stored by columns, each in as few bytes as it needs: numbers that hardly change from one
# record to the next as differences, hashes by their leading bytes (those kept in the type's low bytes).
def pack(x: np.ndarray, hashes: dict[str, int], rising: tuple[str, ...]) -> bytes:
    parts = [np.int64(len(x)).tobytes()]
    for name in x.dtype.names:
        column = np.ascontiguousarray(x[name])
        if name in hashes:
            parts.append(np.ascontiguousarray(column.view("u1").reshape(len(x), 8)[:, : hashes[name]]).tobytes())
        else:
            parts.append((np.r_[column[:1], column[1:] - column[:-1]] if name in rising else column).tobytes())
    return b"".join(parts)


def unpack(blob, dtype: np.dtype, hashes: dict[str, int], rising: tuple[str, ...]) -> np.ndarray:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    x, at = np.empty(n, dtype), 8
    for name in dtype.names:
        if name in hashes:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, : hashes[name]] = np.frombuffer(blob, np.uint8, hashes[name] * n, at).reshape(n, hashes[name])
            x[name] = wide.view("<u8")[:, 0]
            at += hashes[name] * n
        else:
            column = np.frombuffer(blob, dtype[name], n, at)
            x[name] = np.cumsum(column, dtype=dtype[name]) if name in rising else column
            at += column.nbytes
    return x


SUFFIX_FORM = ({"key": 5}, ("call", "id", "low"))
#: Of suffixes that are stored: whole hashes, so that their runs can be split.
STORED_FORM = ({"key": 8}, ("call", "id", "low"))
MARK_FORM = ({}, ("call", "id", "low"))
ANSWER_FORM = ({}, ("id", "low"))


def pack_suffixes(x: np.ndarray, form: tuple = SUFFIX_FORM) -> bytes:
    return pack(x[np.lexsort((x["low"], x["id"]))], *form)


def pack_marks(x: np.ndarray) -> bytes:
    return pack(x[np.lexsort((x["low"], x["id"]))], *MARK_FORM)


def pack_answers(x: np.ndarray) -> bytes:
    return pack(x[np.lexsort((x["low"], x["id"]))], *ANSWER_FORM)


def pack_contexts(marks: np.ndarray, data: np.ndarray, start: np.ndarray) -> bytes:
    """Places and the bytes of their contexts."""
    length = marks["size"].astype(np.int64) + MATCH - 1
    ends = np.cumsum(length)
    blob = data[np.repeat(start - ends + length, length) + np.arange(ends[-1])]
    return pack(marks, {}, ()) + blob.tobytes()


def unpack_contexts(blob) -> tuple[np.ndarray, np.ndarray]:
    marks = unpack(blob, MARK, {}, ())
    return marks, np.frombuffer(blob, np.uint8, offset=8 + MARK.itemsize * len(marks))


def _dealt(to: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    to, records = to[order], records[order]
    starts = _groups(to)
    for s, e in zip(starts, [*starts[1:], len(to)] if len(to) else [], strict=True):
        yield int(to[s]), records[s:e]


SUFFIXES, LEVEL, MARKS, ANSWERS, HOT_KEYS = 1, 2, 3, 4, 5
CONTEXTS, PENDING, RESULTS, DOCUMENT = 6, 7, 8, 9
ROWS = pa.schema([("kind", pa.int32()), ("dest", pa.int32()), ("payload", pa.binary())])
ROWS_SQL = "kind int, dest int, payload binary"


def _rows(found: Iterable[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, dests, payloads = zip(*found, strict=True) if (found := list(found)) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(dests, pa.int32()), pa.array(payloads, pa.binary())], schema=ROWS)


class Document(NamedTuple):
    id: int | None
    data: bytes
    tag: int
    call: int = 0
    payload: bytes = b""

    @property
    def key(self) -> int:
        return LAST_ID if self.id is None else self.id


def _places(docs: list[Document], x: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """MARK records of suffixes in a buffer of documents, and each one's document."""
    ends = np.cumsum([len(d.data) for d in docs])
    doc = np.searchsorted(ends, x.start, side="right")
    out = np.empty(len(x.start), MARK)
    for name, values in (("call", [d.call for d in docs]), ("id", [d.key for d in docs]), ("tag", [d.tag for d in docs])):
        out[name] = np.array(values, MARK[name])[doc]
    out["low"] = x.start - np.r_[0, ends[:-1]][doc]
    out["size"], out["left"] = x.size, x.at - x.start
    return out, doc


def batch_suffixes(docs: list[Document]) -> tuple[np.ndarray, Suffixes]:
    """The buffer of some documents and its sparse suffixes, found piece by piece."""
    buffer = np.frombuffer(b"".join(d.data for d in docs), np.uint8)
    ends = np.cumsum([len(d.data) for d in docs])
    parts, first = [], 0
    while first < len(docs):
        base = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        pieces = [(base, int(ends[last - 1]), ends[first:last])]
        if ends[last - 1] - base > 4 * CHUNK:  # one long document: its windows by pieces, as a window's anchor depends on its bytes alone
            stops = [min(p + CHUNK + MATCH - 1, int(ends[first])) for p in range(base, int(ends[first]), CHUNK)]
            pieces = [(p, stop, np.array([stop])) for p, stop in zip(range(base, int(ends[first]), CHUNK), stops, strict=True)]
        for begin, stop, bounds in pieces:
            found = suffixes(buffer[begin:stop], bounds - begin)
            parts.append(Suffixes(found.start + begin, found.size, found.at + begin, found.key))
        first = last
    return buffer, Suffixes(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _take(x: Suffixes, at: np.ndarray) -> Suffixes:
    return Suffixes(*(c[at] for c in x))


def _all_of(marks: np.ndarray) -> np.ndarray:
    """Answers that remove all windows of some places (31 at most, a bit each)."""
    out = np.empty(len(marks), ANSWER)
    for name in ("id", "tag", "low"):
        out[name] = marks[name]
    out["mask"] = (np.uint64(1) << marks["size"].astype(np.uint64)) - np.uint64(1)
    return out


def _gone(answers: np.ndarray) -> np.ndarray:
    """(n, 2): the byte runs that a document's answers remove."""
    steps = np.arange(WINDOW)
    at = answers["low"].astype(np.int64)[:, None] + steps
    hit = at[(answers["mask"][:, None] >> steps.astype(np.uint32)) & np.uint32(1) != 0]
    return _intervals(hit, hit + MATCH)


def _intervals(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(n, 2): the union of byte ranges [low, high) as disjoint, maximal runs."""
    if not len(low):
        return np.empty((0, 2), np.int64)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    return np.stack([low[new], high[np.r_[new[1:], len(low)] - 1]], axis=1)


def _result(doc_id: int | None, data: bytes, removed: np.ndarray) -> dict:
    kept, at = hashlib.sha256(), 0
    for a, b in removed.tolist():
        kept.update(data[at:a])
        at = b
    kept.update(data[at:])
    return {"id": doc_id, "n_bytes": len(data), "n_removed": int((removed[:, 1] - removed[:, 0]).sum()), "n_spans": len(removed), "kept_sha256": kept.hexdigest()}


RESULT = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
RESULT_SQL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
MET = pa.schema([("kind", pa.int32()), ("dest", pa.int32()), ("text", pa.string()), ("payload", pa.binary()), *RESULT])
MET_SQL = "kind int, dest int, text string, payload binary, " + RESULT_SQL


class Found:
    """Records by document, from an array sorted by id."""

    def __init__(self, records: list[np.ndarray], dtype: np.dtype) -> None:
        x = np.concatenate(records) if records else np.empty(0, dtype)
        self.records = x[np.argsort(x["id"], kind="stable")]
        self.ids = np.ascontiguousarray(self.records["id"])  # a search in a field would copy it each time
        self.called = "call" in dtype.names

    def of(self, doc: Document) -> np.ndarray:
        part = self.records[self.ids.searchsorted(doc.key, "left") : self.ids.searchsorted(doc.key, "right")]
        part = part[part["tag"] == doc.tag]
        return part[part["call"] == doc.call] if self.called else part


def _streams(batches: Iterator[pa.RecordBatch]) -> tuple[Found, Found, Iterator[list[Document]]]:
    """The marks and answers that come first in a partition, and then its documents in batches."""
    marks: list[np.ndarray] = []
    answers: list[np.ndarray] = []
    waiting: list[list] = []

    def split(batch: pa.RecordBatch) -> list[Document]:
        columns = (batch.column(batch.schema.get_field_index(c)) for c in ("kind", "dest", "id", "text", "payload"))
        out = []
        for kind, dest, doc_id, text, payload in zip(*columns, strict=True):
            kind = kind.as_py()
            if kind == MARKS:
                marks.append(unpack(payload.as_buffer(), MARK, *MARK_FORM))
            elif kind == ANSWERS:
                answers.append(unpack(payload.as_buffer(), ANSWER, *ANSWER_FORM))
            else:
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                out.append(Document(doc_id.as_py(), data, tag_of(data), kind - DOCUMENT if kind >= DOCUMENT else 0, payload.as_py() or b""))
        return out

    for batch in batches:
        if docs := split(batch):
            waiting.append(docs)
            break

    def rest() -> Iterator[list[Document]]:
        yield from waiting
        for batch in batches:
            yield split(batch)

    return Found(marks, MARK), Found(answers, ANSWER), rest()


class Index(NamedTuple):
    """What earlier calls left: levels of at least halving size, and the documents (call, id, text) that they point to, a table a call."""

    levels: tuple
    texts: tuple[DataFrame, ...]
    calls: int


def duplicated_bytes(docs: DataFrame, *, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with an index, its documents are sources too."""
    return _run(docs, index, False, id_col, text_col)[0]


def indexed_bytes(docs: DataFrame, *, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Index]:
    """The rows of ``duplicated_bytes``, and the index with these documents in it."""
    out, grown = _run(docs, index, True, id_col, text_col)
    return out, grown


def _run(docs: DataFrame, index: Index | None, keep: bool, id_col: str, text_col: str) -> tuple[DataFrame, Index | None]:
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if keep:
        source = staged(source, "suffix-texts")
    from tabshift.llm import suffix_levels as L

    shards = shard_count(docs, 16 << 20)
    form = SUFFIX_FORM
    if keep or index:
        shards, form = L.power_of_two(shards), STORED_FORM
    buckets, call = shards | 1, index.calls if index else 0
    hot_count = HOT

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Document] = []
        size = 0

        def flush() -> pa.RecordBatch:
            buffer, x = batch_suffixes(waiting)
            places, doc = _places(waiting, x)
            settled, _ = settle(buffer, x, places["id"]) if len(x.start) else (np.empty(0, bool), None)
            known, x, places = _all_of(places[settled]), _take(x, ~settled), places[~settled]
            out = [(ANSWERS, d, pack_answers(r)) for d, r in _dealt(bucket_of(known["id"], known["tag"], buckets), known)]
            if len(places):
                order, runs = order_by_letters(buffer, x.at)
                x, places = _take(x, order), places[order]
                sizes = np.diff(np.r_[runs, len(order)])
                low, high = np.minimum.reduceat(places["id"], runs), np.maximum.reduceat(places["id"], runs)
                met = np.repeat(low != high, sizes)
                out += [(MARKS, d, pack_marks(r)) for d, r in _dealt(bucket_of(places["id"][met], places["tag"][met], buckets), places[met])]
                # of what is met already, one suffix travels on, without waiting for an answer; an index needs all
                lone = ~met | keep
                lone[runs] = True
                new = np.empty(int(lone.sum()), SUFFIX)
                for name in MARK.names:
                    new[name] = places[name][lone]
                new["left"] |= np.where(met[lone], TOLD, np.uint8(0))
                new["key"] = x.key[lone]
                shard = ((new["key"] >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)
                out += [(SUFFIXES, d, pack_suffixes(r, form)) for d, r in _dealt(shard, new)]
            return _rows(out)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < MATCH:
                    continue
                waiting.append(Document(doc_id.as_py(), data, tag_of(data), call))
                size += len(data)
                if size >= BATCH:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            ready = []
            for kind, dest, payload in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("kind", "dest", "payload")), strict=True):
                kind, dest = kind.as_py(), dest.as_py()
                if kind == SUFFIXES:
                    runs.setdefault(dest, []).append(unpack(payload.as_buffer(), SUFFIX, *SUFFIX_FORM))
                else:
                    ready.append((kind, dest, payload.as_py()))
            if ready:
                yield _rows(ready)
        for dest in sorted(runs):
            levels = Levels()
            for run in sorted(runs.get(dest, ()), key=lambda r: int(r["id"].min())):
                levels.add(run)
            out = []
            for level, met in levels.levels:
                told = met & ((level["left"] & TOLD) == 0)
                marks = np.empty(int(told.sum()), MARK)
                for name in MARK.names:
                    marks[name] = level[name][told]
                marks["left"] &= ~TOLD
                out += [(MARKS, d, pack_marks(r)) for d, r in _dealt(bucket_of(marks["id"], marks["tag"], buckets), marks)]
            hot = np.concatenate([level["key"][met] for level, met in levels.levels] or [np.empty(0, np.uint64)])
            keys, counts = np.unique(hot & LOW40, return_counts=True)
            if (many := counts >= hot_count).any():
                found = np.empty(int(many.sum()), HOT_KEY)
                found["code"], found["n"] = keys[many] | np.uint64(dest) << np.uint64(40), counts[many]
                out.append((HOT_KEYS, dest, found.tobytes()))
            yield _rows(out)

    # what a batch settled or met by itself passes through the shards' step untouched
    sent = source.mapInArrow(first, ROWS_SQL)
    if keep or index:
        marks, level = L.scanned(sent, index.levels if index else (), shards, buckets, hot_count)
    else:
        marks = staged(sent.repartitionById(shards, F.pmod("dest", F.lit(shards))).mapInArrow(scan, ROWS_SQL), "suffix-marks")
    # strings met so often that they are dealt window by window: at most MOST_HOT of them, 16 bytes each
    hot_rows = marks.filter(F.col("kind") == HOT_KEYS).select("payload").mapInArrow(_hot_numbers, "code long, n long").orderBy(F.col("n").desc(), "code").limit(MOST_HOT).toArrow()
    hot = np.sort(hot_rows["code"].to_numpy().view(np.uint64))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, answered, stream = _streams(batches)

        def contexts(group: list[tuple[Document, np.ndarray]]) -> tuple[np.ndarray, list[dict]]:
            """Answers from equal contexts of some documents, and the rows of the contexts that are left."""
            buffer = np.frombuffer(b"".join(d.data for d, _ in group), np.uint8)
            base = np.cumsum([0, *(len(d.data) for d, _ in group)])
            own = np.concatenate([m for _, m in group])
            start = own["low"].astype(np.int64) + np.repeat(base[:-1], [len(m) for _, m in group])
            at = start + own["left"]
            x = Suffixes(start, own["size"].astype(np.int64), at, prints_of(buffer, at, np.full(len(at), GRAM)))
            settled, _ = settle(buffer, x, ranks_of(own))
            answers = _all_of(own[settled])
            left = np.flatnonzero(~settled)
            own, x = own[left], _take(x, left)
            code = ((x.key >> np.uint64(40)) % np.uint64(shards)) << np.uint64(40) | x.key & LOW40
            single = np.isin(code, hot)
            n = x.size[single]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            parts = np.repeat(own[single], n)
            parts["low"] += step.astype(np.uint32)
            parts["size"] = 1
            parts["left"] -= step.astype(np.uint8)
            begin = np.repeat(x.start[single], n) + step
            dest = np.r_[code[~single] >> np.uint64(40), prints_of(buffer, begin, np.full(len(begin), MATCH)) % np.uint64(shards)].astype(np.int32)
            parts, begin = np.concatenate([own[~single], parts]), np.r_[x.start[~single], begin]
            rows = []
            for d, where in _dealt(dest, np.arange(len(dest))):
                rows.append({"kind": CONTEXTS, "dest": d, "payload": pack_contexts(parts[where], buffer, begin[where])})
            return answers, rows

        for group in stream:
            out: list[dict] = []
            pending: list[tuple[Document, np.ndarray]] = []
            size = 0

            def settle_pending() -> None:
                found, rows = contexts(pending)
                out.extend(rows)
                found = found[np.argsort(found["id"], kind="stable")]
                here = Found([found], ANSWER)
                for doc, _ in pending:
                    if doc.call == call:
                        known = np.concatenate([answered.of(doc), here.of(doc)])
                        out.append({"kind": PENDING, "dest": int(bucket_of(np.array([doc.key]), np.array([doc.tag]), buckets)[0]), "id": doc.id, "text": doc.data.decode("utf-8", "surrogatepass"), "payload": pack_answers(known)})

            for doc in group:
                own = marked.of(doc) if len(doc.data) >= MATCH else marked.records[:0]
                if len(own):
                    pending.append((doc, own))
                    size += len(doc.data)
                elif doc.call == call:
                    out.append({"kind": RESULTS, **_result(doc.id, doc.data, _gone(answered.of(doc)))})
                if size >= BATCH:
                    settle_pending()
                    pending, size = [], 0
            if pending:
                settle_pending()
            yield pa.RecordBatch.from_pylist(out, schema=MET)

    bucket = lambda: F.pmod(F.pmod(F.coalesce("id", F.lit(LAST_ID)), F.lit(buckets)) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(buckets)), F.lit(buckets)).cast("int")
    nothing = F.lit(None).cast("binary")
    rows = source.select(F.lit(DOCUMENT + call).alias("kind"), bucket().alias("dest"), "id", "text", nothing.alias("payload"))
    if index:
        met_ids = marks.filter(F.col("kind") == MARKS).select("payload").mapInArrow(_marked_ids(call), "call int, key long").distinct()
        texts = functools.reduce(DataFrame.unionByName, index.texts)
        old = texts.join(met_ids.withColumnRenamed("call", "m_call"), (F.col("call") == F.col("m_call")) & (F.coalesce("id", F.lit(LAST_ID)) == F.col("key")), "left_semi")
        rows = rows.unionByName(old.select((F.lit(DOCUMENT) + F.col("call")).cast("int").alias("kind"), bucket().alias("dest"), "id", "text", nothing.alias("payload")))
    told = marks.filter(F.col("kind").isin(MARKS, ANSWERS)).select("kind", "dest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "payload")
    met = staged(told.unionByName(rows).repartitionById(buckets, "dest").sortWithinPartitions("kind").mapInArrow(meet, MET_SQL), "suffix-met")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack_contexts(blob.as_buffer()) for batch in batches for blob in batch.column(1)]
        if parts:
            places, data = np.concatenate([m for m, _ in parts]), np.concatenate([b for _, b in parts])
            length = places["size"].astype(np.int64) + MATCH - 1
            start = np.cumsum(length) - length
            x = Suffixes(start, places["size"].astype(np.int64), start + places["left"], np.zeros(len(start), np.uint64))
            masks = removed_windows(data, x, ranks_of(places))
            hit = (masks != 0) & (places["call"] == call)
            out = _all_of(places[hit])
            out["mask"] = masks[hit]
            yield _rows((ANSWERS, d, pack_answers(r)) for d, r in _dealt(bucket_of(out["id"], out["tag"], buckets), out))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, answered, stream = _streams(batches)
        for group in stream:
            out = []
            for doc in group:
                known = unpack(doc.payload, ANSWER, *ANSWER_FORM)
                out.append(_result(doc.id, doc.data, _gone(np.concatenate([known, answered.of(doc)]))))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(RESULT))

    answers = met.filter(F.col("kind") == CONTEXTS).select("dest", "payload").repartitionById(shards, "dest").mapInArrow(compare, ROWS_SQL)
    answers = staged(answers, "suffix-answers").select("kind", "dest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "payload")
    left = met.filter(F.col("kind") == PENDING).select("kind", "dest", "id", "text", "payload")
    last = answers.unionByName(left).repartitionById(buckets, "dest").sortWithinPartitions("kind").mapInArrow(finish, RESULT_SQL)
    out = met.filter(F.col("kind") == RESULTS).select(*[n for n, _ in RESULT]).unionByName(last).withColumnRenamed("id", id_col)
    discard(marks)
    if not keep:
        if index:
            discard(level.table)
        return out, None
    texts = source.select(F.lit(call).alias("call"), "id", "text")
    return out, Index(L.grown(index.levels if index else (), level), (*(index.texts if index else ()), texts), call + 1)


def ranks_of(places: np.ndarray) -> np.ndarray:
    """Numbers in the order of calls and ids, equal for equal documents."""
    order = np.lexsort((places["id"], places["call"]))
    call, ids = places["call"][order], places["id"][order]
    new = np.r_[0, (call[1:] != call[:-1]) | (ids[1:] != ids[:-1])] if len(order) else np.empty(0, np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _hot_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            x = np.frombuffer(blob.as_buffer(), HOT_KEY)
            yield pa.RecordBatch.from_arrays([pa.array(x["code"].view(np.int64)), pa.array(x["n"])], names=["code", "n"])


def _marked_ids(call: int):
    """The documents of earlier calls that marks point to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                x = unpack(blob.as_buffer(), MARK, *MARK_FORM)
                x = np.unique(x[x["call"] < call][["call", "id"]])
                yield pa.RecordBatch.from_arrays([pa.array(x["call"].astype(np.int32)), pa.array(x["id"].astype(np.int64))], names=["call", "key"])

    return run
