"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code (23, 12) is perfect: every 23-bit
word lies within 3 bits of exactly one codeword. A segment's fuzzy keys are the message indices of the codewords that the
segment and its 23 one-bit neighbours decode to (one to six of them); two segments that differ in at most two bits have a
word between them that is a neighbour of both, and so share a key. The 18-bit segment is decoded with five leading zeros.

Four differing bits in three segments leave these cases (pigeonhole):

* a segment is exact: of the other two, one has at most two errors, so (exact segment, fuzzy key of another) meets;
* none is exact: the errors are (1,1,1) or (2,1,1) in some order; two segments have one error each, so one half of each is
  exact, and the third has at most two: (half, half, fuzzy key of the third) meets.

That gives 18 kinds of key of 30 to 35 bits, about 95 keys a fingerprint. Keys meet in shards (packed exchange); within a
key every candidate is verified, and a breadth-first search keeps a spanning forest of the links, never all pairs: once a
fingerprint is linked, it is compared only with those not yet reached. Forests of all shards join in a distributed
component search. Equal fingerprints are one class from the start, so copies cost one row each.

Defined results: a null or wordless text has fingerprint zero, which links like any other; rows with equal ids are
separate texts, linked by their fingerprints alone; a null id never names a component unless all its ids are null; an
empty table gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabshift.llm.common import MAX_SHARDS, discard, fresh_names, shard_count, staged
from tabshift.llm.components import components
from tabshift.llm.fingerprints import least_hashes
from tabshift.llm.shards import mix64, packed_batch, reduce_shards
from tabshift.llm.shingles import shingle_hashes

SEED = 42
#: The generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))
KEYED = np.dtype([("key", "<u8"), ("fp", "<u8")])
SMALL_GROUP = 8


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the word shingles of a whole text: a bit is set if it is set in over half of their hashes."""
    hashes = shingle_hashes(text, width, SEED)
    return _vote(hashes) if len(hashes) else 0


def _vote(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _row(id_col: str, text_col: str) -> Column:
    """What tells rows apart besides their ids: a hash of id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, rows: bool = False) -> DataFrame:
    """(id, fp): the fingerprint of each row as a long with the same bits; with ``rows`` also its row hash, between them."""
    names = ["id", "row", "fp"] if rows else ["id", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(0)), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps.view("<i8"))], names=names)

    source = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), *([_row(id_col, text_col).alias("row")] if rows else []))
    return source.mapInArrow(run, ", ".join(f"{n} long" for n in names))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error pattern of each of the 2,048 syndromes."""
    single = []
    for i in range(23):
        r = 1 << i
        for j in range(i, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        single.append(r)

    def table(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.uint32)
        for i in range(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ np.uint32(single[first + i])
        return out

    errors = np.zeros(2048, np.uint32)
    for a in range(23):
        errors[single[a]] = 1 << a
        for b in range(a):
            errors[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
    return table(0, 12), table(12, 11), errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit message of the codeword nearest to each 23-bit word."""
    low, high, errors = _golay()
    words = words.astype(np.uint32)
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_keys(segment: np.ndarray, bits: int) -> np.ndarray:
    """(n, 6): the distinct codeword indices of the segment and its one-bit neighbours, -1 beyond the last."""
    flips = np.r_[0, 1 << np.arange(bits)].astype(np.uint32)
    found = np.sort(codeword_index(segment.astype(np.uint32)[:, None] ^ flips[None, :]).astype(np.int32), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = 1 << 20
    found = np.sort(found, axis=1)[:, :6]
    found[found == 1 << 20] = -1
    return found


def keys_of(fps: np.ndarray) -> np.ndarray:
    """KEYED records of all keys of each fingerprint."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1), bits) for at, bits in SEGMENTS]
    fuzzy = [fuzzy_keys(p, bits) for p, bits in parts]
    halves = [((p & np.uint64((1 << (bits // 2)) - 1)), (p >> np.uint64(bits // 2))) for p, bits in parts]
    out, kind = [], 0

    def add(exact: np.ndarray, third: int) -> None:
        nonlocal kind
        for j in range(6):
            has = fuzzy[third][:, j] >= 0
            records = np.empty(int(has.sum()), KEYED)
            records["key"] = (np.uint64(kind) << np.uint64(36)) | (exact[has] << np.uint64(12)) | fuzzy[third][has, j].astype(np.uint64)
            records["fp"] = fps[has]
            out.append(records)
        kind += 1

    for s in range(3):
        for t in range(3):
            if s != t:
                add(parts[s][0], t)
    for p, q, r in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        for i in range(2):
            for j in range(2):
                add((halves[p][i] << np.uint64(12)) | halves[q][j], r)
    return np.concatenate(out)


class Forest:
    """Union-find over positions; the root of a tree is its smallest position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _search(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, int]]:
    """Links of a large group, breadth first: (positions newly reached, position they were reached from)."""
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= distance
            if near.any():
                reached, rest = rest[near], rest[~near]
                yield reached, at
                queue += reached.tolist()


def shard_links(records: np.ndarray, distance: int = 4) -> np.ndarray:
    """(n, 2): a star for each component of a shard's verified links, the smallest fingerprint at its centre."""
    records = records[np.argsort(records["key"], kind="stable")]
    key = records["key"]
    same = key[1:] == key[:-1]
    starts = np.flatnonzero(np.r_[True, ~same])
    sizes = np.diff(np.r_[starts, len(key)])
    keep = np.repeat(sizes > 1, sizes)
    records, sizes = records[keep], sizes[sizes > 1]
    if not len(records):
        return np.empty((0, 2), "<u8")
    values, position = np.unique(records["fp"], return_inverse=True)
    fps, key = records["fp"], records["key"]
    forest = Forest(len(values))
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    pairs = []
    for off in range(1, SMALL_GROUP):
        if off >= len(key):
            break
        hit = np.flatnonzero((key[off:] == key[:-off]) & small[:-off] & (np.bitwise_count(fps[off:] ^ fps[:-off]) <= distance))
        pairs.append(np.stack([position[hit], position[hit + off]], axis=1))
    for a, b in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else []:
        forest.link(a, b)
    at = 0
    for size in sizes.tolist():
        if size > SMALL_GROUP:
            own = position[at : at + size]
            for reached, centre in _search(fps[at : at + size], distance):
                for r in own[reached].tolist():
                    forest.link(int(own[centre]), r)
        at += size
    roots = np.fromiter((forest.root(i) for i in range(len(values))), np.int64, len(values))
    linked = np.flatnonzero(roots != np.arange(len(values)))
    return np.stack([values[roots[linked]], values[linked]], axis=1)


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b) with a, b fingerprints: stars whose union has the components of the link graph on distinct ``fp`` values."""
    if distance > 4:
        raise ValueError("the keys cover at most four differing bits")
    n = shard_count(fps, 1 << 20)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view("<u8")
            for i in range(0, len(values), 1 << 15):
                records = keys_of(values[i : i + (1 << 15)])
                yield packed_batch((mix64(records["key"]) % np.uint64(n)).astype(np.int32), records)

    def joined(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = shard_links(records, distance)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].view("<i8").copy()), pa.array(found[:, 1].view("<i8").copy())], names=["a", "b"])

    return reduce_shards(fps.mapInArrow(keyed, "shard int, payload binary"), n, KEYED, joined, "a long, b long")


def near_duplicates(docs: DataFrame, *, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row; a component is named by its smallest id."""
    prints = staged(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-classes")
    edges = staged(links(classes.select("fp"), distance).distinct(), "simhash-links")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _named(prints, classes, edges).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def _named(prints: DataFrame, classes: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """The rows with component_id (and root), from classes (fp, first_id) and links (a, b) between them."""
    found = components(edges, "a", "b")
    named = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = staged(named.join(smallest, "root").select(F.col("fp").alias("c_fp"), "component_id", *more), "simhash-named")
    # a class may hold a third of all rows: the join on fp is between rows and one row a class, which Spark splits or broadcasts
    return prints.join(by_class, prints["fp"] == by_class["c_fp"]).select(*prints.columns, "component_id", *more)


# ---- similarity beyond four bits ----
# Texts whose shingle sets have a Jaccard similarity of 0.8 differ in about nine bits of 64, so four bits find few of them, and
# four bits alone may join texts that are less alike. With ``similarity`` set, near fingerprints are one way to become candidates,
# a shared min-wise key of the same shingle hashes another. Candidates form families, and within a family the shingle sets
# themselves are compared, every one with every other but for those already reached from it: only a similarity that is met is a
# link. A family of many shingles is cut into blocks, and each pair of blocks is one comparison, so that no task holds a large
# family. Rows with the same shingle set (a variant) are one member. In a large family the members that share most keys are compared
# with all others first; what hangs together then is not compared with itself again, so that copies of one original cost work in
# proportion to their number, and only families without such a centre cost more.

BANDS, ROWS = 32, 8
BLOCK = 1 << 20  # shingles a block, about
SKETCHED = "id long, row long, fp long, variant long, n int, bands binary"
PAIRED = np.dtype([("key", "<u8"), ("fp", "<u8")])
HUBS, HUBS_EACH = 0, 32  # a kind of comparison; hubs a large family
HEAD = 4  # task, side, variant and number of shingles go before a set's hashes


def _sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, row, fp, variant, n, bands): the SimHash, a hash of it and the shingle set, the set's size, the hashes of BANDS groups of bins."""

    def one(text: str | None) -> tuple[int, int, int, bytes]:
        hashes = shingle_hashes(text, width, SEED)
        if not len(hashes):
            return 0, 0, 0, b""
        fp, least, terms = _vote(hashes), least_hashes(hashes), np.unique(hashes)
        bands = [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, ROWS))]
        return fp, xxhash.xxh64_intdigest(terms.tobytes(), fp), len(terms), np.array(bands, "<u8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column(2)]
            fps, variants = (np.array([r[i] for r in rows], "<u8").view("<i8") for i in range(2))
            made = [pa.array(fps), pa.array(variants), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "row", "fp", "variant", "n", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), _row(id_col, text_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, SKETCHED)


def band_stars(records: np.ndarray) -> np.ndarray:
    """(n, 2): the least text of each band key with every other text of it."""
    records = records[np.lexsort((records["fp"], records["key"]))]
    key, fps = records["key"], records["fp"]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    least = np.repeat(fps[starts], np.diff(np.r_[starts, len(key)]))
    return np.unique(np.stack([least, fps], axis=1)[least != fps], axis=0)


class _Rest:
    """Sets not reached yet, in order of size, as one flat array of term numbers."""

    def __init__(self, members: np.ndarray, terms: list[np.ndarray]):
        self.members = members
        self.sizes = np.array([len(terms[i]) for i in members], np.int64)
        self.flat = np.concatenate([terms[i] for i in members]) if len(members) else np.empty(0, np.int64)
        self.ends = np.cumsum(self.sizes)

    def take(self, gone: np.ndarray) -> np.ndarray:
        out = self.members[gone]
        self.flat = self.flat[~np.repeat(gone, self.sizes)]
        self.members, self.sizes = self.members[~gone], self.sizes[~gone]
        self.ends = np.cumsum(self.sizes)
        return out

    def first(self) -> int:
        gone = np.zeros(len(self.members), bool)
        gone[0] = True
        return int(self.take(gone)[0])

    def near(self, mark: np.ndarray, size: int, least: float) -> np.ndarray:
        """Members whose similarity to the marked set is ``least`` or more; the sizes alone rule out those outside a range."""
        a, b = np.searchsorted(self.sizes, least * size - 1e-9), np.searchsorted(self.sizes, size / least + 1e-9, "right")
        if a >= b:
            return np.empty(0, np.int64)
        start = int(self.ends[a] - self.sizes[a])
        both = np.add.reduceat(mark[self.flat[start : self.ends[b - 1]]], self.ends[a:b] - self.sizes[a:b] - start)
        gone = np.zeros(len(self.members), bool)
        gone[a:b] = both >= least * (size + self.sizes[a:b] - both) - 1e-9
        return self.take(gone) if gone.any() else np.empty(0, np.int64)


def set_links(sets: list[np.ndarray], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A forest of the pairs of sets with a Jaccard similarity of ``least`` or more: between sides if there are two, else within the one."""
    sizes = np.array(list(map(len, sets)), np.int64)
    values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    terms = np.split(numbers, np.cumsum(sizes)[:-1])
    order = np.argsort(sizes, kind="stable")
    two = int(side.max() > 0)
    rest = [_Rest(order[side[order] == s], terms) for s in range(1 + two)]
    mark = np.zeros(len(values), np.int32)
    out = []
    while len(rest[0].members) and len(rest[two].members):
        queue = [rest[0].first()]
        while queue:
            at = queue.pop()
            other = rest[1 - side[at] if two else 0]
            if not len(other.members):
                continue
            mark[terms[at]] = 1
            reached = other.near(mark, int(sizes[at]), least).tolist()
            mark[terms[at]] = 0
            out += [(at, r) for r in reached]
            queue += reached
    return out


def family_links(records: np.ndarray, least: float) -> np.ndarray:
    """(n, 2) variants: the links of all comparisons of a shard; records: HEAD and hashes of each set, one after the other."""
    tasks: dict[int, dict[tuple[int, int], np.ndarray]] = {}
    at = 0
    while at < len(records):
        task, side, variant, n = records[at : at + HEAD].tolist()
        tasks.setdefault(task, {})[side, variant] = records[at + HEAD : at + HEAD + n]
        at += HEAD + n
    found = []
    for members in tasks.values():
        if len(members) > 1:
            sides, names = np.array([s for s, _ in members]), [v for _, v in members]
            found += [(names[a], names[b]) for a, b in set_links(list(members.values()), sides, least) if names[a] != names[b]]
    return np.array(found, "<u8").reshape(-1, 2)


def _pairs(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[:, i].astype("<u8").view("<i8").copy()) for i in range(2)], names=["a", "b"])


def _band_records(batch: pa.RecordBatch) -> np.ndarray:
    """PAIRED records of a batch of (variant, bands), in order of key and variant."""
    own = batch.column(0).to_numpy(zero_copy_only=False).view("<u8")
    bands = [np.frombuffer(b.as_buffer(), "<u8") for b in batch.column(1)]
    records = np.empty(sum(map(len, bands)), PAIRED)
    if len(records):
        records["key"], records["fp"] = np.concatenate(bands), np.repeat(own, [len(b) for b in bands])
    return records[np.lexsort((records["fp"], records["key"]))]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


def _met_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, d): the stars of the band keys within a batch (d 0), and for each variant that shares many keys, how often it does (d above 0)."""
    for batch in batches:
        records = _band_records(batch)
        _, sizes = _runs(records["key"])
        values, at = np.unique(records["fp"], return_inverse=True)
        degree = np.bincount(at, np.repeat(sizes - 1, sizes), len(values)).astype(np.int64) if len(values) else np.empty(0, np.int64)
        stars, many = band_stars(records) if len(records) else np.empty((0, 2), "<u8"), degree >= BANDS
        columns = [np.r_[stars[:, 0], values[many]].astype("<u8").view("<i8"), np.r_[stars[:, 1], values[many]].astype("<u8").view("<i8"), np.r_[np.zeros(len(stars), np.int64), degree[many]]]
        yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in columns], names=["a", "b", "d"])


def band_links(variants: DataFrame) -> DataFrame:
    """(a, b, d) as of ``_met_here``, with the stars between batches.

    Variants with one band key meet within their batch first, and only the least of them travels on, so that the shard of a key that a third
    of all texts share gets one record for each batch.
    """
    n = shard_count(variants, 4 << 20)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = _band_records(batch)
            least = records[_runs(records["key"])[0]]
            if len(least):
                yield packed_batch((mix64(least["key"]) % np.uint64(n)).astype(np.int32), least)

    def met(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = band_stars(records)
        if len(found):
            yield _pairs(found)

    own = variants.select("variant", "bands")
    between = reduce_shards(own.mapInArrow(keyed, "shard int, payload binary"), n, PAIRED, met, "a long, b long")
    return staged(own.mapInArrow(_met_here, "a long, b long, d long").unionByName(between.withColumn("d", F.lit(0).cast("long"))), "simhash-stars")


PLAN = "spread boolean, total int, first int, blocks int"


def _compared(docs: DataFrame, plan: DataFrame, kind: int, similarity: float, width: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): the links that the comparisons of a plan find.

    plan: (id, row, variant, n, root) of the members of families, and PLAN. A family has ``total`` blocks of about BLOCK shingles, and a task
    compares two of them, or one with itself. A member belongs to one of the ``blocks`` blocks from ``first`` on and goes to its
    tasks with all others, but for those of its own class if ``spread`` is false (all of that class hang together already).
    """
    wanted = F.col("total") if kind else F.when(F.col("spread"), F.col("total")).otherwise(F.lit(1))
    shingles = plan.agg(F.sum((F.col("n") + HEAD).cast("long") * wanted)).first()[0] or 0
    m = min(MAX_SHARDS, max(shard_count(plan, 4 << 20), -(-shingles // BLOCK)))
    texts = docs.select(F.col(id_col).cast("long").alias("t_id"), _row(id_col, text_col).alias("t_row"), F.col(text_col).alias("text"))
    met = texts.join(plan, F.col("t_id").eqNullSafe(plan["id"]) & (F.col("t_row") == plan["row"]))
    sets = met.select("text", "variant", "root", "spread", "total", "first", "blocks")

    def tasks(number: int, spread: bool, total: int, first: int, blocks: int) -> Iterator[tuple[int, int, int]]:
        """(block, other block, side)."""
        own = first + number % blocks
        if kind == HUBS:  # hubs meet every block, members are in one
            yield from ((j, j, 0) for j in range(total)) if spread else ((own, own, 1),)
            return
        for j in range(total):
            if spread or not first <= j < first + blocks:
                yield min(own, j), max(own, j), int(own > j)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "payload"]
        for batch in batches:
            shards: list[int] = []
            blobs: list[bytes] = []
            variant, roots = (batch.column(i).to_numpy(zero_copy_only=False).view("<u8") for i in (1, 2))
            plans = zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True)
            numbers = mix64(variant ^ np.uint64(SEED)).tolist()
            for i, given in enumerate(plans):
                hashes = np.unique(shingle_hashes(batch.column(0)[i].as_py(), width, SEED))
                for low, high, side in tasks(numbers[i], *given):
                    task = xxhash.xxh64_intdigest(np.array([roots[i], low, high], "<u8").tobytes(), SEED)
                    shards.append(task % m)
                    blobs.append(np.r_[np.array([task, side, variant[i], len(hashes)], "<u8"), hashes].tobytes())
                    if len(blobs) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=names)
                        shards, blobs = [], []
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    def compared(records: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = family_links(records, similarity)
        if len(found):
            yield _pairs(found)

    return staged(reduce_shards(sets.mapInArrow(dealt, "shard int, payload binary"), m, np.dtype("<u8"), compared, "a long, b long"), "simhash-similar")


def similar_links(docs: DataFrame, variants: DataFrame, near: DataFrame, similarity: float, width: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b) of variants that share a band key or are ``near`` (a, b), directly or by others, and have a Jaccard similarity of ``similarity`` or more."""
    how = {"similarity": similarity, "width": width, "id_col": id_col, "text_col": text_col}
    met = band_links(variants)
    families = components(met.filter("d = 0").select("a", "b").union(near).distinct(), "a", "b")
    members = staged(variants.select("id", "row", "variant", "n").join(families, F.col("variant") == F.col("node")).drop("node"), "simhash-members")
    size = F.sum((F.col("n") + HEAD).cast("long"))
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    # families of more than one block are few: a BLOCK of shingles each at least
    large = staged(members.groupBy("root").agg(size.alias("shingles")).filter(F.col("shingles") > BLOCK).select(F.col("root").alias("l_root"), blocks(F.col("shingles")).alias("total")), "simhash-large")
    one = [F.lit(True).alias("spread"), F.lit(1).alias("total"), F.lit(0).alias("first"), F.lit(1).alias("blocks")]
    if large.isEmpty():
        out = _compared(docs, members.select("*", *one), 1, **how)
        discard(met, members, large)
        return out
    small = members.join(F.broadcast(large), F.col("root") == F.col("l_root"), "left_anti").select("*", *one)
    big = members.join(F.broadcast(large), F.col("root") == F.col("l_root")).drop("l_root")
    # 1. hubs, the members that share most keys with others, are compared with their whole family: work that grows with its size
    degrees = met.filter("d > 0").groupBy(F.col("a").alias("h_variant")).agg(F.max("d").alias("d"))
    by_degree = Window.partitionBy("root").orderBy(F.col("d").desc(), "variant")
    hubs = big.join(degrees, F.col("variant") == F.col("h_variant")).withColumn("place", F.row_number().over(by_degree)).filter(F.col("place") <= HUBS_EACH)
    columns = ["id", "row", "variant", "n", "root"]
    plan = [hubs.select(*columns, F.lit(True).alias("spread"), "total", F.lit(0).alias("first"), F.col("total").alias("blocks")), big.select(*columns, F.lit(False).alias("spread"), "total", F.lit(0).alias("first"), F.col("total").alias("blocks"))]
    plan = staged(plan[0].union(plan[1]), "simhash-hubs")
    first = _compared(docs, plan, HUBS, **how)
    # 2. what hangs together now is not compared with itself again; classes of less than a block are the rest, compared with all
    hung = components(first, "a", "b").select(F.col("node").alias("c_node"), F.col("root").alias("class"))
    classed = staged(big.join(hung, F.col("variant") == F.col("c_node"), "left").select(*columns, "class"), "simhash-classed")
    sizes = classed.groupBy("root", "class").agg(size.alias("shingles"))
    whole = sizes.filter(F.col("class").isNotNull() & (F.col("shingles") > BLOCK)).select("root", "class", blocks(F.col("shingles")).alias("blocks"))
    rest = sizes.join(whole.select(F.col("root").alias("w_root"), F.col("class").alias("w_class")), (F.col("root") == F.col("w_root")) & (F.col("class") == F.col("w_class")), "left_anti")
    rest = rest.groupBy("root").agg(F.sum("shingles").alias("shingles")).select("root", F.lit(None).cast("long").alias("class"), blocks(F.col("shingles")).alias("blocks"))
    order = Window.partitionBy("root").orderBy(F.col("class").asc_nulls_first())
    before = F.coalesce(F.sum("blocks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    laid = whole.unionByName(rest).withColumn("first", before).withColumn("total", F.sum("blocks").over(Window.partitionBy("root")).cast("int"))
    laid = staged(laid.select(F.col("root").alias("y_root"), F.col("class").alias("y_class"), "first", "blocks", "total"), "simhash-laid")
    known = laid.filter("y_class is not null")
    own = classed.join(F.broadcast(known.select(F.col("y_root").alias("k_root"), F.col("y_class").alias("k_class"))), (F.col("root") == F.col("k_root")) & (F.col("class") == F.col("k_class")), "left")
    placed = own.join(F.broadcast(laid), (F.col("root") == F.col("y_root")) & F.col("k_class").eqNullSafe(F.col("y_class")))
    again = placed.select(*columns, F.col("k_class").isNull().alias("spread"), "total", "first", "blocks").filter("spread or blocks < total")
    second = _compared(docs, staged(small.unionByName(again), "simhash-plan"), 1, **how)
    out = first.union(second)
    discard(met, members, large, plan, classed, laid)
    return out


def groups(docs: DataFrame, *, similarity: float, distance: int = 4, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of the groups that links of similar shingle sets make."""
    return _grouped(docs, similarity, distance, width, id_col, text_col).select(F.col("id").alias(id_col), "component_id")


def _grouped(docs: DataFrame, similarity: float, distance: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, component_id, root): each row's group, which ``root`` names even where all ids are null. Texts without words are one group."""
    sketches = staged(_sketched(docs, id_col, text_col, width), "simhash-sketches")
    best = sketches.groupBy("variant").agg(F.min("id").alias("first_id"), F.min(F.struct("id", "row", "n", "bands", "fp")).alias("m"))
    variants = staged(best.select("variant", "first_id", "m.id", "m.row", "m.n", "m.bands", "m.fp"), "simhash-variants")
    some = variants.filter("n > 0")
    prints = staged(some.groupBy("fp").agg(F.min("variant").alias("first")), "simhash-classes")
    found = links(prints.select("fp"), distance)
    ends = [prints.select(F.col("fp").alias(f"{k}_fp"), F.col("first").alias(k)) for k in ("a", "b")]
    near = found.select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp")).join(ends[0], "a_fp").join(ends[1], "b_fp").select("a", "b")
    equal = some.join(prints.withColumnRenamed("fp", "p_fp"), F.col("fp") == F.col("p_fp")).filter("variant <> first").select(F.col("first").alias("a"), F.col("variant").alias("b"))
    edges = similar_links(docs, some.drop("first_id", "fp"), staged(near.union(equal), "simhash-near"), similarity, width, id_col, text_col)
    rows = _named(sketches.select("id", "row", F.col("variant").alias("fp")), variants.select(F.col("variant").alias("fp"), "first_id"), edges, "root")
    out = staged(rows.select("id", "row", "component_id", "root"), "simhash-found")
    discard(sketches, variants, prints)
    return out


def deduplicated(docs: DataFrame, *, similarity: float | None = None, distance: int = 4, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: that with its smallest id, null ids last, then of those with that id the least by a hash of the row.

    Rows are told apart by id and text; of rows equal in both one stays.
    """
    if similarity is None:
        prints = staged(fingerprints(docs, id_col, text_col, width, rows=True), "simhash-prints")
        classes = staged(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-classes")
        edges = staged(links(classes.select("fp"), distance).distinct(), "simhash-links")
        found = staged(_named(prints, classes, edges, "root"), "simhash-found")
    else:
        found = _grouped(docs, similarity, distance, width, id_col, text_col)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))).alias("m"))
    # the caller's columns may have any names
    k_id, k_row, row = fresh_names(docs, "id", "row", "kept")
    keep = first.select(F.col("m.id").alias(k_id), F.col("m.row").alias(k_row))
    marked = docs.withColumn(row, _row(id_col, text_col))
    kept = marked.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col(k_id)) & (F.col(row) == F.col(k_row)), "left_semi")
    if not found.groupBy("id", "row").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, row])
    return kept.drop(row)
