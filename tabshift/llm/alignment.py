"""Cross-tokenizer alignment by elementary intervals.

A text is encoded by a byte-level BPE (A: a space and the text) and by a SentencePiece model (B: the text, before which it puts a
space itself), so both write the same bytes. The union of the byte offsets at which tokens of either end parts the bytes into
elementary intervals; a search in either array gives the one token of A and the one of B that own an interval, which so is one
overlap; offsets at which both end close a group. All pairs of A and B tokens of a group are linked; an id pair's count is the
number of documents in which it is linked.

1. Batches of documents are encoded and aligned at once, as one run of bytes. A document's links become distinct id pairs with
   multiplicities, written as numbers into the batch's list of distinct pairs; only that list, with the number of the batch's
   documents that hold each pair, is dealt to the shards by A id.
2. A shard sums the batches' lists, takes each A id's highest count, and answers every batch: a count for each of its pairs and
   whether it is the highest. A frequent pair costs a shard one entry a batch.
3. Batches meet their answers and sum them over their documents' links.

Texts are encoded once. B is asked once for each distinct word of a batch if no piece of its vocabulary goes on after a space, so
that texts may be cut before single spaces; else, and for texts with double or outer spaces, it gets whole texts.

Defined results: documents that are null or empty, or for which either tokenizer doesn't give back its bytes (a text with U+2581,
say), have no tokens: zeros and an empty digest; strings of special tokens are plain text; rows with equal ids and repeated rows
are documents each; an empty table gives an empty result. Ids may be of any type; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabshift.llm import tokens
from tabshift.llm.common import discard, shard_count, staged

ENCODE, BATCH = 8 << 20, 1 << 20  # bytes of text encoded and aligned at once
PAIRS = 1 << 20  # documents' pairs that share a list
SHARD = 16 << 20
#: Links of a group beyond which equal ids are put together before its products expand.
LARGE = 1 << 12
COUNTS, DOCUMENT = 0, 1
#: Fixed value: how SentencePiece writes a space.
MARK = "▁"


def byte_level(entry: str) -> bytes:
    """The bytes of an entry of a byte-level vocabulary; an entry in other letters stands for itself."""
    letters = _byte_letters()
    return bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()


@cache
def _byte_letters() -> dict[str, int]:
    """Printable bytes are their own letters; the others, in order, are the letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary(NamedTuple):
    """Bytes and lengths by id."""

    entries: list[bytes]
    sizes: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> Vocabulary:
        return cls(entries, np.array([len(e) for e in entries], np.int64))

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids.tolist()))


class PieceEncoder:
    """A SentencePiece model that is asked once for each distinct word of some texts."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary.of([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        spaced = self.vocabulary.joined(np.array(self.model.encode("a  b "), np.int64)) == b" a  b "  # a space first, all others kept
        self.cuts = spaced and not any(MARK in p.lstrip(MARK) for p in pieces)

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(texts, num_threads=1) if texts else []
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids in each)."""
        if not self.cuts:
            return self._numbered(texts.to_pylist())
        whole = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        whole = np.flatnonzero(pc.or_(whole, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False))
        apart, apart_sizes = self._numbered(texts.take(pa.array(whole)).to_pylist())
        parts = pc.split_pattern(texts, " ")
        words = pc.dictionary_encode(parts.flatten())
        of = words.indices.to_numpy().astype(np.int64)
        flat, sizes = self._numbered(words.dictionary.to_pylist())
        # a text is its words, or one piece that comes after all words'
        bounds = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy())]
        each = np.ones(len(texts), np.int64)
        n_words = np.diff(bounds)
        each[:] = n_words
        each[whole] = 1
        firsts = np.cumsum(each) - each
        number = np.empty(int(each.sum()), np.int64)
        is_whole = np.zeros(len(texts), bool)
        is_whole[whole] = True
        number[np.repeat(~is_whole, each)] = of[np.repeat(~is_whole, n_words)]
        number[firsts[whole]] = len(sizes) + np.arange(len(whole))
        flat, sizes = np.concatenate([flat, apart]), np.concatenate([sizes, apart_sizes])
        begins = np.cumsum(sizes) - sizes
        took = sizes[number]
        total = np.r_[0, np.cumsum(took)]
        return tokens._gather(flat, begins[number], took), total[np.cumsum(each)] - total[firsts]


class Aligner:
    """Both tokenizers, and the alignment of texts in which they agree."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.first = tokens.encoder(byte_path, True)
        known = self.first.tokenizer.get_vocab()
        entries = [b""] * (max(known.values()) + 1)
        for entry, i in known.items():
            entries[i] = byte_level(entry)
        self.a, self.second = Vocabulary.of(entries), PieceEncoder(piece_path)
        self.b = self.second.vocabulary
        self.width = len(self.b.entries)  # a pair's number is a * width + b
        self.pairs = len(entries) * self.width
        self.ids = max(len(self.a.entries), self.width)
        self.said = [b"%d%c" % (i, sep) for sep in b",|;" for i in range(self.ids)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, A ids in each text, B ids, B ids in each text)."""
        found = self.first.encode_after_space(texts)
        n_a = np.fromiter(map(len, found), np.int64, len(found)) // self.first.dtype.itemsize
        return np.frombuffer(b"".join(found), self.first.dtype), n_a, *self.second.encode(texts)

    def agreed(self, texts: pa.Array, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same without the ids of texts that either doesn't give back."""
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64) + 1
        good = sizes > 1
        for ids, n, vocabulary in ((a, n_a, self.a), (b, n_b, self.b)):
            ends = np.cumsum(n)
            total = np.r_[0, np.cumsum(vocabulary.sizes[ids])]
            good &= total[ends] - total[ends - n] == sizes
        want = [b" " + x.as_buffer().to_pybytes() if ok else b"" for x, ok in zip(texts.cast(pa.binary()), good.tolist(), strict=True)]
        whole = b"".join(want)
        for ids, n, vocabulary in ((a, n_a, self.a), (b, n_b, self.b)):
            written = vocabulary.joined(ids[np.repeat(good, n)])
            if written != whole:
                at = np.cumsum([len(x) for x in want])
                good &= [written[e - len(x) : e] == x for x, e in zip(want, at.tolist(), strict=True)]
                return self.agreed(texts, a[np.repeat(good, n_a)], np.where(good, n_a, 0), b[np.repeat(good, n_b)], np.where(good, n_b, 0))
        return a[np.repeat(good, n_a)].astype(np.int64), np.where(good, n_a, 0), b[np.repeat(good, n_b)].astype(np.int64), np.where(good, n_b, 0)


class Groups(NamedTuple):
    """The groups of a run of bytes: where their tokens begin and how many there are, of A and of B."""

    first_a: np.ndarray
    n_a: np.ndarray
    first_b: np.ndarray
    n_b: np.ndarray


def groups_of(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Groups:
    """The groups of two tokenizations of the same bytes, from the lengths of their tokens."""
    end_a, end_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    ends = np.concatenate([end_a, end_b])
    ends.sort(kind="stable")  # two rising runs are merged
    ends = ends[np.diff(ends, prepend=0) > 0]  # the union of both: no token is empty
    own_a, own_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    if not len(ends):
        none = np.empty(0, np.int64)
        return Groups(none, none, none, none)
    shared = np.flatnonzero((end_a[own_a] == ends) & (end_b[own_b] == ends))  # the last interval of each group
    last_a, last_b = own_a[shared] + 1, own_b[shared] + 1
    first_a, first_b = np.r_[0, last_a[:-1]], np.r_[0, last_b[:-1]]
    return Groups(first_a, last_a - first_a, first_b, last_b - first_b)


def links_of(g: Groups, a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair number, how often) of all links; large groups put equal ids together first."""
    product = g.n_a * g.n_b
    small = np.flatnonzero(product <= LARGE)
    n = product[small]
    group = np.repeat(small, n)
    at = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    per = g.n_b[group]
    pair = a[g.first_a[group] + at // per] * width + b[g.first_b[group] + at % per]
    parts = [(group, pair, np.ones(len(pair), np.int64))]
    for i in np.flatnonzero(product > LARGE).tolist():
        of_a, times_a = np.unique(a[g.first_a[i] : g.first_a[i] + g.n_a[i]], return_counts=True)
        of_b, times_b = np.unique(b[g.first_b[i] : g.first_b[i] + g.n_b[i]], return_counts=True)
        pairs = (of_a[:, None] * width + of_b[None, :]).ravel()
        parts.append((np.full(len(pairs), i), pairs, np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def document_pairs(doc: np.ndarray, group: np.ndarray, pair: np.ndarray, times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair number, how often) of each document's distinct pairs, by document; pair numbers are below ``most``."""
    code = doc[group] * most + pair
    order = np.argsort(code)
    code = code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    often = np.add.reduceat(times[order], starts) if len(code) else times
    return code[starts] // most, code[starts] % most, often


def digests(g: Groups, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, said: list[bytes], ids: int) -> list[str]:
    """SHA-256 of each document's groups as text, ``a1,a2|b1;a3|b2``; '' for documents without tokens."""
    group_a, group_b = (np.repeat(np.arange(len(n)), n) for n in (g.n_a, g.n_b))
    out = np.empty(len(a) + len(b), np.int64)
    ends_a, ends_b = g.first_a + g.n_a - 1, g.first_b + g.n_b - 1
    code_a, code_b = a.copy(), b.copy()
    code_a[ends_a] += ids
    code_b[ends_b] += 2 * ids
    out[np.arange(len(a)) + g.first_b[group_a]] = code_a
    out[np.arange(len(b)) + (g.first_a + g.n_a)[group_b]] = code_b
    codes, at, found = out.tolist(), 0, []
    for n in (n_a + n_b).tolist():
        found.append(hashlib.sha256(b"".join(map(said.__getitem__, codes[at : at + n]))[:-1]).hexdigest() if n else "")
        at += n
    return found


@cache
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers or, under a first one, of any width."""
    return zlib.compress(b"".join([np.int64(len(columns[0])).tobytes(), *(c.tobytes() for c in columns)]), 1)


def _unpacked(payload: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zlib.decompress(payload), 8, []
    n = int(np.frombuffer(data, "<i8", 1)[0])
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def encoded(both: Aligner, rows: pa.RecordBatch) -> Iterator[tuple]:
    """(ids, texts, A ids, A ids in each, B ids, B ids in each) of runs of about BATCH bytes; words are put together over ENCODE bytes."""
    ids, texts = rows.column(0), pc.fill_null(rows.column(1), "")
    sizes = pc.binary_length(texts).to_numpy()
    bounds = _cut(sizes, ENCODE)
    for begin, end in zip(bounds, bounds[1:], strict=False):
        a, n_a, b, n_b = both.encode(texts.slice(begin, end - begin))
        upto_a, upto_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        parts = _cut(sizes[begin:end], BATCH)
        for s, e in zip(parts, parts[1:], strict=False):
            yield ids.slice(begin + s, e - s), texts.slice(begin + s, e - s), a[upto_a[s] : upto_a[e]], n_a[s:e], b[upto_b[s] : upto_b[e]], n_b[s:e]


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _cut(sizes: np.ndarray, most: int) -> list[int]:
    """Bounds of runs of rows of about ``most`` bytes, a row at least."""
    if not len(sizes):
        return [0]
    out, total = [0], 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            out.append(i)
            total = 0
        total += n
    return [*out, len(sizes)]


def aligned(docs: DataFrame, *, byte_tokenizer: str, piece_tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shards = shard_count(docs, SHARD)
    kind_of_id = source.schema["id"].dataType
    whole = [T.StructField(c, T.StringType() if c == "groups_sha256" else T.LongType()) for c in FIGURES]
    rows_schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("id", kind_of_id), *whole, T.StructField("payload", T.BinaryType())])
    out_schema = T.StructType([T.StructField("id", kind_of_id), *whole[:4], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), whole[4]])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, batch = aligner(byte_tokenizer, piece_tokenizer), TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            """The documents that wait, with their pairs as numbers into one list, and that list by shard."""
            ids, figures, shas, pair, often, ends = zip(*waiting, strict=True)
            pairs, number = np.unique(np.concatenate(pair), return_inverse=True)
            number, often = number.astype("<u4"), np.concatenate(often).astype("<i8")
            bounds = np.r_[0, np.cumsum(np.concatenate(ends))]
            payloads = [_packed(number[s:e], often[s:e]) for s, e in zip(bounds, bounds[1:], strict=False)]
            n = len(payloads)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, DOCUMENT, np.int32)), pa.array(np.full(n, batch)), pa.nulls(n, pa.int32()), pa.concat_arrays(ids), *(pa.array(np.concatenate(x)) for x in zip(*figures, strict=True)), pa.array([x for c in shas for x in c], pa.string()), pa.array(payloads, pa.binary())],
                names=rows_schema.names,
            )
            holders = np.bincount(number, minlength=len(pairs))
            shard = (pairs // both.width * 0x9E3779B1 >> 7) % shards  # all pairs of an A id in one shard
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            there = np.flatnonzero(np.diff(cuts))
            asked = [order[cuts[s] : cuts[s + 1]] for s in there.tolist()]
            payloads = [_packed(x.astype("<u4"), pairs[x].astype("<i8"), holders[x].astype("<i8")) for x in asked]
            n = len(there)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, COUNTS, np.int32)), pa.array(np.full(n, batch)), pa.array(there.astype(np.int32)), pa.nulls(n, ids[0].type), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.string()), pa.array(payloads, pa.binary())],
                names=rows_schema.names,
            )

        for rows in batches:
            for ids, texts, *found in encoded(both, rows):
                a, n_a, b, n_b = both.agreed(texts, *found)
                g = groups_of(both.a.sizes[a], both.b.sizes[b])
                doc = np.searchsorted(np.cumsum(n_a), g.first_a, side="right")
                n_docs = len(ids)
                of, pair, often = document_pairs(doc, *links_of(g, a, b, both.width), both.pairs)
                figures = [n_a, n_b, np.bincount(doc, minlength=n_docs), np.bincount(of, weights=often, minlength=n_docs).astype(np.int64)]
                sha = digests(g, a, b, n_a, n_b, both.said, both.ids)
                waiting.append((ids, figures, sha, pair, often, np.bincount(of, minlength=n_docs)))
                held += len(pair)
                if held >= PAIRS:
                    yield from flush()
                    waiting, held, batch = [], 0, batch + 1
        if waiting:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = aligner(byte_tokenizer, piece_tokenizer).width
        places, asked = [], []
        for rows in batches:
            places += rows.column(1).to_pylist()
            asked += [_unpacked(x.as_py(), "<u4", "<i8", "<i8") for x in rows.column(2)]
        if not asked:
            return
        pairs, number = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, number, np.concatenate([x[2] for x in asked]))
        of = pairs // width
        begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        best = total == np.repeat(np.maximum.reduceat(total, begins), np.diff(np.r_[begins, len(of)]))
        at = 0
        for place, (index, own, _) in zip(places, asked, strict=True):
            here = number[at : at + len(own)]
            at += len(own)
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([_packed(index, total[here].astype("<i8"), best[here].astype("u1"))], pa.binary())], names=["batch", "payload"])

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, told, counts, best = None, [], np.empty(0, np.int64), np.empty(0, bool)
        for rows in batches:
            n_best, count_sum, mine = [], [], []
            columns = (rows.column(rows.schema.get_field_index(c)) for c in ("kind", "batch", "payload"))
            for i, (kind, batch, payload) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                if batch != now:
                    now, told, counts = batch, [], None
                if kind == COUNTS:
                    told.append(_unpacked(payload, "<u4", "<i8", "u1"))
                    continue
                if counts is None:
                    n = sum(len(x[0]) for x in told)
                    counts, best = np.zeros(n, np.int64), np.zeros(n, bool)
                    for index, total, top in told:
                        counts[index], best[index] = total, top
                    told = []
                number, often = _unpacked(payload, "<u4", "<i8")
                n_best.append(int(often[best[number]].sum()))
                count_sum.append(int((often * counts[number]).sum()))
                mine.append(i)
            own = rows.take(pa.array(mine, pa.int64()))
            given = [own.column(own.schema.get_field_index(c)) for c in ("id", *FIGURES)]
            yield pa.RecordBatch.from_arrays([*given[:5], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), given[5]], names=out_schema.names)

    told = staged(source.mapInArrow(align, rows_schema), "alignment")
    answers = told.filter(F.col("kind") == COUNTS).select("shard", "batch", "payload").repartitionById(shards, "shard").mapInArrow(count, "batch long, payload binary")
    answers = answers.select(F.lit(COUNTS).alias("kind"), "batch", "payload")
    rows = told.filter(F.col("kind") == DOCUMENT).drop("shard").unionByName(answers, allowMissingColumns=True)
    out = rows.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(evaluate, out_schema)
    out = staged(out.withColumnRenamed("id", id_col), "aligned")
    discard(told)
    return out
