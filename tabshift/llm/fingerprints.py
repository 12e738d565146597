"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once. The hash's leading bits choose one of BINS bins, and a bin keeps its least hash.
An empty bin borrows from the first full one in its own fixed sequence of uniform probes (optimal densification), the same
sequence for every document. A fingerprint packs the BITS low-order bits of each bin's hash, as hexadecimal digits. Bins of
unlike sets agree by chance at a rate of 2^-BITS, so the share m of agreeing bins is corrected to (m - 2^-BITS) / (1 - 2^-BITS).

Defined results: a text of fewer than five words is one shingle; a text without words (null, empty, white space) has the empty
fingerprint, which is like another empty one with 1 and like any other with 0; equal texts have equal fingerprints; rows with
equal ids are separate documents, next to each other in order of their texts; null ids come after all others; the one row of a
table is its own next document; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm.common import MAX_BUCKETS, order_cuts, shard_count, with_order_bucket
from tabshift.llm.shards import mix64
from tabshift.llm.shingles import shingle_hashes

WIDTH, SEED = 5, 42
BINS, BIN_BITS, BITS = 256, 8, 4


@cache
def _probes(n: int) -> np.ndarray:
    """(BINS, n): where an empty bin looks, in turn."""
    at = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(1, n + 1, dtype=np.uint64)[None, :]
    return (mix64(at + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, empty bins filled; needs one hash at least."""
    hashes = np.sort(hashes)
    bins = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    full = np.zeros(BINS, bool)
    least = np.zeros(BINS, np.uint64)
    full[bins[first]] = True
    least[bins[first]] = hashes[first]
    empty, n = np.flatnonzero(~full), 32
    while len(empty):
        probes = _probes(n)[empty]
        hit = full[probes]
        found = hit.any(axis=1)
        least[empty[found]] = least[probes[found, hit[found].argmax(axis=1)]]
        empty, n = empty[~found], n * 8
    return least


def minhash(text: str | None) -> bytes:
    """The packed low-order bits, two bins a byte; empty for a text without words."""
    hashes = shingle_hashes(text, WIDTH, SEED)
    if not len(hashes):
        return b""
    low = (least_hashes(hashes) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two packed fingerprints, corrected for chance, from 0 to 1."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = (np.count_nonzero(x & 15 == 0) + np.count_nonzero(x >> 4 == 0)) / BINS
    return float(min(1.0, max(0.0, (same - 2.0**-BITS) / (1 - 2.0**-BITS))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([minhash(t.as_py()).hex() for t in batch.column(1)], pa.string())], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, fingerprint string")


def with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, ahead, id, text) in partitions sorted so that each document is followed by the next in descending id.

    Documents are dealt by order buckets; the first of each bucket also goes, marked ahead, to the bucket before it in that
    order (the first of all: to the last). Null ids come last, equal ids go by text. The driver gets one row a bucket.
    """
    n = 4 * shard_count(docs, 32 << 20, MAX_BUCKETS // 4)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_order_bucket(rows, "id", order_cuts(rows, "id", n))
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), -1).otherwise(F.col("bucket")))
    tops = rows.groupBy("bucket").agg(F.max("id").alias("top")).orderBy(F.col("bucket").desc()).collect()
    before = {t.bucket: tops[i - 1].bucket for i, t in enumerate(tops)}
    frame = docs.sparkSession.createDataFrame([(t.bucket, t.top, before[t.bucket]) for t in tops], "t_bucket int, top long, goes int")
    met = rows.join(F.broadcast(frame), rows["bucket"] == frame["t_bucket"])
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ahead"))
    both = F.when(F.col("id").eqNullSafe(F.col("top")), F.array(own, F.struct(F.col("goes").alias("bucket"), F.lit(True).alias("ahead")))).otherwise(F.array(own))
    dealt = met.select("id", "text", F.explode(both).alias("to")).select("to.bucket", "to.ahead", "id", "text")
    parts = max(1, n // 4)
    return dealt.repartition(parts, "bucket").sortWithinPartitions(F.col("bucket").desc(), "ahead", F.col("id").desc_nulls_last(), "text")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, and that of its text with the last third replaced by the next document's beginning."""

    def row(this: tuple, other: tuple) -> dict:
        doc_id, text, own = this
        _, after, other_print = other
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        edited_print = own if edited == text else minhash(edited)
        return {
            id_col: doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": own.hex(), "edited_fingerprint": edited_print.hex(), "near_edited": likeness(own, edited_print), "near_next": likeness(own, other_print),
        }

    schema = pa.schema([(id_col, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits = bucket = None
        for batch in batches:
            out = []
            for b, ahead, doc_id, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "ahead", "id", "text")), strict=True):
                b = b.as_py()
                if b != bucket:
                    waits, bucket = None, b
                if ahead.as_py() and waits is None:  # the copies of further rows with that id
                    continue
                text = text.as_py()
                this = (doc_id.as_py(), text, minhash(text))
                if waits is not None:
                    out.append(row(waits, this))
                waits = None if ahead.as_py() else this
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return with_following(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
