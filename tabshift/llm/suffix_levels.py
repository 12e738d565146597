"""The stored levels of the suffix index: tables that only their own merges write again.

A call's suffixes become one level: a table of sorted runs, one for each value of some low bits of the strings' hashes (a power of
two, so that a level's runs can be split or put together as others need). Its runs are scanned against every stored level where
that lies: the new runs, the smaller side, go to the level's rows, by broadcast while they are at most BROADCAST_BYTES, else both
are shuffled by run. What is written for a call is so its own level and, whenever the last level has grown to half of the one
before it, the merge of both; over n calls each suffix is written at most log2(n) + 1 times.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm import suffixes as S
from tabshift.llm.common import discard, staged

BROADCAST_BYTES = 64 << 20
RUN_BYTES = 16 << 20
#: Of a stored suffix: its own call has met its string. Beside S.TOLD, above all distances.
MET = np.uint8(64)
FLAGS = S.TOLD | MET
KEYS = 100


class Level(NamedTuple):
    """(dest, payload): sorted runs of suffixes, dest the low ``shards`` bits' value of their strings' runs."""

    table: DataFrame
    shards: int
    bytes: int


def power_of_two(n: int) -> int:
    return 1 << (max(n, 1) - 1).bit_length()


def _run_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


def _is_in(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, keys)
    return (at < len(ordered)) & (ordered[np.minimum(at, len(ordered) - 1)] == keys) if len(ordered) else np.zeros(len(keys), bool)


def _call_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's batches of this call, each scanned against the levels of those before: one run, with marks of what met."""
    runs: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        ready = []
        for kind, dest, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if kind == S.SUFFIXES:
                runs.setdefault(dest, []).append(S.unpack(payload, S.SUFFIX, *S.STORED_FORM))
            else:
                ready.append((kind, dest, payload))
        if ready:
            yield S._rows(ready)
    for dest in sorted(runs):
        levels = S.Levels()
        for run in sorted(runs[dest], key=lambda r: int(r["id"].min())):
            levels.add(run)
        whole = np.concatenate([run for run, _ in levels.levels])
        whole["left"] |= np.where(np.concatenate([met for _, met in levels.levels]), MET, np.uint8(0))
        yield S._rows([(S.LEVEL, dest, S.pack_suffixes(whole, S.STORED_FORM))])


def _places(run: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    marks = np.empty(len(run), S.MARK)
    for name in S.MARK.names:
        marks[name] = run[name]
    marks["left"] &= ~FLAGS
    return [(S.MARKS, d, S.pack_marks(r)) for d, r in S._dealt(S.bucket_of(marks["id"], marks["tag"], buckets), marks)]


def _met(shards: int, buckets: int):
    """(old payload, new payload) rows -> marks of the old places that a new run holds, and the new run's strings with their old counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old, new in zip(batch.column(0), batch.column(1), strict=True):
                stored, fresh = (S.unpack(x.as_buffer(), S.SUFFIX, *S.STORED_FORM) for x in (old, new))
                keys = np.unique(fresh["key"])
                found = stored[_is_in(np.ascontiguousarray(stored["key"]), keys)]
                met, counts = np.unique(found["key"], return_counts=True)
                told = np.empty(len(met), S.HOT_KEY)
                told["code"], told["n"] = met, counts
                out = _places(found, buckets)
                out += [(KEYS, d, r.tobytes()) for d, r in S._dealt(_run_of(met, shards), told)]
                yield S._rows(out)

    return run


def _marked(hot: int, buckets: int):
    """A shard's new run and the strings that stored levels hold -> marks of the new places that met, and hot strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, np.ndarray] = {}
        known: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for kind, dest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == S.LEVEL:
                    runs[dest] = S.unpack(payload.as_buffer(), S.SUFFIX, *S.STORED_FORM)
                else:
                    known.setdefault(dest, []).append(np.frombuffer(payload.as_py(), S.HOT_KEY))
        for dest, new in sorted(runs.items()):
            old = np.concatenate(known.get(dest) or [np.empty(0, S.HOT_KEY)])
            met = (new["left"] & MET != 0) | _is_in(np.ascontiguousarray(new["key"]), np.unique(old["code"]))
            out = _places(new[met & (new["left"] & S.TOLD == 0)], buckets)
            keys, number = np.unique(np.r_[new["key"][met], old["code"]], return_inverse=True)
            counts = np.bincount(number, weights=np.r_[np.ones(int(met.sum())), old["n"]], minlength=len(keys)).astype(np.int64)
            if (many := counts >= hot).any():
                found = np.empty(int(many.sum()), S.HOT_KEY)
                found["code"], found["n"] = keys[many] & S.LOW40 | np.uint64(dest) << np.uint64(40), counts[many]
                out.append((S.HOT_KEYS, dest, found.tobytes()))
            yield S._rows(out)

    return run


def _payload_bytes(table: DataFrame) -> int:
    return table.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]


def scanned(sent: DataFrame, levels: tuple[Level, ...], shards: int, buckets: int, hot: int) -> tuple[DataFrame, Level]:
    """(marks, the call's level) of a call's suffixes, scanned against each other and against all stored levels."""
    first = staged(sent.repartitionById(shards, F.pmod("dest", F.lit(shards))).mapInArrow(_call_run, S.ROWS_SQL), "suffix-call")
    table = staged(first.filter(F.col("kind") == S.LEVEL).select("dest", "payload"), "suffix-level")
    own = Level(table, shards, _payload_bytes(table))
    found = []
    for level in levels:
        both = min(level.shards, shards)
        new = table.select(F.pmod("dest", F.lit(both)).alias("n_dest"), F.col("payload").alias("new"))
        if own.bytes <= BROADCAST_BYTES:
            new = F.broadcast(new)
        met = level.table.join(new, F.pmod(level.table["dest"], F.lit(both)) == new["n_dest"]).select("payload", "new")
        found.append(staged(met.mapInArrow(_met(shards, buckets), S.ROWS_SQL), "suffix-met-level"))
    runs = table.select(F.lit(S.LEVEL).alias("kind"), "dest", "payload")
    out = first.filter(F.col("kind") != S.LEVEL)
    for rows in found:
        runs = runs.unionByName(rows.filter(F.col("kind") == KEYS))
        out = out.unionByName(rows.filter(F.col("kind") == S.MARKS))
    marked = runs.repartitionById(shards, F.pmod("dest", F.lit(shards))).mapInArrow(_marked(hot, buckets), S.ROWS_SQL)
    marks = staged(out.unionByName(marked), "suffix-marks")
    discard(first, *found)
    return marks, own


def _split(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                x = S.unpack(payload.as_buffer(), S.SUFFIX, *S.STORED_FORM)
                yield S._rows([(S.LEVEL, d, S.pack_suffixes(r, S.STORED_FORM)) for d, r in S._dealt(_run_of(x["key"], shards), x)])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for dest, payload in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            runs.setdefault(dest, []).append(S.unpack(payload.as_buffer(), S.SUFFIX, *S.STORED_FORM))
    for dest, parts in runs.items():
        yield S._rows([(S.LEVEL, dest, S.pack_suffixes(np.concatenate(parts), S.STORED_FORM))])


def grown(levels: tuple[Level, ...], new: Level) -> tuple[Level, ...]:
    """The levels with one more; each is at least twice as large as the next. A merged level has as many runs as its size needs."""
    kept = list(levels)
    while kept and kept[-1].bytes < 2 * new.bytes:
        last = kept.pop()
        shards = max(last.shards, new.shards, power_of_two((last.bytes + new.bytes) // RUN_BYTES))
        both = last.table.select("payload").unionByName(new.table.select("payload")).mapInArrow(_split(shards), S.ROWS_SQL)
        table = staged(both.repartitionById(shards, "dest").mapInArrow(_joined, S.ROWS_SQL).select("dest", "payload"), "suffix-level")
        discard(last.table, new.table)
        new = Level(table, shards, _payload_bytes(table))
    return (*kept, new)
