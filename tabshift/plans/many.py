"""Metadata envelopes of many CSV files in one plan.

All files are read together, however many they are and however unlike: one scan gives each file's encoding and size, one pass its
beginning, from which its dialect and names are told; then all lines, with their file's dialect beside them, are cut into records,
records into cells, and cells are profiled by file and column in the same aggregations as one table's. What comes together at the
end of a file is its columns' profiles, first values and sampled rows, never its rows.

A large file has many tasks, a task many small files. The facts of files (one row each) go to all tasks by broadcast; more than
BROADCAST_FILES are refused, and such folders are taken in several calls.

Defined results: as ``envelope``'s; files without a line, and paths that match nothing, have no row here. Cells beyond a file's first
record are dropped, missing ones are null.
"""

from __future__ import annotations

import csv
import functools
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.operators import profile as P
from tabshift.plans import envelope as E
from tabshift.sources import chunks
from tabshift.sources import files as S

BROADCAST_FILES = 100_000
SNIFFED = "path string, delimiter string, quote string, has_header boolean, inconsistent boolean, names array<string>, repeated array<string>"


def _sniffed(check_quoting: bool):
    """(path, block, value) rows of first chunks -> each file's dialect and names; a file's lines come one after the other."""

    def told(path: str, lines: list[str]) -> tuple:
        text = "\n".join(lines).lstrip("﻿")[: S.SNIFF_CHARS]
        dialect = S.sniff(text, check_quoting)
        cells = next(csv.reader(io.StringIO(text, newline=""), delimiter=dialect.delimiter, quotechar=dialect.quote), [])
        names = P.deduplicated_names([x or f"_c{i}" for i, x in enumerate(cells)]) if dialect.has_header else [f"c{i}" for i in range(len(cells))]
        return path, *dialect, names, E.repeated_names(cells) if dialect.has_header else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, size, out = None, [], 0, []
        for batch in batches:
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path != now:
                    if now is not None:
                        out.append(told(now, lines))
                    now, lines, size = path, [], 0
                if size < S.SNIFF_CHARS and (lines or value.strip()):
                    lines.append(value.removesuffix("\r")[: S.SNIFF_CHARS])
                    size += len(lines[-1]) + 1
        if now is not None:
            out.append(told(now, lines))
        if out:
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["path", "delimiter", "quote", "has_header", "inconsistent", "names", "repeated"])

    return run


def file_facts(spark: SparkSession, paths: Sequence[str] | str, check_quoting: bool = False) -> DataFrame:
    """(path, size, encoding, attempted, n_lines, delimiter, quote, has_header, inconsistent, names, repeated) of each file with a line."""
    scanned = S.scan(spark, paths)
    charset = scanned.select("path", F.col("encoding"))
    begun = chunks.pieces(spark, paths, "\n").filter("block = 0").select("path", F.col("value").cast("binary").alias("bytes"))
    c = charset.withColumnRenamed("path", "c_path")
    texts = begun.join(F.broadcast(c), begun["path"] == c["c_path"]).select("path", F.when(F.col("encoding") == "latin-1", F.decode("bytes", "ISO-8859-1")).otherwise(F.decode("bytes", "UTF-8")).alias("value"))
    return scanned.drop("open_quotes", "open_apostrophes").join(texts.mapInArrow(_sniffed(check_quoting), SNIFFED), "path")


def _cells(spark: SparkSession, paths: Sequence[str] | str, facts: DataFrame) -> DataFrame:
    """(path, row, col_pos, value) of all data rows; rows are numbered from 0 in each file."""
    f = F.broadcast(facts.select(F.col("path").alias("f_path"), "encoding", "delimiter", "quote", "has_header", F.size("names").alias("width")))
    lines = chunks.pieces(spark, paths, "\n").join(f, F.col("path") == F.col("f_path"))
    value = F.when(F.col("encoding") == "latin-1", F.decode(F.col("value").cast("binary"), "ISO-8859-1")).otherwise(F.col("value"))
    lines = lines.withColumn("value", F.regexp_replace(value, "^﻿", ""))
    # one parser for each pair of delimiter and quote: a handful
    kinds = facts.groupBy("delimiter", "quote").agg(F.max(F.size("names")).alias("width")).collect()
    out = []
    for k in kinds:
        own = lines.filter((F.col("delimiter") == k.delimiter) & (F.col("quote") == k.quote))
        records = chunks.records_of(chunks.transitions(own.select("path", "block", "value"), k.delimiter, k.quote))
        schema = ", ".join(f"_c{i} string" for i in range(max(k.width, 1)))
        parsed = F.from_csv("text", F.lit(schema), {"sep": k.delimiter, "quote": k.quote, "escape": k.quote})
        out.append(records.select("path", "row_idx", F.array(*[parsed[f"_c{i}"] for i in range(max(k.width, 1))]).alias("cells")))
    rows = functools.reduce(DataFrame.unionByName, out)
    first = F.broadcast(rows.groupBy("path").agg(F.min("row_idx").alias("base")).withColumnRenamed("path", "b_path"))
    rows = rows.join(first, F.col("path") == F.col("b_path")).join(f, F.col("path") == F.col("f_path"))
    rows = rows.withColumn("row", F.col("row_idx") - F.col("base") - F.col("has_header").cast("int")).filter("row >= 0")
    return rows.select("path", "row", F.slice("cells", F.lit(1), F.col("width")).alias("cells"))


def envelopes_of(spark: SparkSession, paths: Sequence[str] | str, *, head_n: int = 3, middle_n: int = 1, tail_n: int = 1, sample_values: int = 3, check_quoting: bool = False) -> DataFrame:
    """(path, envelope, est_tokens) of all files at ``paths``, the envelope as pretty JSON."""
    facts = file_facts(spark, paths, check_quoting)
    kept = S.scratch(spark, "facts")
    facts.write.parquet(kept)  # a row a file, which several steps read
    facts = spark.read.parquet(kept)
    n = facts.count()
    if n > BROADCAST_FILES:
        raise ValueError(f"{n} files: take at most {BROADCAST_FILES} a call")
    counted = facts.withColumn("row_count", F.greatest(F.col("n_lines") - F.col("has_header").cast("int"), F.lit(0)))
    if not n:
        return spark.createDataFrame([], "path string, envelope string, est_tokens long")
    rows = _cells(spark, paths, facts)
    cells = rows.select("path", "row", F.posexplode("cells").alias("col_pos", "value"))
    key = F.concat_ws("\n", F.col("col_pos").cast("string"), "path").alias("col_name")  # a file's column, until its name is known
    distinct = P.distinct_cells(cells.select("col_pos", key, "value", "row"), "row")
    path = F.substring_index("col_name", "\n", -1)
    profiled = P.profile_distinct(distinct).withColumn("path", path)
    names = counted.select(F.col("path").alias("n_path"), F.posexplode("names").alias("n_pos", "name"))
    profiled = profiled.join(names, (F.col("path") == F.col("n_path")) & (F.col("col_pos") == F.col("n_pos"))).withColumn("col_name", F.col("name")).withColumn("warned", P.column_warnings())
    fields = ["col_pos", "col_name", "dtype", "row_count", "null_count", "unique_count", "min_value", "max_value", "max_length", "min_integer", "max_integer", "max_digits", "warned"]
    columns = profiled.groupBy("path").agg(F.collect_list(F.struct(*fields)).alias("profiled"))
    firsts = P.first_of_distinct(distinct, sample_values).withColumn("path", path).withColumn("at", F.substring_index("col_name", "\n", 1).cast("int"))
    firsts = firsts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "rank", "value"))).alias("firsts"))
    totals = F.broadcast(counted.select(F.col("path").alias("t_path"), "row_count"))
    sampled = P.sample_rows(rows.join(totals, F.col("path") == F.col("t_path")), F.col("row"), F.col("row_count"), head_n, middle_n, tail_n)
    sampled = sampled.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("row", "bucket", "cells"))).alias("sampled"))
    whole = counted.join(columns, "path", "left").join(firsts, "path", "left").join(sampled, "path", "left")
    return whole.mapInArrow(_assembled, "path string, envelope string, est_tokens long")


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            names = r["names"]
            dialect = S.Dialect(r["delimiter"], r["quote"], r["has_header"], r["inconsistent"])
            firsts: dict[str, list[str]] = {}
            for f in r["firsts"] or []:
                firsts.setdefault(names[f["at"]], []).append(f["value"])
            samples: E.Samples = {"head": [], "middle": [], "tail": []}
            for s in r["sampled"] or []:
                samples[s["bucket"]].append({c: v or "" for c, v in zip(names, s["cells"], strict=False)})
            some = r["row_count"] > 0
            record = E.assembled(r["path"], r["size"], r["encoding"], r["attempted"], dialect, r["row_count"], r["repeated"] if some else [], r["profiled"] or [] if some else [], firsts, samples)
            out.append((r["path"], *E.rendered(record)))
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["path", "envelope", "est_tokens"])
