"""The metadata envelope of a CSV file: encoding, dialect, schema, samples and warnings in one JSON record."""

from __future__ import annotations

import argparse
import functools
import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabshift.operators import profile as P
from tabshift.sources import files as S

SCHEMA_VERSION = "0.1"
#: Fields of a warning's context that are numbers.
COUNTS, RATES = ("unique_count", "row_count", "null_count"), ("rows_per_entity_avg", "null_rate")


def _warning(code: str, severity: str, message: str, **context: Any) -> dict:
    return {"code": code, "severity": severity, "message": message, "context": context}


def _typed(value: str, dtype: str) -> Any:
    if dtype == "integer":
        return int(value)
    if dtype == "float":
        return float(value)
    if dtype == "boolean":
        return value.strip().lower() in ("true", "1", "yes")
    return value


Samples = dict[str, list]


def assembled(path: str, size: int, encoding: str, attempted: Sequence[str], dialect: S.Dialect, row_count: int, repeated: Sequence[str], profiled: Sequence[Any], firsts: dict[str, list[str]], samples: Samples) -> dict:
    """The record of a file from what has been found of it; ``profiled`` are rows of the profile with ``warned``, ``firsts`` values by column."""
    out: dict[str, Any] = {"format": "csv", "file_path": path, "file_size_bytes": size, "encoding": encoding, "schema_version": SCHEMA_VERSION}
    warnings = [_warning("LATIN1_FALLBACK", "warn", "not valid UTF-8; read as latin-1", attempted_encodings=list(attempted), final_encoding="latin-1")] if encoding == "latin-1" else []
    columns: list[dict] = []
    if not row_count:
        warnings.append(_warning("EMPTY_FILE", "error", "no data rows", row_count=0))
    else:
        if not dialect.has_header:
            warnings.append(_warning("MISSING_HEADER", "warn", "no header row; columns are numbered"))
        if repeated:
            warnings.append(_warning("DUPLICATE_COLUMN_NAME", "warn", "a name is used twice", duplicates=list(repeated)))
        if dialect.inconsistent_quoting:
            warnings.append(_warning("INCONSISTENT_QUOTING", "warn", "cells of a column are quoted in some rows only"))
    for r in sorted(profiled, key=lambda r: r["col_pos"]):
        block = {"name": r["col_name"], "dtype": r["dtype"], "null_count": r["null_count"], "unique_count": r["unique_count"], "sample_values": [_typed(v, r["dtype"]) for v in firsts.get(r["col_name"], [])]}
        if r["dtype"] == "integer" and r["max_digits"] <= 38:
            block |= {"min": int(r["min_integer"]), "max": int(r["max_integer"])}
        elif r["dtype"] in ("integer", "float"):
            block |= {"min": r["min_value"], "max": r["max_value"]}
        if r["dtype"] == "string":
            block["max_length"] = r["max_length"]
        columns.append(block)
        for w in r["warned"]:
            context = {k: int(v) if k in COUNTS else float(v) if k in RATES else v for k, v in dict(w["context"]).items()}
            warnings.append(_warning(w["code"], w["severity"], w["message"], **context))
    schema = {"delimiter": dialect.delimiter, "quote_char": dialect.quote, "has_header": dialect.has_header, "row_count": row_count, "columns": columns}
    return out | {"schema": schema, "samples": samples, "warnings": warnings}


def repeated_names(cells: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(x for i, x in enumerate(cells) if x in cells[:i]))


def envelope(spark: SparkSession, path: str, *, head_n: int = 3, middle_n: int = 1, tail_n: int = 1, sample_values: int = 3, max_rows: int | None = None, check_quoting: bool = False, whole_file: bool = False) -> dict:
    """The envelope as a dict. All rows are profiled unless ``max_rows`` is given; rates are over the rows profiled.

    ``check_quoting`` makes INCONSISTENT_QUOTING a real check of the file's beginning; else nothing raises that warning. ``whole_file``
    lets all lines decide the delimiter, the quote mark and that check instead of the beginning.
    """
    found = S.scan(spark, path).first() or Row(size=0, encoding="utf-8-sig", attempted=[], n_lines=0)  # empty files have no row
    facts = path, found.size, found.encoding, found.attempted
    samples: Samples = {"head": [], "middle": [], "tail": []}
    if not found.n_lines:
        return assembled(*facts, S.Dialect(), 0, [], [], {}, samples)
    sample = S.first_text(spark, path, found.encoding)
    dialect = S.sniff_file(spark, path, found.encoding, check_quoting) if whole_file else S.sniff(sample, check_quoting)
    row_count = max(found.n_lines - dialect.has_header, 0)
    if not row_count:
        return assembled(*facts, dialect, 0, [], [], {}, samples)
    multi_line = found.open_quotes if dialect.quote == '"' else found.open_apostrophes
    table = S.read_raw(spark, path, dialect, found.encoding, sample=sample, multi_line=multi_line)
    names = [c for c in table.columns if c != "row_idx"]
    repeated = repeated_names(S.first_record(sample, dialect) or []) if dialect.has_header else []
    rows = table.filter(F.col("row_idx") < max_rows) if max_rows else table
    # profile, first values and samples are one job; the exchange of distinct cells is shared
    distinct = P.distinct_cells(P.unpivoted(rows, keep=("row_idx",)), "row_idx")
    parts = {
        "profile": P.profile_distinct(distinct).withColumn("warned", P.column_warnings()), "first": P.first_of_distinct(distinct, sample_values),
        "sample": P.sample_rows(table, F.col("row_idx"), F.lit(row_count), head_n, middle_n, tail_n),
    }
    whole = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias(k)) for k, d in parts.items()])
    got = whole.collect()
    profiled, sampled = ([r[k] for r in got if r[k] is not None] for k in ("profile", "sample"))
    firsts: dict[str, list[str]] = {}
    for r in sorted((r["first"] for r in got if r["first"] is not None), key=lambda r: r["rank"]):
        firsts.setdefault(r.col_name, []).append(r.value)
    for r in sorted(sampled, key=lambda r: r.row_idx):
        samples[r.bucket].append({n: r[n] if r[n] is not None else "" for n in names})
    return assembled(*facts, dialect, row_count, repeated, profiled, firsts, samples)


def rendered(record: dict) -> tuple[str, int]:
    """Pretty JSON and an estimate of its tokens, a quarter of its characters."""
    text = json.dumps(record, indent=2, ensure_ascii=False)
    return text, len(text) // 4


def envelopes(spark: SparkSession, paths: Sequence[str], at_once: int = 8, **options: Any) -> DataFrame:
    """(path, envelope, est_tokens) of some files, the envelope as pretty JSON; the jobs of ``at_once`` files run side by side."""
    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(lambda p: (p, *rendered(envelope(spark, p, **options))), paths))
    return spark.createDataFrame(rows, "path string, envelope string, est_tokens long")


def main(arguments: Sequence[str] | None = None) -> int:
    """``python -m tabshift.plans.envelope FILE``: the envelope and its estimated tokens on standard output."""
    parser = argparse.ArgumentParser(prog="envelope", description="Metadata envelope of a CSV file.")
    parser.add_argument("file")
    for name, n in (("head", 3), ("middle", 1), ("tail", 1)):
        parser.add_argument(f"--{name}-n", type=int, default=n, help=f"rows of the {name}, {n} if not given")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("envelope").getOrCreate()
    text, tokens = rendered(envelope(spark, given.file, head_n=given.head_n, middle_n=given.middle_n, tail_n=given.tail_n))
    print(text)
    print(f"# about {tokens} tokens (a quarter of the characters)")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
