"""Text, CSV and JSON files: encoding, dialect, row positions, raw reads, and sinks with fixed writing rules."""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabshift.operators.profile import deduplicated_names
from tabshift.sources import chunks
from tabshift.sources import dialects as whole
from tabshift.sources.committed import write_named_files  # noqa: F401  a sink like those below

SNIFF_CHARS = 16_384


def supported(path: Column, suffix: str = ".csv") -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)) == suffix


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, encoding, attempted, n_lines, open_quotes, open_apostrophes) of text files, in one splittable pass over their lines.

    encoding: utf-8-sig if the whole file is valid UTF-8, else latin-1 after two failed tries (no line break is part of a longer
    UTF-8 character, so a file is valid if its lines are). n_lines: lines that aren't blank. The open flags tell whether some
    line has an odd number of that mark, without which no quoted cell can go on over a line's end. Files without lines have no row.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    odd = lambda mark: F.bool_or((F.octet_length("value") - F.octet_length(F.replace("value", F.lit(mark), F.lit("")))) % 2 == 1)
    whole = lines.groupBy("path", "size").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.count(F.when(F.col("value").rlike(r"\S"), 1)).alias("n_lines"), odd('"').alias("open_quotes"), odd("'").alias("open_apostrophes"))
    return whole.select(
        "path", "size", F.when(F.col("valid"), "utf-8-sig").otherwise("latin-1").alias("encoding"),
        F.when(F.col("valid"), F.array().cast("array<string>")).otherwise(F.array(F.lit("utf-8-sig"), F.lit("utf-8"))).alias("attempted"), "n_lines", "open_quotes", "open_apostrophes",
    )


def encodings(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """(path, size, encoding, attempted) of text files that have a line, or with ``folders`` of the documents whose parts are a folder's files."""
    files = scan(spark, path).select("path", "size", "encoding", "attempted")
    if not folders:
        return files
    # a part that isn't UTF-8 decides for its whole document; it is the lesser name and has the tries
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(F.sum("size").alias("size"), F.min("encoding").alias("encoding"), F.max_by("attempted", F.size("attempted")).alias("attempted"))


def one_partition(scan: DataFrame) -> bool:
    """Whether a scan (a plan without exchanges) has a single partition; looks at the plan, runs nothing."""
    return scan._jdf.queryExecution().toRdd().getNumPartitions() <= 1


def with_position(df: DataFrame, name: str = "row_idx", single: bool = False) -> DataFrame:
    """Contiguous positions from 0 in the order of partitions and rows within them.

    Two passes: rows per partition, then each row's place in its partition plus the rows before. What the window sees is one
    row a partition. The order is that of a file scan; the input must be deterministic, so rows that are sorted first go to
    ``in_order``. ``single``: there is one partition only, which needs neither pass.
    """
    if single:
        return df.withColumn(name, F.monotonically_increasing_id())
    return _offset(df.withColumn("_at", F.monotonically_increasing_id()), name)


def _offset(marked: DataFrame, name: str) -> DataFrame:
    """Positions of rows whose ``_at`` holds their partition and their place in it."""
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"))
    return marked.withColumn("_q", part).join(F.broadcast(offsets), F.col("_q") == F.col("_p")).withColumn(name, place + F.col("_before")).drop("_at", "_p", "_q", "_before")


def in_order(df: DataFrame, *order: str, name: str = "row_idx") -> DataFrame:
    """Contiguous positions from 0 in the order of columns that tell rows apart.

    A sort draws its range bounds anew each time it is planned, so that two passes over it would see other partitions. The sorted
    rows are written once with their places, and both passes read those.
    """
    path = scratch(df.sparkSession, "ordered")
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    return _offset(df.sparkSession.read.parquet(path), name)


class Dialect(NamedTuple):
    delimiter: str = ","
    quote: str = '"'
    has_header: bool = False
    inconsistent_quoting: bool = False


def sniff(sample: str, check_quoting: bool = False, known: tuple[str, str] | None = None) -> Dialect:
    """Delimiter and quote of a sample (its first SNIFF_CHARS characters) unless they are ``known``, and whether it has a header.

    It has one if the sniffer says so or can't tell, or if no column of the body is all numbers. ``check_quoting`` also looks
    for columns whose cells are quoted in some rows without need and bare in others.
    """
    from tabshift.operators.scoring import number

    sample = sample[:SNIFF_CHARS]
    if not sample:
        return Dialect()
    sniffer = csv.Sniffer()
    delimiter, quote = known or (",", '"')
    try:
        found = sniffer.sniff(sample, delimiter if known else None)
        delimiter, quote = known or (found.delimiter, found.quotechar or '"')
    except csv.Error:
        pass
    try:
        header = sniffer.has_header(sample)
    except csv.Error:
        header = True
    if not header:
        body = list(csv.reader(sample.splitlines(), delimiter=delimiter))[1:]
        columns = [[x for x in c if x] for c in zip(*body, strict=False)] if body else []
        header = not any(c and all(number(x) is not None for x in c) for c in columns)
    return Dialect(delimiter, quote, header, check_quoting and mixed_quoting(sample, delimiter, quote))


def sniff_file(spark: SparkSession, path: str, encoding: str = "utf-8-sig", check_quoting: bool = False) -> Dialect:
    """The dialect by all lines of a file (see ``dialects``); the header is judged by its beginning."""
    known = whole.delimiter_and_quote(spark, path, encoding)
    found = sniff(first_text(spark, path, encoding), known=known)
    mixed = check_quoting and not whole.quoting_habits(spark, path, *known, encoding).filter("quoted and bare").isEmpty()
    return found._replace(inconsistent_quoting=mixed)


def mixed_quoting(sample: str, delimiter: str, quote: str) -> bool:
    """Whether some column has cells quoted without need and cells without quotes."""
    q, d = re.escape(quote), re.escape(delimiter)
    cells = re.compile(rf"(?:{q}((?:[^{q}]|{q}{q})*){q}|([^{d}\n]*?))({d}|\r?\n|\Z)")
    quoted: set[int] = set()
    bare: set[int] = set()
    column = 0
    for m in cells.finditer(sample):
        if m[1] is not None and not any(c in m[1] for c in (quote, delimiter, "\n", "\r")):
            quoted.add(column)
        elif m[2]:
            bare.add(column)
        column = column + 1 if m[3] == delimiter else 0
    return bool(quoted & bare)


def dialects(texts: Column, check_quoting: bool = False) -> Column:
    """struct<delimiter, quote, has_header, inconsistent_quoting> of each text's beginning: ``sniff`` for many files at once."""
    @F.pandas_udf("delimiter string, quote string, has_header boolean, inconsistent_quoting boolean")
    def found(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sniff(t or "", check_quoting) for t in text], columns=["delimiter", "quote", "has_header", "inconsistent_quoting"])

    return found(F.substring(texts, 1, SNIFF_CHARS))


def count_records(spark: SparkSession, path: str, dialect: Dialect, encoding: str = "utf-8-sig") -> DataFrame:
    """(row_count): logical records without the header; a record may be several lines. Counted in as many tasks as the file has chunks."""
    found = chunks.count_records(spark, path, dialect.delimiter, dialect.quote, encoding)
    return found.select(F.greatest(F.col("records") - int(dialect.has_header), F.lit(0)).cast("long").alias("row_count"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file with row_idx: one array of objects, an object, or an object a line (several in a file of more than one chunk)."""
    if one_partition(spark.read.text(path, lineSep=",")):
        rows = spark.read.option("multiLine", True).json(path)
        return with_position(rows, single=one_partition(rows))
    start = spark.read.text(path).filter(F.col("value").rlike(r"\S")).limit(1).select(F.substring(F.regexp_replace(F.substring("value", 1, SNIFF_CHARS), "^[\ufeff\\s]+", ""), 1, 1).alias("c")).first()
    if start and start.c == "[":
        return chunks.read_json_array(spark, path)
    return with_position(spark.read.json(path))


def count_data_rows(lines: DataFrame, has_header: bool, value: str = "value") -> DataFrame:
    """(row_count): physical lines that aren't blank, without the header."""
    return lines.agg(F.greatest(F.count(F.when(F.col(value).rlike(r"\S"), 1)) - int(has_header), F.lit(0)).cast("long").alias("row_count"))


def first_text(spark: SparkSession, path: str, encoding: str) -> str:
    """The beginning of a file, decoded: its first SNIFF_CHARS characters, however many lines they are."""
    charset = "utf-8" if encoding.startswith("utf-8") else "latin-1"
    some, text = 200, ""
    while True:  # a line has one character at least, its end
        lines = spark.read.text(path).limit(some).select(F.substring("value", 1, SNIFF_CHARS).cast("binary").alias("b")).collect()
        text = "\n".join(bytes(r.b).decode(charset, "replace") for r in lines).lstrip("\ufeff")
        if len(text) >= SNIFF_CHARS or len(lines) < some:
            return text[:SNIFF_CHARS]
        some = min(SNIFF_CHARS + 1, some * SNIFF_CHARS // max(len(text), 1) + some)


def first_record(sample: str, dialect: Dialect) -> list[str] | None:
    """The cells of a sample's first record; None if the sample may end within it."""
    reader = csv.reader(io.StringIO(sample, newline=""), delimiter=dialect.delimiter, quotechar=dialect.quote)
    cells = next(reader, None)
    return cells if cells and (next(reader, None) is not None or len(sample) < SNIFF_CHARS) else None


def read_raw(spark: SparkSession, path: str, dialect: Dialect, encoding: str = "utf-8-sig", *, sample: str | None = None, multi_line: bool = True, max_rows: int | None = None) -> DataFrame:
    """All columns as strings with row_idx; header names repeat as name, name.1, ...; without a header c0, c1, ...

    With the file's beginning as ``sample`` its columns are known without a job. ``multi_line`` False (no quoted cell goes on over a
    line's end, see ``scan``) lets the lines be parsed as they are; otherwise a file of more than one chunk is cut into records by
    ``chunks`` and stays in as many tasks. Positions are the same on either way. ``max_rows`` keeps the first rows.
    """
    charset = "UTF-8" if encoding.startswith("utf-8") else "ISO-8859-1"
    rules = {"sep": dialect.delimiter, "quote": dialect.quote, "escape": dialect.quote}
    first = first_record(sample, dialect) if sample else None
    cells = lambda: ", ".join(f"_c{i} string" for i in range(len(first)))
    if multi_line and not one_partition(spark.read.text(path)):
        records = chunks.csv_records(spark, path, dialect.delimiter, dialect.quote, encoding)
        if first is None:
            head = records.filter("row_idx = 0").first()
            first = next(csv.reader(io.StringIO(head.text, newline=""), delimiter=dialect.delimiter, quotechar=dialect.quote)) if head else []
        parsed = records.select("row_idx", F.from_csv("text", F.lit(cells()), rules).alias("r"))
        return _named(parsed.select("row_idx", "r.*"), first, dialect, max_rows) if first else parsed.select("row_idx")
    reader = spark.read.options(**rules, encoding=charset, header=False, multiLine=multi_line, inferSchema=False)
    if first is not None:
        lines = reader.schema(cells()).csv(path)
    else:
        lines = reader.csv(path)
        first = lines.first()
    placed = with_position(lines, single=one_partition(lines))
    return _named(placed, first, dialect, max_rows) if first is not None else placed


def _named(placed: DataFrame, first: Sequence[str | None], dialect: Dialect, max_rows: int | None) -> DataFrame:
    """Columns named by the first record or numbered; rows after it."""
    columns = [c for c in placed.columns if c != "row_idx"]
    if dialect.has_header:
        names = deduplicated_names([(x or f"_c{i}").lstrip("\ufeff") for i, x in enumerate(first)])
        placed = placed.filter("row_idx > 0").select((F.col("row_idx") - 1).alias("row_idx"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    else:
        placed = placed.select("row_idx", *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return placed.filter(F.col("row_idx") < max_rows) if max_rows else placed


# ---- sinks ----

CSV_RULES = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}


def write_csv(df: DataFrame, path: str) -> None:
    """Comma, header, doubled quotes, blanks for nulls."""
    df.write.options(**CSV_RULES).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept."""
    df.write.option("ignoreNullFields", False).json(path)


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Files that hold one JSON array each, one a task, an element a line; nulls kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, "["
        for batch in batches:
            out = []
            for line in batch.column(0).to_pylist():
                if last is not None:
                    out.append(f"{before}{last},")
                    before = ""
                last = line
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if last is None else before + last + "]"], pa.string())], names=["value"])

    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(run, "value string").write.text(path)


def as_json_text(df: DataFrame, pretty: bool = True, order: str | None = None) -> DataFrame:
    """(json): all rows as one array; for small results, as it is one value."""
    item = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != order])
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*([F.col(order).alias("o")] if order else []), item.alias("x")))).alias("r"))
    return rows.select(F.to_json(F.transform("r", lambda s: s["x"]), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("json"))


def write_text(df: DataFrame, path: str, column: str = "report") -> None:
    df.select(column).write.text(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors see (``spark.checkpoint.dir``); a local one where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="tabshift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tabshift/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
