"""Quoted CSV and JSON arrays read in many tasks, whatever line breaks or commas their values hold.

A file is read in pieces (lines; for JSON what lies between commas) by as many tasks as it has chunks. Where a piece begins, a task
can't know whether it stands within a quoted value, so

1. each chunk is summed up as a function of the state in which it may begin: in which state it ends and how many records it closes
   (for JSON also how far it changes the depth of brackets);
2. these functions, one row a chunk, are composed in the order of the chunks, which gives each chunk its state and its first number;
3. each chunk is cut into records from its known state. Records that lie in one chunk are put together there; only those that go
   on over the end of a chunk are shuffled, two parts a boundary, and put together by their number.

No text is collected and no piece is parsed twice but for the two scans. States of pieces come from JVM expressions; tasks only
compose them, many pieces at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORDS = pa.schema([("row_idx", pa.int64()), ("path", pa.string()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])
RECORDS_SQL = "row_idx long, path string, block long, whole boolean, text string"


def pieces(spark: SparkSession, path: str, separator: str, encoding: str = "utf-8") -> DataFrame:
    """(path, block, value): what lies between separators, in order within each chunk; block is the chunk's place in its file."""
    rows = spark.read.option("lineSep", separator).text(path)
    value = F.col("value") if encoding.startswith("utf-8") else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((path, block), begin, end) of the runs of one chunk in a batch."""
    path, block = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    begin = 0
    for i in range(1, len(path) + 1):
        if i == len(path) or block[i] != block[begin] or path[i] != path[begin]:
            yield (path[begin], block[begin]), begin, i
            begin = i


def _stitched(records: DataFrame, between: str) -> DataFrame:
    """(path, row_idx, text): whole records as they are, the others put together from their parts."""
    parts = records.filter(~F.col("whole")).groupBy("path", "row_idx").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined = parts.select("path", "row_idx", F.array_join(F.transform("parts", lambda p: p["text"]), between).alias("text"))
    return records.filter("whole").select("path", "row_idx", "text").unionByName(joined)


# ---- CSV: lines that may begin within a quoted cell ----

START, BARE, QUOTED, CLOSED = range(4)


def open_after(line: Column, delimiter: str | Column, quote: str, within: bool) -> Column:
    """Whether a quoted cell is still open at the end of a line that begins a record or, ``within``, goes on in a quoted cell.

    What stands before each quote mark decides what the mark does: it opens a cell, is a plain character of a bare one, closes a
    quoted one or, right after that, is a doubled mark.
    """
    mark = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    before = F.slice(F.split(line, f"\\Q{quote}\\E", -1), 1, F.greatest(F.size(F.split(line, f"\\Q{quote}\\E", -1)) - 1, F.lit(0)))

    def step(state: Column, text: Column) -> Column:
        here = (
            F.when(state == QUOTED, QUOTED).when((state == CLOSED) & (text == ""), CLOSED).when(F.endswith(text, mark), START)
            .when(text == "", state).otherwise(BARE)
        )
        return F.when(here == START, QUOTED).when(here == BARE, BARE).when(here == QUOTED, CLOSED).otherwise(QUOTED)

    state = F.aggregate(before, F.lit(QUOTED if within else START), step)
    return F.when(F.contains(line, F.lit(quote)), state == QUOTED).otherwise(F.lit(within))


def csv_lines(spark: SparkSession, path: str, delimiter: str, quote: str, encoding: str) -> DataFrame:
    """(path, block, value, opens, stays, blank): pieces with their transition from either state."""
    return transitions(pieces(spark, path, "\n", encoding), delimiter, quote)


def transitions(lines: DataFrame, delimiter: str | Column, quote: str) -> DataFrame:
    """(path, block, value, opens, stays, blank) of lines; the delimiter may be a column of theirs."""
    v = F.col("value")
    return lines.select("path", "block", "value", open_after(v, delimiter, quote, False).alias("opens"), open_after(v, delimiter, quote, True).alias("stays"), (~v.rlike(r"\S")).alias("blank"))


def running(opens: np.ndarray, stays: np.ndarray, state: bool) -> np.ndarray:
    """The state after each line, from the state before the first: the last line that forces a state, and the flips since then."""
    forced, flips = opens == stays, np.cumsum(opens & ~stays)
    last = np.maximum.accumulate(np.where(forced, np.arange(len(opens)), -1))
    return np.where(last >= 0, opens[last] ^ ((flips - flips[last]) % 2 == 1), state ^ (flips % 2 == 1))


def _csv_function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chunk: the state it ends in and the records it begins, for each state it may begin in."""
    chunk, ends, begun, out = None, [False, True], [0, 0], []
    for batch in batches:
        opens, stays, blank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        for key, s, e in _segments(batch):
            if key != chunk:
                if chunk:
                    out.append((*chunk, *ends, *begun))
                chunk, ends, begun = key, [False, True], [0, 0]
            for k in (0, 1):
                after = running(opens[s:e], stays[s:e], ends[k])
                before = np.r_[ends[k], after[:-1]]
                begun[k] += int((~before & ~blank[s:e]).sum())
                ends[k] = bool(after[-1])
    if chunk:
        out.append((*chunk, *ends, *begun))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["path", "block", "opens", "stays", "n_plain", "n_within"])


def csv_chunks(lines: DataFrame) -> DataFrame:
    """(path, block, within, base, n): each chunk's state, the records before it, and those it begins. One row a chunk goes through the windows."""
    found = lines.select("path", "block", "opens", "stays", "blank").mapInArrow(_csv_function, "path string, block long, opens boolean, stays boolean, n_plain long, n_within long")
    file = Window.partitionBy("path").orderBy("block")
    flip = (F.col("opens") & ~F.col("stays")).cast("int")
    flips = found.withColumn("flips", F.sum(flip).over(file))
    last = F.last(F.when(F.col("opens") == F.col("stays"), F.struct("opens", "flips")), ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1))
    flips = flips.withColumns({"last": last, "so_far": F.col("flips") - flip})
    odd = lambda n: n % 2 == 1
    within = F.when(F.col("last").isNull(), odd(F.col("so_far"))).otherwise(F.col("last.opens") != odd(F.col("so_far") - F.col("last.flips")))
    known = flips.withColumn("within", within).withColumn("n", F.when(F.col("within"), F.col("n_within")).otherwise(F.col("n_plain")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return known.select("path", "block", "within", before.alias("base"), "n")


class _Cut:
    """Records of a chunk so far: what has been cut, and the pieces of the record that is still open."""

    def __init__(self, key: tuple[str, int], row: int, between: str) -> None:
        self.key, self.row, self.between = key, row, between
        self.open: list[str] = []
        self.whole = True  # whether the open record began in this chunk

    def rows(self, texts: list[tuple[int, bool, str]]) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in texts], pa.int64()), pa.array([self.key[0]] * n, pa.string()), pa.array([self.key[1]] * n, pa.int64()), pa.array([x[1] for x in texts], pa.bool_()), pa.array([x[2] for x in texts], pa.string())], schema=RECORDS)

    def closed(self) -> tuple[int, bool, str]:
        out = self.row, self.whole, self.between.join(self.open)
        self.open, self.whole, self.row = [], True, self.row + 1
        return out

    def rest(self) -> pa.RecordBatch:
        return self.rows([(self.row, False, self.between.join(self.open))] if self.open else [])


def _csv_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Cut | None = None
    state = False
    for batch in batches:
        opens, stays, blank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        value = batch.column(2)
        for key, s, e in _segments(batch):
            if now is None or now.key != key:
                if now:
                    yield now.rest()
                state, base = batch.column(6)[s].as_py(), batch.column(7)[s].as_py()
                now = _Cut(key, base - state, "\n")
                now.whole = not state
            after = running(opens[s:e], stays[s:e], state)
            before = np.r_[state, after[:-1]]
            state = bool(after[-1])
            begins = ~before & ~blank[s:e]
            # an open record has the number now.row; those that begin here come after it
            number = now.row + int(before[0]) + np.cumsum(begins) - 1
            # records of one line are taken together, the others line by line
            lone = np.flatnonzero(begins & ~after)
            done: list[tuple[int, bool, str]] = []
            for i in np.flatnonzero(before | (begins & after)).tolist():
                if begins[i]:
                    now.row, now.open, now.whole = int(number[i]), [], True
                now.open.append(value[s + i].as_py())
                if not after[i]:
                    done.append(now.closed())
            now.row = int(number[-1]) + 1 - state
            texts = value.slice(s, e - s).take(pa.array(lone))
            n = len(lone)
            yield pa.RecordBatch.from_arrays([pa.array(number[lone]), pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(np.ones(n, bool)), texts], schema=RECORDS)
            if done:
                yield now.rows(done)
    if now:
        yield now.rest()


def _placed(rows: DataFrame, chunks: DataFrame, columns: list[str], cut: Callable) -> DataFrame:
    """The records of all chunks; the chunks' table, one row each, goes to all tasks, so that pieces stay in place and order."""
    c = F.broadcast(chunks.withColumnsRenamed({"path": "c_path", "block": "c_block"}))
    both = rows.join(c, (rows["path"] == c["c_path"]) & (rows["block"] == c["c_block"]))
    return both.select(*rows.columns, *columns).mapInArrow(cut, RECORDS_SQL)


def csv_records(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', encoding: str = "utf-8") -> DataFrame:
    """(row_idx, text): the records of CSV files, header included, in the order of paths and lines; lines of white space alone between records are none."""
    return records_of(csv_lines(spark, path, delimiter, quote, encoding)).drop("path")


def records_of(lines: DataFrame) -> DataFrame:
    """(path, row_idx, text): the records of lines with their transitions."""
    records = _placed(lines, csv_chunks(lines), ["within", "base"], _csv_cut)
    return _stitched(records, "\n").select("path", "row_idx", F.regexp_replace("text", r"\r\z", "").alias("text"))


def count_records(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', encoding: str = "utf-8") -> DataFrame:
    """(records): how many records CSV files have, header included, without cutting them."""
    return csv_chunks(csv_lines(spark, path, delimiter, quote, encoding)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"))


# ---- JSON: commas at depth 1 of an array ----


def json_pieces(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(path, block, value, odd, deeper, deeper_within): whether a piece has an odd number of quote marks, and how far it changes the depth if it begins outside or within a string."""
    rows = pieces(spark, path, ",", encoding)
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # no comma is ever escaped, so pieces hold whole escapes

    def deeper(text: Column) -> Column:
        outside = F.regexp_replace(text, r'"[^"]*(?:"|\z)', "")
        count = lambda marks: F.char_length(outside) - F.char_length(F.translate(outside, marks, ""))
        return count("[{") - count("]}")

    odd = (F.char_length(plain) - F.char_length(F.replace(plain, F.lit('"'), F.lit("")))) % 2 == 1
    return rows.select("path", "block", "value", odd.alias("odd"), deeper(plain).alias("deeper"), deeper(F.concat(F.lit('"'), plain)).alias("deeper_within"))


class _Depths(NamedTuple):
    """After each piece: whether a string is open, and the depth."""

    within: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, odd: np.ndarray, deeper: np.ndarray, deeper_within: np.ndarray, within: bool, depth: int) -> _Depths:
        after = within ^ (np.cumsum(odd) % 2 == 1)
        before = np.r_[within, after[:-1]]
        return cls(after, depth + np.cumsum(np.where(before, deeper_within, deeper)))


def _json_function(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chunk: whether it flips the string state, and for each state it may begin in how far it changes the depth and how many pieces end at each depth."""
    chunk, state, out = None, [], []

    def told() -> None:
        out.append((*chunk, state[0][0], state[0][1], state[1][1], list(state[0][2].items()), list(state[1][2].items())))

    for batch in batches:
        odd, deeper, deeper_within = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        for key, s, e in _segments(batch):
            if key != chunk:
                if chunk:
                    told()
                chunk, state = key, [[False, 0, {}], [True, 0, {}]]
            for now in state:
                after = _Depths.of(odd[s:e], deeper[s:e], deeper_within[s:e], now[0], now[1])
                for depth, n in zip(*(x.tolist() for x in np.unique(after.depth[~after.within], return_counts=True)), strict=True):
                    now[2][depth] = now[2].get(depth, 0) + n
                now[0], now[1] = bool(after.within[-1]), int(after.depth[-1])
    if chunk:
        told()
    if out:
        columns = list(zip(*out, strict=True))
        kind = pa.map_(pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns[:5]), *(pa.array(c, kind) for c in columns[5:])], names=["path", "block", "odd", "deeper", "deeper_within", "ends", "ends_within"])


def json_chunks(rows: DataFrame) -> DataFrame:
    """(path, block, within, depth, base) of each chunk: the state it begins in, and the elements closed before it."""
    schema = "path string, block long, odd boolean, deeper long, deeper_within long, ends map<long,long>, ends_within map<long,long>"
    found = rows.select("path", "block", "odd", "deeper", "deeper_within").mapInArrow(_json_function, schema)
    file = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    known = found.withColumn("within", before(F.col("odd").cast("int"), file) % 2 == 1)
    known = known.withColumn("depth", before(F.when(F.col("within"), F.col("deeper_within")).otherwise(F.col("deeper")), file))
    ends = F.when(F.col("within"), F.col("ends_within")).otherwise(F.col("ends"))
    at = lambda d: F.coalesce(F.try_element_at(ends, F.lit(d).cast("long") - F.col("depth")), F.lit(0))
    known = known.withColumn("n", at(0) + at(1))
    return known.select("path", "block", "within", "depth", before("n", Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)).alias("base"))


def _json_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Cut | None = None
    within, depth = False, 0
    for batch in batches:
        odd, deeper, deeper_within = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        value = batch.column(2).to_pylist()
        for key, s, e in _segments(batch):
            if now is None or now.key != key:
                if now:
                    yield now.rest()
                within, depth, base = (batch.column(i)[s].as_py() for i in (6, 7, 8))
                now = _Cut(key, base, ",")
                now.whole = key[1] == 0
            after = _Depths.of(odd[s:e], deeper[s:e], deeper_within[s:e], within, depth)
            closes = np.flatnonzero(~after.within & (after.depth <= 1) & (after.depth >= 0))
            done, begin = [], s
            for i in closes.tolist():
                now.open += value[begin : s + i + 1]
                begin = s + i + 1
                if key[1] == 0 and now.row == base:  # the array's own brackets
                    now.open[0] = now.open[0].lstrip("\ufeff \t\r\n").removeprefix("[")
                if after.depth[i] == 0:
                    now.open[-1] = now.open[-1].rstrip().removesuffix("]")
                done.append(now.closed())
            now.open += value[begin:e]
            within, depth = bool(after.within[-1]), int(after.depth[-1])
            yield now.rows(done)
    if now:
        if now.key[1] == 0 and now.open and now.row == 0:
            now.open[0] = now.open[0].lstrip("\ufeff \t\r\n").removeprefix("[")
        yield now.rest()


def json_elements(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(row_idx, text): the elements of files that hold one JSON array each, each on one line, in the order of paths and elements."""
    rows = json_pieces(spark, path, encoding)
    records = _placed(rows, json_chunks(rows), ["within", "depth", "base"], _json_cut)
    out = _stitched(records, ",").select("row_idx", F.trim(F.regexp_replace("text", r"[\r\n\t]+", " ")).alias("text"))
    return out.filter("text <> ''")


def json_schema(elements: DataFrame, text: str = "text"):
    """The schema that Spark infers from texts of JSON values."""
    spark = elements.sparkSession
    texts = getattr(elements.select(text)._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark.read._jreader.json(texts), spark).schema


def read_json_array(spark: SparkSession, path: str, schema=None, encoding: str = "utf-8") -> DataFrame:
    """Rows with row_idx of a JSON array of objects, read in as many tasks as its file has chunks."""
    elements = json_elements(spark, path, encoding)
    schema = schema or json_schema(elements)
    return elements.select("row_idx", F.from_json("text", schema).alias("r")).select("row_idx", "r.*")
