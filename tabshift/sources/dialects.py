"""Dialects from whole files: counts of every candidate by line, aggregated in one distributed pass.

A file's beginning may mislead: comments, a preamble, long cells, a first page of another kind. Here all lines have a say. A line's
cells that are quoted are set aside; then each candidate's marks are counted. The delimiter is the candidate whose commonest number
of marks, if there are any, the largest share of lines has; of equal shares the one listed first wins. The quote mark is the one that
encloses more cells. Quoting habits are a column's: some of its cells quoted without need, others bare, anywhere in the file.

Only histograms, a row a candidate and number of marks, and one row a column are shuffled. Lines with more than MOST_MARKS marks
count as having that many. Blank lines have no say, nor have lines with an odd number of a quote mark, at which a cell of several
lines begins or ends. Defined results: a file without marks has commas; one without quoted cells has double quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.sources import chunks

DELIMITERS = (",", "\t", ";", "|", ":", " ")
QUOTES = ('"', "'")
MOST_MARKS = 1000


def _without_quoted(line: Column, quote: str) -> Column:
    return F.regexp_replace(line, f"{quote}[^{quote}]*{quote}", "")


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    lines = chunks.pieces(spark, path, "\n", encoding).select(F.regexp_replace("value", r"\r\z", "").alias("line"))
    return lines.filter(F.col("line").rlike(r"\S"))


def statistics(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(quote, delimiter, marks, lines, enclosed): how many lines have so many of a delimiter outside quotes, and how many cells of these lines the quote encloses."""
    lines = _lines(spark, path, encoding)
    edge = "[" + "".join(d if d in ",;:| " else "\\t" for d in DELIMITERS) + "]"
    told = []
    for quote in QUOTES:
        outside = _without_quoted(F.col("line"), quote)
        enclosed = F.regexp_count("line", F.lit(f"(?:^|{edge}){quote}[^{quote}]*{quote}(?={edge}|$)"))
        for d in DELIMITERS:
            marks = F.least(F.char_length(outside) - F.char_length(F.replace(outside, F.lit(d), F.lit(""))), F.lit(MOST_MARKS))
            told.append(F.struct(F.lit(quote).alias("quote"), F.lit(d).alias("delimiter"), marks.alias("marks"), enclosed.alias("enclosed")))
            told[-1] = F.when(F.regexp_count("line", F.lit(quote)) % 2 == 0, told[-1])
    each = lines.select(F.explode(F.array_compact(F.array(*told))).alias("t")).select("t.*")
    return each.groupBy("quote", "delimiter", "marks").agg(F.count("*").alias("lines"), F.sum("enclosed").cast("long").alias("enclosed"))


def delimiter_and_quote(spark: SparkSession, path: str, encoding: str = "utf-8") -> tuple[str, str]:
    """The file's delimiter and quote mark; the driver sees the histograms, MOST_MARKS rows a candidate at most."""
    found = statistics(spark, path, encoding).collect()
    first = DELIMITERS[0]
    cells = {q: sum(r.enclosed for r in found if r.quote == q and r.delimiter == first) for q in QUOTES}
    quote = max(QUOTES, key=lambda q: cells[q])
    lines = sum(r.lines for r in found if r.quote == quote and r.delimiter == first)
    best, share = first, 0.0
    for d in DELIMITERS:
        most = max((r.lines for r in found if (r.quote, r.delimiter) == (quote, d) and r.marks), default=0)
        if most > share * lines:
            best, share = d, most / lines
    return best, quote


def quoting_habits(spark: SparkSession, path: str, delimiter: str, quote: str, encoding: str = "utf-8") -> DataFrame:
    """(col_pos, quoted, bare): whether a column has cells that are quoted without need, and cells that are bare, over all records."""
    records = chunks.csv_records(spark, path, delimiter, quote, encoding)
    d, q = f"\\Q{delimiter}\\E", f"\\Q{quote}\\E"
    other = f"[^{quote}]"
    plain = F.regexp_replace("text", f"(^|{d}){q}(?:(?!{d})[^{quote}\r\n])*{q}(?={d}|$)", "$1\u0001")
    needed = F.regexp_replace(plain, f"(^|{d}){q}{other}*+(?:{q}{q}{other}*+)*+{q}", "$1\u0002")
    cells = records.select(F.posexplode(F.split(needed, d, -1)).alias("col_pos", "cell"))
    return cells.groupBy("col_pos").agg(F.bool_or(F.col("cell") == "\u0001").alias("quoted"), F.bool_or(~F.col("cell").rlike("^(\u0001|\u0002.*|)$")).alias("bare"))
