"""Dates and times of mixed forms as Column expressions: a cell is cut into words and numbers, which a table of orders makes a date of.

1. The weekday goes, then what ends the cell as a time: hours and minutes, seconds and fractions, am or pm, a zone.
2. What is left is looked up in ``ORDERS``: which of its numbers and month names are year, month and day.
3. Numbers become a timestamp; what is no date (a 30th of February, hour 25) is null.

Where month and day could be either, the month comes first; years of two digits lie within fifty years of today; a month without
a day is its first, a year without a month its January, and a time without a date is today's. Times with a zone are instants, others
are in the session's zone. Fractions beyond microseconds, and those after a
comma, are cut off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months and days, marks of zones.
MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
WEEKDAY = r"^(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+"
ZONE = r"(z|utc|gmt|[+-]\d{2}(?::?\d{2})?)"
TIME = rf"(?:^|[t\s]\s*)(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:\.(\d{{1,9}})|,\d{{1,9}})?)?\s*([ap]m)?\s*{ZONE}?$"
COMPACT = rf"^\d{{8}}[t\s](\d{{2}})(\d{{2}})(\d{{2}})?\s*{ZONE}?$"
NTH = r"(\d{1,2})(?:st|nd|rd|th)?"
YEAR = r"(\d{4}|\d{2})"
#: Forms of what is left of a date, and the groups that are its year, month and day; 0: the first.
ORDERS = (
    (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$", (1, 3, 4)), (r"^(\d{4})[-/](\d{1,2})$", (1, 2, 0)), (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)), (r"^(\d{4})$", (1, 0, 0)),
    (rf"^(1[3-9]|[23]\d)([-/. ])(\d{{1,2}})\2{YEAR}$", (4, 3, 1)), (rf"^(\d{{1,2}})([-/. ])(\d{{1,2}})\2{YEAR}$", (4, 1, 3)),
    (rf"^{NTH}[-\s]*{MONTH}[-\s,.]*{YEAR}$", (3, 2, 1)), (rf"^{MONTH}\.?[-\s]*{NTH},?[-\s]+(\d{{4}})$", (3, 1, 2)), (rf"^{MONTH}[-\s,.]+(\d{{4}})$", (2, 1, 0)), (rf"^(\d{{4}})[-\s]*{MONTH}[-\s]*(\d{{1,2}})$", (1, 2, 3)),
)
#: Cells that are a year, or a year, month and day, in plain digits.
DAY_DIGITS = r"^\d{4}(?:\d{4})?\z"
#: What all forms have in common: one test sets words and numbers aside. A number is no date unless its digits are a year, or a year with a month and a day.
DATE_LIKE = (
    r"(?i)^\s*(?:\d{4}(?:(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:[t\s].*)?)?\s*$|(?!\d[\d_]*(?:\.[\d_]*)?(?:e[+-]?[\d_]*)?\s*$)\d{1,4}(?:st|nd|rd|th)?[-/. ]*(?:\d|[a-z]{3})|\d{1,2}:\d"
    r"|(?:mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}[-,. ]+(?:\d|[a-z]{3}))"
)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def to_timestamp(value: Column) -> Column:
    """The time that a cell stands for; null for others."""
    cell = F.regexp_replace(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), WEEKDAY, "")
    return F.when(value.rlike(DAY_DIGITS), _day(value)).when(value.rlike(DATE_LIKE), _let(cell, _read))


def _day(digits: Column) -> Column:
    """The midnight of yyyy or yyyymmdd, without a look at other forms."""
    part = lambda at, size: F.substring(digits, at, size).cast("int")
    whole, midnight = F.char_length(digits) == 8, [F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)")]
    return F.try_make_timestamp(part(1, 4), F.when(whole, part(5, 2)).otherwise(1), F.when(whole, part(7, 2)).otherwise(1), *midnight)


def _read(cell: Column) -> Column:
    compact, timed = cell.rlike(COMPACT), cell.rlike(TIME)
    part = lambda of_compact, of_time: F.when(compact, F.regexp_extract(cell, COMPACT, of_compact) if of_compact else "").when(timed, F.regexp_extract(cell, TIME, of_time)).otherwise("")
    date = F.when(compact, F.substring(cell, 1, 8)).when(timed, F.regexp_replace(F.regexp_replace(cell, TIME, ""), r"[\s,]+$", "")).otherwise(cell)
    parts = F.struct(
        date.alias("date"), (compact | timed).alias("timed"), part(1, 1).alias("hour"), part(2, 2).alias("minute"), part(3, 3).alias("second"), part(0, 4).alias("fraction"), part(0, 5).alias("half"), part(4, 6).alias("zone"))
    return _let(parts, lambda p: _let(_date(p["date"], p["timed"]), lambda d: _made(d, p)))


def _date(text: Column, timed: Column) -> Column:
    """struct<y, m, d> as texts; null if the text has no known order."""
    today = F.current_date()
    known = lambda y, m, d: F.struct(y.cast("string").alias("y"), m.cast("string").alias("m"), d.cast("string").alias("d"))
    out = F.when(timed & (text == ""), known(F.year(today), F.month(today), F.day(today)))
    for form, groups in reversed(ORDERS):
        out = F.when(text.rlike(form), known(*[F.regexp_extract(text, form, g) if g else F.lit("1") for g in groups])).otherwise(out)
    return out


def _made(date: Column, p: Column) -> Column:
    short = F.lit(2000) + date["y"].cast("int")
    year = F.when(F.char_length(date["y"]) > 2, date["y"].cast("int")).otherwise(F.when(short >= F.year(F.current_date()) + 50, short - 100).otherwise(short))
    month = F.when(date["m"].rlike("^[a-z]"), ((F.position(F.substring(date["m"], 1, 3), F.lit(MONTHS)) + 2) / 3).cast("int")).otherwise(date["m"].try_cast("int"))
    number = lambda c: F.when(c == "", 0).otherwise(c.try_cast("int"))
    hour = number(p["hour"])
    hour = F.when(p["half"] == "", hour).when(hour.between(1, 12), hour % 12 + F.when(p["half"] == "pm", 12).otherwise(0))
    whole = number(p["second"])
    second = F.when(whole < 60, F.concat(whole.cast("string"), F.lit("."), F.rpad(F.substring(p["fraction"], 1, 6), 6, "0")).cast("decimal(8,6)"))
    plain = [year, month, date["d"].try_cast("int"), hour, number(p["minute"]), second]
    zone = F.when(p["zone"].rlike("^[a-z]"), "+00:00").otherwise(F.concat(F.substring(p["zone"], 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substring(p["zone"], 4, 3), ":", ""), 2, "0")))
    made = F.when(p["zone"] == "", F.try_make_timestamp(*plain)).otherwise(F.try_make_timestamp(*plain, zone))
    return F.when(date.isNotNull(), made)
