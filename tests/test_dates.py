import datetime as dt
import random
import warnings

import pandas as pd
from pyspark.sql import functions as F

from tabshift.functions import dates
from tabshift.functions.dates import to_timestamp

FORMS = """2024-01-15|2024-1-5|2024/01/15|2024.01.15|2024-01|2024/01|Jan 2024|January 2024|15 January 2024|15 Jan 2024|15-Jan-2024|15-Jan-24|15 Jan 24|January 15, 2024|Jan 15 2024|January 15th, 2024|15th January 2024
1st Feb 2024|01/15/2024|15/01/2024|1/5/2024|1/5/24|01-15-2024|15.01.2024|1.5.24|20240115T103000|20240115T1030|20240115 103000|20240115|2024-01-15T10:30|2024-01-15T10:30:05|2024-01-15 10:30:05.123|2024-01-15 10:30:05.123456789
2024-01-15T10:30:05Z|2024-01-15T10:30:05+05:30|2024-01-15 10:30:05 +0530|2024-01-15T10:30:05+05|2024-01-15 10:30 UTC|15 January 2024 3:04 PM|Jan 15, 2024 3:04:05 am|01/15/2024 03:04 PM|1/15/24 15:04|Mon, 15 Jan 2024 10:00:00 GMT
Monday, January 15, 2024|Mon 15 Jan 2024|2024-13-01|2024-02-30|32/01/2024|13/13/2024|hello|May|may 5|Sept 5, 2024|Sep 5 2024|2024 Jan 15|2024-Jan-15|15/Jan/2024:10:30:00|12|2024||2024-01-15T24:00:00|25:00|10:61|1 2 2024|5 May 2024
Juneteenth 2024|Jan-15-2024|2024-01-15T10:30:05.5-08:00|2024-15-01|1/5/70|1/5/99|1/5/76|3 PM|decide 2024|12 monkeys|1.5|1,234|12:15:99|29 Feb 2023|29 Feb 2024|31 April 2024|0/1/2024| 2024-01-15 |JAN 15 2024 3:04 PM|2024-01-15 10:30:05,250""".replace("\n", "|").split("|")


def test_forms_against_pandas(spark):
    assert len(FORMS) >= 80
    rows = spark.createDataFrame(list(enumerate(FORMS)), "i int, v string").select("i", F.date_format(to_timestamp(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).collect()
    got = {FORMS[r.i]: r.t for r in rows}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for form in FORMS:
            t = pd.to_datetime(form.strip(), format="mixed", errors="coerce")
            want = None if pd.isna(t) else (t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t).strftime("%Y-%m-%d %H:%M:%S.%f")
            assert got[form] == want, form


def test_times_alone_are_todays(spark):
    forms = ["10:30", "10:30:15", "3:04 PM", "00:00", "12:15 AM", "12:15 pm"]
    rows = spark.createDataFrame(list(enumerate(forms)), "i int, v string").select("i", to_timestamp(F.col("v")).alias("t"), F.current_date().alias("d")).collect()
    assert [r.t.time() for r in sorted(rows)] == [dt.time(10, 30), dt.time(10, 30, 15), dt.time(15, 4), dt.time(0), dt.time(0, 15), dt.time(12, 15)]
    assert all(r.t.date() == r.d for r in rows)


#: The first test as it was: each cell that passed it went through all forms.
LOOSE = r"(?i)^\s*(?:\d{4}(?:\d{4}(?:[t\s].*)?)?\s*$|\d{1,4}(?:st|nd|rd|th)?[-/. ]*(?:\d|[a-z]{3})|\d{1,2}:\d|[a-z]{3,9}[-,. ]+(?:\d|[a-z]{3}))"


def test_numbers_and_words_do_not_reach_the_forms(spark):
    cells = ["12", "1234567", "12345678", "20241301", "20240100", "123456789012", "1234567.50", "12.5", "1_000", "10_000.5", "12e5", "12E-05", " 1234567 ", "green blue", "large-steel 5", "ok. 12"]
    rows = spark.createDataFrame([(c,) for c in cells], "v string")
    assert [r.v for r in rows.filter(F.col("v").rlike(dates.DATE_LIKE)).collect()] == []
    assert rows.filter(to_timestamp(F.col("v")).isNotNull()).count() == 0


def test_the_first_test_loses_no_date(spark):
    rng = random.Random(7)
    cells = [*FORMS, "0000", "0001", "00000101", "20240229", "20230229", "20241231", "99991231", "20240115\u2028", "2024\u2028", "20240115\n", "20240115 x", "99999999 1234", "\t2024 ", "Mon 2024", "monday, 5 May 2024", "October 2024", "oct.2024"]
    pieces = ["2024", "01", "15", "5", "13", "99", "0", "-", "/", ".", " ", ":", "t", "T", "Jan", "may", "MON", "wednes", "day", "sept", "th", "pm", "Z", "+05", "e", "_", ",", "\n", "\u2028", "abc"]
    cells += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 7))) for _ in range(6000)]
    cells += ["".join(rng.choice("0123456789") for _ in range(n)) for n in (4, 8) for _ in range(1500)]
    for form in FORMS:
        for _ in range(10):
            i = rng.randrange(len(form) + 1)
            cells.append(form[:i] + rng.choice(pieces) + form[i + rng.randint(0, 2):])
    v = F.col("v")
    cell = F.regexp_replace(F.lower(F.regexp_replace(v, r"^\s+|\s+$", "")), dates.WEEKDAY, "")
    before = F.when(v.rlike(LOOSE), dates._let(cell, dates._read))
    rows = spark.createDataFrame([(c,) for c in cells], "v string").select("v", before.alias("a"), to_timestamp(v).alias("b"))
    assert rows.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []
    assert rows.filter("b is not null").count() > 500
