"""Value grammar of text cells as Column predicates: what counts as null, integer, float, boolean, date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabshift.functions.dates import to_timestamp  # noqa: F401  part of the grammar

DIGITS = r"\d+(_\d+)*"
INTEGER = rf"^\s*[+-]?{DIGITS}\s*$"
LEADING_ZERO_INT = r"^\s*-*0.+"
FLOAT = rf"(?i)^\s*[+-]?(({DIGITS}\.?({DIGITS})?|\.{DIGITS})(e[+-]?{DIGITS})?|inf|infinity|nan)\s*$"
LEADING_ZERO_FLOAT = r"^\s*-*0[^.\s]"
PLAIN = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"
# The cells that are booleans, exactly so written.
BOOLEANS = ("true", "false", "True", "False", "0", "1", "yes", "no")

def is_null(value: Column) -> Column:
    """Missing or the empty string; white space alone is a value."""
    return value.isNull() | (value == "")


def is_integer(value: Column) -> Column:
    return value.rlike(INTEGER) & ~value.rlike(LEADING_ZERO_INT)


def is_number(value: Column) -> Column:
    return value.rlike(FLOAT)


def is_float(value: Column) -> Column:
    return is_number(value) & ~value.rlike(LEADING_ZERO_FLOAT)


def is_boolean(value: Column) -> Column:
    return value.isin(*BOOLEANS)


def to_number(value: Column) -> Column:
    """The double that a numeric cell stands for, null for others."""
    return F.when(is_number(value), F.regexp_replace(F.trim(value), "_", "").try_cast("double"))


def to_integer(value: Column) -> Column:
    """The integer that an integer cell stands for, exact up to 38 digits; null for others."""
    return F.when(is_integer(value), F.regexp_replace(F.trim(value), r"[_+]", "").try_cast("decimal(38,0)"))


def integer_digits(value: Column) -> Column:
    """How many digits an integer cell has, null for others."""
    return F.when(is_integer(value), F.char_length(F.regexp_replace(value, r"[^0-9]", "")))


def zero_padded(value: Column) -> Column:
    """All digits with a leading zero: never part of a date column."""
    return value.rlike(r"^0\d+$")


def is_plain(value: Column) -> Column:
    """A number in its commonest form, without white space, underscores, exponents or zeros before it: what else it is needs few further looks."""
    return value.rlike(PLAIN)


def blank(value: Column) -> Column:
    return value.isNull() | ~value.rlike(r"\S")


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def values_equal(a: Column, b: Column) -> Column:
    """Cells are equal if their texts are, or their numbers, or both are empty, or their trimmed texts are."""
    x, y = to_number(a), to_number(b)
    numbers = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (x == y)
    return F.coalesce(a.eqNullSafe(b) | F.coalesce(numbers, F.lit(False)) | (is_null(a) & is_null(b)) | F.coalesce(strip(a) == strip(b), F.lit(False)), F.lit(False))


def header_key(name: Column) -> Column:
    return F.lower(strip(name))
