"""Cleanup of generated text: outer white space, code fence, preamble, trailing prose; with the names of the steps that did something."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabshift.functions import grammar as G

#: The opening line takes all blank lines after it and gives none back: a fence with nothing in it is not closed.
FENCED = r"(?s)\A(?>```[A-Za-z0-9_+\-]*\s*\n)(.*?)\n```"


DECODER = json.JSONDecoder()


def without_fence(text: Column) -> Column:
    """The body of a fence that the text begins with; what follows the closing fence goes, an open fence stays."""
    return F.when(text.rlike(FENCED), F.regexp_extract(text, FENCED, 1)).otherwise(text)


def without_preamble(text: Column, fmt: Column) -> Column:
    """json: from the first line that begins an object or array; csv: from the first line with a comma; txt: as it is."""
    lines = F.split(text, "\n", -1)
    starts = lambda test: F.array_position(F.transform(lines, test), True)
    at = F.when(fmt == "json", starts(lambda x: x.rlike(r"^\s*[\{\[]"))).when(fmt == "csv", starts(lambda x: x.contains(","))).otherwise(F.lit(0))
    kept = F.array_join(F.slice(lines, at.cast("int"), F.greatest(F.size(lines), F.lit(1))), "\n")
    return F.when(at > 1, kept).otherwise(text)


def end_of_json(text: str) -> int | None:
    """Place after the bracket that closes the first one; counts that kind alone and passes over strings."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    try:
        return DECODER.raw_decode(text, start)[1]  # a whole value ends at the bracket that the walk below would find
    except (ValueError, RecursionError):
        pass
    opening = text[start]
    closing = "}" if opening == "{" else "]"
    depth, in_string, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif in_string:
            skip = c == "\\"
            in_string = c != '"'
        elif c == '"':
            in_string = True
        elif c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return i + 1
    return None


def without_trailing(text: Column) -> Column:
    """A JSON text up to the end of its first bracket, if more than white space follows."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            end = end_of_json(t) if t is not None else None
            return t[:end] if end is not None and t[end:].strip() else t

        return texts.map(one)

    return cut(text)


def cleaned(raw: Column, fmt: Column, trailing: bool = True) -> Column:
    """struct<text, applied>. ``trailing`` False leaves out the one step that needs Python."""
    fmt = F.lower(fmt)
    a = G.strip(F.coalesce(raw, F.lit("")))
    b = without_fence(a)
    c = without_preamble(b, fmt)
    d = F.when(fmt == "json", without_trailing(c)).otherwise(c) if trailing else c
    e = G.strip(d)
    applied = F.array_compact(F.array(
        F.when((a != F.coalesce(raw, F.lit(""))) | (e != d), F.lit("strip_whitespace")), F.when(b != a, F.lit("strip_code_fence")),
        F.when(c != b, F.lit("strip_preamble")), F.when(d != c, F.lit("strip_trailing_prose")),
    ))
    return F.struct(e.alias("text"), applied.alias("applied"))
