"""Scores of an actual text against an expected one: format validity, schema compliance, loadability, content accuracy.

Two forms with one meaning: ``scores`` is an Arrow-batched UDF that parses each text once; ``json_accuracy`` and
``csv_accuracy`` are the relational forms of content accuracy, over tables of leaves or cells, for documents too large for one
cell. Tests hold them against each other.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabshift.functions import grammar as G

FORMATS = ("json", "csv", "txt")
MISSING = object()


def parsed_json(text: str) -> Any:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return MISSING


def csv_rows(text: str) -> list[list[str]] | None:
    try:
        return list(csv.reader(io.StringIO(text)))
    except csv.Error:
        return None


def skeleton(value: Any) -> str:
    """Canonical shape of a JSON value: keys in order of name, the first element of a list, type names of scalars."""
    out, todo = [], [value]
    while todo:
        now = todo.pop()
        if isinstance(now, _Text):
            out.append(now)
        elif isinstance(now, dict):
            inner: list[Any] = [_Text("{")]
            for n, k in enumerate(sorted(now)):
                inner += [_Text(f"{',' if n else ''}{json.dumps(k)}:"), now[k]]
            todo += [_Text("}"), *reversed(inner)]
        elif isinstance(now, list):
            todo += [_Text("]"), *now[:1], _Text("[")]
        else:
            out.append(type(now).__name__)
    return "".join(out)


class _Text(str):
    """A finished part of a skeleton, told apart from the strings of a JSON value."""


def leaves(value: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """(path, scalar): a.b for keys, [i] for elements; the root scalar has an empty path. Depth costs no recursion."""
    todo = [(path, value)]
    while todo:
        path, now = todo.pop()
        if isinstance(now, dict):
            todo += reversed([(f"{path}.{k}" if path else str(k), v) for k, v in now.items()])
        elif isinstance(now, list):
            todo += reversed([(f"{path}[{i}]", v) for i, v in enumerate(now)])
        else:
            yield path, now


def number(value: Any) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError, OverflowError):
        return None


def equal(a: Any, b: Any) -> bool:
    if a == b:
        return True
    x, y = number(a), number(b)
    if x is not None and x == y:
        return True
    if a in (None, "") and b in (None, ""):
        return True
    return isinstance(a, str) and isinstance(b, str) and a.strip() == b.strip()


def loads_as_table(value: Any) -> bool:
    try:
        if isinstance(value, dict):
            value = next((v for v in value.values() if isinstance(v, list)), [value])
        if not isinstance(value, list):
            return False
        if all(type(x) is dict and not any(isinstance(v, (dict, list)) for v in x.values()) for x in value):
            return True  # flat records always load
        pd.json_normalize(value)
    except Exception:  # noqa: BLE001  the question is whether it loads
        return False
    return True


#: Not in a text whose lines are records and whose commas all part cells.
UNPLAIN = re.compile('["\r\0\ufeff\ud800-\udfff]')


def loads_as_csv(text: str) -> bool:
    """Whether pandas can load it; a plain table of named columns whose rows are equally wide always loads."""
    if not UNPLAIN.search(text):
        head, *body = text.removesuffix("\n").split("\n")
        if all(c.strip() for c in head.split(",")) and all(x.strip() for x in body) and len({x.count(",") for x in body}) <= 1:
            return True
    try:
        return len(pd.read_csv(io.StringIO(text)).columns) > 0
    except Exception:  # noqa: BLE001
        return False


def header(rows: list[list[str]]) -> list[str]:
    return [c.strip().lower() for c in rows[0]]


def score(actual: str | None, expected: str | None, fmt: str, required: list[str] | None, load: bool = True) -> tuple[float, float, float | None, float]:
    """(format_validity, schema_compliance, loadability, content_accuracy), each from 0 to 1; a null text is empty. Without ``load`` loadability is None where pandas would have to tell."""
    actual, expected, fmt = actual or "", expected or "", fmt.lower()
    if fmt == "txt":
        some = float(bool(actual.strip()))
        found = sum(s.lower() in actual.lower() for s in required or ())
        return some, 1.0, some, found / len(required) if required else 0.0
    if fmt == "json":
        a, e = parsed_json(actual), parsed_json(expected)
        if a is MISSING:
            return 0.0, 0.0, 0.0, 0.0
        want, have = dict(leaves(e)) if e is not MISSING else {}, dict(leaves(a))
        same = sum(p in have and equal(have[p], v) for p, v in want.items())
        return 1.0, float(e is not MISSING and skeleton(a) == skeleton(e)), float(loads_as_table(a)) if load else None, same / len(want) if want else 0.0
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt}")
    a, e = csv_rows(actual), csv_rows(expected)
    valid = bool(a) and len(a[0]) > 0 and all(len(r) == len(a[0]) for r in a)
    alike = bool(a) and bool(e) and header(a) == header(e)
    accuracy = 0.0
    if alike and len(e) > 1 and e[0]:
        cell = lambda i, j: a[i][j] if i < len(a) and j < len(a[i]) else ""
        same = sum(equal(cell(i, j), v) for i, row in enumerate(e[1:], 1) for j, v in enumerate(row))
        accuracy = min(1.0, same / ((len(e) - 1) * len(e[0])))
    return float(valid), float(alike), float(loads_as_csv(actual)) if load else None, accuracy


SCORES = ("format_validity", "schema_compliance", "loadability", "content_accuracy")


def scores(actual: Column, expected: Column, fmt: Column, required: Column | None = None, only: Sequence[str] = SCORES) -> Column:
    """struct of the four scores, or of those asked for (nothing is loaded unless loadability is); an unknown format fails the job."""
    places, load = [SCORES.index(c) for c in only], "loadability" in only

    @F.pandas_udf(", ".join(f"{c} double" for c in only))
    def scored(a: pd.Series, e: pd.Series, f: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = [score(x, y, z, None if w is None else list(w), load) for x, y, z, w in zip(a, e, f, r, strict=True)]
        return pd.DataFrame([[row[i] for i in places] for row in rows], columns=list(only))

    return scored(actual, expected, fmt, required if required is not None else F.lit(None).cast("array<string>"))


# ---- relational forms ----


class LeafWalk:
    """UDTF: the leaves of a JSON text as (path, kind, value), the last of equal paths."""

    def eval(self, text: str):
        value = parsed_json(text or "")
        if value is not MISSING:
            for path, leaf in dict(leaves(value)).items():
                kind = "null" if leaf is None else "bool" if isinstance(leaf, bool) else "num" if isinstance(leaf, (int, float)) else "str"
                yield path, kind, None if leaf is None else str(float(leaf)) if kind == "bool" else repr(leaf) if kind == "num" else leaf


class CsvCells:
    """UDTF: the cells of a CSV text as (r, c, value); a row without cells gives (r, -1, null)."""

    def eval(self, text: str):
        for r, row in enumerate(csv_rows(text or "") or []):
            if not row:
                yield r, -1, None
            for c, value in enumerate(row):
                yield r, c, value


def register(spark) -> None:
    """Make walk_json_leaves and csv_cells available in SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("walk_json_leaves", udtf(LeafWalk, returnType="path: string, kind: string, value: string"))
    spark.udtf.register("csv_cells", udtf(CsvCells, returnType="r: int, c: int, value: string"))


#: A text may name a key with a dot or bracket, or be no JSON that Spark reads (repeated keys, NaN, or none at all).
DOTTED_KEY = r'"(?=[^"]*"\s*:)[^"]*[.\[\]]'
STEP = """SELECT {keys}, CASE WHEN e.pos IS NULL THEN t.path WHEN e.key IS NULL THEN concat(t.path, '[', e.pos, ']') WHEN t.path = '' THEN e.key ELSE concat(t.path, '.', e.key) END AS path,
  CASE WHEN e.pos IS NULL THEN t.v ELSE e.value END AS v FROM {{t}} AS t, LATERAL variant_explode_outer(t.v) AS e"""


PEELED = 6


def json_depth(text: Column) -> Column:
    """How deep the brackets of a JSON text nest: how often its innermost pairs can be peeled off, for deep texts by a walk over them."""
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    left = F.translate(F.regexp_replace(plain, r'"[^"]*"|[^\[\]{}"]+', ""), "[]", "{}")
    depth = F.lit(0)
    for _ in range(PEELED):
        depth = depth + (left != "").cast("int")
        left = F.replace(left, F.lit("{}"), F.lit(""))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, mark: Column) -> Column:
        now = at["now"] + F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return depth + F.when(F.char_length(left) == 0, 0).otherwise(F.aggregate(F.split(left, ""), zero, step, lambda at: at["most"]))


def json_leaves(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, path, kind, value) of each leaf: a.b for keys, [i] for elements; the root scalar has an empty path.

    Texts are parsed once as variants and unfolded level by level, as many as the deepest text has; one pass finds that number.
    Only texts that Spark's parser doesn't take, or whose keys could be taken for paths, are walked by the table function, which is
    in the plan only if there are any.
    """
    return _leaves(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")


def _leaves(texts: DataFrame, *keys: str) -> DataFrame:
    spark = texts.sparkSession
    named = texts.select(*keys, "text", F.try_parse_json("text").alias("v"))
    odd = F.col("text").isNotNull() & (F.col("v").isNull() | F.col("text").rlike(DOTTED_KEY))
    # a product, not a case: what is worked out in any case is worked out once
    told = named.select(odd.alias("odd"), json_depth(F.col("text")).alias("depth"))
    depth, some_odd = told.agg(F.max(F.col("depth") * (~F.col("odd")).cast("int")), F.bool_or("odd")).first()
    now = named.filter(~odd if some_odd else F.col("text").isNotNull()).select(*keys, F.lit("").alias("path"), "v")
    for _ in range(depth or 0):
        now = spark.sql(STEP.format(keys=", ".join(f"t.{k}" for k in keys)), t=now)
    found = now.withColumn("type", F.schema_of_variant("v")).filter(~F.col("type").rlike("^(OBJECT|ARRAY)"))
    text, number = F.variant_get("v", "$", "string"), F.variant_get("v", "$", "double").cast("string")
    kind = F.when(F.col("type") == "VOID", "null").when(F.col("type") == "BOOLEAN", "bool").when(F.col("type") == "STRING", "str").otherwise("num")
    value = F.when(F.col("type") == "BOOLEAN", F.when(text == "true", "1.0").otherwise("0.0")).when(F.col("type").rlike(r"^DECIMAL\(\d+,[1-9]|^(DOUBLE|FLOAT)"), number).when(F.col("type") != "VOID", text)
    out = found.select(*keys, "path", kind.alias("kind"), value.alias("value"))
    if some_odd:
        register(spark)
        rest = named.filter(odd).select(*keys, "text")
        out = out.unionByName(spark.sql(f"SELECT {', '.join(f't.{k}' for k in keys)}, path, kind, value FROM {{t}} AS t, LATERAL walk_json_leaves(t.text)", t=rest))
    return out


def csv_cells(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, r, c, value)."""
    register(texts.sparkSession)
    return _lateral(texts, id_col, text_col, "csv_cells", "r, c, value")


def _lateral(texts: DataFrame, id_col: str, text_col: str, function: str, columns: str) -> DataFrame:
    named = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.sparkSession.sql(f"SELECT t.id, {columns} FROM {{t}} AS t, LATERAL {function}(t.text)", t=named)


def json_accuracy(pairs: DataFrame, id_col: str, actual: str, expected: str) -> DataFrame:
    """(id, content_accuracy): the share of expected leaves that the actual text has with an equal value. Ids tell pairs apart."""
    side = lambda name, wanted: F.struct(F.lit(wanted).alias("wanted"), F.col(name).alias("text"))
    both = pairs.select(F.col(id_col).alias("id"), F.inline(F.array(side(expected, True), side(actual, False))))
    leaf = F.struct("value").alias("leaf")  # a leaf that is null is there all the same
    met = _leaves(both, "id", "wanted").select("id", "path", "wanted", leaf).groupBy("id", "path").agg(F.max(F.when(F.col("wanted"), F.col("leaf"))).alias("want"), F.max(F.when(~F.col("wanted"), F.col("leaf"))).alias("have"))
    same = F.col("have").isNotNull() & G.values_equal(F.col("want.value"), F.col("have.value"))
    ratios = met.filter("want is not null").groupBy("id").agg(F.avg(F.when(same, 1.0).otherwise(0.0)).alias("ratio"))
    return pairs.select(F.col(id_col).alias("id")).join(ratios, "id", "left").select(F.col("id").alias(id_col), F.coalesce("ratio", F.lit(0.0)).alias("content_accuracy"))


#: Texts with these, or longer than the reader's longest cell, are left to Python's reader.
UNSPLIT, LONGEST = '["\r\0]', 131_072


def csv_accuracy(pairs: DataFrame, id_col: str, actual: str, expected: str) -> DataFrame:
    """(id, content_accuracy): the share of expected cells that the actual table has in the same place; 0 if headers differ.

    Pairs of texts without quotes, whose lines are rows and whose commas part cells, are compared where they lie. Only the others, if
    there are any, become a table of cells by the table function and meet by place.
    """
    named = pairs.select(F.col(id_col).alias("id"), F.coalesce(F.col(actual), F.lit("")).alias("a"), F.coalesce(F.col(expected), F.lit("")).alias("e"))
    odd = F.col("a").rlike(UNSPLIT) | F.col("e").rlike(UNSPLIT) | (F.char_length("a") > LONGEST) | (F.char_length("e") > LONGEST)
    out = named.filter(~odd).select("id", plain_csv_accuracy(F.col("a"), F.col("e")).alias("ratio"))
    if not named.filter(odd).isEmpty():
        out = out.unionByName(_cells_accuracy(named.filter(odd)))
    return out.select(F.col("id").alias(id_col), F.col("ratio").alias("content_accuracy"))


def plain_csv_accuracy(actual: Column, expected: Column) -> Column:
    """Content accuracy of two CSV texts without quotes."""
    cells = lambda line: F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, ",", -1))
    lines = lambda text: F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    keys = lambda line: F.transform(cells(line), G.header_key)
    want, have = lines(expected), lines(actual)

    def same(e: Column, a: Column) -> Column:
        """Equal cells of a row; a missing cell is empty, and cells beyond the expected ones don't count."""
        width = F.size(cells(e))
        met = F.zip_with(cells(e), F.slice(cells(F.coalesce(a, F.lit(""))), F.lit(1), width), lambda x, y: G.values_equal(x, F.coalesce(y, F.lit(""))))
        return F.size(F.filter(met, lambda hit: hit))

    rows = F.size(want) - 1
    hits = F.aggregate(F.zip_with(F.slice(want, F.lit(2), rows), F.slice(have, F.lit(2), rows), same), F.lit(0).cast("long"), lambda n, x: n + x)
    alike = (want[0] != "") & (rows > 0) & (keys(want[0]) == keys(have[0]))
    return F.when(alike, F.least(F.lit(1.0), hits / (rows * F.size(cells(want[0]))))).otherwise(F.lit(0.0))


def _cells_accuracy(pairs: DataFrame) -> DataFrame:
    """(id, ratio) of (id, a, e) by tables of cells."""
    want, have = csv_cells(pairs, "id", "e"), csv_cells(pairs, "id", "a")
    keys = lambda cells, name: cells.filter("r = 0 and c >= 0").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", G.header_key(F.col("value")).alias("k")))), lambda s: s["k"]).alias(name))
    alike = keys(want, "w").join(keys(have, "h"), "id").filter("w = h").select("id", F.size("w").alias("width"))
    rows = want.groupBy("id").agg((F.max("r")).alias("rows"))
    h = have.select(F.col("id").alias("h_id"), F.col("r").alias("h_r"), F.col("c").alias("h_c"), F.col("value").alias("h_value"))
    body = want.filter("r > 0 and c >= 0").join(alike, "id")
    joined = body.join(h, (body["id"] == h["h_id"]) & (body["r"] == h["h_r"]) & (body["c"] == h["h_c"]), "left")
    same = joined.groupBy("id", "width").agg(F.sum(F.when(G.values_equal(F.col("value"), F.coalesce("h_value", F.lit(""))), 1).otherwise(0)).alias("same"))
    ratios = same.join(rows.filter("rows > 0"), "id").select("id", F.least(F.lit(1.0), F.col("same") / (F.col("rows") * F.col("width"))).alias("ratio"))
    return pairs.select("id").join(ratios, "id", "left").select("id", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def substring_accuracy(text: Column, required: Column) -> Column:
    """The share of required substrings that a text contains in any case; 0 without any."""
    hits = F.size(F.filter(required, lambda s: F.contains(F.lower(text), F.lower(s))))
    return F.when(F.size(required) > 0, hits / F.size(required)).otherwise(F.lit(0.0))
