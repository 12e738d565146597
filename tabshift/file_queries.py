"""Queries of the operators that work on files: tables are written to the shared folder and read back by the operator."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.functions import grammar as G
from tabshift.operators import profile as P
from tabshift.operators import states as St
from tabshift.operators import transforms as T
from tabshift.plans import formats
from tabshift.plans import runner as R
from tabshift.plans.convert import Spec, convert, typed, write_csv_document
from tabshift.plans.envelope import envelopes
from tabshift.plans.many import envelopes_of
from tabshift.queries import LINES, query, table
from tabshift.sources import chunks
from tabshift.sources import files as S
from tabshift.streaming import logs


def _one_file(df: DataFrame, order: str, name: str, **options) -> str:
    """Rows in order as one CSV file in a folder of its own; for tables that are small beside a task."""
    path = S.scratch(df.sparkSession, name)
    df.orderBy(order).coalesce(1).write.options(**{**S.CSV_RULES, **options}).csv(path)
    return path


def _text_file(spark: SparkSession, name: str, text: str) -> str:
    root = S.scratch(spark, "texts")
    S.write_named_files(spark.createDataFrame([(name, text)], "name string, text string"), root).count()
    return f"{root}/{name}"


# ---- sources ----


@query("q_encoding", r"SELECT coalesce(lang, 'none') AS lang, CASE WHEN bool_or(regexp_matches(coalesce(text, ''), '[\x80-\xFF]')) THEN 'latin-1' ELSE 'utf-8-sig' END AS encoding FROM documents GROUP BY coalesce(lang, 'none')")
def encoding(spark, sf_dir):
    """One Latin-1 document a language, in as many parts as there are tasks: valid UTF-8 only if all of it is ASCII."""
    path = S.scratch(spark, "latin")
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.concat(F.lit("text "), F.coalesce("text", F.lit(""))).alias("text"))
    docs.write.partitionBy("lang").option("encoding", "ISO-8859-1").csv(path)
    return S.encodings(spark, path, folders=True).select(F.regexp_extract("path", r"lang=([^/]*)$", 1).alias("lang"), "encoding")


@query("q_sniff", """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE chr(9) END AS delimiter, n_nationkey % 3 <> 0 AS has_header,
  n_nationkey % 3 <> 0 AND n_nationkey % 2 = 0 AS inconsistent_quoting FROM nation""")
def sniffed(spark, sf_dir):
    key = F.col("n_nationkey")
    mark = F.when(key % 4 == 0, ",").when(key % 4 == 1, ";").when(key % 4 == 2, "|").otherwise("\t")
    number = lambda i: (key + i).cast("string")
    row = lambda i, name: F.call_function("concat_ws", mark, number(i), name, number(10 + i))
    quoted = F.when((key % 3 != 0) & (key % 2 == 0), F.concat(F.lit('"'), F.col("n_name"), F.lit('"'))).otherwise(F.col("n_name"))
    body = F.concat_ws("\n", row(1, F.col("n_name")), row(2, quoted), row(3, F.col("n_name")), row(4, F.col("n_name")))
    text = F.when(key % 3 != 0, F.concat(F.call_function("concat_ws", mark, F.lit("id"), F.lit("name"), F.lit("qty")), F.lit("\n"), body)).otherwise(body)
    return table(spark, sf_dir, "nation").select("n_nationkey", S.dialects(text, check_quoting=True).alias("d")).select("n_nationkey", "d.delimiter", "d.has_header", "d.inconsistent_quoting")


@query("q_supported", "SELECT c_custkey, c_custkey % 4 < 2 AS supported FROM customer")
def supported(spark, sf_dir):
    ends = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".CSV", ".csv.txt", "csv")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.supported(F.concat(F.lit("in.v1/"), F.col("c_name"), ends)).alias("supported"))


@query("q_capped_read", """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, CAST(c_custkey AS VARCHAR) AS name, c_name AS "name.1", c_mktsegment AS segment FROM customer ORDER BY c_custkey LIMIT 200""")
def capped_read(spark, sf_dir):
    """A raw read of the first rows; the second of two equal header names is numbered."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").withColumn("at", F.col("c_custkey"))
    lines = rows.select("at", F.concat_ws(";", "c_custkey", F.concat(F.lit("'"), F.col("c_name"), F.lit("'")), "c_mktsegment").alias("line"))
    head = spark.createDataFrame([(-1, "name;name;segment")], "at long, line string")
    path = S.scratch(spark, "capped")
    head.unionByName(lines).orderBy("at").coalesce(1).select("line").write.text(path)
    return S.read_raw(spark, path, S.Dialect(";", "'", True), multi_line=False, max_rows=200)


@query("q_csv_roundtrip", "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, nullif(lang, '') AS lang, nullif(source, '') AS source FROM documents")
def csv_roundtrip(spark, sf_dir):
    path = S.scratch(spark, "csv")
    S.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    rows = spark.read.options(header=True, quote='"', escape='"', multiLine=True).schema("doc_id long, text string, lang string, source string").csv(path)
    return rows.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "lang", "source")


@query("q_json_roundtrip", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def json_roundtrip(spark, sf_dir):
    path = S.scratch(spark, "json")
    S.write_json(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    rows = spark.read.schema("conv_id long, turn long, role string, text string").json(path)
    return rows.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _quoted_csv(spark: SparkSession, sf_dir: str) -> str:
    """Documents as CSV files without a header; texts with line breaks are quoted cells of several lines."""
    path = S.scratch(spark, "quoted")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").write.options(**S.CSV_RULES | {"header": False}).csv(path)
    return path


@query("q_csv_split", "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, nullif(lang, '') AS lang, nullif(source, '') AS source FROM documents")
def csv_split(spark, sf_dir):
    """Cells with line breaks, cut into records by their chunks' states and parsed in as many tasks."""
    records = chunks.csv_records(spark, _quoted_csv(spark, sf_dir))
    rows = records.select(F.from_csv("text", F.lit("doc_id long, text string, lang string, source string"), {"escape": '"'}).alias("r")).select("r.*")
    return rows.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "lang", "source")


@query("q_logical_rows", "SELECT count(*) AS row_count FROM documents")
def logical_rows(spark, sf_dir):
    """Records, not lines, counted without cutting them."""
    return S.count_records(spark, _quoted_csv(spark, sf_dir), S.Dialect())


@query("q_json_split", "SELECT conv_id, turn, role, md5(coalesce(text, '')) AS text_md5 FROM conversations")
def json_split(spark, sf_dir):
    """Arrays of nested records, cut at their commas of depth 1 by their chunks' states."""
    path = S.scratch(spark, "arrays")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.struct("role", "text").alias("said")).alias("at"))
    S.write_json_arrays(rows, path)
    back = chunks.read_json_array(spark, path, "conv_id long, at struct<turn:long,said:struct<role:string,text:string>>")
    return back.select("conv_id", "at.turn", "at.said.role", F.md5(F.coalesce("at.said.text", F.lit("")).cast("binary")).alias("text_md5"))


@query("q_csv_document", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_document(spark, sf_dir):
    """One document in order of its rows, written by many tasks; its parts are read back side by side."""
    path = S.scratch(spark, "document")
    write_csv_document(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_custkey").alias("at")), path, "at")
    rows = spark.read.option("escape", '"').schema("c_custkey string, c_name string, c_mktsegment string").csv(path)
    return rows.filter("c_custkey <> 'c_custkey'").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


_ITEM = "CASE WHEN event_id % 4 > {0} THEN user_id + {0} END AS items_{0}_who, CASE WHEN event_id % 4 > {0} AND event_id % 2 = 1 THEN event_type END AS items_{0}_tags_0_k"


@query("q_flatten_indexed", f"SELECT event_id, {', '.join(_ITEM.format(i) for i in range(3))} FROM events")
def flatten_indexed(spark, sf_dir):
    """Arrays of structs that hold arrays, as columns of the widest array's size."""
    item = lambda i: F.struct((F.col("user_id") + i).alias("who"), F.when(F.col("event_id") % 2 == 1, F.array(F.struct(F.col("event_type").alias("k")))).alias("tags"))
    flat = T.flatten_indexed(table(spark, sf_dir, "events").select("event_id", F.slice(F.array(*[item(i) for i in range(3)]), F.lit(1), (F.col("event_id") % 4).cast("int")).alias("items")))
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


@query("q_approx_distinct", " UNION ALL ".join(f"SELECT '{c}' AS col_name, count(DISTINCT {c}) AS unique_count, true AS within FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag")))
def approx_distinct(spark, sf_dir):
    """Estimated distinct counts lie within 8 % of the exact ones: four standard deviations of the estimate."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag")
    near = P.profile(rows, approximate=True).select("col_name", F.col("unique_count").alias("near"))
    return P.profile(rows).join(near, "col_name").select("col_name", "unique_count", (F.abs(F.col("near") - F.col("unique_count")) <= 0.08 * F.col("unique_count")).alias("within"))


_STATES = {"c_custkey": "integer", "c_nationkey": "integer", "c_acctbal": "float", "c_name": "string", "c_mktsegment": "string"}


@query("q_profile_states", " UNION ALL ".join(f"SELECT '{c}' AS col_name, '{k}' AS dtype, count(*) AS row_count, count(*) FILTER (WHERE {c} IS NULL) AS null_count, {f'CAST(min({c}) AS DOUBLE)' if k != 'string' else 'CAST(NULL AS DOUBLE)'} AS min_value, {f'CAST(max({c}) AS DOUBLE)' if k != 'string' else 'CAST(NULL AS DOUBLE)'} AS max_value, true AS within FROM customer" for c, k in _STATES.items()))
def profile_states(spark, sf_dir):
    """The profile of two stored states, merged; its distinct counts lie within 8 % of the exact ones."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", *list(_STATES)[1:], F.col("c_custkey").alias("at"))
    path, early = S.scratch(spark, "states"), F.col("c_nationkey") < 12
    for part, some in enumerate((early, F.coalesce(~early, F.lit(True)))):
        St.column_states(rows.filter(some), "at", part=part).write.mode("append").parquet(path)
    exact = P.profile(rows.drop("at")).select("col_name", F.col("unique_count").alias("n"))
    found = St.profile_of(St.merged(spark.read.parquet(path))).join(exact, "col_name")
    return found.select("col_name", "dtype", "row_count", "null_count", "min_value", "max_value", (F.abs(F.col("unique_count") - F.col("n")) <= 0.08 * F.col("n")).alias("within"))


# ---- envelope ----

_BLOCKS = {"c_custkey": "integer", "c_name": "string", "c_acctbal": "float", "c_mktsegment": "string"}


def _block_sql(name: str, kind: str) -> str:
    number = kind != "string"
    low, high = (f"CAST(min({name}) AS DOUBLE)", f"CAST(max({name}) AS DOUBLE)") if number else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    length = "CAST(NULL AS BIGINT)" if number else f"CAST(max(length({name})) AS BIGINT)"
    firsts = f"SELECT string_agg(v, '|' ORDER BY f) FROM (SELECT CAST({name} AS VARCHAR) AS v, min(c_custkey) AS f FROM customer GROUP BY 1 ORDER BY 2 LIMIT 3) x" if kind != "float" else "SELECT ''"
    return f"SELECT '{name}' AS name, '{kind}' AS dtype, count(*) FILTER (WHERE {name} IS NULL) AS null_count, count(DISTINCT {name}) AS unique_count, {low} AS min, {high} AS max, {length} AS max_length, ({firsts}) AS firsts FROM customer"


@query("q_envelope_columns", " UNION ALL ".join(_block_sql(*x) for x in _BLOCKS.items()))
def envelope_columns(spark, sf_dir):
    """The column blocks of a written table's envelope; firsts are the typed sample values of all but floats."""
    path = _one_file(table(spark, sf_dir, "customer").select(*_BLOCKS), "c_custkey", "envelope")
    record = json.loads(envelopes(spark, [path]).first().envelope)
    rows = [(c["name"], c["dtype"], c["null_count"], c["unique_count"], *(float(c[k]) if k in c else None for k in ("min", "max")), c.get("max_length"), "" if c["dtype"] == "float" else "|".join(map(str, c["sample_values"]))) for c in record["schema"]["columns"]]
    return spark.createDataFrame(rows, "name string, dtype string, null_count long, unique_count long, min double, max double, max_length long, firsts string")


@query("q_envelopes_many", "SELECT c_nationkey AS nation, count(*) AS row_count, min(c_custkey) AS low, max(c_custkey) AS high, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def envelopes_many(spark, sf_dir):
    """A file for each nation's customers; all envelopes come from one plan."""
    path = S.scratch(spark, "nations")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_name", "c_mktsegment")
    rows.repartition("nation").write.options(**S.CSV_RULES).partitionBy("nation").csv(path)
    columns = "struct<schema:struct<row_count:bigint,columns:array<struct<min:bigint,max:bigint,unique_count:bigint>>>>"
    found = envelopes_of(spark, path).select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("long").alias("nation"), F.from_json("envelope", columns)["schema"].alias("s"))
    return found.select("nation", "s.row_count", F.col("s.columns")[0]["min"].alias("low"), F.col("s.columns")[0]["max"].alias("high"), F.col("s.columns")[2]["unique_count"].alias("segments"))


_CODES = "CASE WHEN bool_or(strlen({n} || 'é') > length({n} || 'é')) THEN 'LATIN1_FALLBACK ' ELSE '' END || 'MISSING_HEADER NUMERIC_COLUMN_QUOTE_RISK'"


@query("q_envelope_warnings", f"""SELECT 'latin' AS file, count(*) AS row_count, {_CODES.format(n='r_name')} AS codes FROM region
  UNION ALL SELECT 'empty', count(*), CASE WHEN count(*) = 0 THEN 'EMPTY_FILE' ELSE '' END FROM region WHERE r_regionkey < 0
  UNION ALL SELECT 'twice', count(*), 'DUPLICATE_COLUMN_NAME INCONSISTENT_QUOTING' || CASE WHEN count(DISTINCT n_regionkey) * 2 < count(*) THEN ' NUMERIC_COLUMN_QUOTE_RISK' ELSE '' END FROM nation""")
def envelope_warnings(spark, sf_dir):
    """Latin-1 without a header, a header alone, and a file with a repeated name and quotes in some rows only."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    latin = _one_file(region.select("r_regionkey", F.concat("r_name", F.lit("é")).alias("r_name")), "r_regionkey", "latin", header=False, encoding="ISO-8859-1")
    empty = _one_file(region.filter("r_regionkey < 0").select("r_regionkey", "r_name"), "r_regionkey", "empty")
    quoted = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('"'), F.col("n_name"), F.lit('"'))).otherwise(F.col("n_name"))
    lines = nation.select("n_nationkey", F.concat_ws(",", "n_nationkey", quoted, F.concat("n_name", F.lit("x"))).alias("line")).orderBy("n_nationkey").collect()  # 25 rows
    twice = _text_file(spark, "twice.csv", "\n".join(["key,name,name", *[r.line for r in lines]]) + "\n")
    rows = []
    for name, path, options in (("latin", latin, {}), ("empty", empty, {}), ("twice", twice, {"check_quoting": True})):
        record = formats.FORMATS["csv"].extract(spark, path, **options)
        rows.append((name, record["schema"]["row_count"], " ".join(dict.fromkeys(w["code"] for w in record["warnings"]))))
    return spark.createDataFrame(rows, "file string, row_count long, codes string")


@query("q_null_percent", """SELECT k || ' is null in ' || printf('%.1f', 100.0 * n_null / n) || '% of rows' AS message, n_null AS null_count, n AS row_count FROM (
  SELECT 'third' AS k, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_null, count(*) AS n FROM orders UNION ALL SELECT 'seventh', count(*) FILTER (WHERE o_orderkey % 7 = 0), count(*) FROM orders) x WHERE n_null > 0.1 * n""")
def null_percent(spark, sf_dir):
    cell = lambda k: F.when(F.col("o_orderkey") % k != 0, F.concat(F.lit("v"), F.col("o_orderkey").cast("string")))
    found = P.warnings_of(P.profile(table(spark, sf_dir, "orders").select(cell(3).alias("third"), cell(7).alias("seventh"), cell(11).alias("eleventh")))).filter("code = 'HIGH_NULL_RATE'")
    return found.select("message", F.col("context")["null_count"].cast("long").alias("null_count"), F.col("context")["row_count"].cast("long").alias("row_count"))


@query("q_nat_rate", """SELECT k AS col_name, CASE WHEN bad < 0.05 * n THEN 'date' ELSE 'string' END AS dtype FROM (
  SELECT 'few' AS k, count(*) FILTER (WHERE o_orderkey % 25 = 0) AS bad, count(*) AS n FROM orders UNION ALL SELECT 'many', count(*) FILTER (WHERE o_orderkey % 16 = 0), count(*) FROM orders) x""")
def nat_rate(spark, sf_dir):
    cell = lambda k: F.when(F.col("o_orderkey") % k == 0, "no day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return P.profile(table(spark, sf_dir, "orders").select(cell(25).alias("few"), cell(16).alias("many"))).select("col_name", "dtype")


DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "dd-MMM-yyyy", "yyyy-MM-dd'T'00:00:00'Z'", "yyyy-MM-dd 00:00:00+00:00")


@query("q_date_forms", "SELECT o_orderkey, CAST(i AS INTEGER) AS form, CAST(o_orderdate AS DATE) AS day FROM orders, range(" + str(len(DATES)) + ") r(i)")
def date_forms(spark, sf_dir):
    said = F.explode(F.array(*[F.struct(F.lit(i).alias("form"), F.date_format("o_orderdate", f).alias("said")) for i, f in enumerate(DATES)]))
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("x")).select("o_orderkey", "x.form", G.to_timestamp(F.col("x.said")).cast("date").alias("day"))


# ---- exact numbers ----


def big_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer texts beyond the 53 bits of a double (large) and beyond a long (huge)."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.cast("long").alias("row_idx"), (F.lit(9007199254740993) + key).cast("string").alias("large"), F.concat(F.lit("-1234567890123456789"), F.lpad(key.cast("string"), 9, "0")).alias("huge"),
        F.concat(key.cast("string"), F.lit(".50")).alias("price"), F.when(key % 2 == 0, "yes").otherwise("no").alias("flag"))


@query("q_typed_convert", """SELECT o_orderkey AS row_idx, 9007199254740993 + o_orderkey AS large, '-1234567890123456789' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS huge, o_orderkey + 0.5::DOUBLE AS price, o_orderkey % 2 = 0 AS flag FROM orders""")
def typed_convert(spark, sf_dir):
    return typed(big_orders(spark, sf_dir)).withColumn("huge", F.col("huge").cast("string"))


@query("q_min_max_long", """SELECT 'large' AS col_name, CAST(min(9007199254740993 + o_orderkey) AS VARCHAR) AS low, CAST(max(9007199254740993 + o_orderkey) AS VARCHAR) AS high, 16 AS digits FROM orders
  UNION ALL SELECT 'huge', '-1234567890123456789' || lpad(CAST(max(o_orderkey) AS VARCHAR), 9, '0'), '-1234567890123456789' || lpad(CAST(min(o_orderkey) AS VARCHAR), 9, '0'), 28 FROM orders""")
def min_max_long(spark, sf_dir):
    found = P.profile(big_orders(spark, sf_dir).select("large", "huge"))
    return found.select("col_name", F.col("min_integer").cast("string").alias("low"), F.col("max_integer").cast("string").alias("high"), F.col("max_digits").cast("int").alias("digits"))


# ---- conversions ----


@query("q_nest_rows", "SELECT c_custkey AS user_id, c_name AS user_name, n_name AS place_name, 0::BIGINT AS pos FROM customer JOIN nation ON c_nationkey = n_nationkey")
def nest_rows(spark, sf_dir):
    """One object and one array of one element for each row."""
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.col("n_name").alias("place_name"))
    nested = T.nest(both, (T.Entity("user", "user_"), T.Entity("places", "place_", "array")))
    return nested.select(F.col("user.id").alias("user_id"), F.col("user.name").alias("user_name"), F.posexplode("places").alias("pos", "p")).select("user_id", "user_name", F.col("p.name").alias("place_name"), F.col("pos").cast("long").alias("pos"))


@query("q_json_rename", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def json_rename(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_nationkey").alias("at"))
    text = S.as_json_text(rows, order="at").first().json  # 25 rows
    out = convert(spark, _text_file(spark, "nations.json", text), Spec("rename_json", names={"n_nationkey": "id", "n_name": "name"}, order=("id", "name")))
    rows = spark.createDataFrame([(out,)], "t string").select(F.explode(F.from_json("t", "array<struct<id:bigint,name:string>>")).alias("r"))
    return rows.select("r.id", "r.name")


@query("q_json_restructure", "SELECT n_nationkey AS id, n_name AS label, n_regionkey AS region FROM nation")
def json_restructure(spark, sf_dir):
    """{results: [...]} to {users: [...]} through a file."""
    whole = table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("results"))).alias("t")).first().t  # 25 rows
    spec = Spec("restructure", root="results", new_root="users", target={"id": "n_nationkey", "about": {"label": "n_name", "home": {"region": "n_regionkey"}}})
    out = convert(spark, _text_file(spark, "results.json", whole), spec)
    rows = spark.createDataFrame([(out,)], "t string").select(F.explode(F.from_json("t", "users array<struct<id:bigint,about:struct<label:string,home:struct<region:int>>>>")["users"]).alias("r"))
    return rows.select("r.id", "r.about.label", "r.about.home.region")


@query("q_report_facts", """SELECT 'Total keys' AS label, CAST(sum(s_suppkey) AS VARCHAR) AS value FROM supplier UNION ALL SELECT 'Mean key', printf('%.2f', avg(s_suppkey)) FROM supplier
  UNION ALL SELECT 'Lines', CAST(count(*) AS VARCHAR) FROM supplier""")
def report_facts(spark, sf_dir):
    """A report written from a CSV file: the sum, the mean and the number of table lines that it shows."""
    path = _one_file(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "report")
    text = convert(spark, path, Spec("report", title="Suppliers", sums={"Total keys": "s_suppkey"}, means={"Mean key": "s_suppkey"}))
    blocks = text.rstrip("\n").split("\n\n")
    facts = [tuple(x.split(": ")) for x in blocks[2].split("\n")]
    return spark.createDataFrame([*facts, ("Lines", str(len(blocks[1].split("\n")) - 1))], "label string, value string")


# ---- runs ----


def _cases(spark: SparkSession, sf_dir: str) -> str:
    """A folder of cases, one a nation; a fifth of them lack the expected text."""
    nation = table(spark, sf_dir, "nation")
    folder = F.concat(F.lit("use_"), F.col("n_regionkey").cast("string"), F.lit("/"), F.when(F.col("n_nationkey") % 2 == 0, "simple_").otherwise("medium_"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    meta = F.to_json(F.struct(F.concat(F.lit("use_"), F.col("n_regionkey").cast("string")).alias("use_case"), F.when(F.col("n_nationkey") % 2 == 0, "simple").otherwise("medium").alias("complexity"), F.lit("csv").alias("input_format"), F.lit("txt").alias("output_format"), F.array("n_name").alias("required_substrings")))
    file = lambda name, text: F.struct(F.concat(folder, F.lit(f"/{name}")).alias("name"), text.alias("text"))
    expected = F.when(F.col("n_nationkey") % 5 != 0, file("expected.txt", F.col("n_name")))
    root = S.scratch(spark, "cases")
    S.write_named_files(nation.select(F.inline(F.array_compact(F.array(file("meta.json", meta), file("input.csv", F.concat(F.lit("name\n"), F.col("n_name"))), expected)))), root).count()
    return root


@query("q_discover", """SELECT 'use_' || n_regionkey || '/' || CASE n_nationkey % 2 WHEN 0 THEN 'simple_' ELSE 'medium_' END || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS case_id, CASE n_nationkey % 2 WHEN 0 THEN 'simple' ELSE 'medium' END AS complexity,
  'name' || chr(10) || n_name AS input_text, n_name AS expected_text FROM nation WHERE n_nationkey % 5 <> 0""")
def discover(spark, sf_dir):
    return R.discover(spark, _cases(spark, sf_dir)).select("case_id", "complexity", "input_text", "expected_text")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded outputs: each third failed with a return code, each fourth gave nothing, the others say the name in a fence."""
    cases = R.discover(spark, _cases(spark, sf_dir))
    key = F.element_at(F.split("case", "_"), 2).cast("int")
    output = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("```\n"), F.col("expected_text"), F.lit("\n```")))
    outputs = cases.select("case_id", output.alias("raw_output"), F.when(key % 3 == 0, 1).otherwise(0).alias("return_code"))
    return R.evaluate(cases, R.converter("replay", outputs))


_OK = "n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 0"


@query("q_artefacts", f"""SELECT 'use_' || n_regionkey AS use_case_dir, n_nationkey, {_OK} AS ok, strlen(n_name) + 5 AS input_bytes, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE strlen(n_name) + 8 END AS raw_size_bytes,
  CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE strlen(n_name) END AS cleaned_size_bytes FROM nation WHERE n_nationkey % 5 <> 0""")
def artefact_files(spark, sf_dir):
    """The record that is written beside each case's output, read back."""
    root = S.scratch(spark, "artefacts")
    R.write_artefacts(_results(spark, sf_dir), root)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "teacher_meta.json").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    facts = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("use_case_dir"), F.regexp_extract("path", r"_(\d+)/[^/]+$", 1).cast("int").alias("n_nationkey"), F.from_json("value", "ok boolean, input_bytes long, raw_size_bytes long, cleaned_size_bytes long").alias("j"))
    return facts.select("use_case_dir", "n_nationkey", "j.*")


@query("q_summary_record", f"""SELECT CASE WHEN grouping(n_regionkey) = 0 THEN 'by_use_case' ELSE 'overall' END AS level, coalesce('use_' || n_regionkey, '') AS name, count(*) AS n,
  round_even(avg(CASE WHEN {_OK} THEN 1.0::DOUBLE ELSE 0 END), 3) AS content_accuracy FROM nation WHERE n_nationkey % 5 <> 0 GROUP BY GROUPING SETS ((n_regionkey), ())""")
def summary_record(spark, sf_dir):
    """summary.json of a run, read back."""
    root = S.scratch(spark, "summary")
    R.write_summary(_results(spark, sf_dir), root, run_id="replayed", model="none")
    record = json.loads(spark.read.text(f"{root}/summary.json", wholetext=True).first().value)
    whole = record["aggregate"]
    rows = [("overall", "", whole["n_cases"], whole["overall"]["content_accuracy"])]
    rows += [("by_use_case", k, v["n"], v["content_accuracy"]) for k, v in whole["by_use_case"].items()]
    return spark.createDataFrame(rows, "level string, name string, n long, content_accuracy double")


# ---- streams ----


@query("q_stream_levels", """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'INFO' ELSE 'WARN' END AS level, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_levels(spark, sf_dir):
    """Log files as a stream that ends: parsed, counted by level and day, written, and read again."""
    source, out, marks = (S.scratch(spark, name) for name in ("log", "levels", "marks"))
    table(spark, sf_dir, "events").select(LINES["bracket"]().alias("value")).write.text(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    counted = logs.level_counts(logs.log_stream(spark, source), window="1 day")
    stream = counted.writeStream.outputMode("complete").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(put).start()
    stream.awaitTermination()
    return spark.read.schema("window_start timestamp, level string, n long").parquet(out)
