"""Registry of the engine's own queries and their DuckDB SQL, over the whole of the tables they read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.functions import grammar as G
from tabshift.operators import profile as P
from tabshift.operators import scoring as V
from tabshift.operators import transforms as T
from tabshift.operators.cleanup import cleaned
from tabshift.plans import runner as R
from tabshift.sources import files as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- profiles ----

COLUMNS = {
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "float", "c_mktsegment": "string"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "float"},
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "float"},
    "lineitem": {
        "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "date",
    },
}


def _profile_sql(name: str) -> str:
    parts = []
    for i, (c, kind) in enumerate(COLUMNS[name].items()):
        numeric = kind in ("integer", "float")
        low, high = (f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") if numeric else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
        length = f"CAST(max(length({c})) AS BIGINT)" if kind == "string" else "CAST(0 AS BIGINT)"
        parts.append(f"SELECT CAST({i} AS INTEGER) AS col_pos, '{c}' AS col_name, '{kind}' AS dtype, count(*) AS row_count, CAST(0 AS BIGINT) AS null_count, count(DISTINCT {c}) AS unique_count, {low} AS min_value, {high} AS max_value, {length} AS max_length FROM {name}")
    return " UNION ALL ".join(parts)


def _profile_query(name: str) -> Query:
    return lambda spark, sf_dir: P.profile(table(spark, sf_dir, name)).fillna(0, ["max_length"]).drop("min_integer", "max_integer", "max_digits")


for _name in COLUMNS:
    query(f"q_profile_{_name}", _profile_sql(_name))(_profile_query(_name))


# text columns of every logical type, from orders: ints, padded, floats, flags, dates, times, mixed, words, blanks
TYPED = {
    "ints": ("cast(o_orderkey as string)", "cast(o_orderkey as varchar)"),
    "signed": ("concat('-', cast(o_orderkey as string))", "'-' || cast(o_orderkey as varchar)"),
    "padded": ("lpad(cast(o_custkey as string), 9, '0')", "lpad(cast(o_custkey as varchar), 9, '0')"),
    "floats": ("concat(cast(o_orderkey as string), '.50')", "cast(o_orderkey as varchar) || '.50'"),
    "ints_and_floats": ("if(o_orderkey % 2 = 0, cast(o_orderkey as string), '2.5')", "case when o_orderkey % 2 = 0 then cast(o_orderkey as varchar) else '2.5' end"),
    "flags": ("if(o_orderkey % 2 = 0, 'yes', 'no')", "case when o_orderkey % 2 = 0 then 'yes' else 'no' end"),
    "shouted": ("if(o_orderkey % 2 = 0, 'TRUE', 'FALSE')", "case when o_orderkey % 2 = 0 then 'TRUE' else 'FALSE' end"),
    "dates": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "us_dates": ("date_format(o_orderdate, 'MM/dd/yyyy')", "strftime(o_orderdate, '%m/%d/%Y')"),
    "times": ("concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 10:30:00')", "strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:00'"),
    "mixed": ("if(o_orderkey % 3 = 0, 'abc', cast(o_orderkey as string))", "case when o_orderkey % 3 = 0 then 'abc' else cast(o_orderkey as varchar) end"),
    "words": ("o_orderpriority", "o_orderpriority"),
    "some_null": ("if(o_orderkey % 7 = 0, '', cast(o_orderkey as string))", "case when o_orderkey % 7 = 0 then '' else cast(o_orderkey as varchar) end"),
    "blanks": ("''", "''"),
}
_INT = r"regexp_matches(v, '^\s*[+-]?\d+(_\d+)*\s*$') AND NOT regexp_matches(v, '^\s*-*0.+')"
_FLOAT = r"regexp_matches(v, '^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*$') AND NOT regexp_matches(v, '^\s*-*0[^.\s]')"
_BOOL = "v IN ('true','false','True','False','0','1','yes','no')"
_TS = r"CASE WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') THEN 1 WHEN regexp_matches(v, '^\d{2}/\d{2}/\d{4}$') THEN 1 WHEN regexp_matches(v, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$') THEN 2 ELSE 0 END"
_LADDER = f"""SELECT c AS col_name, CASE WHEN count(v) FILTER (WHERE v <> '') = 0 THEN 'string' WHEN bool_and({_INT}) FILTER (WHERE v <> '') THEN 'integer'
  WHEN bool_and({_FLOAT}) FILTER (WHERE v <> '') THEN 'float' WHEN bool_and({_BOOL}) FILTER (WHERE v <> '') THEN 'boolean'
  WHEN min({_TS}) FILTER (WHERE v <> '') = 1 THEN 'date' WHEN min({_TS}) FILTER (WHERE v <> '') = 2 THEN 'datetime'
  WHEN bool_or({_INT} OR {_FLOAT} OR {_BOOL}) FILTER (WHERE v <> '') THEN 'mixed' ELSE 'string' END AS dtype,
  count(*) AS row_count, count(*) FILTER (WHERE v = '') AS null_count, count(DISTINCT v) FILTER (WHERE v <> '') AS unique_count"""
_CELLS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS c, {sql} AS v FROM orders" for k, (_, sql) in TYPED.items())


def typed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*[F.expr(e).alias(k) for k, (e, _) in TYPED.items()])


@query("q_dtype_infer", f"{_LADDER} FROM ({_CELLS_SQL}) x GROUP BY c")
def dtype_infer(spark, sf_dir):
    return P.profile(typed_orders(spark, sf_dir)).select("col_name", "dtype", "row_count", "null_count", "unique_count")


def _warned(code: str) -> Query:
    return lambda spark, sf_dir: P.warnings_of(P.profile(typed_orders(spark, sf_dir))).filter(F.col("code") == code).select("col_name", "code", "severity")


_PROFILED = f"WITH p AS ({_LADDER} FROM ({_CELLS_SQL}) x GROUP BY c)"
for _query, _code, _severity, _where in (
    ("q_repeating_entity", "REPEATING_ENTITY", "warn", "dtype = 'string' AND unique_count > 0 AND unique_count / row_count < 0.5"),
    ("q_numeric_risk", "NUMERIC_COLUMN_QUOTE_RISK", "warn", "dtype IN ('integer', 'float')"),
    ("q_mixed", "MIXED_DTYPE_COLUMN", "error", "dtype = 'mixed'"),
    ("q_null_rate", "HIGH_NULL_RATE", "warn", "null_count / row_count > 0.1"),
    ("q_date_col", "LIKELY_DATE_COLUMN", "info", "dtype IN ('date', 'datetime')"),
):
    query(_query, f"{_PROFILED} SELECT col_name, '{_code}' AS code, '{_severity}' AS severity FROM p WHERE {_where}")(_warned(_code))


@query("q_dup_header", """WITH h AS (SELECT c_custkey AS id, unnest([c_mktsegment, c_name, 'x', lower(c_mktsegment), 'x']) AS name, generate_subscripts([1,2,3,4,5], 1) - 1 AS pos FROM customer),
  s AS (SELECT id, name, pos, row_number() OVER (PARTITION BY id, name ORDER BY pos) AS k FROM h) SELECT id, name, CAST(pos AS BIGINT) AS second_at FROM s WHERE k = 2""")
def dup_header(spark, sf_dir):
    names = F.array("c_mktsegment", "c_name", F.lit("x"), F.lower("c_mktsegment"), F.lit("x"))
    return P.duplicate_names(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), names.alias("names")), "id", "names")


@query("q_count_rows", r"SELECT count(*) FILTER (WHERE regexp_matches(line, '\S')) - 1 AS row_count FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) x")
def count_rows(spark, sf_dir):
    return S.count_data_rows(table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("value")), True)


@query("q_sample_head_mid_tail", """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, o_orderstatus, CASE WHEN i < 3 THEN 'head' WHEN i >= n - 1 THEN 'tail' ELSE 'middle' END AS bucket FROM r WHERE i < 3 OR i = n // 2 OR i >= n - 1""")
def sample_head_mid_tail(spark, sf_dir):
    """Positions by key are counts of smaller keys: range partitions are sorted and offset, no window over all rows."""
    placed = S.in_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return P.sample_rows(placed, F.col("row_idx"), F.lit(table(spark, sf_dir, "orders").count())).select("o_orderkey", "o_orderstatus", "bucket")


@query("q_first_k_distinct", """WITH c AS (SELECT 'o_orderpriority' AS col_name, o_orderpriority AS value, min(o_orderkey) AS f FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, min(o_orderkey) FROM orders GROUP BY 2),
  r AS (SELECT col_name, value, row_number() OVER (PARTITION BY col_name ORDER BY f, value) AS k FROM c) SELECT col_name, k AS rank, value FROM r WHERE k <= 3""")
def first_k_distinct(spark, sf_dir):
    return P.first_distinct(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderkey")


# ---- nest and flatten ----


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return both.select(F.col("o_orderkey").alias("at"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("order_price"))


ENTITIES = (T.Entity("user", "user_", key=True), T.Entity("orders", "order_", "array"))


@query("q_nest_roundtrip", "SELECT c_custkey AS user_id, c_name AS user_name, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS order_id, o_totalprice AS order_price FROM customer JOIN orders ON c_custkey = o_custkey")
def nest_roundtrip(spark, sf_dir):
    nested = T.nest(customer_orders(spark, sf_dir), ENTITIES, "at")
    return nested.select("user.id", "user.name", F.posexplode("orders").alias("pos", "o")).select(F.col("id").alias("user_id"), F.col("name").alias("user_name"), F.col("pos").cast("long").alias("pos"), F.col("o.id").alias("order_id"), F.col("o.price").alias("order_price"))


@query("q_nest_counts", "SELECT c_custkey AS user_id, count(*) AS n_orders, min(o_orderkey) AS first_at FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def nest_counts(spark, sf_dir):
    return T.nest(customer_orders(spark, sf_dir), ENTITIES, "at").select(F.col("user.id").alias("user_id"), F.size("orders").cast("long").alias("n_orders"), "first_at")


@query("q_nest_objects", "SELECT c_custkey, c_name || '/' || n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def nest_objects(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_nationkey", "n_name")
    nested = T.nest(both, (T.Entity("customer", "c_"), T.Entity("nation", "n_")))
    return nested.select(F.col("customer.custkey").alias("c_custkey"), F.concat("customer.name", F.lit("/"), "nation.name").alias("label"))


@query("q_flatten_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\", user_id AS \"who.user_id\", event_type AS \"who.kind.type\" FROM events")
def flatten_props(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    nested = events.select("event_id", F.from_json("props", "k long").alias("props"), F.struct("user_id", F.struct(F.col("event_type").alias("type")).alias("kind")).alias("who"))
    return T.flatten(nested, ["event_id", "props.k", "who.user_id", "who.kind.type"])


@query("q_array_expand", "SELECT vec_id, CAST(u.i - 1 AS BIGINT) AS index, round(CAST(embedding[u.i] AS DOUBLE), 6) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i)")
def array_expand(spark, sf_dir):
    rows = T.expand_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return rows.select("vec_id", F.col("index").cast("long").alias("index"), F.round(F.col("embedding").cast("double"), 6).alias("value"))


@query("q_array_columns", 'SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS "embedding.0", round(CAST(embedding[2] AS DOUBLE), 6) AS "embedding.1" FROM embeddings')
def array_columns(spark, sf_dir):
    wide = T.expand_columns(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 2)
    return wide.select("vec_id", *[F.round(F.col(f"`embedding.{i}`").cast("double"), 6).alias(f"embedding.{i}") for i in range(2)])


# ---- logs ----


def _stamp(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def _level() -> Column:
    return F.when(F.col("event_id") % 3 == 0, "ERROR").when(F.col("event_id") % 3 == 1, "INFO").otherwise("WARN")


LINES: dict[str, Callable[[], Column]] = {
    "bracket": lambda: F.concat(F.lit("["), _stamp("yyyy-MM-dd HH:mm:ss"), F.lit("] "), _level(), F.lit(" svc."), F.col("event_type"), F.lit(": user "), F.col("user_id").cast("string"), F.lit(": done")),
    "iso_z": lambda: F.concat(_stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), _level(), F.lit(" [svc."), F.col("event_type"), F.lit("] user "), F.col("user_id").cast("string"), F.lit(": done")),
    "java": lambda: F.concat(_stamp("yyyy-MM-dd HH:mm:ss"), F.lit(",123 "), _level(), F.lit("  [main-1] svc."), F.col("event_type"), F.lit(" - user "), F.col("user_id").cast("string"), F.lit(": done")),
}
_LOG_SQL = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'INFO' ELSE 'WARN' END AS level,
  'svc.' || event_type AS source, 'user ' || user_id || ': done' AS message FROM events"""


def _log_query(name: str, pattern: str | None) -> Query:
    return lambda spark, sf_dir: T.parse_log(table(spark, sf_dir, "events").select("event_id", LINES[name]().alias("value")), pattern=pattern, keep=("event_id",))


for _name in LINES:
    query(f"q_log_{_name}", _LOG_SQL)(_log_query(_name, _name))
    query(f"q_log_any_{_name}", _LOG_SQL)(_log_query(_name, None))


@query("q_log_unmatched", f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE timestamp END AS timestamp, CASE WHEN event_id % 5 = 0 THEN '' ELSE level END AS level,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE source END AS source, CASE WHEN event_id % 5 = 0 THEN 'broken line ' || event_id ELSE message END AS message FROM ({_LOG_SQL}) x""")
def log_unmatched(spark, sf_dir):
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("broken line "), F.col("event_id").cast("string"))).otherwise(LINES["bracket"]())
    return T.parse_log(table(spark, sf_dir, "events").select("event_id", line.alias("value")), keep=("event_id",))


# ---- reports ----


@query("q_report_totals", "SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS units, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sales FROM lineitem GROUP BY 1")
def report_totals(spark, sf_dir):
    found = T.totals(table(spark, sf_dir, "lineitem"), {"units": "l_quantity", "sales": "l_extendedprice"}, by=("l_returnflag",))
    return found.select("l_returnflag", F.col("units").cast("long").alias("units"), F.col("sales").cast("double").alias("sales"))


@query("q_report_avgs", "SELECT p_brand, printf('%.2f', round(avg(CAST(p_size AS DOUBLE)), 2)) AS mean_size FROM part GROUP BY 1")
def report_avgs(spark, sf_dir):
    return T.means(table(spark, sf_dir, "part"), {"mean_size": "p_size"}, by=("p_brand",))


@query("q_report_category", "SELECT p_type AS category, CAST(sum(p_size * CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(grouping(p_type) AS INTEGER) AS is_total FROM part GROUP BY ROLLUP (p_type)")
def report_category(spark, sf_dir):
    return T.category_totals(table(spark, sf_dir, "part"), "p_type", "p_size", "p_retailprice").select(F.col("p_type").alias("category"), F.col("total").cast("double").alias("total"), "is_total")


@query("q_report_text", """WITH w AS (SELECT n_regionkey, n_nationkey, n_name, CAST(n_nationkey AS VARCHAR) AS k, greatest(max(length(n_name)) OVER (PARTITION BY n_regionkey), 6) AS w1, greatest(max(length(CAST(n_nationkey AS VARCHAR))) OVER (PARTITION BY n_regionkey), 11) AS w2 FROM nation)
  SELECT r_name, r_name || chr(10) || repeat('=', length(r_name)) || chr(10) || chr(10) || string_agg(rtrim(rpad(n_name, CAST(w1 AS INTEGER), ' ') || '  ' || lpad(k, CAST(w2 AS INTEGER), ' ')), chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || 'Nations: ' || count(*) AS report
  FROM w JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def report_text(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = T.aligned(rows.withColumn("at", F.col("n_nationkey")), ["n_name", "n_nationkey"], "at", numeric=["n_nationkey"], group=["r_name"])
    counted = T.report(lines, F.col("r_name"), "at", group=["r_name"])
    n = lines.groupBy("r_name").agg(F.count("*").alias("n"))
    return counted.join(n, "r_name").select("r_name", F.concat("report", F.lit("\n\nNations: "), F.col("n").cast("string")).alias("report"))


# ---- migration ----


@query("q_rename_reorder", "SELECT c_name AS name, c_mktsegment AS segment, c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer")
def rename_reorder(spark, sf_dir):
    return T.rename_and_reorder(table(spark, sf_dir, "customer"), {"c_custkey": "id", "c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"}, ["name", "segment", "id", "nation", "balance"])


@query("q_restructure", "SELECT n_nationkey AS id, c_name AS first, c_mktsegment AS email, c_custkey AS birth_year FROM customer JOIN nation ON c_nationkey = n_nationkey")
def restructure(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    record = F.struct(F.col("c_name").alias("firstName"), F.col("c_mktsegment").alias("emailAddress"), F.col("c_custkey").alias("birthYear"))
    results = both.groupBy("n_nationkey").agg(F.collect_list(record).alias("results"))
    moved = results.select("n_nationkey", F.transform("results", lambda r: T.restructure(r, {"name": {"first": "firstName"}, "contact": {"email": "emailAddress"}, "birth_year": "birthYear"})).alias("users"))
    return moved.select(F.col("n_nationkey").alias("id"), F.explode("users").alias("u")).select("id", "u.name.first", "u.contact.email", "u.birth_year")


# ---- cleanup ----

NOISE: dict[str, tuple[Callable[[Column], Column], str]] = {
    "strip": (lambda p: F.concat(F.lit("  \n"), p, F.lit("\n ")), "strip_whitespace"),
    "fence": (lambda p: F.concat(F.lit("```json\n"), p, F.lit("\n```\nThat is all.")), "strip_code_fence"),
    "preamble": (lambda p: F.concat(F.lit("Here it is:\n\n"), p), "strip_preamble"),
    "trailing": (lambda p: F.concat(p, F.lit("\nHope that helps {really}.")), "strip_trailing_prose"),
}


def _clean_query(name: str) -> Query:
    def run(spark, sf_dir):
        c = cleaned(NOISE[name][0](F.col("props")), F.lit("json"))
        return table(spark, sf_dir, "events").select("event_id", c.alias("c")).select("event_id", "c.text", F.array_join("c.applied", ",").alias("applied"))

    return run


for _name, (_, _step) in NOISE.items():
    query(f"q_clean_{_name}", f"SELECT event_id, props AS text, '{_step}' AS applied FROM events")(_clean_query(_name))


@query("q_clean_csv_preamble", "SELECT event_id, 'a,b' || chr(10) || user_id || ',' || event_type AS text FROM events")
def clean_csv_preamble(spark, sf_dir):
    raw = F.concat(F.lit("Sure\na,b\n"), F.col("user_id").cast("string"), F.lit(","), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", cleaned(raw, F.lit("csv"), trailing=False).alias("c")).select("event_id", "c.text")


# ---- validator ----


def _scored(spark: SparkSession, sf_dir: str, actual: Column, expected: Column, fmt: str, required: Column | None = None, source: str = "events", key: str = "event_id", only: Sequence[str] = V.SCORES) -> DataFrame:
    rows = table(spark, sf_dir, source).select(key, actual.alias("a"), expected.alias("e"), *([required.alias("r")] if required is not None else []))
    return rows.select(key, V.scores(F.col("a"), F.col("e"), F.lit(fmt), F.col("r") if required is not None else None, only).alias("s"))


@query("q_fmt_valid_json", r"SELECT event_id, CAST(json_valid(CASE WHEN event_id % 4 = 0 THEN regexp_replace(props, '\}$', '') ELSE props END) AS DOUBLE) AS format_validity FROM events")
def fmt_valid_json(spark, sf_dir):
    broken = F.when(F.col("event_id") % 4 == 0, F.regexp_replace("props", r"\}$", "")).otherwise(F.col("props"))
    return _scored(spark, sf_dir, broken, F.col("props"), "json", only=("format_validity",)).select("event_id", "s.format_validity")


@query("q_fmt_valid_csv", """SELECT event_id, CAST(len(string_split(line, ',')) = len(string_split('id,kind', ',')) AS DOUBLE) AS format_validity
  FROM (SELECT event_id, user_id || ',' || event_type || CASE WHEN event_id % 4 = 0 THEN ',more' ELSE '' END AS line FROM events) x""")
def fmt_valid_csv(spark, sf_dir):
    text = F.concat(F.lit("id,kind\n"), F.col("user_id").cast("string"), F.lit(","), F.col("event_type"), F.when(F.col("event_id") % 4 == 0, ",more").otherwise(""))
    return _scored(spark, sf_dir, text, text, "csv", only=("format_validity",)).select("event_id", "s.format_validity")


@query("q_fmt_valid_txt", r"SELECT doc_id, CASE WHEN regexp_matches(text, '\S') AND doc_id % 5 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS format_validity FROM documents")
def fmt_valid_txt(spark, sf_dir):
    text = F.when(F.col("doc_id") % 5 == 0, F.lit(" \n\t")).otherwise(F.col("text"))
    return _scored(spark, sf_dir, text, F.lit(""), "txt", source="documents", key="doc_id", only=("format_validity",)).select("doc_id", "s.format_validity")


@query("q_schema_compliance", """SELECT event_id, CAST(json_structure(CASE event_id % 4 WHEN 0 THEN '{"k": ' || k || '}' WHEN 1 THEN '{"k": ' || k || '.0}' WHEN 2 THEN '{"k": "' || k || '"}' ELSE '{"k": ' || k || ', "x": 1}' END)
  = json_structure(props) AS DOUBLE) AS schema_compliance FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) x""")
def schema_compliance(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    mutated = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"k": '), k, F.lit("}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"k": '), k, F.lit(".0}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"k": "'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "x": 1}')))
    return _scored(spark, sf_dir, mutated, F.col("props"), "json", only=("schema_compliance",)).select("event_id", "s.schema_compliance")


@query("q_loadability", """SELECT event_id, CAST(json_type(CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"rows": [' || props || ']}' ELSE '17' END) IN ('OBJECT', 'ARRAY') AS DOUBLE) AS loadability FROM events""")
def loadability(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"rows": ['), F.col("props"), F.lit("]}"))).otherwise(F.lit("17"))
    return _scored(spark, sf_dir, text, F.col("props"), "json", only=("loadability",)).select("event_id", "s.loadability")


#: Both texts of ``_json_pair`` in SQL, and the share of equal leaves.
_JSON_SQL = """WITH r AS (SELECT event_id, '{"id": ' || event_id || ', "user": {"id": ' || user_id || '.0}, "tags": ["' || CASE WHEN event_id % 4 = 0 THEN 'other' ELSE event_type END || '", null]}' AS a,
  '{"id": ' || event_id || ', "user": {"id": "' || user_id || '"}, "tags": ["' || event_type || '", null]}' AS e FROM events)
  SELECT event_id, (CAST(json_extract(a, '$.id') = json_extract(e, '$.id') AS INTEGER) + CAST(CAST(json_extract_string(a, '$.user.id') AS DOUBLE) = CAST(json_extract_string(e, '$.user.id') AS DOUBLE) AS INTEGER)
  + CAST(json_extract(a, '$.tags[0]') = json_extract(e, '$.tags[0]') AS INTEGER) + CAST(json_type(a, '$.tags[1]') = json_type(e, '$.tags[1]') AS INTEGER)) / 4.0::DOUBLE AS content_accuracy FROM r"""


def _json_pair() -> tuple[Column, Column]:
    record = lambda bad: F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "user": {"id": "'), F.col("user_id").cast("string"), F.lit('"}, "tags": ["'), F.when(F.lit(bad) & (F.col("event_id") % 4 == 0), "other").otherwise(F.col("event_type")), F.lit('", null]}'))
    return F.regexp_replace(record(True), r'"id": "(\d+)"', '"id": $1.0'), record(False)


@query("q_content_json", _JSON_SQL)
def content_json(spark, sf_dir):
    """Four leaves: id, user.id (a number written as text), tags[0] (wrong in each fourth row), tags[1] (null)."""
    return _scored(spark, sf_dir, *_json_pair(), "json", only=("content_accuracy",)).select("event_id", "s.content_accuracy")


@query("q_content_json_joined", _JSON_SQL)
def content_json_joined(spark, sf_dir):
    a, e = _json_pair()
    return V.json_accuracy(table(spark, sf_dir, "events").select("event_id", a.alias("a"), e.alias("e")), "event_id", "a", "e")


#: The cells of ``_csv_pair`` in SQL.
_CSV_SQL = """WITH r AS (SELECT event_id, [CAST(user_id AS VARCHAR), event_type, '7', CASE WHEN event_id % 4 = 0 THEN 'other' ELSE 'x' END] AS a, [CAST(user_id AS VARCHAR), event_type, '7', 'x'] AS e FROM events)
  SELECT event_id, count(*) FILTER (WHERE a[i] = e[i]) / 4.0::DOUBLE AS content_accuracy FROM r, range(1, 5) u(i) GROUP BY event_id"""


def _csv_pair() -> tuple[Column, Column]:
    rows = lambda bad: F.concat(F.lit("ID,Kind\n"), F.col("user_id").cast("string"), F.lit(","), F.col("event_type"), F.lit("\n7,"), F.when(F.lit(bad) & (F.col("event_id") % 4 == 0), "other").otherwise("x"))
    return F.regexp_replace(rows(True), "^ID,Kind", "id, kind"), rows(False)


@query("q_content_csv", _CSV_SQL)
def content_csv(spark, sf_dir):
    return _scored(spark, sf_dir, *_csv_pair(), "csv", only=("content_accuracy",)).select("event_id", "s.content_accuracy")


@query("q_content_csv_joined", _CSV_SQL)
def content_csv_joined(spark, sf_dir):
    a, e = _csv_pair()
    return V.csv_accuracy(table(spark, sf_dir, "events").select("event_id", a.alias("a"), e.alias("e")), "event_id", "a", "e")


NEEDLES = ["the", "QUE", "zzz", "and"]
_HITS = " + ".join(f"CAST(contains(lower(text), '{s.lower()}') AS INTEGER)" for s in NEEDLES)


@query("q_content_txt", f"SELECT doc_id, ({_HITS}) / 4.0::DOUBLE AS content_accuracy FROM documents")
def content_txt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.substring_accuracy(F.col("text"), F.array(*[F.lit(s) for s in NEEDLES])).alias("content_accuracy"))


@query("q_score_all", """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '[' || props WHEN 1 THEN '"' || event_type || '"' WHEN 2 THEN '[{"k": "' || json_extract_string(props, '$.k') || '"}]' WHEN 3 THEN '[{"k": 1.5}]' ELSE '[' || props || ']' END AS a, '[ ' || props || ' ]' AS e FROM events),
  v AS (SELECT *, json_valid(a) AS ok, CASE WHEN json_valid(a) THEN a ELSE 'null' END AS j FROM r)
  SELECT event_id, CAST(ok AS DOUBLE) AS format_validity, CAST(ok AND json_structure(j) = json_structure(e) AS DOUBLE) AS schema_compliance, CAST(ok AND json_type(j) IN ('OBJECT', 'ARRAY') AS DOUBLE) AS loadability,
  CAST(ok AND coalesce(CAST(json_extract_string(j, '$[0].k') AS DOUBLE) = CAST(json_extract_string(e, '$[0].k') AS DOUBLE), false) AS DOUBLE) AS content_accuracy FROM v""")
def score_all(spark, sf_dir):
    """All four scores of texts that are cut off, no table, of another type, of another value, or right."""
    k = F.get_json_object("props", "$.k")
    rest = F.col("event_id") % 5
    actual = (
        F.when(rest == 0, F.concat(F.lit("["), F.col("props"))).when(rest == 1, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(rest == 2, F.concat(F.lit('[{"k": "'), k, F.lit('"}]')))
        .when(rest == 3, F.lit('[{"k": 1.5}]')).otherwise(F.concat(F.lit("["), F.col("props"), F.lit("]")))
    )
    return _scored(spark, sf_dir, actual, F.concat(F.lit("[ "), F.col("props"), F.lit(" ]")), "json").select("event_id", "s.*")


@query("q_values_equal", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN upper(event_type) = event_type ELSE contains(event_type, '@') END AS eq FROM events""")
def values_equal(spark, sf_dir):
    """Cells of events against a rewriting of each: the same, as a decimal, padded, another number, empty, in capitals, in place of a missing value."""
    user, kind, way = F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id") % 7
    a = F.when(way < 4, user).when(way == 4, "").otherwise(kind)
    b = F.when(way == 0, user).when(way == 1, F.concat(user, F.lit(".0"))).when(way == 2, F.concat(F.lit(" "), user, F.lit("  "))).when(way == 3, (F.col("user_id") + 1).cast("string")).when(way == 5, F.upper(kind))
    return table(spark, sf_dir, "events").select("event_id", G.values_equal(a, b).alias("eq"))


@query("q_leaf_walk", "SELECT event_id, 'a.k' AS path, 'num' AS kind, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events UNION ALL SELECT event_id, 'b[0]', 'str', event_type FROM events UNION ALL SELECT event_id, 'b[1]', 'null', NULL FROM events")
def leaf_walk(spark, sf_dir):
    text = F.concat(F.lit('{"a": '), F.col("props"), F.lit(', "b": ["'), F.col("event_type"), F.lit('", null]}'))
    return V.json_leaves(table(spark, sf_dir, "events").select("event_id", text.alias("t")), "event_id", "t").withColumnRenamed("id", "event_id")


@query("q_missing_leaves", "SELECT event_id, 'k' AS path FROM events WHERE event_id % 3 = 0")
def missing_leaves(spark, sf_dir):
    """Expected leaves whose path the actual text lacks: an anti join of leaf tables."""
    events = table(spark, sf_dir, "events").select("event_id", "props", F.when(F.col("event_id") % 3 == 0, '{"other": 1}').otherwise(F.col("props")).alias("a"))
    return V.json_leaves(events, "event_id", "props").join(V.json_leaves(events, "event_id", "a"), ["id", "path"], "left_anti").select(F.col("id").alias("event_id"), "path")


@query("q_header_norm", "SELECT c_custkey, lower(trim(c_mktsegment)) = lower(c_mktsegment) AND c_custkey % 2 = 0 AS same FROM customer")
def header_norm(spark, sf_dir):
    a = F.array(F.concat(F.lit("  "), F.col("c_mktsegment")), F.lit("Id"))
    b = F.array(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "ID ").otherwise("no"))
    keys = lambda h: F.transform(h, G.header_key)
    return table(spark, sf_dir, "customer").select("c_custkey", (keys(a) == keys(b)).alias("same"))


@query("q_substring_hits", f"SELECT doc_id, CAST({_HITS} AS BIGINT) AS hits FROM documents")
def substring_hits(spark, sf_dir):
    needles = F.array(*[F.lit(s) for s in NEEDLES])
    return table(spark, sf_dir, "documents").select("doc_id", F.round(V.substring_accuracy(F.col("text"), needles) * len(NEEDLES)).cast("long").alias("hits"))


# ---- runs ----


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = lambda k: (F.pmod(F.col("event_id") * k, F.lit(5)) / 4).alias(R.METRICS[k - 1])
    complexity = F.when(F.col("event_id") % 3 == 0, "simple").when(F.col("event_id") % 3 == 1, "medium").otherwise("complex")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("use_case"), complexity.alias("complexity"), (F.col("event_id") % 10 != 0).alias("ok"), F.struct(*[score(k) for k in range(1, 5)]).alias("scores"))


_MEANS = ", ".join(f"round_even(avg(((event_id * {k}) % 5) / 4.0), 3)::DOUBLE AS {R.METRICS[k - 1]}" for k in range(1, 5))


@query("q_summary_grouping_sets", f"""WITH r AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'medium' ELSE 'complex' END AS complexity FROM events)
  SELECT CASE WHEN grouping(event_type) = 0 THEN 'use_case' WHEN grouping(complexity) = 0 THEN 'complexity' ELSE 'overall' END AS level,
  CASE WHEN grouping(event_type) = 0 THEN event_type WHEN grouping(complexity) = 0 THEN complexity ELSE '' END AS name, count(*) AS n, count(*) FILTER (WHERE event_id % 10 = 0) AS n_errors, {_MEANS}
  FROM r GROUP BY GROUPING SETS ((event_type), (complexity), ())""")
def summary_grouping_sets(spark, sf_dir):
    return R.summarize(run_results(spark, sf_dir))


@query("q_case_order_limit", """SELECT p_type AS use_case_dir, c AS "case" FROM (SELECT p_type, CASE p_partkey % 4 WHEN 0 THEN 'medium_' WHEN 1 THEN 'simple_' WHEN 2 THEN 'complex_' ELSE 'odd_' END || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS c,
  CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 99 END AS k FROM part WHERE contains(p_type, 'A')) x ORDER BY p_type, k, c LIMIT 25""")
def case_order_limit(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("medium_"), F.lit("simple_"), F.lit("complex_"), F.lit("odd_")), (F.col("p_partkey") % 4 + 1).cast("int"))
    cases = table(spark, sf_dir, "part").select(F.col("p_type").alias("use_case_dir"), F.concat(kind, F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("case"))
    return R.select_cases(cases, only="A", limit=25)


@query("q_latest_run", "SELECT max('baseline_' || strftime(o_orderdate, '%Y-%m-%d')) AS run_id FROM orders")
def latest_run(spark, sf_dir):
    return R.latest_run(table(spark, sf_dir, "orders").select(F.concat(F.lit("baseline_"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("run_id")))


@query("q_cleanup_sizes", "SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) // 4 AS BIGINT) AS est_tokens, substring(text, 1, 200) AS preview FROM conversations")
def cleanup_sizes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.output_sizes(F.col("text")).alias("s")).select("conv_id", "turn", "s.*")


@query("q_grouped_labels", "SELECT source, count(*) AS n, round_even(avg(quality), 3) AS quality, round_even(avg(toxic), 3) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
def grouped_labels(spark, sf_dir):
    """The run summary over labels: sources as use cases, labels as scores."""
    both = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    labels = [F.col(c).cast("double").alias(m) for c, m in zip(("quality", "toxic", "quality", "toxic"), R.METRICS, strict=True)]
    found = R.summarize(both.select(F.col("source").alias("use_case"), F.col("lang").alias("complexity"), F.lit(True).alias("ok"), F.struct(*labels).alias("scores")))
    return found.filter("level = 'use_case'").select(F.col("name").alias("source"), "n", F.col(R.METRICS[0]).alias("quality"), F.col(R.METRICS[1]).alias("toxic"))
