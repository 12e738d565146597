import pytest
from pyspark.sql import functions as F

from tabshift.plans import formats
from tabshift.plans.envelope import envelope, envelopes, main, rendered
from tabshift.sources import files as S


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def codes(record):
    return [w["code"] for w in record["warnings"]]


def test_plain_file(spark, tmp_path):
    record = envelope(spark, write(tmp_path, "u.csv", "first_name,city\nAda,Holt\nBo,Rye\nCy,Ely\n"))
    assert codes(record) == [] and record["encoding"] == "utf-8-sig" and record["schema_version"] == "0.1"
    assert record["schema"]["row_count"] == 3 and [c["dtype"] for c in record["schema"]["columns"]] == ["string", "string"]
    assert record["samples"]["head"][0] == {"first_name": "Ada", "city": "Holt"} and record["samples"]["tail"] == []
    text, tokens = rendered(record)
    assert tokens == len(text) // 4


def test_warnings_and_blocks(spark, tmp_path):
    record = envelope(spark, write(tmp_path, "r.csv", "user,n,price\n" + "".join(f"u{i % 2},{i},{i}.5\n" for i in range(6))))
    assert codes(record) == ["REPEATING_ENTITY", "NUMERIC_COLUMN_QUOTE_RISK", "NUMERIC_COLUMN_QUOTE_RISK"]
    n = record["schema"]["columns"][1]
    assert (n["min"], n["max"], n["sample_values"]) == (0, 5, [0, 1, 2]) and "max_length" not in n
    assert [r["n"] for r in record["samples"]["middle"]] == ["3"] and [r["n"] for r in record["samples"]["tail"]] == ["5"]


def test_empty_and_header_only(spark, tmp_path):
    record = envelope(spark, write(tmp_path, "e.csv", b""))
    assert codes(record) == ["EMPTY_FILE"] and record["schema"]["columns"] == []
    record = envelope(spark, write(tmp_path, "h.csv", "a,b\n"))
    assert codes(record) == ["EMPTY_FILE"] and record["schema"]["row_count"] == 0


def test_latin1_bom_tabs_and_duplicates(spark, tmp_path):
    record = envelope(spark, write(tmp_path, "l.csv", "name,city\nRené,Caf\xe9\nBo,Rye\n".encode("latin-1")))
    assert record["encoding"] == "latin-1" and codes(record)[0] == "LATIN1_FALLBACK" and record["samples"]["head"][0]["name"] == "René"
    record = envelope(spark, write(tmp_path, "b.csv", b"\xef\xbb\xbfa,b\nx,y\n"))
    assert [c["name"] for c in record["schema"]["columns"]] == ["a", "b"]
    record = envelope(spark, write(tmp_path, "t.csv", "name\tname\tage\nAda\tL\t36\nBo\tM\t40\n"))
    assert record["schema"]["delimiter"] == "\t" and [c["name"] for c in record["schema"]["columns"]] == ["name", "name.1", "age"] and "DUPLICATE_COLUMN_NAME" in codes(record)


def test_missing_header(spark, tmp_path):
    record = envelope(spark, write(tmp_path, "m.csv", "1,Ada,Rye\n2,Bob,Ely\n3,Cyd,Ayr\n4,Dix,Ash\n"))
    assert "MISSING_HEADER" in codes(record) and [c["name"] for c in record["schema"]["columns"]] == ["c0", "c1", "c2"] and record["schema"]["row_count"] == 4


def test_positions_are_contiguous(spark):
    df = spark.range(100, numPartitions=7)
    assert [r.row_idx for r in S.with_position(df).orderBy("id").collect()] == list(range(100))
    assert S.with_position(spark.range(0)).count() == 0


def test_sorted_positions_are_contiguous_in_many_partitions(spark):
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 200_000
        rows = spark.range(n, numPartitions=3).select((F.col("id") * 77_777 % n).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
        placed = S.in_order(rows, "key").select("key", "row_idx", F.xxhash64("more").alias("h")).toArrow()  # a pass over positions alone would prune its sort
        assert placed.num_rows == n and placed["key"].to_pylist() == placed["row_idx"].to_pylist()
        assert S.in_order(rows.limit(0), "key").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)


def test_encoding_of_documents_in_parts(spark, tmp_path):
    for name, data in {"a/0": b"abc\n", "a/1": b"Caf\xe9\n", "a/2": b"de\n", "b/0": b"x\n", "b/1": "\u00e9\n".encode()}.items():
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        write(tmp_path / "docs", name, data)
    got = {r.path[-1]: (r.size, r.encoding, len(r.attempted)) for r in S.encodings(spark, str(tmp_path / "docs/*"), folders=True).collect()}
    assert got == {"a": (12, "latin-1", 2), "b": (5, "utf-8-sig", 0)}


def test_a_language_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from tabshift import file_queries

    rows = spark.range(40, numPartitions=4).select(F.lit("fr").alias("lang"), F.when(F.col("id") == 39, "\u00e9t\u00e9").otherwise("ete").alias("text"))
    monkeypatch.setattr(file_queries, "table", lambda *_: rows)
    monkeypatch.setattr(S, "scratch", lambda *_: str(tmp_path / "latin"))
    assert [tuple(r) for r in file_queries.encoding(spark, "").collect()] == [("fr", "latin-1")]
    assert len(list((tmp_path / "latin/lang=fr").glob("*.csv"))) == 4


def test_csv_sink(spark, tmp_path):
    out = str(tmp_path / "out")
    S.write_csv(spark.createDataFrame([('say "hi"', None, " x ")], "a string, b string, c string").coalesce(1), out)
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == 'a,b,c\n"say ""hi""",, x \n'


@pytest.mark.parametrize("name,ok", [("a.csv", True), ("A.CSV", True), ("a.csv.txt", False), ("csv", False)])
def test_supported(spark, name, ok):
    from pyspark.sql import functions as F

    assert spark.range(1).select(S.supported(F.lit(name)).alias("x")).first().x is ok


def test_numbers_in_blocks_are_exact(spark, tmp_path):
    low, high = 9007199254740993, 1234567890123456789012345678
    record = envelope(spark, write(tmp_path, "n.csv", f"k,who\n{low},a\n{high},b\n-3,c\n"))
    assert (record["schema"]["columns"][0]["min"], record["schema"]["columns"][0]["max"]) == (-3, high)
    assert [w["context"] for w in record["warnings"]] == [{"column": "k", "dtype": "integer"}]


def test_contexts_hold_numbers(spark, tmp_path):
    record = envelope(spark, write(tmp_path, "c.csv", "a,b\n" + "x,\n" * 4 + "y,q\n"))
    found = {w["code"]: w["context"] for w in record["warnings"] if w["context"].get("column") in ("a", "b")}
    assert found["REPEATING_ENTITY"] == {"column": "b", "unique_count": 1, "row_count": 5, "rows_per_entity_avg": 5.0}
    assert found["HIGH_NULL_RATE"]["null_rate"] == 0.8


def test_quoted_line_breaks_and_latin1_headers(spark, tmp_path):
    record = envelope(spark, write(tmp_path, "q.csv", 'a,b\n"x\ny",1\nz,2\nw,3\n'))
    assert record["samples"]["head"][0] == {"a": "x\ny", "b": "1"}
    record = envelope(spark, write(tmp_path, "d.csv", "caf\xe9,caf\xe9,age\nAda,Lee,36\nBob,May,40\n".encode("latin-1")))
    duplicates = [w["context"]["duplicates"] for w in record["warnings"] if w["code"] == "DUPLICATE_COLUMN_NAME"]
    assert duplicates == [["caf\xe9"]] and [c["name"] for c in record["schema"]["columns"]] == ["caf\xe9", "caf\xe9.1", "age"]


def test_whole_lines_can_be_read_in_many_tasks(spark, tmp_path):
    path = write(tmp_path, "s.csv", "a,b\n" + "".join(f"r{i},{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        scan = S.scan(spark, path).first()
        assert (scan.n_lines, scan.open_quotes, scan.open_apostrophes, scan.encoding) == (5001, False, False, "utf-8-sig")
        rows = S.read_raw(spark, path, S.Dialect(has_header=True), sample=S.first_text(spark, path, "utf-8"), multi_line=False)
        assert rows.rdd.getNumPartitions() > 3
        assert [(r.row_idx, r.a) for r in rows.orderBy("row_idx").collect()] == [(i, f"r{i}") for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoting_check_is_an_option(spark, tmp_path):
    path = write(tmp_path, "i.csv", 'name,city\n"Ada",Holt\nBo,"Rye, East"\nCy,Ely\n')
    assert "INCONSISTENT_QUOTING" not in codes(envelope(spark, path))
    assert "INCONSISTENT_QUOTING" in codes(envelope(spark, path, check_quoting=True))
    assert not S.mixed_quoting('a,b\n"x","y, z"\n"u","v"\n'.split("\n", 1)[1], ",", '"')


def test_registry_of_formats(spark, tmp_path):
    assert formats.format_of("x/Y.CSV").name == "csv" and formats.FORMATS["csv"].schema_version == "0.1"
    with pytest.raises(ValueError, match="no format"):
        formats.extract(spark, "x.parquet")
    formats.register(formats.Format("lines", ".lines", lambda spark, path, **o: {"format": "lines", "rows": spark.read.text(path).count()}))
    try:
        assert formats.extract(spark, write(tmp_path, "a.lines", "1\n2\n")) == {"format": "lines", "rows": 2}
    finally:
        del formats.FORMATS["lines"]


def test_command_line_and_rows(spark, tmp_path, capsys):
    path = write(tmp_path, "c.csv", "who,city\nAda,Holt\nBo,Rye\nCy,Ely\nDi,Ayr\n")
    assert main([path, "--head-n", "1", "--tail-n", "0"]) == 0
    text, _, tail = capsys.readouterr().out.rpartition("#")
    record = __import__("json").loads(text)
    assert len(record["samples"]["head"]) == 1 and record["samples"]["tail"] == [] and "tokens" in tail
    row = envelopes(spark, [path]).first()
    assert row.path == path and row.est_tokens == len(row.envelope) // 4


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/b/x.txt", "é"), ("y.json", None)], "name string, text string")
    assert sorted((r.name, r.bytes) for r in S.write_named_files(rows, str(tmp_path / "out")).collect()) == [("a/b/x.txt", 2), ("y.json", 0)]
    assert (tmp_path / "out/a/b/x.txt").read_text() == "é"
