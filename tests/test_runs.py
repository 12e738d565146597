import pytest
from pyspark.sql import functions as F

from tabshift.operators import transforms as T
from tabshift.operators.scoring import score
from tabshift.plans import runner as R
from tabshift.plans import sample_cases as C
from tabshift.plans.convert import convert
from tabshift.streaming import logs


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cases"))
    C.write(path)
    return path


@pytest.mark.parametrize("key", sorted(C.SAMPLES))
def test_conversions(spark, root, key):
    s = C.SAMPLES[key]
    out = convert(spark, f"{root}/{key}/input.{s.input_format}", s.spec)
    assert score(out, s.expected, s.output_format, list(s.required)) == (1.0, 1.0, 1.0, 1.0), out


def test_discover_evaluate_summarize(spark, root):
    cases = R.discover(spark, root)
    assert cases.count() == 15
    assert [r.case for r in R.select_cases(cases, "nest").collect()] == ["simple_01", "simple_02", "medium_01"]
    assert R.select_cases(cases, limit=4).count() == 4 and R.select_cases(cases, limit=0).count() == 15
    outputs = spark.createDataFrame([(k, "```\n" + s.expected + "\n```" if s.expected else " ".join(s.required)) for k, s in C.SAMPLES.items() if k != "log/simple_01"], "case_id string, raw_output string")
    results = R.evaluate(cases, R.replay(outputs)).cache()
    summary = {(r.level, r.name): r for r in R.summarize(results).collect()}
    assert summary["overall", ""].n == 15 and summary["overall", ""].n_errors == 1
    assert summary["use_case", "log"].format_validity == pytest.approx(0.667) and summary["use_case", "nest"].content_accuracy == 1.0
    assert summary["complexity", "medium"].n == 5


def test_case_without_expectation_is_left_out(spark, root, tmp_path):
    folder = tmp_path / "u" / "simple_01"
    folder.mkdir(parents=True)
    (folder / "meta.json").write_text("{}")
    assert R.discover(spark, str(tmp_path)).count() == 0


def test_flatten_undoes_nest(spark):
    flat = spark.createDataFrame([(1, "Ada", 5, "x"), (2, "Bo", None, "y")], "i int, user_name string, user_age int, item_code string")
    nested = T.nest(flat, (T.Entity("user", "user_"), T.Entity("item", "item_")), "i")
    back = T.flatten(nested).toDF("i", "user_name", "user_age", "item_code")
    assert sorted(back.collect()) == sorted(flat.collect())


def test_conservation_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        T.rename_and_reorder(df, {"a": "x"}, ["x"])
    with pytest.raises(ValueError):
        T.nest(df, (T.Entity("a", "a"),))
    with pytest.raises(ValueError):
        T.flatten(df, ["a"])


def test_arrays(spark):
    df = spark.createDataFrame([(1, [7, 8]), (2, []), (3, None)], "i int, xs array<int>")
    assert sorted((r.i, r["index"], r.xs) for r in T.expand_rows(df, "xs").collect() if r.xs) == [(1, 0, 7), (1, 1, 8)]
    assert T.expand_rows(df, "xs").count() == 4
    assert [r["xs.1"] for r in T.expand_columns(df, "xs", 2).orderBy("i").collect()] == [8, None, None]


def test_log_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("[2026-01-02 03:04:05] INFO db: up\n[2026-01-02 03:04:59] INFO db: up\nnoise\n")
    stream = logs.log_stream(spark, str(folder))
    q = stream.writeStream.format("memory").queryName("parsed_logs").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.message for r in spark.table("parsed_logs").collect()) == ["noise", "up", "up"]
    q = logs.level_counts(logs.log_stream(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("log_levels").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.level, r.n) for r in spark.table("log_levels").collect()] == [("INFO", 2)]


def test_typed_numbers_keep_their_kind(spark):
    from tabshift.plans.convert import typed

    df = typed(spark.createDataFrame([("1", "25.00", "007", "yes")], "a string, b string, c string, d string"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "string", "boolean"]
    assert df.select(F.to_json(F.struct("a", "b", "c"))).first()[0] == '{"a":1,"b":25.0,"c":"007"}'


@pytest.mark.parametrize("text", ["1234567890123456789", "9007199254740993", "-99999999999999999999999999999999999999", "1" * 40])
def test_integers_stay_exact(spark, text):
    from tabshift.plans.convert import typed

    row = typed(spark.createDataFrame([(0, text), (1, "7")], "row_idx int, n string")).filter("row_idx = 0").select(F.to_json(F.struct("n"))).first()[0]
    assert row == ('{"n":' + text + "}" if len(text) < 40 else '{"n":"' + text + '"}')


def test_converters_by_name(spark, root):
    with pytest.raises(ValueError, match="unknown converter"):
        R.converter("oracle")
    keys = [k for k, s in C.SAMPLES.items() if s.use_case == "log"]
    native = R.converter("native", spark, {k: f"{root}/{k}/input.txt" for k in keys}, {k: C.SAMPLES[k].spec for k in keys})
    results = R.evaluate(R.select_cases(R.discover(spark, root), "log"), native)
    assert [tuple(r.scores) for r in results.collect()] == [(1.0,) * 4] * 3


def test_success_needs_a_return_code_of_zero(spark):
    cases = spark.createDataFrame([(k,) for k in "abcd"], "case_id string")
    outputs = spark.createDataFrame([("a", "x", 0), ("b", "x", 1), ("c", "", 0)], "case_id string, raw_output string, return_code int")
    assert {r.case_id: r.ok for r in R.replay(outputs)(cases).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_summary_and_artefacts(spark, root, tmp_path):
    import json

    outputs = spark.createDataFrame([(k, s.expected or " ".join(s.required)) for k, s in C.SAMPLES.items() if k != "log/simple_01"], "case_id string, raw_output string")
    results = R.evaluate(R.discover(spark, root), R.replay(outputs)).cache()
    R.write_summary(results, str(tmp_path / "run"), run_id="r1", model="none")
    record = json.loads((tmp_path / "run/summary.json").read_text())
    assert record["run_id"] == "r1" and record["aggregate"]["n_cases"] == 15 and record["aggregate"]["n_inference_errors"] == 1
    assert record["aggregate"]["by_use_case"]["nest"] == {"n": 3, "format_validity": 1.0, "schema_compliance": 1.0, "loadability": 1.0, "content_accuracy": 1.0}
    assert [c["case_id"] for c in record["cases"][:2]] == ["flatten/simple_01", "flatten/simple_02"]
    assert R.write_artefacts(results, str(tmp_path / "out")) == 45
    assert (tmp_path / "out/nest/simple_01/actual.json").read_text() == C.SAMPLES["nest/simple_01"].expected
    meta = json.loads((tmp_path / "out/log/simple_01/teacher_meta.json").read_text())
    assert (meta["ok"], meta["cleaned_size_bytes"]) == (False, 0)
    assert R.summary(results.limit(0))["aggregate"] == {}


def test_report_sums_keep_all_digits(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("who,paid\na,123456789012.25\nb,0.5\n")
    from tabshift.plans.convert import Spec

    assert "Paid: 123456789012.75\n" in convert(spark, str(path), Spec("report", title="T", sums={"Paid": "paid"}))
