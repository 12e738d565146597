import io
import json
import random

import pandas as pd
import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabshift.operators import scoring as V
from tabshift.operators.cleanup import cleaned

JSON = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False, width=16) | st.text("ab 1.", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", min_size=1, max_size=2), x, max_size=3), max_leaves=6)


def test_format_validity():
    valid = lambda t, f: V.score(t, t, f, None)[0]
    assert [valid(t, "json") for t in ('{"a": 1}', '{"a": 1} x', "```json\n{}\n```", "", "[1,]")] == [1, 0, 0, 0, 0]
    assert [valid(t, "csv") for t in ("a,b\n1,2\n", "a,b\n1,2,3\n", "a,b\n\n1,2\n", "", 'a,"b\nc"\n')] == [1, 0, 0, 0, 1]
    assert [valid(t, "TXT") for t in ("x", " \n", "")] == [1, 0, 0]
    with pytest.raises(ValueError):
        V.score("", "", "xml", None)


def test_schema_compliance():
    same = lambda a, e, f="json": V.score(a, e, f, None)[1]
    assert same('{"a": 1, "b": "x"}', '{"b": "y", "a": 2}') == 1
    assert same('{"a": 1}', '{"a": 1.0}') == 0
    assert same('{"a": null}', '{"a": "x"}') == 0
    assert same("[]", "[1]") == 0
    assert same('[{"a": 1}]', '[{"a": 2}, {"b": 3}]') == 1
    assert same("A, b\n", "a,B\n1,2\n", "csv") == 1
    assert same("b,a\n", "a,b\n", "csv") == 0


def test_loadability():
    loads = lambda t, f="json": V.score(t, t, f, None)[2]
    assert [loads(t) for t in ("[]", '[{"a": 1}]', '{"rows": [{"a": 1}]}', '{"a": 1}', "17", "x")] == [1, 1, 1, 1, 0, 0]
    assert loads("a,b\n1,2\n", "csv") == 1
    assert loads("a,b\n1,2\n1,2,3\n", "csv") == 0


def test_plain_tables_load_without_pandas(monkeypatch):
    rng = random.Random(5)
    cells = ["a", "1", " ", "\t", "\u00e9", "#", ".", "\x0b", "\x1c", "\u00a0", "NaN", "", '"', "\r", "9" * 30, "\ufeff"]
    row = lambda n: ",".join("".join(rng.choices(cells, k=rng.randrange(3))) for _ in range(n))
    texts = ["\n".join(row(width if rng.random() < 0.9 else rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "\n"]) for width in rng.choices([1, 2, 3], k=3000)]

    def loads(text):
        try:
            return len(pd.read_csv(io.StringIO(text)).columns) > 0
        except Exception:  # noqa: BLE001
            return False

    assert [V.loads_as_csv(t) for t in texts] == [loads(t) for t in texts]
    monkeypatch.setattr(V.pd, "read_csv", lambda *_: pytest.fail("a plain table went to pandas"))
    assert V.score("id,kind\n7,view\n", "id,kind\n7,view\n", "csv", None) == (1, 1, 1, 1)
    assert V.score('id\n"', "id\n", "csv", None, load=False)[2] is None


def test_content_accuracy():
    accuracy = lambda a, e, f="json", r=None: V.score(a, e, f, r)[3]
    assert accuracy('{"a": "9.99", "b": [1, 2]}', '{"a": 9.99, "b": [1, 3]}') == pytest.approx(2 / 3)
    assert accuracy('{"a": 1, "z": 5}', '{"a": 1}') == 1
    assert accuracy("{", "{}") == 0
    assert accuracy("a,b\n1,2\n", "a,b\n1,2\n3,4\n", "csv") == 0.5
    assert accuracy("x,b\n1,2\n", "a,b\n1,2\n", "csv") == 0
    assert accuracy("Total: 5 Units", "", "txt", ["total: 5", "units", "none", "x"]) == 0.5
    assert accuracy("x", "", "txt", []) == 0


def test_scores_column(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}', '{"a": 1}', "json", None), (2, None, "a\n1\n", "csv", None), (3, "Hi", "", "txt", ["hi"])], "i int, a string, e string, f string, r array<string>")
    got = {r.i: tuple(r.s) for r in rows.select("i", V.scores(F.col("a"), F.col("e"), F.col("f"), F.col("r")).alias("s")).collect()}
    assert got == {1: (1.0, 1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0, 0.0), 3: (1.0, 1.0, 1.0, 1.0)}


def test_relational_json_form_agrees(spark):
    @given(st.lists(st.tuples(JSON, JSON), min_size=8, max_size=15))
    @settings(max_examples=5, deadline=None, phases=[Phase.explicit, Phase.generate])
    def check(pairs):
        # numbers and texts of the row form compare as in the relational one but for booleans, which are numbers there
        texts = [(i, json.dumps(a), json.dumps(e)) for i, (a, e) in enumerate(pairs)]
        rows = spark.createDataFrame(texts, "i int, a string, e string")
        got = {r.i: r.content_accuracy for r in V.json_accuracy(rows, "i", "a", "e").collect()}
        for i, a, e in texts:
            assert got[i] == pytest.approx(V.score(a, e, "json", None)[3]), (a, e)

    check()


def test_relational_csv_form_agrees(spark):
    cell = st.text("ab1. ", max_size=2)

    @given(st.lists(st.tuples(st.lists(st.lists(cell, min_size=1, max_size=3), min_size=1, max_size=3), st.lists(st.lists(cell, min_size=1, max_size=3), min_size=1, max_size=3)), min_size=8, max_size=15))
    @settings(max_examples=5, deadline=None, phases=[Phase.explicit, Phase.generate])
    def check(pairs):
        text = lambda rows: "".join(",".join(r) + "\n" for r in [["h1", "h2"], *rows])
        texts = [(i, text(a), text(e)) for i, (a, e) in enumerate(pairs)]
        rows = spark.createDataFrame(texts, "i int, a string, e string")
        got = {r.i: r.content_accuracy for r in V.csv_accuracy(rows, "i", "a", "e").collect()}
        for i, a, e in texts:
            assert got[i] == pytest.approx(V.score(a, e, "csv", None)[3]), (a, e)

    check()


def test_plain_csv_pairs_need_neither_python_nor_a_shuffle(spark):
    texts = ["a,b\n1,2", "A , b\n1.0,2,3\n\n4\n", "a,b\n\n1,2\n\n", "", "\n", "\n\n1,2", "a,b", "a,b\n", "a\n,\nx", "x\n1", ",\n,\n1,", " a,b\n 1 ,2\n5", "a,b\n1_0,\u00e9\n\n"]
    texts += ["\n".join(["h,i", "10,x", "3"]), None]
    pairs = [(i * len(texts) + j, a, e) for i, a in enumerate(texts) for j, e in enumerate(texts)]
    scored = V.csv_accuracy(spark.createDataFrame(pairs, "i long, a string, e string"), "i", "a", "e")
    plan = scored._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange", "Join"))
    got = {r.i: r.content_accuracy for r in scored.collect()}
    odd = spark.createDataFrame([*pairs, (-1, 'a\n"1\n2"\n', 'a\n"1\n2"'), (-2, "a\r\n1", "a\n1"), (-3, 'a\n"', None)], "i long, a string, e string")
    mixed = {r.i: r.content_accuracy for r in V.csv_accuracy(odd, "i", "a", "e").collect()}
    for i, a, e in odd.collect():
        want = V.score(a, e, "csv", None, load=False)[3]
        assert mixed[i] == pytest.approx(want) and got.get(i, mixed[i]) == mixed[i], (a, e)


def test_cleanup(spark):
    cases = [
        ("json", '```json\n{"a": 1}\n```\nDone', '{"a": 1}', ["strip_code_fence"]), ("json", 'Sure:\n{"a": "}"} bye', '{"a": "}"}', ["strip_preamble", "strip_trailing_prose"]),
        ("csv", " Here\na,b\n1,2 ", "a,b\n1,2", ["strip_whitespace", "strip_preamble"]), ("txt", "Here, yes", "Here, yes", []), ("json", "```json\n{}", "{}", ["strip_preamble"]),
        ("json", '[{"a": 1}]', '[{"a": 1}]', []), ("csv", "one\ntwo", "one\ntwo", []), ("json", '{"a": 1}\n{"b": 2}', '{"a": 1}', ["strip_trailing_prose"]), ("json", None, "", []),
    ]
    rows = spark.createDataFrame([(i, f, raw) for i, (f, raw, _, _) in enumerate(cases)], "i int, f string, raw string")
    got = [(r.c.text, r.c.applied) for r in rows.select("i", cleaned(F.col("raw"), F.col("f")).alias("c")).orderBy("i").collect()]
    assert got == [(text, applied) for _, _, text, applied in cases]


def test_deep_values_need_no_recursion():
    deep = "[" * 5000 + "1" + "]" * 5000
    parsed = V.parsed_json(deep)
    if parsed is not V.MISSING:
        assert [v for _, v in V.leaves(parsed)] == [1] and V.skeleton(parsed).count("[") == 5000
    assert len(V.score(deep, deep, "json", None)) == 4
    assert V.skeleton({"b": [], "a": [{"x": None}, 1], "c": "s"}) == '{"a":[{"x":NoneType}],"b":[],"c":str}'


def test_empty_fence_is_not_closed(spark):
    from tabshift.operators.cleanup import without_fence

    texts = ["```\n\n```", "```json\n\n\n{}\n```", "```\nx"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.x for r in rows.orderBy("i").select(without_fence(F.col("t")).alias("x")).collect()] == [texts[0], "{}", texts[2]]


def test_end_of_json_with_and_without_a_whole_value(monkeypatch):
    from tabshift.operators import cleanup as C

    texts = ['{"a": [1, "}"]} rest', 'x [1, {"b": 2}] y', '{"a": }} z', '["\\"]"] more', "{", "no", "[" * 3000 + "]" * 3000 + " t", '{"a": 1}{"b": 2}']
    fast = [C.end_of_json(t) for t in texts]

    class Never:
        def raw_decode(self, *_):
            raise ValueError

    monkeypatch.setattr(C, "DECODER", Never())
    assert fast == [C.end_of_json(t) for t in texts]


LEAF_TEXTS = [
    '{"a": 1, "b": {"c": [1, 2.50, {"d": null}], "e": {}}, "f": []}', "[]", "{}", "5", '"x"', "null", "true", "", "no json", '{"a": 1, "a": 2}', '{"a.b": 1, "a": {"b": 2}}', '[NaN, -Infinity, 1e5, 1E-7, 12345678901234567890, 0.1]',
    '{"k[0]": 1, "k": [2]}', '[[[[["deep"]]]], {"": {"": 3}}]', '{"s": "a\\"b{[,\\\\", "t": "\\u00e9\\n", "u": "[.]: \\"q\\": "}', '{"b": [true, false, null, ""]}', "[1,]", '{"x": ' * 30 + "1" + "}" * 30,
]


def test_leaves_without_python_equal_the_walk(spark):
    rows = list(enumerate([*LEAF_TEXTS, None]))
    got = {}
    for r in V.json_leaves(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect():
        assert (r.id, r.path) not in got
        got[r.id, r.path] = (r.kind, r.value)
    want = {(i, p): (k, v) for i, t in rows for p, k, v in V.LeafWalk().eval(t)}
    assert set(got) == set(want)
    for at, (kind, value) in want.items():
        assert got[at][0] == kind and (got[at][1] == value or kind == "num" and float(got[at][1]) == float(value) or value == "nan" == got[at][1]), at


def test_plain_texts_need_no_python(spark):
    pairs = spark.createDataFrame([(1, '{"a": [1, {"b": "x"}]}', '{"a": [1.0, {"b": " x"}], "c": null}'), (2, None, "[1]"), (3, "[1]", None)], "id long, a string, e string")
    scored = V.json_accuracy(pairs, "id", "a", "e")
    assert "Python" not in scored._jdf.queryExecution().toString() and "Arrow" not in scored._jdf.queryExecution().toString()
    assert {r.id: round(r.content_accuracy, 4) for r in scored.collect()} == {1: 0.6667, 2: 0.0, 3: 0.0}
