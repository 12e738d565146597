import pytest

from tabshift.plans.envelope import envelope
from tabshift.sources import dialects as D
from tabshift.sources import files as S


def write(tmp_path, text, name="d.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


BODY = [("name", "city", "n"), ("Ada", "Holt", "1"), ("Bo", "Rye", "22"), ("Cy", "Ely", "3")]


@pytest.mark.parametrize("delimiter", [",", ";", "|", "\t"])
@pytest.mark.parametrize("quote", ["", '"', "'"])
def test_plain_dialects(spark, tmp_path, delimiter, quote):
    text = "\n".join(delimiter.join(f"{quote}{c}{quote}" for c in row) for row in BODY) + "\n"
    path = write(tmp_path, text)
    assert D.delimiter_and_quote(spark, path) == (delimiter, quote or '"')
    if delimiter != "|" or not quote:  # as the sample tells them
        found = S.sniff_file(spark, path)
        assert (found.delimiter, found.has_header) == (S.sniff(text).delimiter, S.sniff(text).has_header)


def test_a_beginning_that_misleads(spark, tmp_path):
    preamble = "".join(f"# note {i}, of, some; length: x\n" for i in range(700))
    path = write(tmp_path, preamble + "".join(f"{i};name {i};{i / 2}\n" for i in range(3000)))
    assert len(preamble) > S.SNIFF_CHARS and S.sniff(S.first_text(spark, path, "utf-8")).delimiter != ";"
    assert S.sniff_file(spark, path).delimiter == ";" and envelope(spark, path, whole_file=True)["schema"]["delimiter"] == ";"


def test_marks_within_quotes_have_no_say(spark, tmp_path):
    path = write(tmp_path, "".join(f'"a,b,c,{"," * (i % 5)}"|{i}|"x, y"\n' for i in range(50)))
    assert D.delimiter_and_quote(spark, path) == ("|", '"')


@pytest.mark.parametrize("late,mixed", [('7,"plain",x\n', True), ('7,"with, comma",x\n', False), ('"7",b,"x ""y"""\n', True), ("", False)])
def test_quoting_habits_of_the_whole_file(spark, tmp_path, late, mixed):
    path = write(tmp_path, "id,name,t\n" + "".join(f'{i},name {i},"two\nlines, {i}"\n' for i in range(2000)) + late)
    assert S.sniff_file(spark, path, check_quoting=True).inconsistent_quoting is mixed
    assert not S.sniff(S.first_text(spark, path, "utf-8"), True).inconsistent_quoting
    codes = [w["code"] for w in envelope(spark, path, check_quoting=True, whole_file=True)["warnings"]]
    assert ("INCONSISTENT_QUOTING" in codes) is mixed


def test_files_without_marks(spark, tmp_path):
    assert D.delimiter_and_quote(spark, write(tmp_path, "")) == (",", '"')
    assert D.delimiter_and_quote(spark, write(tmp_path, "word\n\nother\n", "w.csv")) == (",", '"')
