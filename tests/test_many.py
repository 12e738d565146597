import json

from tabshift.plans.envelope import envelope
from tabshift.plans.many import envelopes_of

FILES = {
    "plain.csv": "first_name,city\nAda,Holt\nBo,Rye\nCy,Ely\n", "numbers.csv": "user,n,price\n" + "".join(f"u{i % 2},{i},{i}.5\n" for i in range(40)), "semi.csv": "a;b;b\n1;x;y\n2;;z\n3;q;w\n",
    "quoted.csv": 'id,note\n1,"two\nlines, and ""more"""\n2,plain\n3,"x, y"\n', "none.csv": "1,Ada,Rye\n2,Bob,Ely\n3,Cyd,Ayr\n4,Dix,Ash\n", "head.csv": "a,b\n", "dates.csv": "when|what\n2024-01-05|a\n2024-02-06|b\n2024-03-07|a\n",
    "tabs.csv": "name\tname\tage\nAda\tL\t36\nBo\tM\t40\n", "bom.csv": "﻿a,b\nx,y\nz,w\n", "wide.csv": ",".join(f"c{i}" for i in range(30)) + "\n" + ",".join(str(i) for i in range(30)) + "\n",
}


def facts(record):
    """What both ways must agree on, in any order of warnings."""
    record = dict(record)
    record.pop("file_path")
    record["warnings"] = sorted(json.dumps(w, sort_keys=True) for w in record["warnings"])
    return record


def test_one_plan_gives_what_single_files_give(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "latin.csv").write_bytes("name,city\nRené,Caf\xe9\nBo,Rye\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_bytes(b"")
    got = {r.path.rpartition("/")[2]: r for r in envelopes_of(spark, str(tmp_path), check_quoting=True).collect()}
    assert set(got) == {*FILES, "latin.csv"}
    for name, r in got.items():
        want = envelope(spark, str(tmp_path / name), check_quoting=True)
        if name == "quoted.csv":  # its records are fewer than its lines; both count lines
            assert json.loads(r.envelope)["schema"]["row_count"] == want["schema"]["row_count"] == 4
        assert facts(json.loads(r.envelope)) == facts(want), name
        assert r.est_tokens == len(r.envelope) // 4


def test_many_files_are_few_jobs(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"f{i:03d}.csv").write_text(f"id,name\n{i},n{i}\n{i + 1},m\n")
    spark.sparkContext.setJobGroup("many", "many files")
    assert envelopes_of(spark, str(tmp_path)).count() == 60
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 40, jobs
    assert envelopes_of(spark, [str(tmp_path / "f001.csv"), str(tmp_path / "f002.csv")]).count() == 2
