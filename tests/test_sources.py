"""Readers and writers."""

import hashlib
import zipfile

import pytest
from pyspark.sql import types as T

from loomgate import sources as S

ROW = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("n", T.LongType())])


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"event_id": "a", "n": 1}\n\n{"event_id": "b", "n": 2}\n')
    assert S.read_jsonl_by_key(spark, str(p), ROW, "event_id").count() == 2
    p.write_text('{"event_id": "a", "n": 1}\nnonsense\n')
    with pytest.raises(Exception, match="bad line"):
        S.read_jsonl(spark, str(p), ROW).collect()
    p.write_text('{"event_id": "a", "n": 1}\n{"event_id": "a", "n": 2}\n')
    with pytest.raises(ValueError):
        S.read_jsonl_by_key(spark, str(p), ROW, "event_id")


def test_document(spark, tmp_path):
    p = tmp_path / "d.json"
    S.write_json_document({"events": [{"event_id": "ä", "n": 1}]}, str(p))
    doc = T.StructType([T.StructField("events", T.ArrayType(ROW))])
    assert [tuple(r) for r in S.read_json_document(spark, str(p), doc, "events").collect()] == [("ä", 1)]
    assert p.read_text().endswith("}\n")


def test_ledger(spark, tmp_path):
    p = str(tmp_path / "l.csv")
    rows = spark.createDataFrame([("a", "PENDING", None), ("b", "PENDING", 'x, "y"')], "event_id string, review string, notes string")
    S.write_ledger(rows, p, {"review": "PENDING"})
    assert [tuple(r) for r in S.read_ledger(spark, p, "event_id").orderBy("event_id").collect()] == [("a", "PENDING", ""), ("b", "PENDING", 'x, "y"')]
    S.write_ledger(rows, p, {"review": "PENDING"})
    done = spark.createDataFrame([("a", "PASS", "")], "event_id string, review string, notes string")
    S.write_ledger(done, p, {"review": "PENDING"})
    with pytest.raises(FileExistsError):
        S.write_ledger(rows, p, {"review": "PENDING"})
    S.write_ledger(rows, p, {"review": "PENDING"}, overwrite=True)
    S.write_ledger(rows.union(rows), p, {}, overwrite=True)
    with pytest.raises(ValueError):
        S.read_ledger(spark, p, "event_id")


def test_archives_and_classes(spark, tmp_path):
    p = tmp_path / "z.zip"
    code = 'class Task{n}:\n    """doc {v}"""\n    GOAL = "g{v}"\n    def f(self):\n        return [FunctionCall(function="send"), FunctionCall(function="send"), FunctionCall(function="read")]\n'
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("data/query_BO_MA.json", '[{"event_id": "a", "n": 1}, {"event_id": "b", "n": 2}]')
        z.writestr("s/v1_2/t.py", code.format(n=1, v="old"))
        z.writestr("s/v1_10/t.py", code.format(n=1, v="new"))
        z.writestr("s/v1_10/bad.py", "class (")
    rows = S.read_archive_rows(spark, str(p), r"query_(BO|PD|PI|PL)_(MA|SA)\.json$", ROW).collect()
    assert [(r["row_index"], r["event_id"]) for r in rows] == [(0, "a"), (1, "b")]
    got = S.latest_versions(S.python_classes(S.read_archive(spark, str(p), r"\.py$"))).collect()
    assert [(r["class_name"], r["docstring"], r["attributes"], r["calls"]) for r in got] == [("Task1", "doc new", {"GOAL": "gnew"}, ["send", "read"])]


def test_digests(spark, tmp_path):
    p = tmp_path / "x.bin"
    p.write_bytes(b"abc")
    want = hashlib.sha256(b"abc").hexdigest()
    assert S.file_digests(spark, str(p)).first()["sha256"] == want
    assert S.file_digests(spark, str(p), upper=True).first()["sha256"] == want.upper()


def test_jsonl_sink(spark, tmp_path):
    S.write_jsonl(spark.range(3).withColumnRenamed("id", "n"), str(tmp_path / "o"), ["n"])
    assert spark.read.json(str(tmp_path / "o")).count() == 3


def test_strata_and_text(spark, tmp_path):
    """Every stratum must be there; a policy comes with its digest."""
    import json

    p = tmp_path / "a.zip"
    with zipfile.ZipFile(p, "w") as z:
        for kind in ("BO_MA", "PD_SA"):
            z.writestr(f"data/query_{kind}.json", json.dumps([{"event_id": kind, "n": 1}]))
        z.writestr("data/other.json", "[]")
    pattern = r"query_([A-Z]{2}_[A-Z]{2})\.json$"
    assert {(r["stratum"], r["row_index"], r["event_id"]) for r in S.read_strata(spark, str(p), pattern, ROW, 2).collect()} == {("BO_MA", 0, "BO_MA"), ("PD_SA", 0, "PD_SA")}
    with pytest.raises(ValueError, match="8 strata"):
        S.read_strata(spark, str(p), pattern, ROW, 8)
    t = tmp_path / "policy.txt"
    t.write_bytes("Sei höflich.\n".encode())
    assert S.read_text(spark, str(t)) == ("Sei höflich.\n", hashlib.sha256(t.read_bytes()).hexdigest())


def test_command_line(spark, sf_dir, tmp_path, capsys):
    import json

    from loomgate.__main__ import main

    assert main(["list"]) == 0 and "t_gates" in capsys.readouterr().out
    assert main(["query", "nonsense", sf_dir]) == 2
    assert main(["query", "a_counts_by_source_split", sf_dir]) == 0
    assert all("n_hard" in json.loads(x) for x in capsys.readouterr().out.splitlines())
    assert main(["query", "w_terciles", sf_dir, "--out", str(tmp_path / "t")]) == 0 and spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert main(["audit", sf_dir, "--out", str(tmp_path / "audit.json")]) == 1
    assert json.loads((tmp_path / "audit.json").read_text())["status"] == "fail"
