"""Packages, documents, workbooks, corpora, runs, streaming."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spanloom.operators.detect import SparkDetector
from spanloom.operators.eta import eta_ranges, format_eta, windowed_points
from spanloom.plans import workflow
from spanloom.schemas import SpanloomError
from spanloom.sources import docx, packages, segments, workbook
from spanloom.streaming.ingest import ingest


def pack(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


@pytest.mark.parametrize("name", ["", "/a", "a/../b", "a\\b", "C:x", "a//b", "a\0b"])
def test_unsafe_members(name):
    with pytest.raises(SpanloomError):
        packages.check_member_name(name)


def test_package_guards():
    with pytest.raises(SpanloomError):
        packages.read_package(b"no zip")
    with pytest.raises(SpanloomError):
        packages.read_package(pack({"a": "1", "A": "2"}))
    with pytest.raises(SpanloomError):
        packages.parse_xml(b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')


ROWS = [
    {"segment_id": "s000001", "text": "Zeile\tmit 😀\nUmbruch & <Zeichen>", "locator": {"part": "word/document.xml", "kind": "paragraph", "table": None, "row": None, "cell": None, "paragraph": 0}},
    {"segment_id": "s000002", "text": "oben", "locator": {"part": "word/document.xml", "kind": "table-cell", "table": 0, "row": 0, "cell": 0, "paragraph": 0}},
    {"segment_id": "s000003", "text": "", "locator": {"part": "word/document.xml", "kind": "table-cell", "table": 0, "row": 0, "cell": 1, "paragraph": 0}},
    {"segment_id": "s000004", "text": "Ende", "locator": None},
]


def test_docx_round_trip(spark, tmp_path):
    docx.write_docx(ROWS, tmp_path / "a.docx")
    seg, inventory = docx.read_docx(spark, str(tmp_path / "a.docx"))
    assert [r["text"] for r in seg.orderBy("seg_no").collect()] == [r["text"] for r in ROWS]
    assert {r["part"]: r["action"] for r in inventory.collect()}["word/document.xml"] == "extracted"
    built = docx.to_packages(seg).first()["content"]
    assert [r["text"] for r in docx.parse_docx(bytes(built))[0]] == [r["text"] for r in ROWS]


def test_docx_refuses_tracked_changes():
    data = packages.read_package(docx.build_docx(ROWS[:1]))
    data["word/document.xml"] = data["word/document.xml"].replace(b"<w:r>", b"<w:ins/><w:r>")
    with pytest.raises(SpanloomError):
        docx.parse_docx(pack(data))


def view():
    return {
        "schema_version": 1, "run_id": "r", "revision": 3, "candidate_sha256": "ab", "signed_off_by": "",
        "groups": [{"id": "g1", "source": "=1+1", "aliases": "A | a", "category": "person", "token": "PERSON_001", "count": 2, "context": "c", "action": "accept", "replacement": "", "note": ""}],
        "passages": [{"id": "s1", "source": "x", "text": "y", "score": 0.25, "reasons": "z", "outcome": "uninspected", "action": "keep", "replacement": "", "note": ""}],
        "occurrences": [],
    }


def test_workbook_round_trip(tmp_path):
    v = view()
    data = workbook.build_workbook(v)
    assert b"<f>" not in packages.read_package(data)["xl/worksheets/sheet2.xml"]
    back = workbook.read_workbook(data, v)
    assert back["groups"][0]["source"] == "=1+1" and back["passages"][0]["outcome"] == "uninspected"
    for key, value in (("revision", 4), ("run_id", "q")):
        with pytest.raises(SpanloomError):
            workbook.read_workbook(data, v | {key: value})
    for change in ({"token": "X"}, {"id": "g2"}):
        with pytest.raises(SpanloomError):
            workbook.read_workbook(data, v | {"groups": [v["groups"][0] | change]})
    with pytest.raises(SpanloomError):
        workbook.build_workbook(v | {"groups": [v["groups"][0] | {"note": "x" * 40_000}]})
    with pytest.raises(SpanloomError):
        workbook.preflight(pack({**packages.read_package(data), "xl/vbaProject.bin": b""}))


def test_names_and_cells():
    assert workbook.review_name("Bericht") == "Bericht - review.xlsx"
    assert workbook.review_name("a/b").startswith("a_b-") and len(workbook.review_name("ü" * 200).encode()) < 160
    assert workbook.column_letters(28) == "AB" and workbook.cell_place("AB12") == (12, 28)


def test_corpus(spark, tmp_path):
    docs = [{"id": "d1", "segments": [{"id": "s1", "text": "Kim"}, {"id": "s2", "text": ""}], "annotations": [{"segment_id": "s1", "start": 0, "end": 3, "category": "person"}]}]
    (tmp_path / "c.json").write_text(json.dumps(docs))
    seg, gold = segments.read_corpus(spark, str(tmp_path / "c.json"))
    assert seg.count() == 2 and gold.first()["category"] == "person"
    assert segments.segment_violations(seg.unionByName(seg)).first()["violation"] == "duplicate_segment"


def test_run_life(spark, tmp_path):
    seg = spark.createDataFrame([("d", 1, "s000001", "Kim Lee: Hallo zusammen"), ("d", 2, "s000002", "Mail: kim@lee.de, Kim Lee."), ("d", 3, "s000003", "Nichts weiter")], "doc_id string, seg_no int, segment_id string, text string")
    run = tmp_path / "run"
    detector = SparkDetector()
    state = workflow.prepare(seg, run, detector)
    assert state["revision"] == 1
    with pytest.raises(SpanloomError):
        workflow.prepare(seg, run, detector)
    with pytest.raises(SpanloomError):
        workflow.export(spark, run, tmp_path / "out")
    v = workflow.view(spark, run)
    groups = {r["category"]: r for r in v["groups"].collect()}
    assert groups["person"]["token"] == "PERSON_001" and groups["email"]["count"] == 1
    assert workflow.status(spark, run).first()["passages"] == 3
    base = {k: v[k] for k in ("run_id", "revision", "candidate_sha256")}
    same = base | {"signed_off_by": "", "groups": v["groups"], "passages": v["passages"], "occurrences": v["occurrences"]}
    changed = same | {"groups": v["groups"].withColumn("action", F.when(F.col("category") == "email", "remove").otherwise(F.col("action")))}
    with pytest.raises(SpanloomError):  # stale
        workflow.import_review(spark, run, changed | {"revision": 7}, detector)
    with pytest.raises(SpanloomError):  # no detector for a change
        workflow.import_review(spark, run, changed)
    leak = v["groups"].withColumn("action", F.lit("replace")).withColumn("replacement", F.lit("jo@lee.de"))
    with pytest.raises(SpanloomError):
        workflow.import_review(spark, run, same | {"groups": leak}, detector)
    state = workflow.import_review(spark, run, changed, detector)
    assert state["revision"] == 2 and workflow.import_review(spark, run, changed, detector)["revision"] == 2
    rendered = {r["segment_id"]: r["text"] for r in workflow.load(spark, run)[1]["rendered"].collect()}
    assert rendered["s000002"] == "Mail: , PERSON_001." and rendered["s000003"] == "Nichts weiter"
    v = workflow.view(spark, run)
    sign = {k: v[k] for k in ("run_id", "revision", "candidate_sha256", "groups", "passages", "occurrences")} | {"signed_off_by": "R. Viewer"}
    assert workflow.import_review(spark, run, sign)["signed_off_by"] == "R. Viewer"
    manifest = workflow.export(spark, run, tmp_path / "out")
    assert manifest["revision"] == 3 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["manifest.json", "segments.parquet"]
    pointer = json.loads((run / "current.json").read_text())
    path = run / "revisions" / pointer["revision"] / "state.json"
    path.write_text(path.read_text() + " ")
    with pytest.raises(SpanloomError):
        workflow.load(spark, run)


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "doc_id long, text string"
    for i in (1, 2):
        spark.createDataFrame([(i, f"mail{i}@beispiel.de schreibt")], schema).coalesce(1).write.mode("append").parquet(str(src))
        ingest(spark, str(src), schema, str(out), str(tmp_path / "ckpt")).awaitTermination(60)
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r["text"] for r in rows) == ["mail1@beispiel.de", "mail2@beispiel.de"]


def test_eta(spark):
    rows = [("t", float(i * 10), i * 5, 100) for i in range(8)]
    df = spark.createDataFrame(rows, "task string, s double, completed long, total long").select("task", F.timestamp_seconds("s").alias("ts"), "completed", "total")
    last = eta_ranges(windowed_points(df)).orderBy(F.desc("ts")).first()
    assert last["completed"] == 35 and abs(last["low"] - 130) < 1e-6 and abs(last["high"] - 156) < 1e-6
    assert format_eta(130, 156) == "3 min left" and format_eta(1, 50) == "under a minute left"
