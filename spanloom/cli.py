"""Command line: inspect, prepare, status, review, import, export, evaluate, self-test.

Documents are Word files or Parquet tables (doc_id, text).  Review workbooks hold one
document's control data, so a run over many documents is reviewed through tables.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import evaluate, rank, resolve, review
from spanloom.operators.detect import SparkDetector
from spanloom.plans import workflow
from spanloom.policy import load_policy
from spanloom.runtime import ship
from spanloom.schemas import SpanloomError
from spanloom.sources import docx, segments, workbook
from spanloom.sources.packages import write_atomic

MAX_REVIEW_ROWS = 100_000


def session(master: str | None) -> SparkSession:
    builder = SparkSession.builder.appName("spanloom").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(master) if master else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def read_input(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".docx"):
        return docx.read_docx(spark, path)[0]
    return segments.from_documents(spark.read.parquet(path))


def detector(policy: str | None) -> SparkDetector:
    return SparkDetector(load_policy(Path(policy).read_text() if policy else None))


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    rows = [r.asDict(recursive=True) for r in df.limit(MAX_REVIEW_ROWS + 1).collect()]
    if len(rows) > MAX_REVIEW_ROWS:
        raise SpanloomError("review: too many rows for a workbook; use the tables")
    return rows


def review_view(spark: SparkSession, run: str) -> tuple[dict[str, Any], str]:
    """The workbook's view of a run with one document, and the document's id."""
    view = workflow.view(spark, run)
    docs = [r["doc_id"] for r in view["passages"].select("doc_id").distinct().limit(2).collect()]
    if len(docs) != 1:
        raise SpanloomError("review: a workbook holds exactly one document")
    tables = {"groups": view["groups"].orderBy("token"), "passages": view["passages"].orderBy(F.desc("score"), "id"), "occurrences": view["occurrences"].orderBy("segment_id", "id")}
    return {k: view[k] for k in workbook.META} | {k: _rows(df.drop("doc_id")) for k, df in tables.items()}, docs[0]


def do_inspect(spark: SparkSession, a: argparse.Namespace) -> Any:
    return _rows(segments.summary(read_input(spark, a.source)))


def do_prepare(spark: SparkSession, a: argparse.Namespace) -> Any:
    state = workflow.prepare(read_input(spark, a.source), a.run, detector(a.policy), a.sample)
    return {k: state[k] for k in ("run_id", "revision", "candidate_sha256")}


def do_status(spark: SparkSession, a: argparse.Namespace) -> Any:
    return _rows(workflow.status(spark, a.run))


def do_review(spark: SparkSession, a: argparse.Namespace) -> Any:
    view, doc = review_view(spark, a.run)
    target = Path(a.out) / workbook.review_name(Path(doc).stem)
    workbook.write_workbook(view, target)
    return {"workbook": str(target)}


def do_import(spark: SparkSession, a: argparse.Namespace) -> Any:
    view, doc = review_view(spark, a.run)
    back = workbook.read_workbook(Path(a.workbook).read_bytes(), view)
    current = workflow.view(spark, a.run)
    returned: dict[str, Any] = {k: view[k] for k in ("run_id", "revision", "candidate_sha256")} | {"signed_off_by": back["signed_off_by"]}
    for table in ("groups", "passages", "occurrences"):
        trusted, edited = current[table], workbook.EDITABLE[table]
        rows = [(doc, r["id"], *(str(r[c]) for c in edited)) for r in back[table]]
        changed = spark.createDataFrame(rows, "doc_id string, id string, " + ", ".join(f"{c} string" for c in edited))
        returned[table] = trusted.drop(*edited).join(changed, ["doc_id", "id"]).select(*trusted.columns)
    state = workflow.import_review(spark, a.run, returned, detector(a.policy))
    return {k: state[k] for k in ("revision", "candidate_sha256", "signed_off_by")}


def do_export(spark: SparkSession, a: argparse.Namespace) -> Any:
    manifest = workflow.export(spark, a.run, a.dest)
    if a.docx:
        rendered = workflow.load(spark, a.run)[1]["rendered"]
        for r in docx.to_packages(rendered.select("doc_id", "seg_no", "segment_id", "text", "locator")).toLocalIterator():
            write_atomic(Path(a.dest) / f"{Path(r['doc_id']).stem}.clean.docx", bytes(r["content"]))
    return manifest


def do_evaluate(spark: SparkSession, a: argparse.Namespace) -> Any:
    seg, gold = segments.read_corpus(spark, a.corpus)
    if bad := evaluate.corpus_violations(seg, gold).limit(5).collect():
        raise SpanloomError("corpus: " + ", ".join(f"{b['doc_id']} {b['violation']}" for b in bad))
    found = detector(a.policy).transform(seg).persist()
    selected = resolve.resolve(found, seg)[0]
    rest = evaluate.residuals(gold, selected, seg)
    ranked = rank.rank_retained(seg, review.render_placeholder(seg, selected), found, selected, 0)
    curve = evaluate.inspection_curve(evaluate.ranked_order(ranked, seg), rest)
    return {
        "detection": _rows(evaluate.metrics_total(found, gold, seg))[0],
        "by_category": _rows(evaluate.metrics_by_category(found, gold)),
        "documents": _rows(evaluate.document_residuals(gold, found, rest)),
        "replacement_quality": _rows(evaluate.replacement_quality(gold, selected, seg))[0],
        "effort": _rows(evaluate.effort(curve)),
    }


def do_selftest(spark: SparkSession, a: argparse.Namespace) -> Any:
    seg = spark.createDataFrame([("d", 1, "s000001", "Kim Muster: Schreib an kim@beispiel.de")], "doc_id string, seg_no int, segment_id string, text string")
    found = SparkDetector().transform(seg)
    selected, _ = resolve.resolve(found, seg)
    text = review.render(seg, review.effective(selected, review.entity_groups(selected, seg))).first()["text"]
    if "kim@" in text or "EMAIL_001" not in text:
        raise SpanloomError("self-test: the address still shows")
    return {"ok": True}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spanloom")
    parser.add_argument("--master", default=None, help="Spark master; the environment's own if absent")
    sub = parser.add_subparsers(dest="command", required=True)
    spec: dict[str, list[tuple[str, dict[str, Any]]]] = {
        "inspect": [("source", {})],
        "prepare": [("source", {}), ("run", {}), ("--policy", {}), ("--sample", {"type": int, "default": 5})],
        "status": [("run", {})],
        "review": [("run", {}), ("out", {})],
        "import": [("run", {}), ("workbook", {}), ("--policy", {})],
        "export": [("run", {}), ("dest", {}), ("--docx", {"action": "store_true"})],
        "evaluate": [("corpus", {}), ("--policy", {})],
        "selftest": [],
    }
    for name, args in spec.items():
        p = sub.add_parser(name)
        for arg, options in args:
            p.add_argument(arg, **options)
    a = parser.parse_args(argv)
    try:
        print(json.dumps(globals()[f"do_{a.command}"](session(a.master), a), ensure_ascii=False, default=str))
    except SpanloomError as e:
        print(f"spanloom: {e}", file=sys.stderr)
        raise SystemExit(2) from None


if __name__ == "__main__":
    main()
