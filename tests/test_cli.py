"""The command line over one document, from package to export."""

from __future__ import annotations

import json
import os

import pytest

from spanloom import cli
from spanloom.sources import docx, workbook


def call(capsys, *args):
    cli.main(list(map(str, args)))
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


@pytest.mark.skipif(not os.environ.get("SPANLOOM_SLOW"), reason="takes minutes: set SPANLOOM_SLOW")
def test_commands(spark, tmp_path, capsys):
    rows = [{"segment_id": f"s{i:06d}", "text": t, "locator": None} for i, t in enumerate(["Kim Lee: Hallo zusammen", "Mail: kim@lee.de"], 1)]
    docx.write_docx(rows, tmp_path / "a.docx")
    assert call(capsys, "inspect", tmp_path / "a.docx")[0]["segments"] == 2
    run = tmp_path / "run"
    assert call(capsys, "prepare", tmp_path / "a.docx", run)["revision"] == 1
    assert call(capsys, "status", run)[0]["groups"] == 2
    book = call(capsys, "review", run, tmp_path)["workbook"]
    view, _ = cli.review_view(spark, str(run))
    data = workbook.build_workbook(view | {"signed_off_by": "R. Viewer"})
    (tmp_path / "signed.xlsx").write_bytes(data)
    assert book.endswith("a - review.xlsx")
    assert call(capsys, "import", run, tmp_path / "signed.xlsx")["signed_off_by"] == "R. Viewer"
    assert call(capsys, "export", run, tmp_path / "out", "--docx")["revision"] == 2
    clean = docx.parse_docx((tmp_path / "out" / "a.clean.docx").read_bytes())[0]
    assert [r["text"] for r in clean] == ["PERSON_001: Hallo zusammen", "Mail: EMAIL_001"]
    with pytest.raises(SystemExit):
        cli.main(["export", str(run), str(tmp_path / "out")])


@pytest.mark.skipif(not os.environ.get("SPANLOOM_SLOW"), reason="takes minutes: set SPANLOOM_SLOW")
def test_evaluate_and_selftest(spark, tmp_path, capsys):
    corpus = [{"id": "d", "segments": [{"id": "s1", "text": "Mail: kim@lee.de"}], "annotations": [{"segment_id": "s1", "start": 6, "end": 16, "category": "email"}]}]
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    out = call(capsys, "evaluate", tmp_path / "c.json")
    assert out["detection"]["tp"] == 1 and out["replacement_quality"]["non_pii_masked_characters"] == 0
    assert call(capsys, "selftest") == {"ok": True}
