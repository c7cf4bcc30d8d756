"""Word documents as segments, and back.

Everything that holds text is read or refused, never dropped in silence.  Packages
are read on the executors from the ``binaryFile`` source, one document a row.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schemas import INVENTORY, LOCATOR, SpanloomError
from spanloom.sources.packages import CONTENT_TYPES, NS_RELS, NS_TYPES, build_package, content_types, parse_xml, read_package, relationships, write_atomic

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
# Elements with text that this reader does not support.
REFUSED = {"ins", "del", "moveFrom", "moveTo", "fldSimple", "fldChar", "instrText", "delText", "sdt", "txbxContent", "object", "pict", "footnoteReference", "endnoteReference", "commentReference", "altChunk"}
MAX_TEXT_BYTES = 16 << 20
MAX_SEGMENTS = 100_000
ALLOWED = {CONTENT_TYPES, "_rels/.rels", "word/document.xml"}


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _check(root: ET.Element) -> None:
    for e in root.iter():
        if not isinstance(e.tag, str):
            continue
        if _local(e) in REFUSED:
            raise SpanloomError("document: unsupported content")
        if not e.tag.startswith(f"{{{W}}}") and (e.text or "").strip():
            raise SpanloomError("document: text of a foreign namespace")


def _text(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        kind = _local(e)
        if kind == "t":
            out.append(e.text or "")
        elif kind == "tab" and e.get(f"{{{W}}}val") is None:
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
    text = "".join(out)
    if len(text.encode()) > MAX_TEXT_BYTES:
        raise SpanloomError("document: a paragraph is too long")
    return text


def _blocks(body: ET.Element, part: str, kind: str) -> list[dict[str, Any]]:
    """Paragraphs and table cells in order."""
    out: list[dict[str, Any]] = []
    n_par = n_table = 0
    spot = lambda **x: {"part": part, "kind": kind, "table": None, "row": None, "cell": None, "paragraph": None} | x
    for e in body:
        if _local(e) == "p":
            out.append({"text": _text(e), "locator": spot(paragraph=n_par)})
            n_par += 1
        elif _local(e) == "tbl":
            for r, row in enumerate(x for x in e if _local(x) == "tr"):
                for c, cell in enumerate(x for x in row if _local(x) == "tc"):
                    if any(_local(x) == "tbl" for x in cell.iter()):
                        raise SpanloomError("document: nested tables")
                    paragraphs = [x for x in cell if _local(x) == "p"]
                    for i, p in enumerate(paragraphs):
                        out.append({"text": _text(p), "locator": spot(kind="table-cell", table=n_table, row=r, cell=c, paragraph=i)})
                    if not paragraphs:
                        out.append({"text": "", "locator": spot(kind="table-cell", table=n_table, row=r, cell=c, paragraph=0)})
            n_table += 1
    return out


def parse_docx(data: bytes) -> tuple[list[dict[str, Any]], list[dict[str, str]]]:
    """(segments, inventory) of one package."""
    parts = read_package(data)
    types = content_types(parts)
    main = [n for n, t in types.items() if t == MAIN_TYPE]
    if len(main) != 1:
        raise SpanloomError("document: exactly one main part is needed")
    root = parse_xml(parts[main[0]])
    _check(root)
    body = root.find(f"{{{W}}}body")
    if body is None:
        raise SpanloomError("document: no body")
    segments = _blocks(body, main[0], "paragraph")
    used = {main[0]}
    extra = sorted(target for _, kind, target in relationships(parts, main[0]) if kind.rpartition("/")[2] in ("header", "footer"))
    for part in extra:
        tree = parse_xml(parts[part])
        _check(tree)
        for block in _blocks(tree, part, "header-or-footer"):
            segments.append(block)
        used.add(part)
    if len(segments) > MAX_SEGMENTS:
        raise SpanloomError("document: too many segments")
    rows = [{"seg_no": i, "segment_id": f"s{i:06d}", **s} for i, s in enumerate(segments, 1)]
    inventory = []
    for n in sorted(parts):
        if n in used:
            inventory.append({"part": n, "action": "extracted", "reason": "text"})
        elif n == CONTENT_TYPES or n.endswith(".rels"):
            inventory.append({"part": n, "action": "removed", "reason": "package structure"})
        elif n.startswith("word/") and n.endswith(".xml") and n.rpartition("/")[2].startswith(("footnotes", "endnotes", "comments")) and "".join(parse_xml(parts[n]).itertext()).strip():
            raise SpanloomError("document: a part with text is not supported")
        else:
            inventory.append({"part": n, "action": "removed", "reason": "not text"})
    return rows, inventory


def read_docx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, inventory) of all documents under a path; doc_id is the file's path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    locator = LOCATOR.simpleString()

    def run(which: int):
        def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [{"doc_id": p, **r} for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in parse_docx(bytes(c))[which]]
                columns = ["doc_id", "seg_no", "segment_id", "text", "locator"] if which == 0 else [f.name for f in INVENTORY.fields]
                yield pd.DataFrame(rows, columns=columns)

        return inner

    segments = files.mapInPandas(run(0), f"doc_id string, seg_no int, segment_id string, text string, locator {locator}")
    return segments, files.mapInPandas(run(1), ", ".join(f"{f.name} string" for f in INVENTORY.fields))


def _run(text: str) -> str:
    out, plain = [], ""

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append(f'<w:t xml:space="preserve">{escape(plain)}</w:t>')
        plain = ""

    for ch in text:
        if ch == "\t":
            flush()
            out.append("<w:tab/>")
        elif ch == "\n":
            flush()
            out.append("<w:br/>")
        elif ord(ch) < 32:
            raise SpanloomError("document: control characters can't be written")
        else:
            plain += ch
    flush()
    return f"<w:p><w:r>{''.join(out)}</w:r></w:p>" if out else "<w:p/>"


def build_docx(segments: list[dict[str, Any]]) -> bytes:
    """A minimal package; consecutive cells of a table become that table again, with gaps filled."""
    ids = [s["segment_id"] for s in segments]
    if len(set(ids)) != len(ids):
        raise SpanloomError("document: segment ids are repeated")
    body, i = [], 0
    while i < len(segments):
        spot = segments[i].get("locator") or {}
        if spot.get("kind") != "table-cell":
            body.append(_run(segments[i]["text"]))
            i += 1
            continue
        cells: dict[int, dict[int, list[str]]] = {}
        same = (spot.get("part"), spot.get("table"))
        while i < len(segments) and (x := segments[i].get("locator") or {}).get("kind") == "table-cell" and (x.get("part"), x.get("table")) == same:
            cells.setdefault(x["row"], {}).setdefault(x["cell"], []).append(_run(segments[i]["text"]))
            i += 1
        rows = "".join("<w:tr>" + "".join(f"<w:tc>{''.join(row.get(c, ['<w:p/>']))}</w:tc>" for c in range(max(row) + 1)) + "</w:tr>" for r in range(max(cells) + 1) for row in [cells.get(r, {0: ["<w:p/>"]})])
        body.append(f"<w:tbl>{rows}</w:tbl>")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    return build_package(
        {
            CONTENT_TYPES: f'{head}<Types xmlns="{NS_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{MAIN_TYPE}"/></Types>'.encode(),
            "_rels/.rels": f'{head}<Relationships xmlns="{NS_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>'.encode(),
            "word/document.xml": f'{head}<w:document xmlns:w="{W}"><w:body>{"".join(body)}</w:body></w:document>'.encode(),
        }
    )


def validate_output(data: bytes) -> None:
    """Exactly the allowed parts, readable again."""
    if set(read_package(data)) != ALLOWED:
        raise SpanloomError("document: the output holds other parts")
    parse_docx(data)


def write_docx(segments: list[dict[str, Any]], path: str | Path) -> None:
    data = build_docx(segments)
    validate_output(data)
    write_atomic(path, data)


def to_packages(segments: DataFrame) -> DataFrame:
    """doc_id, content: one package a document, built on the executors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("seg_no").to_dict("records")
        for r in rows:
            spot = r.get("locator")
            r["locator"] = spot.asDict() if hasattr(spot, "asDict") else dict(spot) if spot is not None else None
            for k in ("table", "row", "cell"):
                if r["locator"] and r["locator"].get(k) is not None:
                    r["locator"][k] = int(r["locator"][k])
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [build_docx(rows)]})

    return segments.groupBy("doc_id").applyInPandas(run, "doc_id string, content binary")


def validation_report(segments: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, segments, characters, findings, categories: the bounded report per input."""
    s = segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("characters"))
    f = findings.groupBy("doc_id", "category").count().groupBy("doc_id").agg(F.sum("count").alias("findings"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count")))).alias("categories"))
    return s.join(f, "doc_id", "left").fillna(0, ["findings"])
