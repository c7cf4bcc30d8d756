"""Review workbooks: decision tables as a spreadsheet and back, with the standard library only.

Strings are inline and never formulas.  A workbook is one document's control data,
so it is built and read on the driver; the checks of what came back are joins
(``spanloom.operators.review.decision_violations``).
"""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any
from xml.sax.saxutils import escape, quoteattr

from spanloom.schemas import GROUP_ACTIONS, OCCURRENCE_ACTIONS, OUTCOMES, PASSAGE_ACTIONS, SpanloomError
from spanloom.sources.packages import CONTENT_TYPES, NS_RELS, NS_TYPES, build_package, content_types, parse_xml, read_package, relationships, write_atomic

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAX_CELL_UNITS = 32_767
MAX_ROWS = 100_000
SHEETS = {"groups": "Replacements", "passages": "Ranked passages", "occurrences": "Occurrences"}
COLUMNS = {
    "groups": ["id", "source", "aliases", "category", "token", "count", "context", "action", "replacement", "note"],
    "passages": ["id", "source", "text", "score", "reasons", "outcome", "action", "replacement", "note"],
    "occurrences": ["id", "group_id", "segment_id", "source", "context", "action", "replacement", "note"],
}
EDITABLE = {"groups": ["action", "replacement", "note"], "passages": ["outcome", "action", "replacement", "note"], "occurrences": ["action", "replacement", "note"]}
CHOICES = {("groups", "action"): GROUP_ACTIONS, ("passages", "action"): PASSAGE_ACTIONS, ("passages", "outcome"): OUTCOMES, ("occurrences", "action"): OCCURRENCE_ACTIONS}
META = ["schema_version", "run_id", "revision", "candidate_sha256", "signed_off_by"]
FIRST_ROW = 2


def column_letters(n: int) -> str:
    """1 is A, 27 is AA."""
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def cell_place(ref: str) -> tuple[int, int]:
    """(row, column) of a reference such as AB12."""
    m = re.fullmatch(r"([A-Z]{1,3})([1-9][0-9]{0,6})", ref)
    if not m:
        raise SpanloomError("workbook: a cell reference is malformed")
    column = 0
    for ch in m[1]:
        column = column * 26 + ord(ch) - 64
    return int(m[2]), column


def _cell(row: int, column: int, value: Any, locked: bool) -> str:
    ref, style = f"{column_letters(column)}{row}", 0 if locked else 1
    if value is None:
        return ""
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f'<c r="{ref}" s="{style}"><v>{value!r}</v></c>'
    text = str(value)
    if len(text.encode("utf-16-le")) // 2 > MAX_CELL_UNITS or re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", text):
        raise SpanloomError("workbook: a text does not fit a cell")
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(table: str, rows: list[dict[str, Any]]) -> str:
    columns = COLUMNS[table]
    lines = ["".join(_cell(1, i, c, True) for i, c in enumerate(columns, 1))]
    lines += ["".join(_cell(r, i, row.get(c), c not in EDITABLE[table]) for i, c in enumerate(columns, 1)) for r, row in enumerate(rows, FIRST_ROW)]
    body = "".join(f'<row r="{r}">{cells}</row>' for r, cells in enumerate(lines, 1))
    rules = ""
    for i, c in enumerate(columns, 1):
        if (table, c) in CHOICES and rows:
            letters, last = column_letters(i), FIRST_ROW + len(rows) - 1
            listed = quoteattr(",".join(CHOICES[table, c]))[1:-1]
            rules += f'<dataValidation type="list" allowBlank="0" sqref="{letters}{FIRST_ROW}:{letters}{last}"><formula1>"{listed}"</formula1></dataValidation>'
    count = rules.count("<dataValidation ")
    return (
        f'<worksheet xmlns="{_NS}"><sheetData>{body}</sheetData><sheetProtection sheet="1" objects="1" scenarios="1"/>'
        + (f'<dataValidations count="{count}">{rules}</dataValidations>' if count else "") + "</worksheet>"
    )


def build_workbook(view: dict[str, Any]) -> bytes:
    """view: the META keys and the tables groups, passages, occurrences as lists of rows."""
    intro = [["Review workbook"], ["Edit the unlocked cells only."], *[[k, view.get(k, "")] for k in META]]
    start = "".join(f'<row r="{r}">{"".join(_cell(r, i, v, not (row[0] == "signed_off_by" and i == 2)) for i, v in enumerate(row, 1))}</row>' for r, row in enumerate(intro, 1))
    sheets = [("Start here", f'<worksheet xmlns="{_NS}"><sheetData>{start}</sheetData><sheetProtection sheet="1"/></worksheet>')]
    for table, title in SHEETS.items():
        if table != "occurrences" or view.get(table):
            sheets.append((title, _sheet(table, view.get(table, []))))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    n = len(sheets)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1))
    listed = "".join(f'<sheet name={quoteattr(t)} sheetId="{i}" r:id="rId{i}"/>' for i, (t, _) in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
    styles = (
        f'<styleSheet xmlns="{_NS}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="2"><xf/><xf applyProtection="1"><protection locked="0"/></xf></cellXfs></styleSheet>'
    )
    parts = {
        CONTENT_TYPES: f'{head}<Types xmlns="{NS_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{NS_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{_NS}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{NS_RELS}">{links}<Relationship Id="rId{n + 1}" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": head + styles,
    } | {f"xl/worksheets/sheet{i}.xml": head + xml for i, (_, xml) in enumerate(sheets, 1)}
    return build_package({k: v.encode() for k, v in parts.items()})


def write_workbook(view: dict[str, Any], path: str | Path) -> None:
    write_atomic(path, build_workbook(view))


def preflight(data: bytes) -> dict[str, bytes]:
    """Parts of a workbook without macros, outside links or connections, and without far-off cells."""
    parts = read_package(data)
    for name in parts:
        if re.search(r"vbaProject|externalLink|connections\.xml|embeddings/|macrosheets/", name, re.IGNORECASE):
            raise SpanloomError("workbook: active or linked content")
    content_types(parts)
    return parts


def _cells(parts: dict[str, bytes], part: str, shared: list[str]) -> dict[int, dict[int, Any]]:
    out: dict[int, dict[int, Any]] = {}
    for c in parse_xml(parts[part]).iter(f"{{{_NS}}}c"):
        row, column = cell_place(c.get("r", ""))
        if row > MAX_ROWS or column > 64:
            raise SpanloomError("workbook: a cell is out of range")
        if c.find(f"{{{_NS}}}f") is not None:
            raise SpanloomError("workbook: formulas are not read")
        kind, v = c.get("t", "n"), c.find(f"{{{_NS}}}v")
        if kind == "inlineStr":
            value: Any = "".join(t.text or "" for t in c.iter(f"{{{_NS}}}t"))
        elif v is None or v.text is None:
            continue
        elif kind == "s":
            value = shared[int(v.text)]
        elif kind == "str":
            value = v.text
        else:
            value = float(v.text) if re.search(r"[.eE]", v.text) else int(v.text)
        out.setdefault(row, {})[column] = value
    return out


def read_workbook(data: bytes, expected: dict[str, Any]) -> dict[str, list[dict[str, Any]]]:
    """Decision tables, in the trusted order; stale metadata or other columns are refused."""
    parts = preflight(data)
    shared = []
    if "xl/sharedStrings.xml" in parts:
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS}}}t")) for si in parse_xml(parts["xl/sharedStrings.xml"])]
    target = {i: t for i, _, t in relationships(parts, "xl/workbook.xml")}
    sheets = {s.get("name"): target.get(s.get(f"{{{_OFFICE}}}id", "")) for s in parse_xml(parts["xl/workbook.xml"]).iter(f"{{{_NS}}}sheet")}
    if "Start here" not in sheets:
        raise SpanloomError("workbook: the first sheet is missing")
    meta = {row.get(1): row.get(2, "") for row in _cells(parts, sheets["Start here"], shared).values()}
    for key in META[:-1]:
        if str(meta.get(key, "")) != str(expected.get(key, "")):
            raise SpanloomError(f"workbook: {key} is stale")
    out: dict[str, Any] = {"signed_off_by": str(meta.get("signed_off_by", ""))}
    for table, title in SHEETS.items():
        trusted = expected.get(table, [])
        if title not in sheets:
            if trusted and table != "occurrences":
                raise SpanloomError("workbook: a sheet is missing")
            out[table] = []
            continue
        cells = _cells(parts, sheets[title], shared)
        columns = COLUMNS[table]
        if [cells.get(1, {}).get(i) for i in range(1, len(columns) + 1)] != columns or len(cells.get(1, {})) != len(columns):
            raise SpanloomError("workbook: the columns changed")
        rows = [{c: row.get(i, "") for i, c in enumerate(columns, 1)} for n, row in sorted(cells.items()) if n >= FIRST_ROW and any(v != "" for v in row.values())]
        by_id = {r["id"]: r for r in rows}
        if len(by_id) != len(rows) or set(by_id) != {r["id"] for r in trusted}:
            raise SpanloomError("workbook: ids are missing, repeated or foreign")
        for t in trusted:
            if any(str(by_id[t["id"]][c]) != str(t.get(c, "")) for c in columns if c not in EDITABLE[table]):
                raise SpanloomError("workbook: a locked cell changed")
        out[table] = [by_id[t["id"]] for t in trusted]
    return out


_UNSAFE = re.compile(r'[<>:"/\\|?*\x00-\x1f]')


def review_name(stem: str) -> str:
    """A file name for a review of a document: safe, at most 120 bytes, told apart by a digest if it was changed."""
    import hashlib

    safe = _UNSAFE.sub("_", stem).strip(" .") or "Document"
    if re.fullmatch(r"(?i)(?:con|prn|aux|nul|com[1-9]|lpt[1-9])", safe.split(".")[0]):
        safe = f"_{safe}"
    while len(safe.encode()) > 120:
        safe = safe[:-1]
    if safe != stem:
        safe = f"{safe.rstrip(' .')}-{hashlib.sha256(stem.encode()).hexdigest()[:8]}"
    return f"{safe} - review.xlsx"
