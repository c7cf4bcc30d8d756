"""Bounded reading and atomic writing of ZIP-based office packages, with the standard library only."""

from __future__ import annotations

import io
import os
import re
import stat
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from pathlib import Path
from xml.parsers import expat

from spanloom.schemas import SpanloomError

# Bounds of a package.
MAX_PARTS = 4096
MAX_PART_BYTES = 32 << 20
MAX_TOTAL_BYTES = 128 << 20
MAX_RATIO = 1000

CONTENT_TYPES = "[Content_Types].xml"
NS_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
NS_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"


def check_member_name(name: str) -> None:
    """No empty, absolute, climbing or drive-like names."""
    parts = name.split("/")
    if not name or "\0" in name or "\\" in name or name.startswith("/") or re.match(r"^[A-Za-z]:", name) or any(p in ("", ".", "..") for p in parts[: -1 if name.endswith("/") else None]):
        raise SpanloomError("package: a member has an unsafe name")


def read_package(data: bytes) -> dict[str, bytes]:
    """Parts of a package; refuses what is encrypted, linked, repeated, too many or too large."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise SpanloomError("package: not a ZIP file") from None
    with archive:
        members = archive.infolist()
        if len(members) > MAX_PARTS:
            raise SpanloomError("package: too many parts")
        names = [m.filename for m in members]
        if len({n.lower() for n in names}) != len(names):
            raise SpanloomError("package: a part is repeated")
        if sum(m.file_size for m in members) > MAX_TOTAL_BYTES:
            raise SpanloomError("package: too large when expanded")
        parts = {}
        for m in members:
            check_member_name(m.filename)
            if m.flag_bits & 1 or stat.S_ISLNK(m.external_attr >> 16):
                raise SpanloomError("package: encrypted or linked parts are not read")
            if m.file_size > MAX_PART_BYTES or m.file_size > MAX_RATIO * max(1, m.compress_size):
                raise SpanloomError("package: a part is too large")
            if not m.is_dir():
                try:
                    parts[m.filename] = archive.read(m)
                except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError):
                    raise SpanloomError("package: a part can't be read") from None
        return parts


def parse_xml(data: bytes) -> ET.Element:
    """An XML tree; declarations of types and entities are refused before anything is expanded."""
    guard = expat.ParserCreate()

    def refuse(*_: object) -> None:
        raise SpanloomError("package: document types and entities are not read")

    guard.StartDoctypeDeclHandler = guard.EntityDeclHandler = refuse
    try:
        guard.Parse(data, True)
        return ET.fromstring(data)
    except (expat.ExpatError, ET.ParseError):
        raise SpanloomError("package: malformed XML") from None


def content_types(parts: dict[str, bytes]) -> dict[str, str]:
    """Type of every part, by its name or else its extension."""
    if CONTENT_TYPES not in parts:
        raise SpanloomError("package: no content types")
    root = parse_xml(parts[CONTENT_TYPES])
    default = {e.get("Extension", "").lower(): e.get("ContentType", "") for e in root if e.tag == f"{{{NS_TYPES}}}Default"}
    own = {e.get("PartName", "").lstrip("/"): e.get("ContentType", "") for e in root if e.tag == f"{{{NS_TYPES}}}Override"}
    found = {n: own.get(n) or default.get(n.rpartition(".")[2].lower(), "") for n in parts if n != CONTENT_TYPES}
    if not all(found.values()):
        raise SpanloomError("package: a part has no type")
    return found


def relationships(parts: dict[str, bytes], part: str) -> list[tuple[str, str, str]]:
    """(id, type, target part); external and dangling targets are refused."""
    folder, _, name = part.rpartition("/")
    source = f"{folder}/_rels/{name}.rels".lstrip("/")
    if source not in parts:
        return []
    out = []
    for e in parse_xml(parts[source]):
        if e.get("TargetMode", "Internal") != "Internal":
            raise SpanloomError("package: external targets are not read")
        target = e.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else os.path.normpath(f"{folder}/{target}".lstrip("/"))
        if path not in parts:
            raise SpanloomError("package: a target is missing")
        out.append((e.get("Id", ""), e.get("Type", ""), path))
    return out


def build_package(parts: dict[str, bytes]) -> bytes:
    """A package with fixed times, so that equal contents give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in parts.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_atomic(path: str | Path, data: bytes) -> None:
    """Write beside the target, flush, then replace."""
    path = Path(path)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
