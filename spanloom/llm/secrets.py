"""Secret scans with structural confirmation.

Base candidates come from three patterns.  The method then looks for encoded
keys: base64 and hex runs are decoded and reported only if their structure holds
up: a DER element whose nested lengths fill it exactly, a length-prefixed
private-key container, or a signed token whose header is JSON with an ``alg``.  Keys
may stand behind a path or prefix, be wrapped over lines, be armoured with or without
header lines, or follow an odd digit of hex.

Spans are in code points, end exclusive, and cover the whole match.  The scan is
one pass without exchange; a text is handled alone, so memory is bounded by a
batch.  Defined results: a null text is empty; an empty text has no spans and the
digest of the empty string; a null id passes through, of any type; rows are independent, so
repeated rows have equal results; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import documents

#: Kinds in the order that breaks ties; the first three are the base.
KINDS = ("assign", "access", "hex", "der", "pem", "keyfile", "token")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{16,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")
#: One alphabet each; encoded keys are never shorter than ``LEAST`` bytes.
LEAST = 24
ALPHABETS = (re.compile(r"[A-Za-z0-9+/]{32,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{32,}={0,2}"))
#: Lines of one alphabet, indented or not, as a key that is wrapped.
WRAPPED = re.compile(r"(?m)^[ \t]*[A-Za-z0-9+/]{16,}[ \t]*(?:\r?\n[ \t]*[A-Za-z0-9+/]{4,}={0,2}[ \t]*)+$")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}(?:KEY|CERTIFICATE)(?: BLOCK)?)-----([A-Za-z0-9+/=\s\\:,.()@<>_-]{32,}?)-----END \1-----")
_ARMOUR_HEADER = re.compile(r"(?m)^[ \t]*[A-Za-z][A-Za-z0-9-]*:.*$")
KEYFILE_MAGIC = b"openssh-key-v1\0"
#: Prose has spaces: only texts with a run this long are searched for encoded keys.
_LONG_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_KEYFILE_64 = base64.b64encode(KEYFILE_MAGIC).decode()[:19]


def der_head(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """(start, end) of the contents of the DER element at ``at``; None if its length is not sound."""
    if at + 2 > end:
        return None
    length, body = data[at + 1], at + 2
    if length & 0x80:
        width = length & 0x7F
        if not 1 <= width <= 4 or body + width > end or data[body] == 0:
            return None
        length = int.from_bytes(data[body : body + width], "big")
        if length < 0x80:
            return None
        body += width
    return (body, body + length) if body + length <= end else None


def der_element(data: bytes, at: int, end: int) -> int | None:
    """End of the DER element at ``at`` if all nested lengths are sound, however deep, else None."""
    head = der_head(data, at, end)
    if head is None:
        return None
    whole, open_ends, at = head[1], [end], at
    while True:
        body, stop = head
        if data[at] & 0x20:
            open_ends.append(stop)
            at = body
        elif data[at] & 0x1F == 2 and body == stop:
            return None
        else:
            at = stop
        while at == open_ends[-1] and len(open_ends) > 1:
            open_ends.pop()
        if len(open_ends) == 1:
            return whole
        head = der_head(data, at, open_ends[-1])
        if head is None:
            return None


def is_der(data: bytes) -> bool:
    """A sequence that fills the bytes and starts with an integer or a sequence, as keys and certificates do."""
    return len(data) >= LEAST and data[0] == 0x30 and der_element(data, 0, len(data)) == len(data) and data[2 + (data[1] & 0x7F if data[1] & 0x80 else 0)] in (0x02, 0x30)


def is_keyfile(data: bytes) -> bool:
    """Magic, then length-prefixed cipher, derivation and options, then a key count and a public key."""
    if not data.startswith(KEYFILE_MAGIC):
        return False
    at = len(KEYFILE_MAGIC)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if at + 8 > len(data):
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    return 1 <= count <= 16 and at + 8 + int.from_bytes(data[at + 4 : at + 8], "big") <= len(data)


def decode64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token_header(text: str) -> bool:
    data = decode64(text)
    if not data or data[:1] != b"{":
        return False
    try:
        header = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and (header.get("typ") is None or isinstance(header["typ"], str))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    lowered = text.lower()
    if "passw" in lowered or "secret" in lowered or "token" in lowered or "api" in lowered:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def kind_of(data: bytes | None) -> str | None:
    return None if not data else "der" if is_der(data) else "keyfile" if is_keyfile(data) else None


def starts64(run: str) -> Iterator[int]:
    """Places where an encoded key may start: the run's start and those after a separator of paths and names.

    A sequence of elements is left out unless its own length, which its first bytes tell, fills the rest.
    """
    size = len(run.rstrip("="))
    for at in [0, *(m.end() for m in re.finditer(r"[/+_-]", run))]:
        if run.startswith("M", at):
            data = decode64(run[at : at + 8])
            head = data and der_head(data, 0, 1 << 40)
            if head and head[1] == (size - at) * 3 // 4:
                yield at
        elif run.startswith(_KEYFILE_64, at):
            yield at


def wrapped_key(block: str) -> tuple[int, str] | None:
    """Where in a block of lines a wrapped key starts, which runs to the block's end, and its kind."""
    pieces = [(m.start(), m[0]) for m in re.finditer(r"\S+", block)]
    left = sum(len(p.rstrip("=")) for _, p in pieces)
    for i, (at, piece) in enumerate(pieces):
        if piece.startswith(("M", _KEYFILE_64)):
            head = der_head(decode64(piece[:8]) or b"", 0, 1 << 40) if piece[0] == "M" else None
            if piece[0] != "M" or (head and head[1] == left * 3 // 4):
                kind = kind_of(decode64("".join(p for _, p in pieces[i:])))
                if kind:
                    return at, kind
        left -= len(piece.rstrip("="))
    return None


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    if not _LONG_RUN.search(text):
        return []
    found = [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if is_token_header(m[1])]
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            body = re.sub(r"\\n|\\r", "\n", m[2])
            if kind_of(decode64(re.sub(r"\s", "", _ARMOUR_HEADER.sub("", body)))):
                found.append((m.start(), m.end(), "pem"))
    found.sort()
    taken, last = [a for a, _, _ in found], 0
    ends = []
    for _, b, _ in found:
        last = max(last, b)
        ends.append(last)
    inside = lambda a, b: (i := bisect.bisect_right(taken, a) - 1) >= 0 and b <= ends[i]
    for m in WRAPPED.finditer(text):
        got = None if inside(m.start(), m.end()) else wrapped_key(m[0])
        if got:
            found.append((m.start() + got[0], m.start() + len(m[0].rstrip()), got[1]))
    for m in (m for alphabet in ALPHABETS for m in alphabet.finditer(text)):
        if inside(m.start(), m.end()):
            continue
        for at in starts64(m[0]):
            kind = kind_of(decode64(m[0][at:]))
            if kind:
                found.append((m.start() + at, m.end(), kind))
                break
    for m in LONG_HEX.finditer(text):
        run, odd = m[0], len(m[0]) % 2
        for a, b in ((0, len(run) - odd), (1, len(run)))[: 1 + odd]:
            kind = kind_of(bytes.fromhex(run[a:b]))
            if kind:
                found.append((m.start() + a, m.start() + b, kind))
                break
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in order)


def find_secrets(text: str | None) -> tuple[int, int, int, str, str]:
    """Counts of the base kinds, the base spans and all spans."""
    text = text or ""
    base = base_spans(text)
    kinds = [k for _, _, k in base]
    own = joined(base)
    more = structural_spans(text)
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), own, joined(base + more) if more else own


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, base spans and all spans."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find_secrets(t.as_py()) for t in batch.column(1)]
            a, b, c, base, spans = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
            )

    return slim.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def redact(text: str, spans: str, mask: str = "[secret]") -> str:
    """The text without the spans that ``scan`` reports."""
    out, at = [], 0
    for span in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans.split(",") if s)):
        if span[1] <= at:
            continue
        out += [text[at : max(at, span[0])], mask]
        at = span[1]
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    rows = scan(documents(spark, sf_dir))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
