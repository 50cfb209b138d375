"""Word-processing and spreadsheet files (OpenXML) to text blocks."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file that unpacks to more is refused.
MOST_BYTES = 100 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def kind_of(raw: bytes | None) -> str:
    """The kind of a file by its first bytes."""
    head = (raw or b"")[:8]
    if head.startswith(b"%PDF"):
        return "pdf"
    if head.startswith(b"PK\x03\x04"):
        return "openxml"
    if head.startswith(b"{\\rtf"):
        return "rtf"
    if head.startswith(b"\xd0\xcf\x11\xe0"):
        return "ole"
    if head.startswith((b"\x89PNG", b"GIF8", b"\xff\xd8\xff")):
        return "image"
    return "html" if b"<html" in (raw or b"")[:1024].lower() or head.lstrip()[:1] == b"<" else "text" if raw else "empty"


def _word(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        text = "".join(n.text or "" if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" if n.tag == f"{_W}br" else "" for n in p.iter()).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if text:
            out.append(("heading" if style is not None and style.get(f"{_W}val", "").lower().startswith("heading") else "paragraph", text))
    return out


def _sheet(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    names, shared = z.namelist(), []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    out = []
    for name in sorted(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")):
        for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
            cells = []
            for c in row.iter(f"{_S}c"):
                v = c.find(f"{_S}v")
                if c.get("t") == "s" and v is not None:
                    cells.append(shared[int(v.text)])
                elif c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")))
                elif v is not None:
                    cells.append(v.text or "")
            if any(cells):
                out.append(("row", " | ".join(cells)))
    return out


def _blocks(raw: bytes | None) -> tuple[str, list[tuple[str, str]]]:
    kind = kind_of(raw)
    if kind != "openxml":
        return f"extraction_failed: {kind}", []
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if sum(i.file_size for i in z.infolist()) > MOST_BYTES:
                return "extraction_failed: too large", []
            return "extracted", _word(z) if "word/document.xml" in z.namelist() else _sheet(z)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError) as e:
        return f"extraction_failed: {type(e).__name__}", []


def blocks(files: DataFrame, file_id: str, content: str) -> DataFrame:
    """One row per block, and one without text for a file that gives none, with the reason as its status."""

    def read(batches):
        for pdf in batches:
            out = []
            for i, raw in zip(pdf["file_id"], pdf["content"]):
                status, found = _blocks(None if raw is None else bytes(raw))
                out += [(i, n, k, t, status) for n, (k, t) in enumerate(found, 1)] or [(i, 0, None, None, status)]
            yield pd.DataFrame(out, columns=["file_id", "block_no", "kind", "text", "status"])

    return files.select(F.col(file_id).cast("string").alias("file_id"), F.col(content).alias("content")).mapInPandas(read, "file_id string, block_no int, kind string, text string, status string")
