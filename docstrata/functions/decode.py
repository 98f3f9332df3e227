"""Bytes to text, and documents to text with places: plain text, DOCX, and PDF text layers."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from docstrata.functions.chunking import chunk_code, chunk_text

#: Version of the parser: part of the key under which parsed contents are kept, so that a change parses anew.
PROFILE = "docstrata-1:text-bom:chunk-cjk:c-functions:docx:pages"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bounds on a DOCX part, against archives that unpack to much more than they hold.
MOST_BYTES, MOST_NODES = 64 << 20, 500_000


class ParseError(ValueError):
    """A document that can't be read; ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def decode_text(content: bytes) -> str:
    """Text of UTF-8 or of UTF-16 with a byte order mark, with Unix line ends.

    INVALID_ENCODING if the bytes don't fit; BINARY_FILE for a NUL or more than two and 1 % other control characters.
    """
    encoding = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(content[:2])
    try:
        text = content[2:].decode(encoding) if encoding else content.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
    except UnicodeDecodeError as e:
        raise ParseError("INVALID_ENCODING", str(e)) from e
    if "\0" in text or len(re.findall(r"[\x01-\x08\x0b\x0e-\x1f\x7f]", text)) > max(2, len(text) * 0.01):
        raise ParseError("BINARY_FILE", "binary data or control characters")
    return re.sub("\r\n?", "\n", text)


def pages(text: str) -> list[tuple[int, str]]:
    """The non-blank pages of a text layer whose pages end in form feeds, numbered from 1."""
    return [(i, p) for i, p in enumerate(text.split("\f"), 1) if p.strip()]


def _run_text(node: ET.Element) -> str:
    """The text of a paragraph with insertions accepted and deletions left out."""
    out = []
    for child in node:
        if child.tag in (_W + "del", _W + "moveFrom"):
            continue
        if child.tag == _W + "t":
            out.append(child.text or "")
        elif child.tag == _W + "tab":
            out.append("\t")
        elif child.tag in (_W + "br", _W + "cr"):
            out.append("\n")
        else:
            out.append(_run_text(child))
    return "".join(out)


def docx_blocks(content: bytes) -> tuple[str, list[dict]]:
    """``(title, blocks)``: paragraphs and table rows in order, each with heading path, block id and table number.

    A table's first row is its header and stands before every other row's text. Ids are ``b1``, ``b2`` ..., rows
    ``b3.row1``, list items ``b4.item``. CORRUPT_DOCX if the archive or its document can't be read.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if z.getinfo("word/document.xml").file_size > MOST_BYTES:
                raise ParseError("DOCX_TOO_LARGE", "document.xml is too large")
            body = ET.fromstring(z.read("word/document.xml")).find(_W + "body")
            core = z.read("docProps/core.xml") if "docProps/core.xml" in z.namelist() else b""
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ParseError("CORRUPT_DOCX", str(e)) from e
    if body is None or sum(1 for _ in body.iter()) > MOST_NODES:
        raise ParseError("CORRUPT_DOCX", "no body, or too many nodes")
    blocks, headings, table = [], [], 0
    for n, node in enumerate(body, 1):
        if node.tag == _W + "p":
            text = _run_text(node).strip()
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"(?i)heading ?([1-9])", style.get(_W + "val", "")) if style is not None else None
            if level and text:
                headings = [*headings[: int(level[1]) - 1], text]
            item = node.find(f"{_W}pPr/{_W}numPr") is not None
            if text:
                blocks.append({"text": text, "heading_path": list(headings), "block_id": f"b{n}" + ".item" * item, "table_no": None, "heading": bool(level)})
        elif node.tag == _W + "tbl":
            table += 1
            rows = [" | ".join(_run_text(c).strip() for c in r.iter(_W + "tc")) for r in node.iter(_W + "tr")]
            for i, row in enumerate(rows):
                text = row if i == 0 else f"{rows[0]}\n{row}"
                place = f"b{n}.header" if i == 0 else f"b{n}.row{i}"
                blocks.append({"text": text, "heading_path": list(headings), "block_id": place, "table_no": table, "heading": False})
    named = re.search(rb"<dc:title>([^<]+)</dc:title>", core)
    title = named[1].decode("utf-8", "replace").strip() if named else ""
    return title or next((b["text"] for b in blocks if b["heading"]), ""), blocks


def parse(name: str, content: bytes) -> list[dict]:
    """The chunks of one file, or a ParseError. Kind goes by the name's extension."""
    extension = name.lower().rpartition(".")[2]
    base = name.replace("\\", "/").rpartition("/")[2]
    blank = {"start_line": None, "end_line": None, "page": None, "heading_path": None, "block_id": None, "table_no": None, "symbol": None}
    if extension == "docx":
        title, blocks = docx_blocks(content)
        found = [{**blank, **{k: b[k] for k in ("text", "heading_path", "block_id", "table_no")}, "title": title or base} for b in blocks]
    elif extension == "pdf":
        if content[:5] == b"%PDF-":
            raise ParseError("PDF_UNAVAILABLE", "no PDF reader is installed: give the text layer, pages ended by form feeds")
        found = [
            {**blank, "text": text, "page": page, "title": base} for page, body in pages(decode_text(content)) for text, _, _ in chunk_text(body)
        ]
    else:
        text = decode_text(content)
        code = extension in ("c", "h", "cc", "hh", "cpp", "hpp", "cxx", "hxx")
        chunks = chunk_code(text) if code else [(*c, None) for c in chunk_text(text)]
        heading = re.search(r"(?m)^#[ \t]+(.+)$", text) if extension in ("md", "markdown") else None
        title = heading[1].strip() if heading else base
        found = [{**blank, "text": t, "start_line": a, "end_line": b, "symbol": s, "title": title} for t, a, b, s in chunks]
    if not found:
        raise ParseError("EMPTY_DOCUMENT", "no text")
    return found


CHUNKS = (
    "path string, ordinal int, text string, title string, start_line int, end_line int, page int, heading_path array<string>, "
    "block_id string, table_no int, symbol string, error_code string, error string"
)


def parsed(files: DataFrame) -> DataFrame:
    """The chunks of ``files`` (``path, content``), and one row with ``error_code`` for each that can't be read.

    A broken file never stops the others. Null contents are EMPTY_DOCUMENT. Nothing is shuffled.
    """
    columns = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    rows += [{"path": path, "ordinal": i, **c} for i, c in enumerate(parse(path or "", bytes(content or b"")))]
                except ParseError as e:
                    rows.append({"path": path, "error_code": e.code, "error": str(e)})
            yield pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns, dtype=object)

    return files.select("path", "content").mapInPandas(run, CHUNKS)
