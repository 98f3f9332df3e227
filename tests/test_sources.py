import io
import subprocess
import zipfile
from datetime import datetime, timedelta

import pytest

from docstrata.functions.decode import ParseError, decode_text, docx_blocks, parsed
from docstrata.sources.folder import check_upload_names, hashed, read_folder, unparsed
from docstrata.sources.git import GitSource
from docstrata.streaming.watch import quiet_periods, write_bursts


def docx(body, title=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        if title:
            z.writestr("docProps/core.xml", f"<x><dc:title>{title}</dc:title></x>")
    return out.getvalue()


def p(text, style=""):
    return f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_decoding():
    assert decode_text(b"\xef\xbb\xbfa\r\nb\rc") == "a\nb\nc"
    assert decode_text("﻿hé\r\n".encode("utf-16-le")) == "hé\n"
    assert decode_text(b"\xfe\xff" + "x".encode("utf-16-be")) == "x"
    for content, code in ((b"\xc3\x28", "INVALID_ENCODING"), (b"\xff\xfea", "INVALID_ENCODING"), (b"a\0b", "BINARY_FILE"), (b"\x01\x02\x03a", "BINARY_FILE")):
        with pytest.raises(ParseError) as e:
            decode_text(content)
        assert e.value.code == code


def test_docx_headings_tables_and_tracked_changes():
    table = "<w:tbl>" + "".join(f"<w:tr><w:tc>{p(a)}</w:tc><w:tc>{p(b)}</w:tc></w:tr>" for a, b in (("Name", "Value"), ("baud", "9600"))) + "</w:tbl>"
    tracked = "<w:p><w:r><w:t>kept </w:t></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p>"
    title, blocks = docx_blocks(docx(p("UART", "Heading1") + p("Speed", "Heading2") + table + tracked))
    assert title == "UART"
    assert blocks[3]["text"] == "Name | Value\nbaud | 9600" and blocks[3]["table_no"] == 1 and blocks[3]["block_id"] == "b3.row1"
    assert blocks[4]["text"] == "kept new" and blocks[4]["heading_path"] == ["UART", "Speed"]


def test_broken_files_are_reported_beside_the_others(spark):
    files = [("a.md", b"# T\ntext"), ("b.docx", b"no zip"), ("c.txt", b"  "), ("d.txt", None), ("e.pdf", b"one\ftwo\f"), ("f.pdf", b"%PDF-1.4"), ("g.txt", b"\xc3\x28")]
    got = parsed(spark.createDataFrame(files, "path string, content binary")).collect()
    assert {r.path: r.error_code for r in got if r.error_code} == {
        "b.docx": "CORRUPT_DOCX", "c.txt": "EMPTY_DOCUMENT", "d.txt": "EMPTY_DOCUMENT", "f.pdf": "PDF_UNAVAILABLE", "g.txt": "INVALID_ENCODING"
    }
    assert [(r.page, r.text) for r in got if r.path == "e.pdf"] == [(1, "one"), (2, "two")]
    assert [(r.title, r.start_line) for r in got if r.path == "a.md"] == [("T", 1)]


def test_folder(spark, tmp_path):
    for name in ("src/a.c", "src/b.exe", "node_modules/x.js", "~$w.docx", "Makefile"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("int x;")
    files = hashed(read_folder(spark, str(tmp_path)))
    rows = files.collect()
    assert {r.path for r in rows} == {"src/a.c", "Makefile"}
    assert len({r.raw_hash for r in rows}) == 1 and len({r.parsed_key for r in rows}) == 2
    assert {r.path for r in unparsed(files, files.where("path = 'Makefile'")).collect()} == {"src/a.c"}


def test_upload_names():
    assert check_upload_names(["a.md", "a.md"]) == ["000-a.md", "001-a.md"]
    for bad in ("../a", "con", "nul.txt", "", "a:b"):
        with pytest.raises(ValueError):
            check_upload_names([bad])


def test_git(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a b.c").write_text("one\n")
    (tmp_path / "lfs.bin").write_text("version https://git-lfs.github.com/spec/v1\noid x\n")
    (tmp_path / "link").symlink_to("a b.c")
    git("add", ".")
    git("commit", "-qm", "1")
    git("tag", "v1")
    (tmp_path / "a b.c").write_text("two\n")
    git("commit", "-qam", "2")
    git("tag", "-a", "v2", "-m", "x")
    spark.dataSource.register(GitSource)
    rows = {r.path: r for r in spark.read.format("git").option("ref", "v1").load(str(tmp_path)).collect()}
    assert rows.keys() == {"a b.c", "lfs.bin"}
    assert bytes(rows["a b.c"].content) == b"one\n" and rows["lfs.bin"].error_code == "LFS_POINTER"
    tags = {r.name: r.commit for r in spark.read.format("git").option("table", "tags").load(str(tmp_path)).collect()}
    assert tags["v1"] == rows["a b.c"].commit != tags["v2"]
    with pytest.raises(Exception, match="not a branch"):
        spark.read.format("git").option("ref", "--upload-pack=x").load(str(tmp_path)).collect()


T = datetime(2024, 1, 1)


def changes(spark):
    rows = [("a", T), ("a", T + timedelta(seconds=1)), ("a", T + timedelta(seconds=10)), ("b", T), ("b", None)]
    return spark.createDataFrame(rows, "source_id string, ts timestamp")


def test_bursts_end_after_a_quiet_time(spark):
    got = sorted((r.source_id, r.changes) for r in quiet_periods(changes(spark)).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]


def test_bursts_as_a_stream(spark, tmp_path):
    late = spark.createDataFrame([("z", T + timedelta(hours=1))], "source_id string, ts timestamp")
    changes(spark).union(late).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id string, ts timestamp").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run only moves the watermark on
        write_bursts(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(60)
    got = sorted((r.source_id, r.changes) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1)]
