import io
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest

from glosswork.operators import attribution
from glosswork.sources import files
from glosswork.streaming import changes

ROOT = Path(__file__).resolve().parent.parent
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx():
    body = (
        f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p>'
        '<w:p><w:r><w:rPr><w:color w:val="FF0000"/></w:rPr><w:t>All valves.</w:t></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/header1.xml", f"<w:hdr {W}><w:p><w:r><w:t>SOP-QA-001</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>alpha</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_parsers(spark):
    rows = [("a.docx", docx()), ("b.xlsx", xlsx()), ("c.txt", "eins\r\n\n二".encode("gb18030") + b"\n"), ("d.txt", "﻿x".encode()), ("e.bin", b"x"), ("f.docx", b"no archive"), ("g.txt", b"")]
    got = {}
    for r in files.parse(spark.createDataFrame(rows, "path string, content binary")).orderBy("path", "seg_index").collect():
        got.setdefault(r.path, []).append((r.text, r.kind, r.section))
    assert got["a.docx"] == [("Scope", "heading", "Scope"), ("All valves.", "paragraph", "Scope"), ("cell", "table_cell", "Scope"), ("SOP-QA-001", "header", None)]
    assert got["b.xlsx"] == [("alpha", "sheet_cell", "One")]
    assert got["d.txt"] == [("x", "line", None)]
    assert got["e.bin"][0][1] == got["f.docx"][0][1] == "error" and "g.txt" not in got


def test_listing_and_upload(spark, tmp_path):
    for name in ("a.txt", "~$b.docx", "sub/c.md", "d.exe"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    rows = files.listing(spark, str(tmp_path)).collect()
    assert [r.relative_path for r in rows] == ["a.txt", "sub/c.md"] and all(len(r.item_id) == 64 for r in rows)
    made = [("a.pdf", b"%PDF-1"), ("b.pdf", b"MZ"), ("c.exe", b"x"), ("d.docx", b"PK\x03\x04x"), ("e", b"x"), ("f.txt", b"")]
    ok = {r.file_name: r.accepted for r in files.upload_check(spark.createDataFrame(made, "file_name string, content binary")).collect()}
    assert ok == {"a.pdf": True, "b.pdf": False, "c.exe": False, "d.docx": True, "e": False, "f.txt": False}


def test_remote_listing(spark):
    item = "struct<id:string,name:string,size:bigint,cTag:string,eTag:string,folder:string,modified:string>"
    pages = spark.createDataFrame([("root", [("f", "dir", 0, None, None, "1", None), ("x", "x.txt", 3, "c", "e", None, None)]), ("f", [("y", "y.pdf", 4, None, "e2", None, None)])], f"folder_id string, value array<{item}>")
    assert {r.relative_path: r.etag for r in files.remote_listing(pages).collect()} == {"x.txt": "c", "dir/y.pdf": "e2"}


def test_scanned_text(spark):
    pages = spark.createDataFrame([(1, 1, "own"), (1, 2, " "), (1, 3, None)], "doc_id bigint, page int, text string")
    scanned = spark.createDataFrame([(1, 1, "no"), (1, 2, "read"), (1, 2, "read")], "doc_id bigint, page int, text string")
    assert sorted((r.page, r.text, r.recovered) for r in files.with_scanned_text(pages, scanned).collect()) == [(1, "own", False), (2, "read", True), (3, None, False)]


def test_stream_queues_nothing_twice(spark, tmp_path):
    schema = "source_id bigint, item_id string, etag string, size bigint, modified timestamp, hash string, is_remote boolean"
    spark.sql("SELECT 1L source_id, 'a' item_id, 'e' etag, 5L size, timestamp'2024-01-01' modified, 'h' hash, false is_remote").write.parquet(str(tmp_path / "in"))
    index = spark.createDataFrame([(1, "b", "e", 5, None, "h", True), (2, "c", "e", 5, None, "h", True)], "source_id bigint, item_id string, etag string, size bigint, modified timestamp, hash string, active boolean")
    seen = []
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        changes.follow(stream, lambda: index, lambda d, n: seen.extend((r.item_id, r.outcome) for r in d.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(seen) == [("a", "NEW"), ("b", "MISSING")]


def test_ngram_attribution(spark, segments):
    en, id_ = "the valve is closed before the shift starts and the pump is checked", "katup ditutup sebelum giliran kerja dimulai dan pompa diperiksa dengan teliti"
    model = attribution.train(spark.createDataFrame([("en", en)] * 3 + [("id", id_)] * 3, "lang string, text string"))
    rows = segments([(1, "The pump is closed before the shift", "line", None, None), (1, "pompa ditutup sebelum giliran kerja", "line", None, None), (1, "阀门关闭", "line", None, None), (1, "12", "line", None, None), (1, None, "line", None, None)])
    got = {r.language: r.characters for r in attribution.tallies(rows, ["doc_id"], model).collect()}
    assert got == {"en": 29, "id": 31, "zh": 4}


def test_core_stands_without_llm(tmp_path):
    code = "import sys; sys.modules['glosswork.llm'] = None\nimport __spark_entry__ as e\nq = e.queries(); assert 'p5_found' in q and 'p1_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    for p in (ROOT / "glosswork").rglob("*.py"):
        if "llm" not in p.parts:
            assert "glosswork.llm" not in p.read_text(), p


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
