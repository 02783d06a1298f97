"""Sources behind one contract, sinks and payloads, issues, listings over time, users' patterns, names of files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from glosswork.functions import text as X
from glosswork.operators import attribution, issues, reports, rules, sections, versions
from glosswork.sources import adapters, files, sinks
from glosswork.streaming import changes


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    (root / "a" / "b").mkdir(parents=True)
    (root / "top.txt").write_text("x")
    (root / "a" / "one.DOCX").write_bytes(b"PK")
    (root / "a" / "b" / "two.txt").write_text("deep")
    (root / "a" / "~$one.docx").write_text("lock")
    (root / "a" / "empty.txt").write_text("")
    (root / "a" / "tool.exe").write_text("x")
    (tmp_path / "secret.txt").write_text("outside")
    (root / "a" / "link.txt").symlink_to(tmp_path / "secret.txt")
    return root


def test_library_source(spark, library, tmp_path):
    adapters.register(spark)
    load = lambda **o: {r.relative_path: r for r in spark.read.format("glosswork").options(**o).load().collect()}
    got = load(type="LOCAL_FOLDER", path=str(library), content="true")
    assert set(got) == {"top.txt", "a/one.DOCX", "a/b/two.txt"} and bytes(got["a/b/two.txt"].content) == b"deep"
    assert got["top.txt"].extension == "txt" and not got["top.txt"].is_remote and len(got["top.txt"].item_id) == 64
    assert set(load(path=str(library), max_depth="1")) == {"top.txt", "a/one.DOCX"}
    assert load(type="UPLOAD") == {}
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump" / "1.json").write_text(json.dumps({"value": [{"id": "9", "path": "x/y.pdf", "name": "y.pdf", "size": 4, "eTag": "e", "modified": "2024-01-01T00:00:00+00:00"}]}))
    assert load(type="REMOTE", path=str(tmp_path / "dump"))["x/y.pdf"].etag == "e"
    assert adapters.reachable("UPLOAD", None) is None and adapters.reachable("LOCAL_FOLDER", "x") and adapters.reachable("LOCAL_FOLDER", str(library)) is None
    for path, error in (("../secret.txt", adapters.UnsafePath), ("a", adapters.UnsafePath), ("a/empty.txt", adapters.UnsafePath), ("none.txt", FileNotFoundError)):
        with pytest.raises(error):
            adapters.guarded(str(library), path)
    adapters.store_uploads(spark.createDataFrame([("a.txt", b"x")], "file_name string, content binary"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "uploads")).count() == 1


def test_upload_members(spark):
    made = [("a.docx", b"PK\x03\x04..word/document.xml"), ("b.docx", b"PK\x03\x04xl/workbook.xml"), ("c.xlsx", b"PK\x03\x04xl/workbook.xml"), ("d.txt", b"a\x00b"), ("e.txt", b"ab"), ("f.phar", b"x")]
    got = files.upload_check(spark.createDataFrame(made, "file_name string, content binary"), members=True)
    assert {r.file_name: r.reason for r in got.collect()} == {"a.docx": None, "b.docx": "not a document", "c.xlsx": None, "d.txt": "not a text", "e.txt": None, "f.phar": "denied extension"}


def test_sinks_and_payload(spark, tmp_path):
    tallies = spark.createDataFrame([(1, "en", 5, 1, 2.0), (1, "en", 5, 1, 2.0), (2, None, 1, None, None)], "doc_id bigint, language string, characters int, words int, confidence double")
    report = spark.createDataFrame([(1, "A", 1, ["zh"], None)], "doc_id bigint, name string, sequence int, missing array<string>, short array<string>")
    rows = spark.createDataFrame([(3, "X", "INFO", "d")], "doc_id bigint, issue_type string, severity string, description string")
    texts = sinks.payload(tallies, report, rows)
    assert {r.doc_id for r in texts.collect()} == {1, 2, 3}
    assert [tuple(r) for r in sinks.languages_of(texts).collect()] == [(1, "en", 5, 1, 1.0)]
    odd = spark.createDataFrame([(1, "no json"), (2, None), (3, '{"languages":[{"language":"id","characters":-4,"more":1}],"else":2}')], "doc_id bigint, payload string")
    assert [tuple(r) for r in sinks.languages_of(odd).collect()] == [(3, "id", 0, None, None)]
    for n in (1, 2):  # a batch written again replaces itself
        sinks.write_facts(str(tmp_path), "b1", tallies=tallies.limit(n))
    sinks.write_facts(str(tmp_path), "b2", tallies=tallies.limit(1))
    assert sinks.read_facts(spark, str(tmp_path), "tallies").count() == 3


def test_issues(spark):
    report = [(1, 1, "A", None, 500, {"en": 300, "zh": 20}), (1, 2, "B", None, 500, {}), (1, 3, "C", 2, 50, {"en": 50}), (1, 4, None, None, None, None)]
    rows = spark.createDataFrame(report, "doc_id bigint, sequence int, name string, page int, total_characters int, characters map<string,int>")
    got = {(r.sequence, r.issue_type, r.language): r.description for r in issues.section_issues(rows).collect()}
    assert set(got) == {(1, "MISSING_SECTION_TRANSLATION", "id"), (1, "SHORT_TRANSLATION", "zh")}
    assert "20 characters of Chinese against 300 of English" in got[1, "SHORT_TRANSLATION", "zh"] and "comparable to 60 characters" in got[1, "SHORT_TRANSLATION", "zh"]
    tallies = spark.createDataFrame([(1, "en", 16000), (1, "id", 120), (1, "zh", 1000), (2, "en", 50)], "doc_id bigint, language string, characters int")
    got = {(r.doc_id, r.issue_type, r.language): r.description for r in issues.derived_issues(tallies).collect()}
    assert set(got) == {(1, "UNBALANCED_LANGUAGES", None), (2, "LOW_LANGUAGE_COVERAGE", "en"), (2, "LANGUAGE_MISSING", "id"), (2, "LANGUAGE_MISSING", "zh")}
    assert "scores 65.97 against the required 80." in got[1, "UNBALANCED_LANGUAGES", None]
    assert {r.doc_id: (r.status, r.score) for r in issues.advisory(tallies).collect()} == {1: ("PASS", 100.0), 2: ("FAIL", 33.33)}
    totals = spark.createDataFrame([(1, 5, 0), (2, 500, 2), (3, None, None)], "doc_id bigint, letters bigint, rejected bigint")
    notes = spark.createDataFrame([(2, "cut"), (2, None)], "doc_id bigint, note string")
    assert sorted((r.doc_id, r.issue_type) for r in issues.document_issues(totals, notes).collect()) == [(1, "OCR_REQUIRED"), (2, "PARSER_ERROR"), (2, "PARSER_ERROR"), (3, "OCR_REQUIRED")]


FILE = "source_id bigint, item_id string, etag string, size bigint, modified timestamp, hash string"


def test_listing_over_time(spark):
    t = dt.datetime(2024, 1, 1)
    new = spark.createDataFrame([(1, "same", None, 5, t, "h", False), (1, "back", None, 5, t, "h", False), (1, "new", None, 7, t, "n", False), (1, "mod", "2", 6, t, "m", False)], f"{FILE}, is_remote boolean")
    old = spark.createDataFrame(
        [(1, "same", None, 5, t, "h", True, False, "T", "C", None), (1, "back", None, 5, t, "h", False, True, "T", "C", t), (1, "mod", "1", 5, t, "h", True, False, "T", "C", None), (1, "gone", None, 5, t, "h", True, False, "T", "C", None), (2, "else", None, 5, t, "h", True, False, "T", "C", None)],
        f"{FILE}, active boolean, deleted boolean, title string, code string, missing_since timestamp",
    )
    life = {r.item_id: (r.outcome, r.restored, r.reactivated) for r in versions.lifecycle(new, old.filter("source_id = 1")).collect()}
    assert life == {"same": ("UNCHANGED", False, False), "back": ("UNCHANGED", True, True), "new": ("NEW", False, False), "mod": ("MODIFIED", False, False), "gone": ("MISSING", False, False)}
    got = {r.item_id: (r.hash, r.title, r.active, r.missing_since is None) for r in versions.next_index(new, old, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {"same": ("h", "T", True, True), "back": ("h", "T", True, True), "new": ("n", None, True, True), "mod": ("m", "T", True, True), "gone": ("h", "T", False, False), "else": ("h", "T", True, True)}
    have = spark.createDataFrame([(1, 7, 1, None, "a", False), (2, 7, 2, None, "b", True), (2, 7, 2, None, "b", True), (3, 8, 1, None, "c", True)], "id bigint, document_id bigint, version_number int, revision_label string, file_hash string, is_current boolean")
    more = spark.createDataFrame([(7, "R2", "d"), (9, None, "e")], "document_id bigint, revision_label string, file_hash string")
    assert sorted((r.document_id, r.version_number, r.is_current) for r in versions.append_versions(have, more).collect()) == [(7, 1, False), (7, 2, False), (7, 3, True), (8, 1, True), (9, 1, True)]


def test_stalled_rows_are_old(spark):
    t = dt.datetime(2024, 1, 2)
    rows = spark.createDataFrame([(1, "PENDING", dt.datetime(2024, 1, 1)), (2, "PENDING", t), (3, "DONE", dt.datetime(2023, 1, 1)), (4, "PENDING", None)], "id bigint, status string, at timestamp")
    assert [r.id for r in changes.stalled(rows, "PENDING", "at", 2, F.lit("2024-01-02 01:00:00").cast("timestamp")).collect()] == [1]


def test_patterns_names_and_secrets(spark):
    row = spark.createDataFrame([("SOP-12 x", "C:\\lib\\CON.txt", {"API_KEY": "1", "Certificate": "2", "name": "3", "none": None})], "t string, p string, m map<string,string>")
    t = F.col("t")
    got = row.select(X.first_match(t, r"([A-Z]+)-(\d+)", 2).alias("a"), X.first_match(t, "([A-Z").alias("b"), X.first_match(t, "x", 1).alias("c"), X.first_match(t, "( )").alias("d"), X.base_name(F.col("p")).alias("e"), X.parent(F.col("p")).alias("f"), X.safe_file_name(F.col("p")).alias("g"), X.redact(F.col("m")).alias("h")).first()
    assert tuple(got)[:7] == ("12", None, None, None, "CON.txt", "C:/lib", "_CON.txt")
    assert got.h == {"API_KEY": "[redacted]", "Certificate": "[redacted]", "name": "3", "none": None}
    names = spark.createDataFrame([("..a<b>.txt",), ("/",), ("",), (None,), ("x" * 300,)], "n string").select(X.safe_file_name(F.col("n")).alias("n")).collect()
    assert [r.n for r in names] == ["a_b_.txt", "document", "document", None, "x" * 200]
    kinds = spark.createDataFrame([("yes", "7", '["a"]'), ("?", "x", "x")], "b string, i string, j string").select(reports.typed(F.col("b"), "boolean").alias("b"), reports.typed(F.col("i"), "integer").alias("i"), reports.typed(F.col("j"), "json").alias("j")).collect()
    assert [tuple(r) for r in kinds] == [(True, 7, ["a"]), (None, None, None)]


def test_scripts(spark):
    rows = spark.createDataFrame([("ㄱ",), ("ｱ",), ("ア",), ("字",), ("가",)], "t string").select(X.is_cjk_other(F.col("t")).alias("o")).collect()
    assert [r.o for r in rows] == [True, False, True, False, True]


EN, ID = "the valve of the pump is closed before the shift starts and every reading is written down", "katup pompa ditutup sebelum giliran kerja dimulai dan setiap pembacaan dicatat pada buku"


def test_panel_of_three_languages(spark, segments):
    model = attribution.train(spark.createDataFrame([("en", EN), ("en", EN), ("id", ID), ("id", ID), ("id", None)], "lang string, text string"))
    rows = [(1, EN, "line", 1, "A"), (1, ID, "line", 1, "A"), (1, "阀门关闭前须记录读数" * 4, "line", 1, "A"), (2, ID, "line", None, "B"), (2, EN, "line", None, "B"), (2, None, "line", None, "B"), (2, "12", "line", None, "B")]
    named = attribution.with_language(sections.once(segments(rows).union(segments(rows))), model)
    assert {r.seg_id: r.language for r in named.collect()} == {1: "en", 2: "id", 3: "zh", 4: "id", 5: "en", 6: None, 7: None}
    facts = spark.createDataFrame([(1, False, True), (2, True, False)], "doc_id bigint, is_docx boolean, scanned boolean")
    got = {(r.doc_id, r.rule): (r.applicable, r.passed) for r in rules.run(named, facts=facts).collect()}
    assert got[1, "language_order"] == (True, True) and got[2, "language_order"] == (True, False)
    assert got[1, "numeric_consistency"] == (False, None) and got[2, "numeric_consistency"] == (True, True)
    assert got[2, "header_footer"] == (True, False) and got[1, "header_footer"][0] is False
    untrained = attribution.with_language(segments(rows[:1]), model.limit(0))
    assert untrained.first().language is None


def test_sections_and_their_segments(spark, segments):
    rows = segments([(1, "a", "line", 1, "X"), (1, "b", "line", 2, "X"), (1, "c", "line", None, None), (2, "d", "line", None, "X")])
    report = spark.createDataFrame([(1, 1, "X", 2), (1, 2, "X", 9), (1, 3, None, None), (3, 1, "X", None)], "doc_id bigint, sequence int, name string, page int")
    assert sorted(map(tuple, sections.segments_of(report, rows.union(rows)).collect())) == [(1, 1, 2), (1, 2, 1), (1, 2, 2), (1, 3, 3)]
    assert [r.seg_id for r in sections.in_page_order(rows).filter("doc_id = 1").orderBy("position").collect()] == [3, 1, 2]
