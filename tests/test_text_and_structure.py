import pytest
from pyspark.sql import functions as F

from glosswork.functions import text as X
from glosswork.operators import alignment, furniture, rules, sections


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t"))).first()[0]


def test_scripts(spark):
    assert one(spark, "保留5厘米 abc", X.han) == "保留厘米"
    assert one(spark, "日本語のテキスト", X.han) == ""
    assert one(spark, "a1-b", X.letters) == "ab"
    assert one(spark, " 7  words,\there ", X.words) == ["7", "words,", "here"]
    assert one(spark, None, X.letters) is None


@pytest.mark.parametrize(("name", "kind"), [("WI-12 form.docx", "WORK_INSTRUCTION"), ("information.txt", "FORM"), ("x.txt", "OTHER"), ("Laporan sop.pdf", "REPORT")])
def test_type_guess(spark, name, kind):
    assert one(spark, name, X.guess_type) == kind


def test_names_and_sizes(spark):
    assert one(spark, "SOP_QA-01  final.docx", X.title_from_name) == "SOP QA 01 final"
    assert one(spark, 1536, X.human_size, "bigint") == "1.5 KB"
    assert one(spark, None, X.human_duration, "int") == "—"
    assert one(spark, "MTI-ENV-EVM-SOP-002_Rev. 006", X.document_code) == "MTI-ENV-EVM-SOP-002"
    assert one(spark, "MTI-ENV-EVM-SOP-002_Rev. 006", X.revision) == "006"


def pages(n):
    return [(1, t, "line", p, None) for p in range(1, n + 1) for t in ("MEGA STEEL WORKS", "Every valve is checked before the shift.", f"Page {p} of {n}")]


def test_furniture_needs_three_pages(spark, segments):
    keys = {r.key for r in furniture.furniture_lines(segments(pages(3))).collect()}
    assert {"mega steel works", "page of"} <= keys
    assert furniture.furniture_lines(segments(pages(2))).count() == 0
    assert furniture.furniture_lines(segments([])).count() == 0


def test_content_drops_mangled_furniture_words(spark, segments):
    rows = [*pages(3), (1, "MEGA STEELWORKS valve", "line", 9, None), (1, None, "line", 9, None), (2, "MEGA kept", "paragraph", None, None)]
    texts = [(r.doc_id, r.text) for r in furniture.content_segments(segments(rows)).collect()]
    assert (2, "MEGA kept") in texts
    assert not any("Page" in t for _, t in texts)


def test_sections(spark, segments):
    got = sections.sections(segments([(1, "A", "heading", None, "A"), (1, "x", "paragraph", None, None), (1, "B", "heading", None, "B"), (1, "y", "paragraph", None, "B"), (1, "z", "paragraph", None, None)]))
    assert [(r.sequence, r.name, r.segment_count) for r in got.orderBy("sequence").collect()] == [(1, "A", 2), (2, "B", 3)]
    assert [r.name for r in sections.sections(segments([(1, "p", "paragraph", None, None)])).collect()] == ["(document body)"]
    by_page = sections.sections(segments([(1, "p", "line", 1, None), (1, "q", "line", 2, None)]))
    assert sorted(r.name for r in by_page.collect()) == ["Page 1", "Page 2"]
    assert sections.sections(segments([])).count() == 0


def test_gaps(spark):
    rows = [(1, 1, 900, {"en": 450, "id": 450}), (1, 2, 900, {"en": 450, "id": 446, "zh": 4}), (1, 3, 20, {"en": 20})]
    report = spark.createDataFrame(rows, "doc_id bigint, sequence int, total_characters int, characters map<string,int>")
    got = {r.sequence: (r.evaluated, r.missing, r.short) for r in sections.gaps(report, ("en", "id", "zh")).collect()}
    assert got == {1: (True, ["zh"], []), 2: (True, [], ["zh"]), 3: (False, [], [])}


def test_alignment_keeps_every_segment_once(spark, segments):
    rows = segments([(1, "The valve is closed.", "paragraph", None, None), (1, "阀门已关闭。", "paragraph", None, None), (1, "12", "paragraph", None, None), (1, None, "paragraph", None, None)])
    got = {r.language: r.texts for r in alignment.aligned_blocks(rows).collect()}
    assert got == {"latin": ["The valve is closed."], "zh": ["阀门已关闭。"], "unassigned": ["12"]}
    assert alignment.budgeted(rows, 10).count() == 1


def test_aligned_blocks_say_that_a_document_had_more(segments):
    rows = segments([(d, text, "paragraph", 1, None) for d, texts in ((1, ["Eight ch", "More text."]), (2, ["Short."]), (3, ["Eight ch", None, " "])) for text in texts])
    got = {(r.doc_id, r.truncated) for r in alignment.aligned_blocks(rows, 8).collect()}
    assert got == {(1, True), (2, False), (3, False)}


def test_rules(spark, segments):
    rows = segments([(1, "SOP-QA-001 Rev. 02", "header", None, None), (1, "Storage of materials", "heading", None, "Storage"), (1, "Keep 5 cm and 6,500 mg free.", "paragraph", None, "Storage"), (1, "至少保留 5 厘米 空间。", "paragraph", None, "Storage")], ["FF0000"])
    got = {r.rule: r for r in rules.run(rows).collect()}
    assert list(got) == list(rules.REGISTRY)
    assert got["document_code"].passed and not got["font_color"].passed
    assert got["numeric_consistency"].findings == 1
    miss = rules.numeric_mismatches(rows).first()
    assert miss.missing == ["6,500 mg"]
    assert rules.run(segments([])).count() == 0
