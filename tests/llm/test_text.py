import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.llm import sentences, text_forms


@given(st.text(alphabet=st.characters(max_codepoint=0x2FFFF, exclude_categories=["Cs"]), max_size=40))
def test_form_is_final(text):
    apply = text_forms.transducer().apply
    assert apply(apply(text)) == apply(text)


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ｖéｌｏ", "Vélo"), ("ﾊﾞ", "バ"), ("Κecuali x", "Kecuali x"), ("oﬃcer", "officer"), ("⽤", "用"), ("non‐con", "non-con"), ("la​b­", "lab"), ("ё", "ë"), ("µ", "μ")],
)
def test_same_look(a, b):
    apply = text_forms.transducer().apply
    assert apply(a) == apply(b)


@pytest.mark.parametrize(("a", "b"), [("7", "⁷"), ("At", "AT"), ("l", "1"), ("1", "2"), ("“a”", '"a"')])
def test_other_look(a, b):
    apply = text_forms.transducer().apply
    assert apply(a) != apply(b)


def test_rules_cover_ascii_and_composition():
    rules = text_forms.build_rules()
    assert not any(k.isascii() for k in rules)
    assert all(unicodedata.is_normalized("NFC", v) for v in rules.values())
    with pytest.raises(ValueError, match="plain|two results|final"):
        text_forms.LOOK_ALIKES["a"] = "b"
        try:
            text_forms.build_rules()
        finally:
            del text_forms.LOOK_ALIKES["a"]


def test_pairs(spark, segments):
    rows = segments([(1, "Valve ０ x", "line", None, None), (1, "Valve 0 x", "line", None, None), (1, "Valve 0 x", "heading", None, None), (1, None, "line", None, None), (1, "", "line", None, None), (1, "​", "line", None, None), (2, "Valve 0 x", "line", None, None)])
    rows = rows.union(rows)
    assert sorted(map(tuple, text_forms.same_look(rows).collect())) == [(1, 2), (1, 3)]
    assert text_forms.same_look(rows.limit(0)).count() == 0
    assert sorted(map(tuple, text_forms.look_classes(rows).collect())) == [(1, 1, 3, 2), (2, 1, 3, 1), (3, 1, 3, 1), (7, 7, 1, 0)]


def split(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(sentences.spans(F.col("t")).alias("s")).first().s
    return [text[s.char_start : s.char_end] for s in got or []]


CASES = [
    ["The limit is approx. 5.5 kg, i.e. 6 percent of the load.", "See Fig. 3 and Sec. 4.3 of SOP-QA-001, Rev. 03, before use."],
    ["The light turns red ... then the pump stops.", "(The key is kept in the store.)", "Orbalin Ltd. supplies it and Merrow Inc. services it."],
    ['The panel shows "Stop. Do not restart." until the crew resets it.', '"Is it closed?" asks the auditor before each start.'],
    ["4.3 Waste is weighed.", "Tighten to max. 5 Nm vs. min. 2 Nm."], ["(4) Spills are absorbed!", "Is it open?", "no end mark"],
    ["Am 6. März beginnt die Prüfung um 8.30 Uhr.", "Werkzeuge, z. B. Zangen, liegen im Schrank Nr. 8.", "Ende."],
    ["See https://docs.example.com/Rev.A/Index.HTML?a=1&b=2.", "Mail info.Team@example.com first."], ["Send it to J. R. Hill at info.Team@example.com.", "A. B. Hill signs.", "J.R. Hill reads it."],
    ["Jam kerja adalah pukul 08.30 s.d. 16.45 setiap hari.", "Siapkan sarung tangan, masker, dll.", "Botol rusak."],
]


@pytest.mark.parametrize("parts", CASES)
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "　"])
def test_latin(spark, parts, gap):
    assert split(spark, gap.join(parts)) == parts


HAN = [
    ["指示灯变红……随后泵停止。", "（钥匙存放在更衣室。）", "“阀门关好了吗？”班长在每次启动前都要询问。", "使用v2.4.1；否则须停用。", "压力升至5.5 bar"],
    ["パネルに「停止。再起動しないこと。」と表示されるまで待つ。", "上限は1.5 kgである（第4.2節を参照）。"],
]


@pytest.mark.parametrize("parts", HAN)
@pytest.mark.parametrize("gap", ["", " "])
def test_han(spark, parts, gap):
    assert split(spark, gap.join(parts)) == parts


def test_thai_and_empty(spark, segments):
    assert split(spark, "ห้ามเก็บเกิน 5250 กิโลกรัม พนักงานต้องทำ 10 นาที") == ["ห้ามเก็บเกิน 5250 กิโลกรัม", "พนักงานต้องทำ 10 นาที"]
    assert split(spark, "สวมถุงมือ บันทึกค่า") == ["สวมถุงมือ", "บันทึกค่า"]
    assert split(spark, "A guide.A second \U00020000 one.") == ["A guide.", "A second \U00020000 one."]
    for blank in ("", "  \n", None, "..."):
        assert split(spark, blank) == []
    rows = segments([(1, "One. Two.", "line", None, None), (1, "No.", "heading", None, None), (1, None, "line", None, None)])
    assert sorted(map(tuple, sentences.sentence_spans(rows.union(rows)).collect())) == [(1, 0, 4), (1, 5, 9)]


def test_long_text(spark):
    text = "The pump is closed. " * 4000
    assert len(split(spark, text)) == 4000
