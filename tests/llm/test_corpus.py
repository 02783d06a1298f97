import random
import tracemalloc
from types import SimpleNamespace
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glosswork.llm import bitext, language, leaks, mixing, pieces, scans, tokens

EN = ["The valve is closed before the shift starts.", "Every reading of the pump is recorded in the log.", "Visitors follow the marked path and stay away from the oven.", "Damaged containers are moved to the store without delay."]
ID = ["Katup ditutup sebelum giliran kerja dimulai.", "Setiap pembacaan pompa dicatat pada buku catatan.", "Tamu mengikuti jalur bertanda dan menjauhi oven.", "Wadah yang rusak segera dipindahkan ke gudang."]
ZH = ["班次开始前须关闭阀门。", "泵的每次读数都要记入台账。", "访客须沿标记路线行走并远离烤箱。", "破损的容器应立即转移到仓库。"]
DE = ["Die Anlage wird vor Schichtbeginn gereinigt.", "Alle Messwerte sind im Protokoll einzutragen.", "Änderungen müssen vor der Freigabe genehmigt werden."]


def corpus(documents, extra=()):
    rng = random.Random(5)
    rows, k = [], 100
    for lang, pool in (("en", EN), ("id", ID), ("zh", ZH), ("de", DE)):
        for _ in range(6):
            rows.append((k, " ".join(rng.choices(pool, k=6)), lang, "a"))
            k += 1
    return documents([*rows, *extra])


def test_language(spark, documents, segments):
    docs = corpus(documents, [(1, " ".join(EN), "id-ID", "a"), (2, " ".join(ZH), None, "a"), (3, " ".join(ID), "ind", "a"), (4, " ".join(EN + ID), "en", "a"), (5, None, "en", "a"), (6, "", None, "a"), (7, "SOP-QA-001 5 kg", "en", "a")])
    segs = segments([(1, EN[0] + " " + EN[1], "line", None, None), (1, EN[0] + " " + ZH[0] + " " + ZH[1], "line", None, None), (1, None, "line", None, None), (1, ZH[0], "header", None, None)])
    finds = spark.createDataFrame([(1, 1, 1, "zh"), (2, 1, 1, "EN"), (3, 1, 3, None)], "finding_id bigint, doc_id bigint, seg_id bigint, language string")
    got = {(r.record, r.record_id, r.lang) for r in language.wrong_or_missing(language.attribute(docs.union(docs), segs.union(segs), finds)).collect()}
    assert {("document", 2, "zh"), ("document", 4, "mul"), ("segment", 2, "en"), ("segment", 2, "zh"), ("finding", 1, "en")} <= got
    assert not {x for x in got if x[:2] in {("document", 3), ("document", 5), ("document", 6), ("document", 7), ("finding", 2), ("finding", 3), ("segment", 1)}}


def test_tally_confidence(spark, documents, segments):
    docs = corpus(documents, [(1, " ".join(EN), "en", "a")])
    segs = segments([(1, " ".join(EN), "line", None, None)])
    rows = [(1, "EN", 170, 7.5, 0), (1, "EN", 170, 7.5, 0), (1, "id", 50, 0.9, 0), (1, None, 5, None, 0), (99, "zh", 0, 1.0, 0)]
    tallies = spark.createDataFrame(rows, "doc_id bigint, language string, characters int, confidence double, lang int")
    got = {(r.doc_id, r.language): (r.stated, r.confidence) for r in language.tally_confidence(docs, segs, tallies).collect()}
    assert len(got) == 4 and got[1, "EN"][0] is None and got[1, "EN"][1] > 0.5
    assert got[1, "id"] == (0.9, 0.0) and got[99, "zh"] == (1.0, 0.0) and got[1, None] == (None, 0.0)


def test_language_held_out(spark, documents):
    model = language.fit(corpus(documents))
    look = language.Lookup(model)
    tests = [("en", "Please check the gauge and close the door."), ("id", "Petugas wajib memeriksa katup dan buku catatan."), ("zh", "请检查阀门。"), ("de", "Der Prüfer muss alle Messwerte eintragen."), ("th", "สวมถุงมือ")]
    no, lang, letters, _, _ = language.letters_of_texts(look, [t for _, t in tests], False)
    best = {}
    for n, k, m in zip(no, lang, letters):
        best[n] = max(best.get(n, (0, 0)), (m, k))
    assert [language.LANGS[best[i][1]] for i in range(len(tests))] == [x for x, _ in tests]
    assert len(language.letters_of_texts(look, [""], True)[0]) == 0


ITEM = "Changes to SOP-PUR-013 are approved by the manager and entered in the card. The operator shall clean the cabinet with rinse water for 18 minutes. Samples of paste weighing 40 g are taken from the machine."


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        (ITEM, True), ("Intro. " + ITEM.upper() + " End.", True), (ITEM.replace("clean the", "clean the the"), True), (ITEM.replace("rinse ", ""), True), (ITEM.replace(" ", " \n"), True),
        (ITEM.replace("оperator", "operator").replace("o", "о"), True), (ITEM.replace("cabinet", "cabnet").replace("manager", "mmanager"), True),
        (ITEM.replace("18", "19").replace("013", "014"), False), (ITEM.replace("cabinet", "oven"), False), (ITEM.split(". ")[1] + ".", False), ("", False), (None, False),
    ],
)
def test_leaks(spark, documents, text, hit):
    items = spark.createDataFrame([(7, ITEM), (8, "One sentence only."), (9, None)], "item_id bigint, text string")
    got = leaks.leaked(documents([(1, text, "en", "a"), (1, text, "en", "a"), (2, "Nothing here.", "en", "a")]), items)
    assert [tuple(r) for r in got.collect()] == ([(1, 7)] if hit else [])


CLEAN = "The operator shall clean the cabinet with rinse water daily."


@pytest.mark.parametrize(
    ("first", "second", "written", "hit"),
    [
        (CLEAN, "Samples of paste are always taken at noon.", "Samples of paste are alwys taken at noon.", True),
        ("操作人员应当用纯化水清洗设备表面并记录。", "每批样品取样后送检验室保存备查。", "每批样品取样送检验室保存备查。", True),
        (CLEAN, "Then stop.", "Then stop.", True),
        (CLEAN, "Samples of paste are always taken at noon.", "Samples of soap are never taken in rain.", False),
    ],
)
def test_leaks_of_two_short_sentences(spark, documents, first, second, written, hit):
    items = spark.createDataFrame([(7, f"{first} {second}")], "item_id bigint, text string")
    got = leaks.leaked(documents([(1, f"{first} {written} Other things follow here.", "en", "a")]), items)
    assert [tuple(r) for r in got.collect()] == ([(1, 7)] if hit else [])


def test_leaks_with_a_full_filter(spark, documents, monkeypatch):
    monkeypatch.setattr(leaks, "FILTER", (64, 64))  # everything passes: the join and the check decide
    items = spark.createDataFrame([(7, ITEM), (8, ITEM)], "item_id bigint, text string")
    assert leaks.leaked(documents([(1, ITEM, "en", "a")]), items).count() == 2
    assert leaks.leaked(documents([]), items).count() == 0
    assert leaks.leaked(documents([(1, ITEM, "en", "a")]), items.limit(0)).count() == 0


def test_filters_let_few_others_through(spark):
    rng = np.random.default_rng(2)
    own, others = rng.integers(0, 1 << 64, 3000, np.uint64), rng.integers(0, 1 << 64, 1_000_000, np.uint64)
    held = leaks.Filter(spark.createDataFrame(pd.DataFrame({"h": own.astype(np.int64)})), len(own))
    assert held.has(own).all() and held.has(others).sum() < 300


def test_a_leak_is_checked_once(monkeypatch):
    checks, stands = [], leaks.stands
    monkeypatch.setattr(leaks, "stands", lambda *a: checks.append(a) or stands(*a))
    first, second = (" ".join(leaks.tokens(x)) for x in (CLEAN, "Samples of paste are always taken at noon."))
    rows = [(1, 7, "other words"), (1, 7, f"{first} {second}"), (1, 7, f"{first} {second}"), (2, 7, f"{first} {second}"), (1, 8, f"{first} {second}")]
    d = pd.DataFrame([(doc, item, first, second, 0, 0, text) for doc, item, text in rows])
    got = {r[:2] for r, hit in zip(rows, leaks.stand_there.func(*(d[c] for c in d))) if hit}
    assert got == {(1, 7), (2, 7), (1, 8)} and len(checks) == 3


def test_pieces_round_trip(spark, documents):
    enc = tokens.encoding(tokens.TOKENIZER)
    texts = {1: "\n\n".join(" ".join(EN) for _ in range(30)), 2: "".join(ZH) * 60, 3: "x" * 5000, 4: "short", 5: "", 6: None, 7: "😀" * 400}
    rows = documents([(k, t, "en", "a") for k, t in texts.items()])
    got = pieces.pieces(rows.union(rows), limit=100, overlap=16).toPandas().sort_values(["doc_id", "piece"])
    for doc, g in got.groupby("doc_id"):
        text = texts[doc]
        assert "".join(text[a:b] for a, b in zip(g.own_start, g.char_end)) == text
        assert all(text[a:b] == t for a, b, t in zip(g.char_start, g.char_end, g.text))
        assert all(len(enc.encode_ordinary(t)) <= 100 for t in g.text)
    assert set(got.doc_id) == {1, 2, 3, 4, 7}
    ends = got[got.doc_id == 1].text.str.strip().str[-1]
    assert (ends == ".").all()
    assert [r.doc_id for r in pieces.oversized(rows, 2000).collect()] == sorted(k for k, t in texts.items() if t and len(enc.encode_ordinary(t)) > 2000)
    with pytest.raises(ValueError):
        pieces.pieces(rows, limit=10, overlap=9)


def test_mixing_matches_a_plain_sum(spark, documents):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(EN, k=rng.randint(1, 5))), "en", "big" if k % 3 else "small") for k in range(200)] + [(900, None, "en", "big"), (901, "", "en", "big")]
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    docs = documents(rows)
    chosen, shares = mixing.mix(docs.union(docs), targets, total=6000)
    got = {r.source: r for r in shares.collect()}
    picked = chosen.collect()
    for source, repeats in (("big", 1), ("small", 3)):
        own = [r for r in picked if r.source == source]
        assert len({r.doc_id for r in own}) == len(own) and max(r.repeats for r in own) <= repeats
        total = sum(r.n_tokens * r.repeats for r in own)
        assert total == got[source].chosen_tokens <= got[source].budget
        assert got[source].reached == (total >= 0.99 * got[source].budget)
        if got[source].reached:
            assert got[source].budget - total <= max(r.n_tokens for r in own)
    assert got["none"].chosen_tokens == 0
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def page(lines):
    return "\n".join(lines)


def test_scans(spark, documents):
    clean = [(k, "The maintenance technician checks the filter press. Drain water from the filling line is tested. The step-by-step guide is in the quarantine area.", "en", "a") for k in range(100, 140)]
    body = ["The maintenance technician checks the filter press and the fil-", "CONTROLLED COPY", "ling line. Drain water frorn the line is tested in the quaran¬", "tine area. The guide is a step-", "by-step guide that the technician checks.", ""]
    rows = [(d, p, page([f"SOP-QA-00{d} Filling of the line", *body, f"Page {p} of 3"]), 0.9) for d in (1, 2, 3) for p in (1, 2, 3)] + [(9, 1, None, 0.5), (9, 2, "", None)]
    pages = spark.createDataFrame(rows, "doc_id bigint, page int, text string, confidence double")
    got = {(r.doc_id, r.page, r.line_no, r.defect) for r in scans.defects(pages.union(pages), documents(clean)).collect()}
    one = {x[2:] for x in got if x[:2] == (1, 2)}
    assert one == {(0, "furniture"), (2, "furniture"), (7, "furniture"), (1, "broken"), (3, "broken"), (3, "misread")}
    text = scans.paragraphs(pages).filter("doc_id = 1").orderBy("paragraph").first().text
    assert "the filling line. Drain" in text and "CONTROLLED" not in text
    one = scans.paragraphs(pages, documents(clean)).filter("doc_id = 1").orderBy("paragraph").first()
    assert one.text == "The maintenance technician checks the filter press and the filling line. Drain water from the line is tested in the quarantine area. The guide is a step-by-step guide that the technician checks."
    assert one.confidence == 0.9
    assert scans.defects(pages.limit(0), documents([])).count() == 0


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("Frorn the line", ["Frorn"], ["from"], 0, None, None), "From the line"), (("FRORN", ["FRORN"], ["from"], 0, None, None), "FROM"), (("of qua-", [], [], 0, "qua", "quarantine"), "of quarantine"),
        (("rantine area", [], [], 7, None, None), " area"), (("厍存台账", ["<厍存"], ["<库存"], 0, None, None), "库存台账"), (("a step-", [], [], 0, None, None), "a step-"),
    ],
)
def test_repaired_lines(args, want):
    assert scans.repaired(*args) == want


def test_running_heads_may_alternate():
    left, right = scans.fold("SOP-QA-001 Filling of the line"), scans.fold("Merrow internal use")
    firsts = [(left, right)[p % 2] for p in range(8)]
    assert scans._running(firsts, list(range(8))) == [True] * 8
    assert scans._running(["abcdefg", "hijklmnop", "qrstuvw"], [1, 2, 3]) == [False] * 3
    assert scans.words_of(f"{'a' * 90}-b c-d-e") == ["a" * 90, "b", "c", "d", "e", f"{'a' * 90}-b", "c-d", "d-e"]


def test_corrections_undo_strokes():
    for word, wrong in (("dengan", "deng@n"), ("filter", "fi1ter"), ("sampai", "sarnpai"), ("tested", "fested"), ("agreed", "agreecl"), ("10", "lO"), ("库存台"[:3], "厍存台"[:3])):
        if len(word) == 3 and word[0] > "z":
            assert scans.corrections("<厍存") == ["<库存"]
        else:
            assert word in scans.corrections(wrong)


def test_corrections_of_overlapping_and_many_strokes(spark):
    for word, wrong in (("natrium", "natriiim"), ("sodium", "sodiiim"), ("laboratorium", "laboratoriiim")):
        assert word in scans.corrections(wrong)
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    words = [("natriiim", "natrium"), ("sarnpelrnerkrnal", "sampelmerkmal"), ("annnn", "amm"), (long.replace("m", "rn"), long), ("cllvvfo", "cllwto"), ("water", None)]
    counts = spark.createDataFrame([(w, 50) for _, w in words if w] + [("water", 50), ("natrum", 50)], "word string, n bigint")
    got = {r.word: r.best for r in scans._judged(spark.createDataFrame([(x,) for x, _ in words], "word string"), counts).collect()}
    assert got == dict(words)


def test_translations(spark, documents, segments, monkeypatch):
    rng = random.Random(3)
    things = [("pump", "pompa", "水泵"), ("oven", "tungku", "烤箱"), ("scale", "timbangan", "地磅"), ("valve", "katup", "阀门"), ("tower", "menara", "冷却塔"), ("silo", "gudang", "料仓")]
    rows, want, n = [], set(), 0
    for doc in range(30):
        triples = []
        for _ in range(6):
            t, k = rng.choice(things), rng.randint(2, 99)
            kind = rng.randint(0, 2)
            triples.append([
                (f"The {t[0]} is checked after {k} hours by the crew.", f"Mesin {t[1]} diperiksa setelah {k} jam oleh regu.", f"{t[2]}在{k}小时后由班组检查。"),
                (f"The crew keeps {k} kg of sand near the {t[0]} at night.", f"Regu menyimpan {k} kg pasir di dekat {t[1]} pada malam hari.", f"班组夜间在{t[2]}旁存放{k} kg沙子。"),
                (f"No visitor may open the {t[0]} without permission.", f"Tamu tidak boleh membuka {t[1]} tanpa izin.", f"未经许可访客不得打开{t[2]}。"),
            ][kind])
        triples = list(dict.fromkeys(triples))
        order = [0, 1, 2] if doc % 2 else [0, 2, 1]
        ids = {}
        for lang in order:
            for j in (range(len(triples)) if lang == 0 or doc % 3 else reversed(range(len(triples)))):
                n += 1
                ids[lang, j] = n
                rows.append((doc, triples[j][lang], "paragraph", None, None))
        want |= {tuple(sorted((ids[a, j], ids[b, j]))) for j in range(len(triples)) for a, b in ((0, 1), (0, 2), (1, 2))}
    docs = corpus(documents, [(500 + k, " ".join(r[1] for r in rows if r[0] == k and r[1][0] not in "未班" and not r[1][0] > "z")[:400], None, "a") for k in range(3)])
    segs = segments(rows)
    got = set(map(tuple, bitext.translations(segs.union(segs), docs).collect()))
    hit = len(got & want)
    # a lexicon of thirty documents only; what is found must be right
    assert hit / len(got) > 0.95 and hit / len(want) > 0.9
    assert bitext.translations(segs.limit(0), docs).count() == 0
    # section reports may name a section in any way; a lexicon that is joined gives what one at the workers gives
    names = spark.createDataFrame([(0, "Tujuan / Purpose", 1), (0, None, 2), (77, "", 1)], "doc_id bigint, name string, sequence int")
    monkeypatch.setattr(bitext.aligned, "__defaults__", (0,))
    assert set(map(tuple, bitext.translations(segs.union(segs), docs, names).collect())) == got


def _numbered(n, size=30, words=15):
    """Documents as numbers: sentences of two languages without anchors, and what `meetings` counts in them."""
    rng = np.random.default_rng(3)
    lang = [0] * size + [1] * size
    none = [np.zeros(0, np.int64)] * n
    rows = {"doc_id": range(n), "lang": [lang] * n, "section": [[-1] * len(lang)] * n, "words": [rng.integers(1, 2000, len(lang) * words) for _ in range(n)], "words_n": [[words] * len(lang)] * n}
    for c in ("numbers", "anchors", "segs"):
        rows |= {c: none, f"{c}_n": [[0] * len(lang)] * n}
    taken = []
    bitext.meetings(SimpleNamespace(mapInPandas=lambda run, _: taken.append(run) or MagicMock()))
    return pd.DataFrame(rows), taken[0]


def test_counting_words_holds_few_at_a_time(spark, monkeypatch):
    batch, run = _numbered(500)
    tracemalloc.start()
    for _ in run(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 300
    cells = lambda parts: pd.concat(parts).groupby(["a", "b", "f", "g"])["n"].sum()
    batch = batch[:6]
    whole = cells(run(iter([batch])))
    monkeypatch.setattr(bitext, "CELLS", 5000, raising=False)  # in portions of a document, and given on many times
    parts = list(run(iter([batch[:4], batch[4:]])))
    assert len(parts) > 20 and np.allclose(cells(parts).reindex(whole.index), whole) and len(cells(parts)) == len(whole)
    assert whole[0, bitext.OWN, bitext.NONE, bitext.NONE] == 6 * 30


@pytest.mark.parametrize("n", [5, 60])
def test_pairs_do_not_depend_on_the_size_of_a_document(n):
    names = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ax", "ex", "ix", "ox", "ux", "yx")][:n]
    left, right = [f"{x} {x}q" for x in names], [f"{x}w {x}z" for x in names]
    only = {f"{x}{e}": {f"{x}{d}": 1.0} for x in names for e, d in (("w", ""), ("z", "q"))}  # the other side's table alone
    lexicon = bitext.Lexicon({("en", "id"): {}, ("id", "en"): only})
    assert sorted(bitext.align(lexicon, "en", "id", left, right)) == [(k, k) for k in range(n)]


WORDS = {"pump": "pompa", "oven": "tungku", "closed": "ditutup", "crew": "regu", "night": "malam", "valve": "katup", "checks": "memeriksa", "sand": "pasir"}
SMALL = bitext.Lexicon({("en", "id"): {a: {b: 1.0} for a, b in WORDS.items()}, ("id", "en"): {b: {a: 1.0} for a, b in WORDS.items()}})


@pytest.mark.parametrize(
    ("left", "right", "pairs"),
    [
        (["pump closed 5 night"], ["pompa ditutup malam"], [(0, 0)]),  # a number left out
        (["pump closed 5 night"], ["pompa ditutup 6 malam"], []),  # another number
        (["pump closed 5 night 8"], ["pompa ditutup 5 malam"], [(0, 0)]),
        (["crew checks sand", "valve oven closed pump night"], ["regu memeriksa pasir", "katup tungku", "ditutup pompa malam"], [(0, 0), (1, 1), (1, 2)]),  # one sentence for two
        (["valve oven", "closed pump night"], ["katup tungku ditutup pompa malam"], [(0, 0), (1, 0)]),
        (["crew checks sand", "pump closed"], ["pompa ditutup", "regu memeriksa pasir"], [(0, 1), (1, 0)]),  # another order
        ([], ["pompa"], []), ([""], [""], []),
    ],
)
def test_pairs_of_sentences(left, right, pairs):
    assert sorted(bitext.align(SMALL, "en", "id", left, right)) == pairs


def test_names_and_cognates_vote():
    x, y = bitext.side("en", ["The laboratory of Orbalin is open.", "The laboratory is open to Merrow."]), bitext.side("id", ["Untuk Merrow buka.", "Milik Orbalin juga."])
    assert sorted(bitext.votes(x, y)) == [(0, 1), (1, 0)] and bitext.cognate("Laboratory") == bitext.cognate("laboratorium")
    x, y = bitext.side("en", ["The laboratory of Orbalin is open.", "Nothing."]), bitext.side("id", ["Tak ada.", "Ada laboratorium Orbalin."])
    assert bitext.votes(x, y) == [(0, 1)]
    assert bitext.same_sections(["1. Purpose", "1. Tujuan", "Scope / Lingkup", "Lingkup", None, "Else"], {}) == {None: -1, "1. Purpose": 1, "1. Tujuan": 1, "Else": 3, "Lingkup": 4, "Scope / Lingkup": 4}


def test_chain_and_gap():
    assert bitext.increasing([(0, 0), (1, 5), (2, 1), (3, 2), (4, 9)]) == [(0, 0), (2, 1), (3, 2), (4, 9)]
    assert sorted(bitext._gap([(0, 0, 0.5), (0, 1, 0.9), (1, 0, 0.6), (1, 1, 0.3), (2, 2, 0.4)])) == [(0, 1), (2, 2)]


def test_token_counts(spark):
    rows = spark.createDataFrame([("a b",), ("",), (None,), ("<|endoftext|>",)], "t string")
    got = [r.n for r in rows.select(tokens.count(F.col("t")).alias("n")).collect()]
    assert got[1:3] == [0, None] and got[0] == 2 and got[3] > 1
