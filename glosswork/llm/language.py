"""Language of documents, segments and findings (problem 4).

Hierarchical discrimination. The script gives the family of a run of text (Thai, Han/kana, Latin); inside
Latin a linear support vector machine parts the Germanic from the Malayic family; one-versus-one linear
support vector machines then part the closely related languages of a family (en-de, id-ms, zh-ja). All are
trained here on a bounded sample of labelled documents, in two rounds: labels are partly wrong, so the
second round leaves out documents that the first one contradicts.

A linear machine over character n-grams is a sum over words, so a word's margins are computed once and
remembered; classifying costs one look-up a word. Text is judged clause by clause, letters are counted by
language and summed, so documents of any length and any number of segments combine before the shuffle.

Units, codes, names in capitals, stamps, page marks and running lines belong to no language.

Edge cases: null or blank text has no language and no row; labels are compared without regard to notation
(`en`, `EN`, `en-GB`, `eng` are one); unknown labels count as wrong ones.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm.text_forms import one_to_one, ranges, transducer
from glosswork.session import cut_lineage

#: bound of the labelled sample the machines are fitted on: documents a language, characters of each, clauses a language
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS, SAMPLE_CLAUSES = 200, 2000, 1500
DIMENSIONS = 1 << 16
#: a document or finding has one language if it carries more than this share of the letters
SHARE = 0.9
#: letters that make a clause running text of its own language inside a segment, Latin and other scripts; margin that a
#: clause needs to differ from its sentence
ENOUGH, ENOUGH_EAST, CONVICTION = 10, 5, 0.6

# Notations of the languages' labels.
NOTATIONS = {
    "en": "en eng english", "id": "id in ind indonesian", "zh": "zh zho chi cmn chinese", "ms": "ms msa may zsm malay",
    "ja": "ja jpn japanese", "de": "de deu ger german", "th": "th tha thai", "mul": "mul",
}
FAMILIES = {"germanic": ("en", "de"), "malayic": ("id", "ms"), "east": ("zh", "ja")}

CODE = regex.compile(r"(?<!\p{Latin})(?:\p{Lu}{2,6}-)+\d+|\bv?\d[\d.,:/]*|\p{Latin}*\d\p{Latin}*")
STAMP = regex.compile(r"^[^\p{Ll}\p{Lo}]*$")
# a page mark is at most three words around numbers; unlike a sentence it has no end mark
PAGE_MARK = regex.compile(r"^\W*(?:\p{L}+\.?\s*)?\d{1,4}(?:\s*(?:/|\p{L}{1,5})\s*\d{1,4})?\W*$|^\W*第\s*\S{1,3}\s*页.*$|.*\|\s*\d+\s*/\s*\d+\s*$")
CLAUSE = regex.compile(r"[^.!?,;:。！？，；：、\n|()（）\"“”「」]+")
WORDS = regex.compile(r"[\p{Latin}\p{M}'’-]*\p{Latin}[\p{Latin}\p{M}]*|[\p{Han}\p{Hiragana}\p{Katakana}ー々〇]+|\p{Thai}+")
HAN, THAI = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"), regex.compile(r"\p{Thai}")
LETTER = regex.compile(r"\p{L}")
# Unit symbols that stand among the words of any language.
UNITS = frozenset("kg g mg µg t L l mL ml bar mbar psi Pa kPa MPa rpm Hz kHz W kW V A m cm mm µm nm km h min s Nm N ppm C F pH v".split())


def notation(label: Column) -> Column:
    """The language a label names, whatever its notation; null if it names none of ours or is missing."""
    plain = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    pairs = [F.lit(x) for code, names in NOTATIONS.items() for name in names.split() for x in (name, code)]
    return F.create_map(*pairs)[plain]


def _grams(word: str) -> list[int]:
    """Hashed n-grams of a word with its borders."""
    if HAN.match(word):
        grams = list(word) + [word[i : i + 2] for i in range(len(word) - 1)]
    else:
        w = f"^{word.lower()}$"
        grams = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [w]
    return [zlib.crc32(g.encode()) % DIMENSIONS for g in grams]


def words(text: str) -> list[str]:
    return [w for w in WORDS.findall(CODE.sub(" ", text)) if w not in UNITS]


def script(word: str) -> str:
    return "east" if HAN.match(word) else "thai" if THAI.match(word) else "latin"


@dataclass
class Languages:
    """The fitted machines: margin of a clause = sum over its words / sqrt(n-grams) + bias; positive: first of the pair."""

    weights: dict[tuple[str, str], np.ndarray]
    bias: dict[tuple[str, str], float]
    known: dict[str, tuple[dict[tuple[str, str], float], int]] = field(default_factory=dict)

    def biases(self) -> np.ndarray:
        return np.array([self.bias[p] for p in PAIRS])

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def _word(self, word: str) -> tuple[dict[tuple[str, str], float], int]:
        got = self.known.get(word)
        if got is None:
            grams = _grams(word)
            east = script(word) == "east"
            got = ({k: float(w[grams].sum()) for k, w in self.weights.items() if (k == ("zh", "ja")) == east}, len(grams))
            if len(self.known) < 200_000:
                self.known[word] = got
        return got

    def margin(self, pair: tuple[str, str], clause: list[str]) -> float:
        total, n = 0.0, 0
        for w in clause:
            scores, k = self._word(w)
            total += scores.get(pair, 0.0)
            n += k
        return total / max(n, 1) ** 0.5 + self.bias[pair]

    def clause(self, clause: list[str]) -> tuple[str, float]:
        """(language, margin) of words of one script."""
        kind = script(clause[0])
        if kind == "thai":
            return "th", 3.0
        if kind == "east":
            m = self.margin(("zh", "ja"), clause)
            return ("zh" if m > 0 else "ja"), abs(m)
        family = self.margin(("germanic", "malayic"), clause)
        pair = FAMILIES["germanic" if family > 0 else "malayic"]
        m = self.margin(pair, clause)
        return (pair[0] if m > 0 else pair[1]), min(abs(m), abs(family))


def _sgd(rows: list[list[int]], signs: np.ndarray, epochs: int = 4, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Averaged Pegasos: hinge loss, L2, both classes weighted alike."""
    w, avg, b, avg_b = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    x = [np.unique(np.array(r), return_counts=True) for r in rows]
    scale = [1.0 / max(len(r), 1) ** 0.5 for r in rows]
    share = {s: len(signs) / (2 * max((signs == s).sum(), 1)) for s in (-1, 1)}
    order, step, shrink = np.random.default_rng(7), 0, 1.0
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            step += 1
            rate = 1.0 / (decay * (step + 1 / decay / 2))
            idx, n = x[i]
            shrink *= 1 - rate * decay
            if signs[i] * (shrink * (w[idx] @ n) * scale[i] + b) < 1:
                w[idx] += rate * share[int(signs[i])] * signs[i] * n * scale[i] / shrink
                b += 0.01 * rate * share[int(signs[i])] * signs[i]
        avg += w * shrink
        avg_b += b
    return (avg / epochs).astype(np.float32), avg_b / epochs


def _clauses(text: str) -> Iterator[list[str]]:
    """Clauses of a text as words of one script each; a clause of several scripts gives one for each."""
    for line in transducer().apply(text).split("\n"):
        if STAMP.match(line) or PAGE_MARK.match(line):
            continue
        for m in CLAUSE.finditer(line):
            own: dict[str, list[str]] = {}
            for w in words(m[0]):
                own.setdefault(script(w), []).append(w)
            yield from own.values()


def _fit(samples: list[tuple[str, str]]) -> Languages:
    docs = [(lang, [c for c in _clauses(text[:SAMPLE_CHARACTERS]) if sum(map(len, c)) >= 8]) for lang, text in samples]

    def train(use: list[tuple[str, list[list[str]]]]) -> Languages:
        by: dict[str, list[list[int]]] = {}
        for lang, clauses in use:
            kind = {"zh": "east", "ja": "east", "th": "thai"}.get(lang, "latin")
            for c in clauses:
                if script(c[0]) == kind and len(by.setdefault(lang, [])) < SAMPLE_CLAUSES:
                    by[lang].append([g for w in c for g in _grams(w)])
        sides = {k: ([k[0]], [k[1]]) for k in FAMILIES.values()}
        sides["germanic", "malayic"] = (list(FAMILIES["germanic"]), list(FAMILIES["malayic"]))
        weights, bias = {}, {}
        for pair, (first, second) in sides.items():
            a, b = ([r for lang in side for r in by.get(lang, [])] for side in (first, second))
            signs = np.array([1] * len(a) + [-1] * len(b))
            weights[pair], bias[pair] = _sgd(a + b, signs) if a and b else (np.zeros(DIMENSIONS, np.float32), 1.0 if a else -1.0)
        return Languages(weights, bias)

    first = train(docs)
    kept = []
    for lang, clauses in docs:
        letters: dict[str, int] = {}
        for c in clauses:
            guess, _ = first.clause(c)
            letters[guess] = letters.get(guess, 0) + sum(map(len, c))
        if letters and letters.get(lang, 0) > 0.8 * sum(letters.values()):
            kept.append((lang, clauses))
    return train(kept or docs)


def fit(documents: DataFrame) -> Languages:
    """Machines fitted on at most SAMPLE_DOCUMENTS documents of each label, taken in order of a hash of their text."""
    rows = documents.select(notation(F.col("lang")).alias("label"), F.substring("text", 1, SAMPLE_CHARACTERS).alias("text"))
    rows = rows.filter(F.length("text") >= 80).withColumn("h", F.xxhash64("text"))
    # a rank limit is applied in every partition before the shuffle, so a label's task gets little whatever its share
    first = Window.partitionBy("label").orderBy("h", "text")
    rows = rows.filter(F.col("label").isNotNull() & (F.col("label") != "mul")).withColumn("n", F.row_number().over(first))
    sample = rows.filter(F.col("n") <= SAMPLE_DOCUMENTS).orderBy("label", "n").select("label", "text").collect()  # bounded by the limit
    return _fit([(r["label"], r["text"]) for r in sample])


def _folds() -> tuple[re.Pattern, dict[str, str]]:
    """Widths, blanks and look-alikes to their plain form, invisible characters to nothing. Punctuation stays: it is known
    in either width."""
    source, result = one_to_one()
    pairs = {c: r for c, r in zip(source, result + "\0" * len(source)) if r.isascii() and (r.isalnum() or r in "\0 -")}
    return re.compile(f"[{ranges(set(pairs))}]"), {c: r.strip("\0") for c, r in pairs.items()}


NUMBER = "\x01"
CODES = re.compile(r"[0-9][0-9A-Za-z.,:/]*")
TOKENS = re.compile(
    r"[A-Za-z\u00C0-\u024F\u1E00-\u1EFF'’\u0300-\u036F-]*[A-Za-z\u00C0-\u024F\u1E00-\u1EFF][A-Za-z\u00C0-\u024F\u1E00-\u1EFF\u0300-\u036F]*"
    r"|[\u3005-\u3007\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U000323AF]+|[\u0E01-\u0E7F]+"
    r"|[.!?。！？]|[,;:，；：、()（）\"“”「」]|[\n|]|\x01|\x02"
)
LATIN, EAST, THAI_, COMMA, STOP, LINE, DIGITS, TEXT = range(8)
LANGS = ("en", "de", "id", "ms", "zh", "ja", "th")
PAIRS = (("germanic", "malayic"), ("en", "de"), ("id", "ms"), ("zh", "ja"))
CAP = 300_000


class Lookup:
    """Token -> number, with the machines' margins and the token's kind in arrays."""

    def __init__(self, model: Languages):
        self.model, (self.special, self.folds) = model, _folds()
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.arrays: tuple | None = None

    def _new(self, token: str) -> tuple:
        """kind, letters, n-grams, has a small or caseless letter, four margins"""
        c = token[0]
        mark = {"\n": LINE, "|": LINE, NUMBER: DIGITS, "\x02": TEXT}.get(c)
        if mark is None and not any(map(str.isalpha, token)):
            mark = STOP if c in ".!?。！？" else COMMA
        if mark is not None:
            return (mark, 0, 0, False, 0.0, 0.0, 0.0, 0.0)
        if token in UNITS or "-" in token and token.isupper():  # units and codes
            return (LATIN, 0, 0, False, 0.0, 0.0, 0.0, 0.0)
        kind = {"latin": LATIN, "east": EAST, "thai": THAI_}[script(token)]
        scores, n = self.model._word(token)
        letters = sum(map(str.isalpha, token))
        return (kind, letters, n, token.upper() != token or kind != LATIN, *(scores.get(p, 0.0) for p in PAIRS))

    def fold(self, text: str) -> str:
        return text if text.isascii() else self.special.sub(lambda m: self.folds[m[0]], text)

    def tokens(self, text: str) -> np.ndarray:
        ids, found = self.ids, TOKENS.findall(CODES.sub(NUMBER, text))
        try:
            out = [ids[t] for t in found]
        except KeyError:
            for t in found:
                if t not in ids:
                    ids[t] = len(self.rows)
                    self.rows.append(self._new(t))
            self.arrays = None
            out = [ids[t] for t in found]
        return np.array(out, dtype=np.int64)

    def table(self) -> tuple:
        if self.arrays is None:
            cols = list(zip(*self.rows))
            self.arrays = (np.array(cols[0], np.int8), np.array(cols[1], np.int64), np.array(cols[2], np.float64), np.array(cols[3], bool), np.array(cols[4:], np.float64).T)
        return self.arrays


def letters_of_texts(look: Lookup, texts: list[str], running: bool) -> tuple[np.ndarray, ...]:
    """(text number, language number, letters, letters weighted by confidence, letters of the longest sure clause).

    Every clause is judged by its words, one script at a time. Clauses of a sentence speak one language unless one says
    otherwise with conviction: short and unsure ones follow their sentence. Lines of capitals and page marks count for
    nothing; with `running` neither do lines that come three times in a text and end no sentence. A few Latin words in a
    sentence of another script are names and units.
    """
    if len(look.rows) > CAP:
        look.clear()
    ids = look.tokens("\x02".join(map(look.fold, texts)))
    kinds, letters, grams, small, margins = look.table()
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, np.int64))
    if not len(ids):
        return empty
    kind = kinds[ids]
    text = np.cumsum(kind == TEXT)
    line = np.cumsum((kind == LINE) | (kind == TEXT))
    sentence = np.cumsum((kind == STOP) | (kind >= LINE) & (kind != DIGITS))
    clause = np.cumsum((kind >= COMMA) & (kind != DIGITS))
    word = (kind <= THAI_) & (letters[ids] > 0)
    n_lines = line[-1] + 1
    count = lambda m: np.bincount(line[m], minlength=n_lines)
    n_words, n_digits, n_small = count(word), count(kind == DIGITS), count(word & small[ids])
    last = np.zeros(n_lines, np.int64)
    inside = (kind != LINE) & (kind != TEXT)
    np.maximum.at(last, line[inside], np.flatnonzero(inside))
    ends = (kind[last] == STOP) & (n_words > 0)
    drop = (n_small == 0) | ((n_words <= 3) & (n_digits > 0) & ~ends)
    if running:
        mix = (ids[word].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        place = np.arange(len(ids))[word].astype(np.uint64)
        first = np.full(n_lines, len(ids), np.int64)
        np.minimum.at(first, line[word], np.flatnonzero(word))
        mix *= (place - first[line[word]].astype(np.uint64)) * np.uint64(2) + np.uint64(0xD1B54A32D192ED03)
        h = np.zeros(n_lines, np.uint64)
        np.add.at(h, line[word], mix)
        of = np.zeros(n_lines, np.int64)
        of[line] = text
        some = np.flatnonzero(n_words > 0)
        pairs = np.stack([of[some].astype(np.uint64), h[some]], axis=1)
        _, back, times = np.unique(pairs, axis=0, return_inverse=True, return_counts=True)
        often = np.zeros(n_lines, bool)
        often[some] = times[back.ravel()] >= 3
        drop |= often & ~ends
    keep = np.flatnonzero(word & ~drop[line])
    if not len(keep):
        return empty
    k, st, cl = kind[keep].astype(np.int64), sentence[keep], clause[keep]
    # a few Latin words among another script
    n_sent = st[-1] + 1
    latin, east = (np.bincount(st[k == x], minlength=n_sent) for x in (LATIN, EAST))
    stay = ~((k == LATIN) & (east[st] > 0) & (latin[st] < 3))
    keep, k, st, cl = keep[stay], k[stay], st[stay], cl[stay]
    if not len(keep):
        return empty

    def judge(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own, first, back = np.unique(groups * 3 + k, return_index=True, return_inverse=True)
        size = np.bincount(back, grams[ids[keep]])
        m = np.stack([np.bincount(back, margins[ids[keep], i]) for i in range(4)], axis=1) / np.sqrt(np.maximum(size, 1))[:, None] + look.model.biases()
        kind_, germanic = k[first], m[:, 0] > 0
        pair = np.where(germanic, m[:, 1], m[:, 2])
        lang = np.where(kind_ == THAI_, 6, np.where(kind_ == EAST, np.where(m[:, 3] > 0, 4, 5), np.where(germanic, 0, 2) + (pair <= 0)))
        sure = np.where(kind_ == THAI_, 3.0, np.where(kind_ == EAST, np.abs(m[:, 3]), np.minimum(np.abs(m[:, 0]), np.abs(pair))))
        return back, first, lang, sure

    s_back, _, s_lang, s_sure = judge(st)
    c_back, c_first, c_lang, c_sure = judge(cl)
    n = np.bincount(c_back, letters[ids[keep]]).astype(np.int64)
    whole, w_sure = s_lang[s_back[c_first]], s_sure[s_back[c_first]]
    follow = (c_lang != whole) & ((c_sure < CONVICTION) | (n < ENOUGH) & (k[c_first] == LATIN))
    lang, sure = np.where(follow, whole, c_lang), np.where(follow, w_sure, np.where(c_lang == whole, np.maximum(c_sure, w_sure), c_sure))
    key = text[keep][c_first] * 8 + lang
    own, back = np.unique(key, return_inverse=True)
    total = np.bincount(back, n).astype(np.int64)
    weighted = np.bincount(back, n / (1 + np.exp(-2.5 * sure)))
    longest = np.zeros(len(own), np.int64)
    np.maximum.at(longest, back, np.where(sure >= CONVICTION, n, 0))
    return own // 8, own % 8, total, weighted, longest


BODY, HEADING, RUNNING = 0, 1, 2
LETTERS = "lang string, letters bigint, sure double, longest bigint"


def tally(rows: DataFrame, model: Languages, keys: list[str], running: bool) -> DataFrame:
    """keys (bigint), lang, letters, sure, longest: letters of each row's text by language; no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # four machines of DIMENSIONS floats, 1 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = Lookup(shared.value)
        for b in batches:
            own, texts, at = [b[k].to_numpy() for k in keys], b["text"].tolist(), 0
            while at < len(texts):  # in portions of some million characters
                size, to = 0, at
                while to < len(texts) and (to == at or size + len(texts[to]) < 2_000_000):
                    size += len(texts[to])
                    to += 1
                no, lang, letters, sure, longest = letters_of_texts(look, [t.replace("\x02", " ") for t in texts[at:to]], running)
                named = {k: v[at:to][no] for k, v in zip(keys, own)}
                yield pd.DataFrame(named | {"lang": np.array(LANGS, object)[lang], "letters": letters, "sure": sure, "longest": longest})
                at = to

    some = rows.filter(F.col("text").isNotNull()).select(*keys, "text")
    return some.mapInPandas(run, ", ".join(f"{k} bigint" for k in keys) + f", {LETTERS}")


def decide(letters: DataFrame, key: str) -> DataFrame:
    """key, lang, confidence: the language of more than SHARE of the letters, else mul."""
    best = F.max_by(F.struct("lang", "letters", "sure"), F.struct("letters", "lang"))
    by = letters.groupBy(key, "lang").agg(F.sum("letters").alias("letters"), F.sum("sure").alias("sure"))
    all_ = by.groupBy(key).agg(F.sum("letters").alias("n"), F.sum("sure").alias("s"), best.alias("b")).filter("n > 0")
    one = F.col("b.letters") > SHARE * F.col("n")
    return all_.select(
        key, F.when(one, F.col("b.lang")).otherwise("mul").alias("lang"),
        F.round(F.when(one, F.col("b.sure") / F.col("b.letters")).otherwise(F.col("s") / F.col("n")), 4).alias("confidence"),
    )


def _counted(documents: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Letters by language of the segments (with `part`: BODY, HEADING or RUNNING), and of the documents: by their segments but
    running headers and footers, or by their text where they have none."""
    model = fit(documents)
    kind = F.coalesce(F.col("kind"), F.lit(""))
    part = F.when(kind == "heading", HEADING).when(kind.isin("header", "footer"), RUNNING).otherwise(BODY).cast("bigint")
    rows = segments.select("seg_id", "doc_id", "text", part.alias("part"))
    # only counts leave the first stage, so no text is ever shuffled; three branches read those of the segments
    seg_letters = cut_lineage(tally(rows, model, ["seg_id", "doc_id", "part"], False).dropDuplicates(["seg_id", "lang"]))
    of_doc = seg_letters.filter(F.col("part") != RUNNING).select("doc_id", "lang", "letters", "sure")
    plain = tally(documents, model, ["doc_id"], True).drop("longest").dropDuplicates(["doc_id", "lang"])
    plain = plain.join(rows.filter(F.col("part") == BODY).select("doc_id").distinct(), "doc_id", "left_anti")
    return seg_letters, of_doc.unionByName(plain)


def tally_confidence(documents: DataFrame, segments: DataFrame, tallies: DataFrame) -> DataFrame:
    """doc_id, language, characters, stated, confidence: each tally's confidence as the text bears it out: how sure its
    letters are of that language, times the part of the counted characters that are. stated: the tally's own, null where it
    is not between 0 and 1. Tallies delivered twice count once; a language that the text lacks has 0."""
    _, letters = _counted(documents, segments)
    by = letters.groupBy("doc_id", "lang").agg(F.sum("letters").alias("letters"), F.sum("sure").alias("sure"))
    own = tallies.select("doc_id", "language", "characters", F.when(F.col("confidence").between(0, 1), F.col("confidence")).alias("stated")).distinct()
    met = own.withColumn("lang", notation(F.col("language"))).join(by, ["doc_id", "lang"], "left")
    part = F.least(F.lit(1.0), F.try_divide(F.col("letters"), F.col("characters")))
    return met.select("doc_id", "language", "characters", "stated", F.round(F.coalesce(part * F.col("sure") / F.col("letters"), F.lit(0.0)), 4).alias("confidence"))


def attribute(documents: DataFrame, segments: DataFrame, findings: DataFrame) -> DataFrame:
    """record, record_id, lang, confidence, label: a language for every document, finding and part of a mixed segment.

    Documents that have segments are judged by these (running headers and footers have no language), others by their text; a
    finding by the segment it points to, of whatever kind. A segment is mixed if two languages have a clause of running text in it; it has a row for each.
    """
    seg_letters, doc_letters = _counted(documents, segments)
    labelled = documents.select("doc_id", notation(F.col("lang")).alias("label")).dropDuplicates(["doc_id"])
    doc_rows = decide(doc_letters, "doc_id").join(labelled, "doc_id").select(
        F.lit("document").alias("record"), F.col("doc_id").alias("record_id"), "lang", "confidence", "label"
    )
    east = F.col("lang").isin("zh", "ja", "th")
    said = seg_letters.filter(F.col("part") == BODY).filter(F.col("longest") >= F.when(east, ENOUGH_EAST).otherwise(ENOUGH))
    mixed = said.groupBy("seg_id").agg(F.count("*").alias("n"), F.collect_list(F.struct("lang", "sure", "letters")).alias("parts")).filter("n > 1")
    seg_rows = mixed.select("seg_id", F.explode("parts").alias("p")).select(
        F.lit("segment").alias("record"), F.col("seg_id").alias("record_id"), F.col("p.lang").alias("lang"),
        F.round(F.col("p.sure") / F.col("p.letters"), 4).alias("confidence"), F.lit(None).cast("string").alias("label"),
    )
    found = findings.select("finding_id", "seg_id", notation(F.col("language")).alias("label")).dropDuplicates(["finding_id"])
    of_seg = decide(seg_letters, "seg_id").join(mixed.select("seg_id", F.lit(True).alias("mixed")), "seg_id", "left")
    of_seg = of_seg.withColumn("lang", F.when(F.col("mixed"), F.lit("mul")).otherwise(F.col("lang")))
    finding_rows = found.join(of_seg, "seg_id").select(
        F.lit("finding").alias("record"), F.col("finding_id").alias("record_id"), "lang", "confidence", "label"
    )
    return reduce(DataFrame.unionByName, (doc_rows, seg_rows, finding_rows))


def wrong_or_missing(attributed: DataFrame) -> DataFrame:
    """Documents and findings whose label is missing or another language's, and the languages of mixed segments."""
    keep = (F.col("record") == "segment") | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return attributed.filter(keep).select("record", "record_id", "lang").distinct()
