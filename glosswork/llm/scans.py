"""Text of scanned pages to continuous paragraphs (problem 6).

Lines are labelled header (page furniture: running header or footer, page number, stamp), body or break (blank)
by a linear model over the sequence of a page's lines, decoded by Viterbi. Its layout features: place on the page,
likeness to the line in the same place of the other pages, page marks, capitals, length against the page's width,
sentence ends and starts, flow from the line before to the line after, and likeness to short lines of many other
documents (stamps). The model starts from prior weights and is re-estimated by Viterbi training (label, count
features and transitions, repeat) over all pages; a round's counts are a few dozen numbers a partition.

Body lines are joined over furniture, blank lines' paragraphs and page ends. A word divided at a line's end is
joined if the joined form is more usual in the corpus than the hyphenated one; a word is misread if exchanging
look-alike strokes (rn-m, cl-d, 1-l ...), however many, gives one at least RATIO times as usual. Words are compared with
counts over all documents by joins, with those that fold to the same strokes; no vocabulary is collected.

Edge cases: null or empty pages have no lines with a defect; pages delivered twice count once; a missing page
ends the text, so nothing is joined over it; documents are labelled in blocks of BLOCK_PAGES pages.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from glosswork.llm.groups import in_groups, together
from glosswork.llm.text_forms import transducer
from glosswork.session import cut_lineage

BLOCK_PAGES = 200
#: how much more usual than a word its corrected form must be
RATIO = 10
#: rounds of Viterbi training
ROUNDS = 2
#: share of the scanned documents in which a short line must stand to be a stamp
STAMP_SHARE = 0.002

# What a scanner reads for what is printed.
STROKES = [
    ("c", "e"), ("e", "c"), ("@", "a"), ("ri", "n"), ("n", "ri"), ("!", "i"), ("!", "l"), ("f", "t"), ("t", "f"), ("0", "o"), ("5", "s"),
    ("1", "l"), ("1", "i"), ("9", "g"), ("6", "b"), ("8", "b"), ("$", "s"), ("|", "l"), ("|", "i"), ("ii", "u"), ("u", "ii"), ("cl", "d"),
    ("d", "cl"), ("rn", "m"), ("m", "rn"), ("b", "h"), ("h", "b"), ("lc", "k"), ("k", "lc"), ("h", "li"), ("li", "h"), ("vv", "w"),
    ("w", "vv"), ("nn", "m"), ("m", "nn"), ("q", "g"), ("y", "v"),
]
BY_FIRST = {c: [s for s in STROKES if s[0][0] == c] for c in {s[0][0] for s in STROKES}}
# Letters read for digits.
DIGITS = [("O", "0"), ("o", "0"), ("Q", "0"), ("D", "0"), ("l", "1"), ("I", "1"), ("i", "1"), ("|", "1"), ("!", "1"), ("Z", "2"), ("S", "5"), ("s", "5"), ("B", "8"), ("g", "9"), ("q", "9")]
# Han characters of like shape, the one read and the one printed.
HAN = dict(
    p.split("-") for p in (
        "贝-员 顼-须 科-料 庄-压 枇-批 际-标 晶-品 杳-查 斑-班 入-人 冼-洗 彔-录 较-校 捡-检 厍-库 侧-测 钏-钟 笺-签 问-间 曰-日 帖-贴 末-未 己-已 "
        "土-士 干-千 犬-大 太-大 目-日 由-田 甲-申 夭-天 今-令 兔-免 折-拆 晴-睛 侯-候 拔-拨 徒-徙 季-李 处-外 亏-亐 氷-水 木-本 休-体 住-往 "
        "沽-活 扳-板 抗-杭 衣-农 圆-园 困-因 囚-四 刀-力 九-丸 白-百 乌-鸟 鸣-呜 免-兔 埋-理 盒-盆 栗-粟 哀-衷 辨-辩 副-剐 冶-治 泠-冷 凊-清"
    ).split()
)

WORD = re.compile(r"[A-Za-zÀ-ɏ0-9@!|$]*[A-Za-zÀ-ɏ0-9@|$](?:['’][A-Za-z]+)?")
DIVIDED = re.compile(r"[A-Za-zÀ-ɏ0-9@!|$-]*[A-Za-zÀ-ɏ0-9@!|$](?=[-‐‑¬\xad–]\s*$)")
HYPHENS = "-‐‑¬\xad–"
PART = re.compile(r"[A-Za-zÀ-ɏ0-9]+")
WATCHED = frozenset(HAN) | frozenset(HAN.values())
WATCHED_ONE = re.compile(f"[{''.join(sorted(WATCHED))}]")
HAN_RUN = re.compile(r"[㐀-鿿]+")


def words_of(text: str) -> list[str]:
    """Words as they are counted: small letters, numbers, pairs around hyphens, and Han characters of like shape with their neighbours."""
    plain = text.lower()
    out = WORD.findall(plain)
    at = plain.find("-")
    while at >= 0:
        if right := PART.match(plain, at + 1):
            k = at
            while k and PART.match(plain[k - 1]):
                k -= 1
            if k < at:
                out.append(f"{plain[k:at]}-{right[0]}")
        at = plain.find("-", at + 1)
    return out


def han_contexts(text: str) -> list[tuple[int, str]]:
    """(position, context) of watched characters: with both neighbours, or with one at a run's end."""
    out = []
    for m in WATCHED_ONE.finditer(text):
        i = m.start()
        left, right = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        left, right = (left if "㐀" <= left <= "鿿" else "<"), (right if "㐀" <= right <= "鿿" else ">")
        if left != "<" or right != ">":
            out.append((i, left + m[0] + right))
    return out


def _loose(context: str) -> list[str]:
    """The contexts a count goes to: the exact one, and those with one neighbour only."""
    left, c, right = context
    out = [context]
    if left != "<" and right != ">":
        out += ["<" + c + right, left + c + ">"]
    return out


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: counts over all documents, added up in each batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: Counter = Counter()
            for text in b["text"]:
                plain = transducer().apply(text)
                counts.update(words_of(plain))
                counts.update(x for _, c in han_contexts(plain) for x in _loose(c))
            yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    rows = documents.select("text").filter(F.length("text") > 0).mapInPandas(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def corrections(word: str) -> list[str]:
    """Forms of a word that need no vocabulary: Han characters, digits, one or two strokes exchanged in a word of at most 40
    characters. `stroke_key` and `reads_as` find those with more strokes, and longer words."""
    if len(word) == 3 and HAN_RUN.match(word[1]):
        return [word[0] + HAN[word[1]] + word[2]] if word[1] in HAN else []
    if len(word) > 40:
        return []
    out: set[str] = set()
    plain = word.lower()
    if any(c.isdigit() for c in word) or len(word) <= 2:
        swap = dict(DIGITS)
        whole = "".join(swap.get(c, c) for c in word)
        if whole.isdigit() and whole != word:
            out.add(whole)
    sites = [(m.start(), a, b) for a, b in STROKES for m in re.finditer(f"(?={re.escape(a)})", plain)]
    odd = [s for s in sites if not s[1].isalpha()]  # marks and digits in a word are never right by themselves
    for one in sites:
        out.add(plain[: one[0]] + one[2] + plain[one[0] + len(one[1]) :])
    for x, y in combinations(sorted(sites), 2):
        if x[0] + len(x[1]) <= y[0]:
            out.add(plain[: x[0]] + x[2] + plain[x[0] + len(x[1]) : y[0]] + y[2] + plain[y[0] + len(y[1]) :])
    if len(odd) >= 2:
        table = {a: b for a, b in reversed(STROKES) if len(a) == 1 and not a.isalpha()}
        out.add("".join(table.get(c, c) for c in plain))
    return sorted(out - {plain})


def stroke_key(word: Column) -> Column:
    """The strokes of a word: the same for all words that exchanging any number of STROKES makes of one another."""
    key = F.translate(F.lower(word), "e@!1|lf05$9qy", "caiiiitossggv")
    for letters, strokes in (("[68bhu]", "ii"), ("d", "ci"), ("k", "ic"), ("w", "vv"), ("m", "rri"), ("n", "ri")):
        key = F.regexp_replace(key, letters, strokes)
    return F.regexp_replace(key, "(?<=r)i(?=r+i)", "")  # m is rn as well as nn


def reads_as(word: str, form: str) -> bool:
    """The form is the word with strokes exchanged at places that do not overlap."""
    word, seen, stack = word.lower(), {(0, 0)}, [(0, 0)]
    if word == form:
        return False
    while stack:
        i, j = stack.pop()
        if i == len(word) and j == len(form):
            return True
        ways = [(i + len(a), j + len(b)) for a, b in BY_FIRST.get(word[i : i + 1], ()) if word.startswith(a, i) and form.startswith(b, j)]
        if i < len(word) and j < len(form) and word[i] == form[j]:
            ways.append((i + 1, j + 1))
        stack += [x for x in ways if x not in seen]
        seen.update(ways)
    return False


@pandas_udf(T.BooleanType())
def reads_as_forms(words: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([reads_as(w, f) for w, f in zip(words, forms)], dtype=bool)


@pandas_udf(T.ArrayType(T.StringType()))
def correction_forms(words: pd.Series) -> pd.Series:
    return words.map(corrections)


# ---- line labelling ----

FOLD = str.maketrans({"0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "5": "s", "9": "g", "@": "a", "c": "e", "f": "t", "h": "b", "6": "b", "8": "b"})
PAGE_MARK = re.compile(r"^\W*(?:(?:[A-Za-z]{2,8}\.?\s*)?[0-9OlISB]{1,4}(?:\s*(?:/|of|dari|von|de|[a-z]{2,4})\s*[0-9OlISB]{1,4})?|第\s*\S{1,4}\s*页.*|.{0,24}\|\s*[0-9OlISB]{1,4}\s*/\s*[0-9OlISB]{1,4}|Rev\.?\s*[0-9OlISB]{1,3}\s+\S{2,6}\s*[0-9OlISB]{1,4})\W*$")
BARE = re.compile(r"^[\d.,]+(?:\s?[A-Za-z°%µ/]{1,4})?$")
ENDS = re.compile(r"[.!?。！？:：][\"”」』)）]*\s*$")
TITLE = re.compile(r"^(?:[A-Z]{2,5}-[A-Z]{2,4}-\S{2,4}\b|.*\|| *.*\bRev\.? ?\S{1,3}\s*$)")


EASTERN, WESTERN = re.compile("[\u0e01-\u0e7f\u3040-\u30ff\u3400-\u9fff]"), re.compile("[A-Za-z\u00c0-\u024f]")
NUMERIC = re.compile(r"[0-9][0-9.,:/-]{3,}|(?<![A-Za-z@])[0-9][0-9.,:/-]*(?![A-Za-z@])")
#: a speck before a line
SPECK = re.compile(r"^(?:[^\w(（“\"'\[|]+|[il|]\s+)(?=[A-Z⺀-\ud7ff])")


def fold(line: str) -> str:
    """Letters of a line in classes of strokes that are mistaken for one another."""
    s = NUMERIC.sub("", line).lower().replace("rn", "m").replace("ri", "n").replace("cl", "d").replace("ii", "u").replace("vv", "w").replace("li", "h").replace("lc", "k")
    return re.sub(r"[\W\d_]+", "", s.translate(FOLD))


def _alike(a: str, b: str) -> bool:
    if not a or not b:
        return False
    short, long = sorted((a, b), key=len)
    if long.startswith(short) and len(short) * 2 >= len(long):
        return True
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() > 0.75 and m.quick_ratio() > 0.75 and m.ratio() > 0.75


def _running(firsts: list[str], pages: list[int]) -> list[bool]:
    """Whether a page's first line is like those of half of the pages, or of the odd or the even ones, and of two at least.
    Distinct lines are compared with one of each group only, the most usual first."""
    tally = Counter(x for x in firsts if x)
    groups: list[tuple[str, set[str]]] = []
    for k, _ in tally.most_common():
        for head, members in groups:
            if _alike(head, k):
                members.add(k)
                break
        else:
            groups.append((k, {k}))
    sides = (pages, [p for p in pages if p % 2], [p for p in pages if not p % 2])
    good: set[str] = set()
    for _, members in groups:
        own = {p for p, k in zip(pages, firsts) if k in members}
        if sum(tally[k] for k in members) >= 2 and any(side and len(own.intersection(side)) * 2 >= len(side) for side in sides):
            good |= members
    return [k in good for k in firsts]


FEATURES = (
    "bias first_like first_title last_like edge_mark middle_mark own_number caps stamp other_script starts_small ends long short bare interrupts edge"
).split()
BIT = {x: 1 << k for k, x in enumerate(FEATURES)}
#: prior weights of header against body
PRIOR = dict(zip(FEATURES, (-2.0, 5.0, 4.0, 5.0, 4.0, 0.0, 2.0, 4.0, 6.0, 5.0, -3.0, -3.0, -3.0, 0.5, -2.0, 1.0, 0.0)))


def page_features(lines: list[list[str]], pages: list[int], stamps: frozenset) -> list[list[set[str] | None]]:
    """Features of every line of every page; None for a blank line."""
    edges = [([i for i, x in enumerate(p) if x.strip()] or [None]) for p in lines]
    firsts = [fold(SPECK.sub("", p[e[0]].strip())) if e[0] is not None else "" for p, e in zip(lines, edges)]
    lasts = [re.sub(r"[0-9OlISB]+", "#", p[e[-1]]) if e[0] is not None else "" for p, e in zip(lines, edges)]
    last_of = Counter(lasts)
    no_like = _running(firsts, pages)
    out = []
    for no, p in enumerate(lines):
        filled = edges[no]
        width = float(np.median([len(x) for x in p if x.strip()])) if filled[0] is not None else 1.0
        whole = "".join(p)
        n_east, n_latin = len(EASTERN.findall(whole)), len(WESTERN.findall(whole))
        east = n_east > n_latin if n_east + n_latin else None
        row: list[set[str] | None] = []
        for i, line in enumerate(p):
            text = SPECK.sub("", line.strip())
            if not text:
                row.append(None if not line.strip() else {"bias", "short"})
                continue
            f = {"bias"}
            first, last = i == filled[0], i == filled[-1]
            key = fold(text)
            if first and no_like[no]:
                f.add("first_like")
            if first and TITLE.match(text) and not ENDS.search(text):
                f.add("first_title")
            if last and PAGE_MARK.match(text) and last_of[lasts[no]] >= 2:
                f.add("last_like")
            if PAGE_MARK.match(text) and not (BARE.match(text) and not last and not first):
                f.add("edge_mark" if first or last else "middle_mark")
            if (first or last) and re.sub(r"\D", "", text.translate(str.maketrans("OlISB", "01158"))) == str(pages[no]):
                f.add("own_number")
            letters = [c for c in text if c.isalpha()] if len(text) < 0.8 * width + 8 else []
            if len(letters) >= 5 and not ENDS.search(text) and not any(c.islower() or c > "ɏ" for c in letters) and len(text) < 0.8 * width + 8:
                f.add("caps")
            if len(text) < 40 and key and not ENDS.search(text) and any(key[:n] in stamps for n in (len(key), 8)):
                f.add("stamp")
            if len(text) < 40 and len(letters) >= 4 and not ENDS.search(text) and east is not None and all((c > "ɏ") != east for c in letters):
                f.add("other_script")
            if text[0].islower():
                f.add("starts_small")
            if ENDS.search(text):
                f.add("ends")
            f.add("long" if len(text) > 0.85 * width else "short" if len(text) < 0.6 * width else "bias")
            if BARE.match(text) and not (first or last):
                f.add("bare")
            if first or last:
                f.add("edge")
            before = next((p[k].strip() for k in range(i - 1, -1, -1) if p[k].strip()), "")
            after = next((p[k].strip() for k in range(i + 1, len(p)) if p[k].strip()), "")
            if before and after and not ENDS.search(before) and (after[0].islower() or before[-1] in HYPHENS) and not text[0].islower():
                f.add("interrupts")
            row.append(f)
        out.append(row)
    return out


class LineModel:
    """Header against body: weights of features and of label pairs. A line is a set of features as bits; -1 is a blank line."""

    def __init__(self, weights: dict[str, float] | None = None, steps: np.ndarray | None = None):
        self.weights = weights or dict(PRIOR)
        self.steps = steps if steps is not None else np.array([[0.0, 0.0], [0.0, -1.0]])  # body, header
        self.known: dict[int, float] = {}

    def score(self, line: int) -> float:
        got = self.known.get(line)
        if got is None:
            got = self.known[line] = sum(self.weights[x] for k, x in enumerate(FEATURES) if line >> k & 1)
        return got

    def label(self, row: list[int]) -> list[str]:
        """Viterbi over the filled lines of a page; blank lines are breaks."""
        out, back, body, header = ["break"] * len(row), [], 0.0, 0.0
        (bb, bh), (hb, hh) = self.steps.tolist()
        at = [i for i, f in enumerate(row) if f >= 0]
        for k, i in enumerate(at):
            s = self.score(row[i])
            if k:
                back.append((int(header + hb > body + bb), int(header + hh > body + bh)))
                body, header = max(body + bb, header + hb), max(body + bh, header + hh) + s
            else:
                header = s
        j = int(header > body)
        for k in range(len(at) - 1, -1, -1):
            out[at[k]] = ("body", "header")[j]
            if k:
                j = back[k - 1][j]
        return out

    def counts(self, rows: list[list[int]]) -> Counter:
        """What one round of Viterbi training counts: (feature or "lines", label) and (label, label)."""
        out: Counter = Counter()
        for row in rows:
            labels = [(f, x) for f, x in zip(row, self.label(row)) if f >= 0]
            out.update(("line", f, x) for f, x in labels)
            out.update(("step", a, b) for (_, a), (_, b) in zip(labels, labels[1:]))
        total: Counter = Counter()
        for (kind, f, x), n in out.items():
            if kind == "step":
                total["step", f, x] += n
                continue
            total["lines", "", x] += n
            for k, name in enumerate(FEATURES):
                if f >> k & 1:
                    total["line", name, x] += n
        return total

    def retrained(self, counts: dict[tuple[str, str, str], int]) -> LineModel:
        """The model after a round: half prior, half the odds that were counted."""
        names = ("body", "header")
        total = np.array([2.0 + counts.get(("lines", "", x), 0) for x in names])
        seen = {f: np.array([1.0 + counts.get(("line", f, x), 0) for x in names]) for f in FEATURES}
        steps = np.array([[1.0 + counts.get(("step", a, b), 0) for b in names] for a in names])
        odds = {f: float(np.log(seen[f][1] / total[1]) - np.log(seen[f][0] / total[0])) for f in FEATURES}
        odds["bias"] = float(np.log(total[1] / total[0]))
        weights = {f: 0.5 * PRIOR[f] + 0.5 * float(np.clip(odds[f], -6, 6)) for f in FEATURES}
        rows = np.log(steps / steps.sum(axis=1, keepdims=True))
        return LineModel(weights, 0.5 * (rows - rows[:, :1]) * np.array([[0, 0.3], [0, 0.3]]))


def bits(row: list[set[str] | None]) -> list[int]:
    return [-1 if f is None else sum(BIT[x] for x in f) for f in row]


def _stamps(pages: DataFrame) -> frozenset:
    """Keys of short lines that stand in at least STAMP_SHARE of the scanned documents and end no sentence: fewer than
    (short lines a document) / STAMP_SHARE of them, whatever the size of the corpus."""
    lines = pages.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter((F.length("line") < 40) & (F.length("line") > 2))
    lines = lines.filter(~F.col("line").rlike(ENDS.pattern) & ~F.col("line").rlike(r"[-‐‑¬\x{AD}–,，]\s*$") & F.col("line").rlike(r"^[^\p{L}]*(\p{Lu}|\p{Lo})"))
    lines = lines.select("doc_id", F.regexp_replace(F.lower("line"), r"[\s\p{P}\p{N}|]+", "").alias("k")).filter(F.length("k") >= 4).distinct()
    n = pages.select("doc_id").distinct().count()
    keys = lines.groupBy("k").count().filter(F.col("count") >= max(3, STAMP_SHARE * n)).select("k").collect()
    out = set()
    for (k,) in keys:
        out |= {fold(k), fold(k)[:8]} if len(fold(k)) >= 8 else {fold(k)}
    return frozenset(out)


class Rows:
    """Rows of many groups as frames of some thousand."""

    def __init__(self, schema: str):
        self.schema, self.found = [c.split() for c in schema.split(", ")], []

    def add(self, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        self.found.extend(rows)
        if len(self.found) >= 5000:
            yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame(self.found, columns=[n for n, _ in self.schema])
        self.found = []
        yield frame.astype({n: "Int32" for n, kind in self.schema if kind == "int"})


PAGE = "doc_id bigint, page int, text string, lines array<int>"
LINE = "doc_id bigint, page int, line_no int, label string, words array<string>, divided string, rest string, rest_page int, rest_line int, rest_all string, contexts array<string>"


def _doc_lines(doc: int, pages: list[tuple[int, str]], labels: list[list[str]], own: set[int]) -> Iterator[tuple]:
    lines = [t.split("\n") for _, t in pages]
    numbers = [p for p, _ in pages]
    flow = [(no, i) for no, p in enumerate(lines) for i in range(len(p)) if labels[no][i] == "body"]
    after = {a: b for a, b in zip(flow, flow[1:]) if numbers[b[0]] - numbers[a[0]] <= 1}
    heads: dict[tuple[int, int], int] = {}
    plain = {k: transducer().apply(lines[k[0]][k[1]].rstrip().translate(str.maketrans({c: "-" for c in HYPHENS}))) for k in flow}
    cut = {k: m[0] for k in flow if (m := DIVIDED.search(plain[k]))}
    for k in cut:
        if k in after:
            heads[after[k]] = len(re.match(r"[^\s]*", plain[after[k]].lstrip())[0])
    for no, p in enumerate(lines):
        if numbers[no] not in own:
            continue
        for i in range(len(p)):
            k = (no, i)
            if labels[no][i] != "body":
                yield (doc, numbers[no], i, labels[no][i], [], None, None, None, None, None, [])
                continue
            text = plain[k]
            tail = cut.get(k)
            inner = text[: len(text) - len(tail) - 1] if tail is not None else text
            if k in heads:
                inner = inner.lstrip()[heads[k] :] if heads[k] <= len(inner.lstrip()) else ""
            words = [w for w in WORD.findall(inner)]
            rest = rest_page = rest_line = rest_all = None
            if tail is not None and k in after:
                b = after[k]
                chunk = re.match(r"[^\s]*", plain[b].lstrip())[0]
                m = WORD.match(chunk)
                rest, rest_page, rest_line, rest_all = (m[0] if m else ""), numbers[b[0]], b[1], chunk
            piece = tail.rpartition("-")[2] if tail is not None else None
            yield (doc, numbers[no], i, "body", words, piece, rest, rest_page, rest_line, rest_all, [c for _, c in han_contexts(text)])


def _blocks(pages: DataFrame) -> DataFrame:
    """Pages once, with their block; the first page of the next block comes along, for the word that its text begins with."""
    block = F.floor(F.col("page") / BLOCK_PAGES)
    blocks = F.when(F.col("page") % BLOCK_PAGES == 0, F.array(block, block - 1)).otherwise(F.array(block))
    return pages.select("*", F.explode(blocks).alias("block"))


def featured(pages: DataFrame) -> DataFrame:
    """doc_id, page, text, lines: pages with the features of their lines as bits."""
    own = pages.select("doc_id", "page", "text").filter(F.length("text") > 0).dropDuplicates(["doc_id", "page"])
    shared = pages.sparkSession.sparkContext.broadcast(_stamps(own))  # fewer than (short lines a document) / STAMP_SHARE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (doc, _), g in in_groups(batches, ["doc_id", "block"]):
            texts, numbers = g["text"].tolist(), g["page"].tolist()
            found = zip(numbers, texts, map(bits, page_features([x.split("\n") for x in texts], numbers, shared.value)))
            yield from out.add([(doc, *x) for x in found])
        yield from out.rest()

    out = Rows(PAGE)
    pages_ = own.withColumn("block", F.floor(F.col("page") / BLOCK_PAGES))
    return together(pages_, ["doc_id", "block"], "page").mapInPandas(run, PAGE)


def trained(rows: DataFrame, rounds: int = ROUNDS) -> LineModel:
    """Viterbi training over all pages: each round labels them and adds up what its labels count, in every partition first."""
    model, spark = LineModel(), rows.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total: Counter = Counter()
            for b in batches:
                total.update(shared.value.counts([x.tolist() for x in b["lines"]]))
            yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["kind", "x", "y", "n"])

        counts = rows.select("lines").mapInPandas(run, "kind string, x string, y string, n bigint").groupBy("kind", "x", "y").agg(F.sum("n").alias("n"))
        model = model.retrained({(r["kind"], r["x"], r["y"]): r["n"] for r in counts.collect()})  # a row a feature and label
    return model


def labelled_lines(pages: DataFrame) -> DataFrame:
    """Every line of every page with its label, its whole words, and the word divided at its end with its other part."""
    rows = cut_lineage(featured(pages))  # read by every round of training and by the labels
    shared = pages.sparkSession.sparkContext.broadcast(trained(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (doc, block), g in in_groups(batches, ["doc_id", "block"]):
            numbers = g["page"].tolist()
            labels = [shared.value.label(x.tolist()) for x in g["lines"]]
            yield from out.add(_doc_lines(doc, list(zip(numbers, g["text"])), labels, {p for p in numbers if p // BLOCK_PAGES == block}))
        yield from out.rest()

    out = Rows(LINE)
    return together(_blocks(rows), ["doc_id", "block"], "page").mapInPandas(run, LINE)


def _judged(words: DataFrame, counts: DataFrame) -> DataFrame:
    """word (as read), n, best, n_best: its count, and the most usual corrected form."""
    known = words.join(counts.withColumnRenamed("word", "w"), F.lower("word") == F.col("w"), "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    forms = known.select("word", "n", F.explode(correction_forms("word")).alias("form"))
    good = forms.join(counts.select(F.col("word").alias("form"), F.col("n").alias("n_form")), "form").select("word", "form", "n_form")
    # only a form that is usual enough to matter is read stroke by stroke; digits alone are a number
    latin = F.col("word").rlike("[A-Za-z]")
    keyed = counts.filter(latin & (F.col("n") >= RATIO)).select(stroke_key(F.col("word")).alias("key"), F.col("word").alias("form"), F.col("n").alias("n_form"))
    near = known.filter(latin | F.col("word").rlike("[@!|$]")).withColumn("key", stroke_key(F.col("word"))).join(keyed, "key")
    near = near.filter((F.col("n_form") >= RATIO * F.greatest("n", F.lit(1))) & (F.lower("word") != F.col("form")))
    good = good.unionByName(near.filter(reads_as_forms("word", "form")).select("word", "form", "n_form"))
    best = good.groupBy("word").agg(F.max_by("form", F.struct("n_form", "form")).alias("best"), F.max("n_form").alias("n_best"))
    return known.join(best, "word", "left").na.fill({"n_best": 0})


WHERE = ["doc_id", "page", "line_no"]
#: words known as misread that are sent to the workers; if there are more, lines meet them in a salted join
MOST_WRONG, SALTS = 1_000_000, 32


def decisions(pages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, misread, cut). misread: WHERE, word, best of words inside lines; cut: divided words (WHERE, divided, rest,
    rest_page, rest_line, best) with `broken`, and `fixed` where the joined word is misread for `best`."""
    lines = cut_lineage(labelled_lines(pages))
    counts = cut_lineage(vocabulary(documents))
    body = lines.filter("label = 'body'")
    whole = body.select(*WHERE, F.explode(F.array_distinct(F.concat("words", "contexts"))).alias("word"))
    # a divided word: joined, with a hyphen, and the part that stands alone
    parts = body.filter("divided is not null").select(
        *WHERE, "divided", "rest", "rest_page", "rest_line", "rest_all",
        F.concat("divided", F.coalesce("rest", F.lit(""))).alias("joined"), F.lower(F.concat_ws("-", "divided", "rest")).alias("compound"),
    )
    asked = whole.select("word").union(parts.select("joined")).distinct().filter(F.length("word") > 0)
    verdict = cut_lineage(_judged(asked, counts))
    wrong = (F.col("n_best") >= RATIO * F.greatest("n", F.lit(1))) & (F.col("n_best") > 0)
    known = verdict.filter(wrong).select("word", "best")
    if known.count() <= MOST_WRONG:  # usual words stay where they are
        misread = whole.join(F.broadcast(known), "word")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        misread = whole.withColumn("salt", F.pmod(F.xxhash64(*WHERE), F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"]).drop("salt")
    cut = parts.join(verdict.select(F.col("word").alias("joined"), "n", "best", "n_best"), "joined", "left")
    cut = cut.join(counts.select(F.col("word").alias("compound"), F.col("n").alias("n_compound")), "compound", "left").na.fill(0, ["n", "n_best", "n_compound"])
    fixed = wrong & F.col("rest").isNotNull()
    usual = F.when(fixed, F.col("n_best")).otherwise(F.col("n"))
    # parts of codes and compounds keep their hyphen: the rest then goes on in capitals, or the compound is the usual form
    broken = F.when(
        F.col("rest").isNull() | (F.col("rest") == ""), F.col("divided").rlike(r"^\p{Ll}+$")
    ).otherwise((usual > F.col("n_compound")) | ((usual == 0) & (F.col("n_compound") == 0) & ~F.col("rest").rlike(r"^[\p{Lu}\d]")))
    return lines, misread, cut.withColumns({"broken": broken, "fixed": fixed})


def defects(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, page, line_no, defect: furniture lines, lines that end in a divided word, lines with a misread character."""
    lines, inside, cut = decisions(pages, documents)
    furniture = lines.filter("label = 'header'").select(*WHERE, F.lit("furniture").alias("defect"))
    # a misread character of a joined word belongs to the line it stands on
    same = F.expr("substring(lower(divided), 1, length(divided)) = substring(best, 1, length(divided))")
    hit = cut.filter(F.col("fixed") & F.col("broken"))
    first = hit.filter(~same).select(*WHERE)
    second = hit.filter(same).select("doc_id", F.col("rest_page").alias("page"), F.col("rest_line").alias("line_no"))
    misread = inside.select(*WHERE).unionByName(first).unionByName(second).withColumn("defect", F.lit("misread"))
    ends = cut.filter("broken").select(*WHERE, F.lit("broken").alias("defect"))
    return furniture.unionByName(ends).unionByName(misread).distinct()


def _cased(read: str, best: str) -> str:
    """The right form in the case of the one that was read."""
    letters = [c for c in read if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return best.upper()
    return best[:1].upper() + best[1:] if read[:1].isupper() else best


def repaired(line: str, words: list[str], bests: list[str], head: int, tail: str | None, ending: str | None) -> str:
    """A line with its misread words right; without the `head` characters that went to the line before it; `tail`, what its
    end reads, becomes `ending`."""
    text = line.strip()[head:] if head else line.strip()
    if tail is not None and (m := re.search(re.escape(tail) + rf"[{HYPHENS}]?\s*$", text)):
        text = text[: m.start()]
    else:
        ending = None
    if words:
        text = transducer().apply(text)
        for word, best in zip(words, bests):
            if len(word) == 3 and HAN_RUN.match(word[1]):
                text = text.replace(word.strip("<>"), best.strip("<>"))
            else:
                text = re.sub(rf"(?<![A-Za-zÀ-ɏ0-9@!|$]){re.escape(word)}(?![A-Za-zÀ-ɏ0-9@|$])", lambda _, w=word, b=best: _cased(w, b), text)
    return text + (ending or "")


@pandas_udf(T.StringType())
def repaired_lines(line: pd.Series, words: pd.Series, bests: pd.Series, head: pd.Series, tail: pd.Series, ending: pd.Series) -> pd.Series:
    rows = zip(line, words, bests, head, tail, ending)
    return pd.Series([repaired(x, [] if w is None else list(w), [] if b is None else list(b), 0 if pd.isna(h) else int(h), c, e) for x, w, b, h, c, e in rows], dtype=object)


def paragraphs(pages: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, paragraph (0-based), text, confidence: the continuous text of every scanned document.

    Furniture goes, misread words are put right, divided words joined, and other hyphens at a line's end kept, as `decisions`
    has it; lines are joined by blanks (scripts without blanks: by nothing); a blank line parts paragraphs, and so does a
    missing page. confidence: the mean of the pages' own, on the scale 0-1, over the paragraph's lines; pages without any
    count as one half. Words are counted in `documents`, by default in the pages themselves.
    """
    own = pages.filter(F.length("text") > 0).groupBy("doc_id", "page").agg(F.max("text").alias("text"), F.max("confidence").alias("confidence"))
    sure = F.coalesce(F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")), F.lit(0.5))
    own = own.withColumn("confidence", F.greatest(F.least(sure, F.lit(1.0)), F.lit(0.0)))
    labels, misread, cut = decisions(pages, documents if documents is not None else own)
    known = misread.groupBy(*WHERE).agg(F.sort_array(F.collect_set(F.struct("word", "best"))).alias("wrong"))
    # a divided word stands whole at the end of its first line
    joined = F.col("broken") & (F.coalesce("rest", F.lit("")) != "")
    best = F.when(F.col("divided").rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring("best", 1, 1)), F.expr("substring(best, 2)"))).otherwise(F.col("best"))
    whole = F.when(F.col("fixed"), best).otherwise(F.concat("divided", "rest"))
    ends = cut.groupBy(*WHERE).agg(F.max(F.struct(F.col("divided").alias("tail"), F.when(joined, whole).alias("ending"))).alias("e"))
    heads = cut.filter(joined).groupBy("doc_id", F.col("rest_page").alias("page"), F.col("rest_line").alias("line_no")).agg(F.max(F.length("rest")).alias("head"))
    lines = own.select("doc_id", "page", "confidence", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).join(labels.select(*WHERE, "label"), WHERE)
    kept = lines.filter("label <> 'header'").join(known, WHERE, "left").join(ends, WHERE, "left").join(heads, WHERE, "left")
    tail = F.when(F.col("e.ending").isNotNull(), F.col("e.tail"))
    text = repaired_lines("line", F.col("wrong.word"), F.col("wrong.best"), "head", tail, "e.ending")
    # what stands between this line and the next: nothing after a divided word or a hyphen that stays
    kept = kept.select(*WHERE, "label", "confidence", text.alias("line"), F.when(F.col("e").isNotNull(), "").otherwise("\n").alias("gap"))
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    new = F.coalesce(F.col("page") - F.lag("page").over(order) > 1, F.lit(False)) | (F.col("label") == "break")
    numbered = kept.withColumn("paragraph", F.sum(new.cast("int")).over(order)).filter("label = 'body'")
    ordered = numbered.groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", "line", "gap"))).alias("ls"), F.round(F.avg("confidence"), 4).alias("confidence"))
    text = F.rtrim(F.array_join(F.transform("ls", lambda x: F.concat(x["line"], x["gap"])), ""), F.lit("\n"))
    text = F.regexp_replace(text, r"([\x{2E80}-\x{9FFF}，。、；：！？（）“”])\n(?=[\x{2E80}-\x{9FFF}，。、；：！？（）“”])", "$1")
    return ordered.select("doc_id", "paragraph", F.regexp_replace(text, r"\n", " ").alias("text"), "confidence")
