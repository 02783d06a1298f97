"""Sentences of a document that translate one another (problem 2).

Per document: sentences get a language and features (words; pairs of neighbouring characters in Han script). Numbers,
codes, names and cognates (words of one beginning) that one sentence of each language alone has are anchors; they vote
for pairs, and the pairs they agree on are chained by longest increasing subsequence. The gaps between chained anchors
are aligned by local dynamic programming over beads of one to one, one to two and two to one sentences; what reordering
leaves over is paired by mutual best likeness. Sections whose names share a number, a part or a place in their order
(section reports give the order) are taken for one another's; that ranks candidates, it never excludes any.

Likeness is coverage by a lexicon in both directions. The lexicon is trained here on all documents: words that meet in
anchor pairs, and in sentences at the same place between anchors, are counted over the corpus (added up in every batch
before their shuffle), and expectation maximisation runs on those counts as aggregates and joins. It goes to the
workers as it is if it has at most ENTRIES entries; a larger one is joined, each document getting its words' entries.
A sentence may lack numbers that the other has, at a cost; where both have numbers that the other lacks they differ.

Equal sentences of one language are one node, so copies all pair; a segment pairs with every segment that holds a
translation of one of its sentences. Edge cases: null and empty texts have no sentences; segments delivered twice count
once; segments in several languages are left out; documents in one language have no pair. A document is one task: its
sentences are compared by products of matrices in tiles of TILE sentences.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.llm import language
from glosswork.llm.groups import in_groups, together
from glosswork.llm.sentences import RAISED, body, spans
from glosswork.llm.text_forms import transducer
from glosswork.session import cut_lineage

ROUNDS = 5
#: probability under which a translation is dropped while the lexicon is trained, and in the end
FAINT, LEAST = 0.002, 0.02
#: entries (word, translation, probability: 20 bytes) up to which a lexicon goes to the workers whole: 40 MB
ENTRIES = 2_000_000
#: likeness that a pair needs in its place, and out of order; probability at which a feature counts as explained
IN_ORDER, OUT_OF_ORDER, EXPLAINED = 0.42, 0.5, 0.08
#: weight of a word the corpus has once, of a number the other sentence lacks, and what a matching section adds
RARE, LOST_NUMBER, SAME_SECTION = 6.0, 2.0, 0.02
#: sentences on either side of its place with which one without anchors is counted
AROUND = 2
#: letters that make a sentence of another language in a segment
MIXED = 10
TILE = 1024

FEATURE = re.compile(r"[0-9]+(?:[.,:][0-9]+)*|[A-Za-zÀ-ɏ]+|[㐀-鿿぀-ヿ々]+|[ก-๿]+")
MARK = re.compile(r"^[(（]?[0-9]{1,2}(?:\.[0-9]{1,2})?(?:[.)）]+\s*|\s+)(?=[^\s0-9])")
SHIFT = str.maketrans(RAISED, "0123456789")
NUMBERED = re.compile(r"^\W*([0-9]+(?:\.[0-9]+)*)")
LANGS = language.LANGS


@lru_cache(1 << 18)
def key_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


@lru_cache(1 << 16)
def cognate(word: str) -> str | None:
    """The beginning that a word shares with its relatives in other languages; none for short words."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c))
    return "~" + plain[:5] if len(plain) >= 6 and plain.isascii() else None


def features(text: str) -> tuple[list[str], list[str], list[str]]:
    """(words, numbers, other anchors: codes, names, cognates) of a sentence in its one form."""
    words, numbers, anchors = [], [], []
    for m in FEATURE.finditer(text):
        w = m[0]
        if w[0].isdigit():
            numbers.append(re.sub("[.,:]", "", w))
        elif w[0] >= "぀":
            words += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            words.append(w.casefold())
            if m.start() and (not w.isascii() or w[0].isupper()):
                anchors.append(w.casefold())
            if c := cognate(w):
                anchors.append(c)
    return words, numbers, anchors


class Lexicon:
    """For each ordered pair of languages: word -> {word of the other: probability}, as sorted arrays; weights of words."""

    def __init__(self, tables: dict[tuple[str, str], dict[str, dict[str, float]]] | None = None, weights: dict[str, dict[str, float]] | None = None):
        rows = [(LANGS.index(a), LANGS.index(b), key_of(f), key_of(g), p) for (a, b), t in (tables or {}).items() for f, gs in t.items() for g, p in gs.items()]
        self.fill(pd.DataFrame(rows, columns=["a", "b", "f", "g", "p"]), pd.DataFrame([(LANGS.index(a), key_of(f), w) for a, t in (weights or {}).items() for f, w in t.items()], columns=["a", "f", "w"]))

    def fill(self, entries: pd.DataFrame, weights: pd.DataFrame) -> Lexicon:
        self.pairs = {}
        for pair, x in entries.groupby(["a", "b"]):
            x = x.sort_values("f", kind="stable")
            self.pairs[pair] = tuple(x[c].to_numpy(t) for c, t in (("f", np.int64), ("g", np.int64), ("p", np.float32)))
        self.known = {}
        for lang, x in weights.groupby("a"):
            x = x.sort_values("f", kind="stable")
            self.known[lang] = (x["f"].to_numpy(np.int64), x["w"].to_numpy(np.float32))
        return self

    def weights(self, lang: int, words: np.ndarray) -> np.ndarray:
        """Weights of sorted words."""
        keys, w = self.known.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.float32)))
        if not len(keys):
            return np.full(len(words), RARE, np.float32)
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        return np.where(keys[at] == words, w[at], np.float32(RARE))

    def strengths(self, a: int, b: int, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How well each word of one language explains each of the other (both sorted); a word explains itself."""
        out = np.zeros((len(own), len(other)), np.float32)
        if (a, b) in self.pairs:
            f, g, p = self.pairs[a, b]
            first, end = np.searchsorted(f, own, "left"), np.searchsorted(f, own, "right")
            n = end - first
            row = np.repeat(np.arange(len(own)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            to = np.minimum(np.searchsorted(other, g[at]), max(len(other) - 1, 0))
            hit = other[to] == g[at] if len(other) else np.zeros(len(at), bool)
            out[row[hit], to[hit]] = np.minimum(1.0, p[at][hit] / EXPLAINED)
        _, x, y = np.intersect1d(own, other, assume_unique=True, return_indices=True)
        out[x, y] = 1.0
        return out


class Side:
    """Sentences of one language in a document: words as a flat array with pointers, numbers, anchors, places, sections."""

    def __init__(self, lang: int, words: list[np.ndarray], numbers: list[tuple], anchors: list[tuple], sections: list[int] | None = None):
        self.lang, self.n = lang, len(words)
        self.flat = np.concatenate(words) if words else np.zeros(0, np.int64)
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.numbers, self.anchors = numbers, anchors
        self.sections = sections or [-1] * self.n
        self.vocabulary, self.at = np.unique(self.flat, return_inverse=True)

    def matrix(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, len(self.vocabulary)), np.float32)
        out[np.repeat(np.arange(self.n), self.size), self.at] = weights[self.at]
        return out

    def explains(self, strength: np.ndarray, a: int, b: int) -> np.ndarray:
        """For sentences a..b-1: how well each explains each word of the other language, by its best word for it."""
        out = np.zeros((b - a, strength.shape[1]), np.float32)
        some = np.flatnonzero(self.size[a:b] > 0)
        if len(some):
            lo, hi = self.first[a], self.first[b - 1] + self.size[b - 1]
            out[some] = np.maximum.reduceat(strength[self.at[lo:hi]], self.first[a:b][some] - lo, axis=0)
        return out


def side(lang: str, texts: list[str]) -> Side:
    found = [features(t) for t in texts]
    return Side(LANGS.index(lang), [np.array(list(dict.fromkeys(map(key_of, w))), np.int64) for w, _, _ in found], [tuple(sorted(map(key_of, n))) for _, n, _ in found], [tuple(dict.fromkeys(map(key_of, a))) for _, _, a in found])


def lacking(a: tuple, b: tuple) -> int | None:
    """Numbers that one sentence has more than the other; none if each has some that the other lacks."""
    if a == b:
        return 0
    x, y = Counter(a), Counter(b)
    more, less = sum((x - y).values()), sum((y - x).values())
    return None if more and less else more + less


def votes(x: Side, y: Side) -> list[tuple[int, int]]:
    """Pairs that numbers, codes, names and cognates of one sentence of each language alone agree on."""
    total: dict[tuple[int, int], float] = defaultdict(float)

    def alone(lists: list[tuple], whole: bool) -> dict:
        seen: dict = {}
        for i, keys in enumerate(lists):
            for k in {keys} if whole else set(keys):
                if k != ():
                    seen[k] = -1 if k in seen else i
        return seen

    for of, worth, whole in ((lambda s: s.numbers, 2.0, True), (lambda s: s.numbers, 1.0, False), (lambda s: s.anchors, 1.0, False)):
        other = alone(of(y), whole)
        for k, i in alone(of(x), whole).items():
            j = other.get(k, -1)
            if i >= 0 and j >= 0:
                total[i, j] += worth
    best_i: dict[int, float] = defaultdict(float)
    best_j: dict[int, float] = defaultdict(float)
    total = {p: v for p, v in total.items() if lacking(x.numbers[p[0]], y.numbers[p[1]]) is not None}
    for (i, j), v in total.items():
        best_i[i], best_j[j] = max(best_i[i], v), max(best_j[j], v)
    ties_i, ties_j = Counter(i for (i, _), v in total.items() if v == best_i[i]), Counter(j for (_, j), v in total.items() if v == best_j[j])
    return [p for p, v in total.items() if v >= 2 and v == best_i[p[0]] == best_j[p[1]] and ties_i[p[0]] == ties_j[p[1]] == 1]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs that rises in both places."""
    tails: list[int] = []
    where: list[int] = []
    back: list[int] = []
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    for k, (_, j) in enumerate(pairs):
        pos = bisect_left(tails, j)
        back.append(where[pos - 1] if pos else -1)
        if pos == len(tails):
            tails.append(j)
            where.append(k)
        else:
            tails[pos], where[pos] = j, k
    out, k = [], where[-1] if where else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _gap(beads: list[tuple]) -> list[tuple[int, int]]:
    """The rising beads of a gap with the greatest sum of likeness, as pairs (a Fenwick tree of maxima over the second
    place). A bead is (i, j, likeness) or, of several sentences, (i, j, likeness, last i, last j)."""
    rows = sorted((b[0], b[1], b[2], *(b[3:] or b[:2])) for b in beads)
    places = {j: k + 1 for k, j in enumerate(sorted({b[4] for b in rows}))}
    ends = sorted(places)
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(places) + 1)
    best: list[tuple[float, int]] = []
    waiting: list[tuple[int, int]] = []  # (last i, bead): they may be followed from the next i on
    for k, (i, j, s, last, _) in enumerate(rows):
        for w in [w for w in waiting if w[0] < i]:
            waiting.remove(w)
            at = places[rows[w[1]][4]]
            while at < len(tree):
                tree[at] = max(tree[at], (best[w[1]][0], w[1]))
                at += at & -at
        at, got = bisect_left(ends, j), (0.0, -1)
        while at > 0:
            got = max(got, tree[at])
            at -= at & -at
        best.append((got[0] + s, got[1]))
        waiting.append((last, k))
    if not best:
        return []
    k, out = max(range(len(best)), key=lambda x: best[x][0]), []
    while k >= 0:
        i, j, _, last, end = rows[k]
        out += [(p, q) for p in range(i, last + 1) for q in range(j, end + 1)]
        k = best[k][1]
    return out


class Likeness:
    """Candidates of a document's two languages with their likeness."""

    def __init__(self, lexicon: Lexicon, x: Side, y: Side, least: float):
        self.x, self.y = x, y
        wx, wy = lexicon.weights(x.lang, x.vocabulary), lexicon.weights(y.lang, y.vocabulary)
        self.there, self.back = lexicon.strengths(x.lang, y.lang, x.vocabulary, y.vocabulary), lexicon.strengths(y.lang, x.lang, y.vocabulary, x.vocabulary)
        self.mx, self.my = x.matrix(wx), y.matrix(wy)
        self.whole_x, self.whole_y = self.mx.sum(axis=1), self.my.sum(axis=1)
        same = x.numbers == y.numbers
        kinds_x, kinds_y = {k: n for n, k in enumerate(dict.fromkeys(x.numbers))}, {k: n for n, k in enumerate(dict.fromkeys(y.numbers))}
        lack = np.array([[-1 if (n := lacking(a, b)) is None else n for b in kinds_y] for a in kinds_x], np.float32) if len(kinds_x) * len(kinds_y) <= TILE * TILE else None
        at_x, at_y = np.array([kinds_x[k] for k in x.numbers], np.int64), np.array([kinds_y[k] for k in y.numbers], np.int64)
        names_x, names_y = list(kinds_x), list(kinds_y)
        self.found: dict[tuple[int, int], float] = {}
        self.near: list[tuple[int, int]] = []  # pairs of which one sentence may be a part of the other
        sx, sy = np.array(x.sections), np.array(y.sections)
        for a in range(0, x.n, TILE):
            b = min(a + TILE, x.n)
            ex = x.explains(self.there, a, b)
            for c in range(0, y.n, TILE):
                d = min(c + TILE, y.n)
                if lack is not None:
                    more = lack[np.ix_(at_x[a:b], at_y[c:d])]
                else:
                    more = np.array([[-1 if (n := lacking(names_x[p], names_y[q])) is None else n for q in at_y[c:d]] for p in at_x[a:b]], np.float32)
                fine = more >= 0
                lost = LOST_NUMBER * np.maximum(more, 0)
                cy = (ex @ self.my[c:d].T) / np.maximum(self.whole_y[None, c:d] + lost, 1e-6)
                cx = (self.mx[a:b] @ y.explains(self.back, c, d).T) / np.maximum(self.whole_x[a:b, None] + lost, 1e-6)
                s = (cx + cy) / 2
                s += SAME_SECTION * ((sx[a:b, None] == sy[None, c:d]) & (sx[a:b, None] >= 0))
                for i, j in zip(*(v.tolist() for v in np.nonzero(fine & (s >= least)))):
                    self.found[a + i, c + j] = float(s[i, j])
                part = fine & (np.maximum(cx, cy) >= 0.55) & (np.abs(cx - cy) >= 0.15)
                self.near += [(a + i, c + j) for i, j in zip(*(v.tolist() for v in np.nonzero(part)))]

    def merged(self, i: int, js: tuple[int, int], turned: bool) -> float:
        """Likeness of a sentence and two neighbours of the other language that together say it, else 0."""
        x, y, there, back, mx, my = (self.y, self.x, self.back, self.there, self.my, self.mx) if turned else (self.x, self.y, self.there, self.back, self.mx, self.my)
        if lacking(x.numbers[i], tuple(sorted(y.numbers[js[0]] + y.numbers[js[1]]))) != 0:
            return 0.0
        by = [y.explains(back, j, j + 1)[0] for j in js]
        own = mx[i] / max(mx[i].sum(), 1e-6)
        parts, both = [float(e @ own) for e in by], float(np.maximum(*by) @ own)
        if both < 0.6 or both < max(parts) + 0.2:
            return 0.0
        ex = x.explains(there, i, i + 1)[0]
        covered = [float(ex @ my[j]) / max(float(my[j].sum()), 1e-6) for j in js]
        return (both + sum(covered) / 2) / 2 if min(covered) >= 0.6 else 0.0

    def beads(self) -> list[tuple]:
        """Beads of one sentence and two neighbours."""
        near, out = set(self.near), []
        for i, j in near:
            if (i, j + 1) in near and (s := self.merged(i, (j, j + 1), False)):
                out.append((i, j, 2 * s, i, j + 1))
            if (i + 1, j) in near and (s := self.merged(j, (i, i + 1), True)):
                out.append((i, j, 2 * s, i + 1, j))
        return out


def align_sides(lexicon: Lexicon, x: Side, y: Side, in_order: float = IN_ORDER) -> list[tuple[int, int]]:
    """Pairs (i, j) of sentences that translate one another. Sentences of a side are different from one another."""
    like = Likeness(lexicon, x, y, in_order)
    cands = like.found
    best_i: dict[int, float] = {}
    best_j: dict[int, float] = {}
    for (i, j), s in cands.items():
        best_i[i], best_j[j] = max(best_i.get(i, 0), s), max(best_j.get(j, 0), s)
    pairs = increasing([p for p in votes(x, y) if p in cands])
    used_i, used_j = {p[0] for p in pairs}, {p[1] for p in pairs}
    edges = [(-1, -1), *pairs, (x.n, y.n)]
    starts = [e[0] for e in edges]
    gaps: dict[int, list[tuple]] = defaultdict(list)
    for bead in [(i, j, s) for (i, j), s in cands.items() if s >= 0.85 * max(best_i[i], best_j[j])] + like.beads():
        i, j, last, end = bead[0], bead[1], *(bead[3:] or bead[:2])
        if used_i.intersection((i, last)) or used_j.intersection((j, end)):
            continue
        # a gap takes what is nearly the best for both; the rest is out of order
        k = bisect_right(starts, i) - 1
        if edges[k][1] < j and end < edges[k + 1][1] and last < edges[k + 1][0]:
            gaps[k].append(bead)
    for beads in gaps.values():
        for i, j in _gap(beads):
            pairs.append((i, j))
            used_i.add(i)
            used_j.add(j)
    for (i, j), s in sorted(cands.items(), key=lambda c: (-c[1], c[0])):
        if s >= OUT_OF_ORDER and i not in used_i and j not in used_j and s >= 0.9 * max(best_i[i], best_j[j]):
            pairs.append((i, j))
            used_i.add(i)
            used_j.add(j)
    return pairs


def align(lexicon: Lexicon, a: str, b: str, left: list[str], right: list[str], in_order: float = IN_ORDER) -> list[tuple[int, int]]:
    """Pairs (i, j) of sentences of language a and b that translate one another. Each list holds different sentences."""
    return align_sides(lexicon, side(a, left), side(b, right), in_order)


# ---- documents as numbers ----

SAID = "doc_id bigint, seg_id bigint, seg_index int, lang int, section string, text string"
PARTS = {"node": "lang section", "ptr": "words numbers anchors segs"}
NODES = "doc_id bigint, lang array<int>, section array<int>, " + ", ".join(f"{c} array<bigint>, {c}_n array<int>" for c in PARTS["ptr"].split())


def said(segments: DataFrame, model: language.Languages) -> DataFrame:
    """Body segments in one language: doc_id, seg_id, seg_index, lang (number), section, text (in its one form)."""
    rows = body(segments).filter(F.length("text") > 0).select("doc_id", "seg_id", "seg_index", "section", "text")
    shared = segments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = language.Lookup(shared.value)
        for b in batches:
            texts = [transducer().apply(t).translate(SHIFT).replace("\x02", " ") for t in b["text"]]
            no, lang, letters, _, longest = language.letters_of_texts(look, texts, False)
            # a segment with running text in a second language is out
            sure = longest >= np.where(lang >= 4, language.ENOUGH_EAST, MIXED)
            out = np.bincount(no[sure], minlength=len(b)) > 1 if len(no) else np.zeros(len(b), bool)
            top = pd.DataFrame({"no": no, "lang": lang, "letters": letters}).sort_values(["no", "letters"], ascending=[True, False]).drop_duplicates("no")
            top = top[~out[top["no"].to_numpy(np.int64)]]
            rows_ = b.iloc[top["no"].to_numpy(np.int64)].copy()
            rows_["lang"], rows_["text"] = top["lang"].to_numpy(), np.array(texts, object)[top["no"].to_numpy(np.int64)]
            yield rows_[["doc_id", "seg_id", "seg_index", "lang", "section", "text"]]

    return rows.mapInPandas(run, SAID)


def same_sections(names: list[str | None], order: dict[str, int]) -> dict[str | None, int]:
    """Number of each section name: names that share a part or a leading number have one; so have those that hold one
    part each and stand at the same place of their languages' orders."""
    group: dict[str, int] = {}
    out: dict[str | None, int] = {None: -1}
    for name in sorted({n for n in names if n}, key=lambda n: (order.get(n, 1 << 30), n)):
        number = NUMBERED.match(name)
        parts = [p for p in (re.sub(r"[\W\d_]+", "", x).casefold() for x in name.split("/")) if p]
        keys = parts + ([f"#{number[1]}"] if number else [])
        no = next((group[k] for k in keys if k in group), len(out))
        out[name] = no
        for k in keys:
            group.setdefault(k, no)
    return out


def _document(doc: int, rows: pd.DataFrame) -> dict | None:
    """A document's sentences as numbers; equal sentences of a language are one node: by their words, without a list mark."""
    named = rows["lang"].to_numpy() < 0
    order = {t: int(k) for t, k in zip(rows["text"][named], rows["seg_index"][named]) if t}
    rows = rows[~named]
    if rows["lang"].nunique() < 2:
        return None
    sections = same_sections(rows["section"].tolist(), order)
    nodes: dict[tuple[int, str], list] = {}
    for lang, seg, section, text, ss in zip(rows["lang"].tolist(), rows["seg_id"].tolist(), rows["section"], rows["text"], rows["spans"]):
        for s in ss:
            plain = MARK.sub("", text[s["char_start"] : s["char_end"]])
            key = lang, " ".join(plain.casefold().rstrip(" .!?。！？").split())
            node = nodes.get(key)
            if node is None:
                words, numbers, anchors = features(plain)
                node = nodes[key] = [lang, sections.get(section, -1), list(dict.fromkeys(map(key_of, words))), sorted(map(key_of, numbers)), list(dict.fromkeys(map(key_of, anchors))), []]
            node[5].append(seg)
    cols = list(zip(*nodes.values()))
    out = {"doc_id": doc, "lang": list(cols[0]), "section": list(cols[1])}
    for name, lists in zip(PARTS["ptr"].split(), cols[2:]):
        out[name], out[f"{name}_n"] = [v for x in lists for v in x], [len(x) for x in lists]
    return out


def documents_as_numbers(segments: DataFrame, sections: DataFrame | None, model: language.Languages) -> DataFrame:
    """One row a document in several languages: its sentences in their order, with words, numbers, anchors and segments."""
    rows = said(segments, model)
    # documents in one language end here, after one exchange of texts; a second brings the names of the sections to the rest
    doc = Window.partitionBy("doc_id")
    rows = rows.withColumns({"lo": F.min("lang").over(doc), "hi": F.max("lang").over(doc)}).filter("lo <> hi").drop("lo", "hi")
    rows = rows.dropDuplicates(["doc_id", "seg_id"])
    if sections is not None:  # the names of its sections come along, as rows without a language
        names = sections.filter(F.length("name") > 0).select(
            "doc_id", F.lit(-1).cast("bigint").alias("seg_id"), F.col("sequence").alias("seg_index"), F.lit(-1).alias("lang"),
            F.lit(None).cast("string").alias("section"), F.col("name").alias("text"),
        ).distinct()
        rows = rows.unionByName(names)
    rows = together(rows, ["doc_id"], "seg_index", "seg_id")
    split = F.when(F.col("lang") >= 0, spans(F.col("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[dict] = []
        for key, g in in_groups(batches, ["doc_id"]):
            if got := _document(key[0], g):
                found.append(got)
            if len(found) >= 100:
                yield pd.DataFrame(found)
                found = []
        yield pd.DataFrame(found, columns=[c.split()[0] for c in NODES.split(", ")])

    return rows.select("*", split.alias("spans")).mapInPandas(run, NODES)


def sides(row: tuple) -> tuple[dict[int, Side], dict[int, list[list[int]]]]:
    """The languages of a document, and the segments of each sentence."""
    lang = np.asarray(row.lang)
    cut = {}
    for c in PARTS["ptr"].split():
        ends = np.cumsum(np.asarray(getattr(row, f"{c}_n"), np.int64))
        cut[c] = np.split(np.asarray(getattr(row, c), np.int64), ends[:-1])
    out, segs = {}, {}
    for k in sorted(set(lang.tolist())):
        own = np.flatnonzero(lang == k).tolist()
        out[k] = Side(k, [cut["words"][i] for i in own], [tuple(cut["numbers"][i].tolist()) for i in own], [tuple(cut["anchors"][i].tolist()) for i in own], [int(row.section[i]) for i in own])
        segs[k] = [cut["segs"][i].tolist() for i in own]
    return out, segs


# ---- the lexicon ----

CELL = "a int, b int, f bigint, g bigint, n double"
#: place of a language's own counts (f: word, n: sentences) in `b`, and the word that stands for no word
OWN, NONE = -1, 0
#: meetings of words that a worker holds before it adds them up: 24 bytes each, and about six times that while it does
CELLS = 1_000_000


def learnt_from(x: Side, y: Side) -> list[tuple[int, int, float]]:
    """Pairs of sentences to count, with weights: anchor pairs, and what stands at the same place between chained anchors."""
    sure = votes(x, y)
    out = [(i, j, 1.0) for i, j in sure]
    chain = [(-1, -1), *increasing(sure), (x.n, y.n)]
    taken_i, taken_j = {i for i, _ in sure}, {j for _, j in sure}
    for (i0, j0), (i1, j1) in zip(chain, chain[1:]):
        left, right = [i for i in range(i0 + 1, i1) if i not in taken_i], [j for j in range(j0 + 1, j1) if j not in taken_j]
        for k, i in enumerate(left):
            place = round(k * (len(right) - 1) / max(len(left) - 1, 1)) if right else 0
            near = [j for j in right[max(0, place - AROUND) : place + AROUND + 1] if lacking(x.numbers[i], y.numbers[j]) == 0]
            out += [(i, j, 1.0 / len(near)) for j in near]
    return out


def _crossed(x: Side, y: Side, pairs: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(f, g, weight) of all words that meet in pairs, with the words of each side against none."""
    i, j, w = (np.array(c) for c in zip(*pairs))
    i, j = i.astype(np.int64), j.astype(np.int64)
    n, m = x.size[i], y.size[j]
    cells = n * m
    pair = np.repeat(np.arange(len(i)), cells)
    k = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    f, g = x.flat[x.first[i][pair] + k // m[pair]], y.flat[y.first[j][pair] + k % m[pair]]
    one = lambda s, at, size: s.flat[np.repeat(s.first[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    alone_x, alone_y = one(x, i, n), one(y, j, m)
    return (
        np.concatenate([f, alone_x, np.full(len(alone_y), NONE)]), np.concatenate([g, np.full(len(alone_x), NONE), alone_y]),
        np.concatenate([w[pair], np.repeat(w, n), np.repeat(w, m)]),
    )


def _added(f: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights added up by cell."""
    names_f, at_f = np.unique(f, return_inverse=True)
    names_g, at_g = np.unique(g, return_inverse=True)
    cell = at_f * len(names_g) + at_g
    if len(names_f) * len(names_g) <= 4 * len(cell) + 1_000_000:
        total = np.bincount(cell, w, minlength=len(names_f) * len(names_g))
        own = np.flatnonzero(total)
        total = total[own]
    else:
        own, back = np.unique(cell, return_inverse=True)
        total = np.bincount(back, w)
    return names_f[own // len(names_g)], names_g[own % len(names_g)], total


Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def _met(row: tuple) -> Iterator[tuple[tuple[int, int], Part]]:
    """((a, b), cells) of a document, in portions of about CELLS cells."""
    own, _ = sides(row)
    for a, x in own.items():
        yield (a, OWN), (np.append(x.flat, NONE), np.full(len(x.flat) + 1, NONE), np.append(np.ones(len(x.flat)), x.n))
        for b, y in own.items():
            if a < b and (pairs := learnt_from(x, y)):
                i, j = np.array([p[:2] for p in pairs], np.int64).T
                portion = np.cumsum(x.size[i] * y.size[j] + x.size[i] + y.size[j]) // CELLS
                cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(pairs)]
                for lo, hi in zip(cuts, cuts[1:]):
                    yield (a, b), _crossed(x, y, pairs[lo:hi])


def _tallied(parts: Iterator[tuple[tuple[int, int], Part]]) -> Iterator[tuple[tuple[int, int], Part]]:
    """Cells added up; whenever CELLS are held, and given on when adding leaves more than half of them."""
    found: dict[tuple[int, int], list[Part]] = defaultdict(list)
    held = 0

    def add_up() -> None:
        for key, own in found.items():
            found[key] = [_added(*(np.concatenate(c) for c in zip(*own)))]

    for key, part in parts:
        found[key].append(part)
        held += len(part[0])
        if held >= CELLS:
            add_up()
            held = sum(len(own[0][0]) for own in found.values())
            if held > CELLS // 2:
                yield from ((k, own[0]) for k, own in found.items())
                found.clear()
                held = 0
    add_up()
    yield from ((k, own[0]) for k, own in found.items())


def meetings(docs: DataFrame) -> DataFrame:
    """a, b, f, g, n: how often words of two languages (a < b) meet in pairs of sentences, and (b = OWN) in how many
    sentences a word stands (f = NONE: all sentences); added up in every task before the shuffle, CELLS at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (a, b), (f, g, n) in _tallied(p for batch in batches for row in batch.itertuples(index=False) for p in _met(row)):
            yield pd.DataFrame({"a": np.int32(a), "b": np.int32(b), "f": f, "g": g, "n": n})

    return docs.mapInPandas(run, CELL).groupBy("a", "b", "f", "g").agg(F.sum("n").alias("n"))


def train(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries a, b, f, g, p; weights a, f, w). Translation probabilities by expectation maximisation over counts: a word's
    share of another is its count times its probability, over the mean such sum of the sentences the other stands in."""
    met = cells.filter(F.col("b") != OWN)
    turned = met.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("g").alias("f"), F.col("f").alias("g"), "n")
    both = met.unionByName(turned).filter(F.col("g") != NONE)
    rows = both.withColumn("v", F.col("n"))  # v: count times probability, which is even at first
    for k in range(ROUNDS):
        to, from_ = Window.partitionBy("a", "b", "g"), Window.partitionBy("a", "b", "f")
        times = F.max(F.when(F.col("f") == NONE, F.col("n"))).over(to)
        share = rows.withColumn("z", F.sum("v").over(to) / times).withColumn("c", F.col("v") / F.col("z")).drop("z")
        # what is left of faint entries goes with them
        rows = share.withColumn("p", F.col("c") / F.sum("c").over(from_)).filter((F.col("p") >= FAINT) | (F.col("f") == NONE)).withColumn("v", F.col("n") * F.col("p")).drop("c")
    entries = rows.filter((F.col("f") != NONE) & (F.col("p") >= LEAST)).select("a", "b", "f", "g", F.col("p").cast("float").alias("p"))
    own = cells.filter(F.col("b") == OWN)
    total = own.filter(F.col("f") == NONE).select("a", F.col("n").alias("total"))
    weights = own.filter(F.col("f") != NONE).join(F.broadcast(total), "a").select("a", "f", F.log((F.col("total") + 1) / F.col("n")).cast("float").alias("w"))  # one row a language
    return entries, weights


def _pairs(row: tuple, lexicon: Lexicon) -> set[tuple[int, int]]:
    own, segs = sides(row)
    pairs: set[tuple[int, int]] = set()
    for a, x in own.items():
        for b, y in own.items():
            if a < b:
                for i, j in align_sides(lexicon, x, y):
                    pairs |= {(min(s, t), max(s, t)) for s in segs[a][i] for t in segs[b][j] if s != t}
    return pairs


PAIR = "seg_id_a bigint, seg_id_b bigint"


def aligned(docs: DataFrame, entries: DataFrame, weights: DataFrame, most: int = ENTRIES) -> DataFrame:
    """Pairs of segments of documents as numbers."""
    frame = lambda pairs: pd.DataFrame(sorted(pairs), columns=["seg_id_a", "seg_id_b"], dtype=np.int64)
    if entries.count() + weights.count() <= most:
        shared = docs.sparkSession.sparkContext.broadcast(Lexicon().fill(entries.toPandas(), weights.toPandas()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield frame({p for row in b.itertuples(index=False) for p in _pairs(row, shared.value)})

        return docs.mapInPandas(run, PAIR)
    # a larger lexicon: each document gets the entries of its own words
    words = docs.select(F.col("doc_id").alias("owner"), F.explode(F.array_distinct("words")).alias("f"))
    asked = words.join(entries, "f").unionByName(words.join(weights, "f").select("f", "owner", "a", F.lit(OWN).alias("b"), F.lit(0).cast("bigint").alias("g"), F.col("w").alias("p")))

    def joined(_: tuple, d: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        own = e["b"] == OWN
        lexicon = Lexicon().fill(e[~own], e[own].rename(columns={"p": "w"}))
        return frame({p for row in d.itertuples(index=False) for p in _pairs(row, lexicon)})

    return docs.groupBy("doc_id").cogroup(asked.groupBy("owner")).applyInPandas(joined, PAIR)


def translations(segments: DataFrame, documents: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """seg_id_a < seg_id_b of body segments that hold sentences translating one another."""
    docs = cut_lineage(documents_as_numbers(segments, sections, language.fit(documents)))  # numbers; read for the lexicon and for the pairs
    entries, weights = train(cut_lineage(meetings(docs)))
    return aligned(docs, cut_lineage(entries), cut_lineage(weights)).distinct()
