"""Held-out evaluation passages inside the corpus (problem 7).

Items and documents become streams of tokens in one form (look-alikes, widths, case, punctuation and the notation of
numbers folded), and templates: typed placeholders stand for numbers and units. (Names are compared as words: once case
is ignored nothing tells them from words.) Of two sentences with EDITS_TOGETHER edits one has at most one, so one of its
halves is whole, and of the other one third is. Windows in these parts of the items' sentences are the table that the
documents' template windows are hash-joined with; a window counts only if its slots (numbers, units) are the same, and
halves only if a part of the sentence beside them stands near. A last step checks both sentences: they must be there
token by token, with the same numbers, names and units, but for a few words or characters lost or doubled.

The corpus is read and tokenized once, whatever the number of items. Bit filters of the table's windows (at most FILTER
bits, so they are sent to the workers whatever the table's size) let few windows through; these carry the text around
them, meet the table in a join, and are checked where they meet. A filter that is full only lets more through.

Edge cases: null or empty texts and items have no leak, items of one sentence none either (two are needed);
documents delivered twice give one row; an item that stands in a document several times gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from glosswork.llm.language import UNITS
from glosswork.llm.sentences import sentence_rows
from glosswork.llm.text_forms import transducer
from glosswork.session import cut_lineage

#: lengths of windows in tokens; a part of a sentence is looked up by the longest that it holds
WINDOWS = (1, 2, 3, 4, 5, 6, 8, 11)
#: tokens that one edit takes at most in scripts without blanks
RUN = 4
#: words or characters lost or doubled that a sentence may have, and the two together
EDITS, EDITS_TOGETHER = 2, 3
#: bits a window in the filters, of which two are set, and bits of a filter at least and at most (32 MB)
BITS, FILTER = 256, (1 << 20, 1 << 28)

TOKEN = re.compile(
    r"[0-9]+(?:[.,:][0-9]+)*|[a-zß-ɏḀ-ỿµ̀-ͯ]+"
    r"|[々-〇぀-ヿ㐀-䶿一-鿿\U00020000-\U000323AF]|[ก-๿]+|[Ͱ-ԯ]+|\x02"
)
HYPHEN = re.compile(r"[-¬](?<=[a-z][-¬])(?:(?<=-)(?=[a-z])|\s*\n\s*(?=[a-z]))")  # its first character is sought as a set
GROUPED = re.compile(r"[0-9]{1,3}(?:[.,][0-9]{3})+")


def number(token: str) -> str:
    """One notation of a number: no grouping marks, a point before decimals."""
    return re.sub("[.,]", "", token) if GROUPED.fullmatch(token) else token.replace(",", ".")


def tokens(text: str) -> list[str]:
    """Tokens of a text in its one form; a character each in scripts without blanks. A hyphen inside a word, or one that
    divides it at a line's end, is layout."""
    return TOKEN.findall(HYPHEN.sub("", transducer().apply(text).casefold()))


def _eq(a: str, b: str) -> bool:
    return a == b or (a[0].isdigit() and b[0].isdigit() and number(a) == number(b))


def _slip(a: str, b: str) -> bool:
    """One is the other with a character lost or doubled; numbers are values and have none."""
    if a[0].isdigit() or b[0].isdigit() or abs(len(a) - len(b)) != 1 or min(len(a), len(b)) < 2:
        return False
    short, long = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    if short[i:] != long[i + 1 :]:
        return False
    return long is a or (0 < i and long[i] == long[i - 1]) or (i + 1 < len(long) and long[i] == long[i + 1])


def _edits(a: list[str], b: list[str], at: int, budget: int) -> list[tuple[int, int]]:
    """(end, edits) of all ways to read sentence `a` at b[at:] with at most `budget` edits."""
    best: dict[tuple[int, int], int] = {}
    out: dict[int, int] = {}
    stack = [(0, at, 0)]
    while stack:
        i, j, cost = stack.pop()
        while i < len(a) and j < len(b) and _eq(a[i], b[j]):
            i, j = i + 1, j + 1
            if cost < budget and i < len(a):  # the same stretch may also be read as doubled or lost
                for k in range(1, 5):
                    if j + k <= len(b) and b[j : j + k] == b[j - k : j] and j - k >= at and (k == 1 or "⺀" < b[j][0]):
                        stack.append((i, j + k, cost + 1))
        if best.get((i, j), 99) <= cost:
            continue
        best[i, j] = cost
        if i == len(a):
            out[j] = min(out.get(j, 99), cost)
            if cost < budget:
                for k in range(1, 5):
                    if b[j : j + k] == b[j - k : j] and j + k <= len(b) and (k == 1 or "⺀" < b[j][0]):
                        stack.append((i, j + k, cost + 1))
            continue
        if j < len(b):  # the same letters, parted otherwise
            for x, y, flip in ((a[i], b[j : j + 5], False), (b[j], a[i : i + 5], True)):
                whole = ""
                for k, part in enumerate(y, 1):
                    whole += part
                    if len(whole) >= len(x):
                        if k > 1 and whole == x:
                            stack.append((i + k, j + 1, cost) if flip else (i + 1, j + k, cost))
                        break
        if cost >= budget:
            continue
        east = "⺀" < a[i][0]
        for k in range(1, 5 if east else 2):  # a word lost
            if i + k <= len(a) and not a[i + k - 1][0].isdigit():
                stack.append((i + k, j, cost + 1))
        if j < len(b):
            if _slip(a[i], b[j]):
                stack.append((i + 1, j + 1, cost + 1))
            for k in range(1, 5 if east else 2):  # a word doubled
                if j - k >= at and b[j : j + k] == b[j - k : j] and j + k <= len(b):
                    stack.append((i, j + k, cost + 1))
    return list(out.items())


# ---- windows ----

SEED, BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
NUMBER_SLOT, UNIT_SLOT = 0x5851F42D4C957F2D, 0x14057B7EF767814F
UNIT_WORDS = frozenset(u.casefold() for u in UNITS)


class Numbers:
    """Tokens as 64-bit numbers: of the token itself, and of its slot or word."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.rows: list[tuple[int, int]] = []

    def of(self, stream: list[str]) -> np.ndarray:
        if len(self.at) > 500_000:
            self.__init__()
        for t in set(stream).difference(self.at):
            plain = number(t) if t[0].isdigit() else t
            own = xxhash.xxh3_64_intdigest(plain)
            self.at[t] = len(self.rows)
            self.rows.append((own, NUMBER_SLOT if t[0].isdigit() else UNIT_SLOT if t in UNIT_WORDS else own))
        at = np.array([self.at[t] for t in stream], dtype=np.int64)
        return np.array(self.rows, dtype=np.uint64).reshape(-1, 2)[at]


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(size + 1, b, np.uint64) for b in (SEED, BACK))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Sums:
    """Hashes of all windows of a stream, of any length, from prefix sums."""

    def __init__(self, ids: np.ndarray):
        up, self.down = _powers(1 << max(len(ids), 1).bit_length())
        self.n = len(ids)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * up[: self.n], dtype=np.uint64)])

    def windows(self, w: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of w tokens, at all places or those given."""
        if self.n < w:
            return np.zeros(0, np.uint64)
        h = (self.total[w:] - self.total[: self.n - w + 1]) * self.down[: self.n - w + 1] if at is None else (self.total[at + w] - self.total[at]) * self.down[at]
        h = (h ^ np.uint64(w)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def _parts(n: int, parts: int, east: bool) -> list[tuple[int, int]]:
    """(first, length) of so many parts of a sentence that one edit fewer always leaves one of them whole."""
    between = RUN - 1 if east else 0
    size = (n - between * (parts - 1)) // parts
    w = max((x for x in WINDOWS if x <= size), default=0)
    # the last part ends with the sentence
    return [(k * (n - size) // (parts - 1), w) for k in range(parts)] if w else []


def _east(sentence: list[str]) -> bool:
    return any("⺀" < x[0] for x in sentence)


#: kinds of rows: windows by template; windows to start from that call for a check by themselves; pairs of windows
TEMPLATE, WHOLE, BOTH = 0, 1, 2
TABLE = "h bigint, kind int, item_id bigint, s int, at int, first string, second string"


def together(h: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """One hash of two windows."""
    x = (h * np.uint64(0x2545F4914F6CDD1D)) ^ beside
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pieces(item: int, parts: list[list[str]], numbers: Numbers) -> Iterator[tuple]:
    """Windows of an item's pairs of sentences: halves of either with thirds of the other; where one is too short for that,
    what the other's edits leave."""
    for s, (a, b) in enumerate(zip(parts, parts[1:])):
        both = numbers.of(a + b)
        slots, words = Sums(both[:, 1]), Sums(both[:, 0])
        text = " ".join(a), " ".join(b)
        halves, thirds = ([_parts(len(x), k, _east(x)) for x in (a, b)] for k in (2, 3))
        length = lambda p: p[0][1] if p else 0

        def hashed(sums: Sums, base: int, windows: list[tuple[int, int]]) -> np.ndarray:
            return np.array([sums.windows(w, np.array([base + first]))[0] for first, w in windows], np.uint64)

        for own, other, base, far in ((0, 1, 0, len(a)), (1, 0, len(a), 0)):
            use, with_ = halves[own], thirds[other]
            if length(halves[other]) < 3 <= length(thirds[own]):  # the other is too short: this one may have two edits
                use, with_ = thirds[own], []
            elif length(halves[own]) < 3 <= length(thirds[other]):
                continue
            elif length(with_) < 2:
                with_ = []
            h, beside = hashed(words, base, use), hashed(words, far, with_)
            for t in {*hashed(slots, base, use).tolist(), *hashed(slots, far, with_).tolist()}:
                yield t, TEMPLATE, item, s, 0, "", ""
            for k, (first, _) in enumerate(use):
                for x in [int(together(h[k : k + 1], beside[q : q + 1])[0]) for q in range(len(beside))] if with_ else [int(h[k])]:
                    yield x, BOTH if with_ else WHOLE, item, s, base + first, *text


def table(items: DataFrame) -> DataFrame:
    """The windows of all items."""
    held = sentence_rows(items.select("item_id", "text").dropDuplicates(["item_id"]), "item_id")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        parts = [t for t in map(tokens, g.sort_values("char_start")["sentence"]) if t]
        with np.errstate(over="ignore"):
            rows = list(_pieces(int(key[0]), parts, Numbers()))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in TABLE.split(", ")])
        return out.assign(h=np.array(out["h"].tolist(), np.uint64).astype(np.int64))

    return held.groupBy("item_id").applyInPandas(run, TABLE)


class Filter:
    """A set of hashes as two bits each; it may let others through, too."""

    def __init__(self, hashes: DataFrame, n: int):
        """hashes: h bigint. Bits are set by an aggregate, so at most FILTER bits come to the driver."""
        self.bits = min(max(1 << (BITS * max(n, 1)).bit_length(), FILTER[0]), FILTER[1])
        places = F.array(*(h.bitwiseAND(F.lit(self.bits - 1)) for h in (F.col("h"), F.shiftright("h", 32))))
        words = hashes.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toPandas()
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.words[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint64)

    def _set(self, h: np.ndarray) -> np.ndarray:
        place = h & np.uint64(self.bits - 1)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def has(self, h: np.ndarray) -> np.ndarray:
        out = self._set(h)
        some = np.flatnonzero(out)
        out[some] = self._set(h[some] >> np.uint64(32))
        return out


HIT = "doc_id bigint, at int, around string, hs array<bigint>"


def _portions(texts: list[str], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        n, to = 0, at
        while to < len(texts) and (to == at or n + len(texts[to]) < size):
            n += len(texts[to])
            to += 1
        yield at, to
        at = to


class Search:
    """What the workers get: filters of windows by template and, with their slots, of those to check; how far pairs reach."""

    def __init__(self, pieces: DataFrame):
        reach = F.max(F.size(F.split("first", " ")) + F.size(F.split("second", " "))).alias("reach")
        sizes = {r["kind"]: r for r in pieces.groupBy("kind").agg(F.count("*").alias("n"), reach).collect()}  # a row a kind
        self.reach = max([r["reach"] for r in sizes.values()], default=0) + 2 * RUN * EDITS_TOGETHER
        self.filters = [Filter(pieces.filter(F.col("kind") == k).select("h"), sizes[k]["n"] if k in sizes else 0) for k in (TEMPLATE, WHOLE, BOTH)]

    def hits(self, docs: np.ndarray, texts: list[str], numbers: Numbers) -> Iterator[tuple]:
        """(doc, place of a window in the text around it, that text as tokens, hashes to look up)"""
        template, whole, both = self.filters
        for a, b in _portions(texts):
            stream = tokens("\x02".join(t.replace("\x02", " ") for t in texts[a:b]))
            if not stream:
                continue
            ids = numbers.of(stream)
            slots, words = Sums(ids[:, 1]), Sums(ids[:, 0])
            found = []
            for w in WINDOWS:
                h = slots.windows(w)
                at = np.flatnonzero(template.has(h)) if len(h) else np.zeros(0, np.int64)
                if len(at):
                    found.append((at, words.windows(w, at)))
            if not found:
                continue
            at, own = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(at, kind="stable")
            at, own = at[order], own[order]
            alone = np.flatnonzero(whole.has(own))
            calls = [(alone, own[alone])]
            # every window with those that follow it within reach, both ways round
            for step in range(1, len(at)):
                near = np.flatnonzero(at[step:] - at[:-step] <= self.reach)
                if not len(near):
                    break
                for x, y in ((near, near + step), (near + step, near)):
                    pair = together(own[x], own[y])
                    hit = both.has(pair)
                    calls.append((x[hit], pair[hit]))
            who, h = (np.concatenate(c) for c in zip(*calls))
            if not len(who):
                continue
            place = at[who]
            order = np.lexsort((h, place))
            place, h = place[order], h[order]
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            ends = np.array([k for k, t in enumerate(stream) if t == "\x02"], dtype=np.int64)
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)]):
                p = int(place[lo])
                doc = int(np.searchsorted(ends, p))
                start = max(int(ends[doc - 1]) + 1 if doc else 0, p - self.reach)
                end = min(int(ends[doc]) if doc < len(ends) else len(stream), p + self.reach)
                yield int(docs[a + doc]), p - start, " ".join(stream[start:end]), np.unique(h[lo:hi]).astype(np.int64).tolist()


# ---- the check ----


@lru_cache(1 << 14)
def _asked(first: str, second: str) -> tuple[list[list[str]], list[str], list[str], int]:
    """Both sentences; their values; their words, the longest first; how many of the words edits may take."""
    parts = [first.split(" "), second.split(" ")]
    both = parts[0] + parts[1]
    words = sorted((t for t in both if not t[0].isdigit()), key=len, reverse=True)
    return parts, [number(t) for t in both if t[0].isdigit()], words, EDITS_TOGETHER * (RUN if _east(both) else 1)


def may_stand(values: list[str], words: list[str], spare: int, text: str) -> bool:
    """All values are in the text (tokens in a row), and all but so many words as edits may take."""
    if not all([v in text for v in values]):
        return False
    for w in words:
        if w not in text:
            spare -= 1
            if spare < 0:
                return False
    return True


def stands(parts: list[list[str]], start: int, doc: list[str]) -> bool:
    """Both sentences stand together in the document, from about `start` on."""
    # list marks and edits of both sentences move the start
    reach = 4 + 4 * RUN if _east(parts[0] + parts[1]) else 12
    for at in range(max(0, start - reach), min(len(doc), start + reach + 1)):
        for end, first in _edits(parts[0], doc, at, EDITS):
            skip = end  # a list mark may stand between them
            while skip < len(doc) and skip < end + 2 and not _eq(parts[1][0], doc[skip]) and (doc[skip][0].isdigit() or len(doc[skip]) == 1):
                skip += 1
            for go in {end, skip}:
                if any(first + second <= EDITS_TOGETHER for _, second in _edits(parts[1], doc, go, EDITS)):
                    return True
    return False


@pandas_udf(T.BooleanType())
def stand_there(doc_id: pd.Series, item_id: pd.Series, first: pd.Series, second: pd.Series, at: pd.Series, place: pd.Series, around: pd.Series) -> pd.Series:
    """Whether both sentences stand in the tokens around a window; at: its place in the item, place: in those tokens. Of
    a document and an item only the first such row of a batch is given: many windows call for a check at one place."""
    out, found = [], set()
    for pair, a, b, q, p, text in zip(zip(doc_id, item_id), first, second, at, place, around):
        if pair in found:
            out.append(False)
            continue
        parts, values, words, spare = _asked(a, b)
        doc = text.split(" ")
        plain = "".join([number(t) if t[0].isdigit() else t for t in doc])
        out.append(may_stand(values, words, spare, plain) and stands(parts, p - q, doc))
        if out[-1]:
            found.add(pair)
    return pd.Series(out, dtype=bool)


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: documents that hold at least two consecutive sentences of an item."""
    pieces = cut_lineage(table(items))  # read for the filters and for the join
    shared = documents.sparkSession.sparkContext.broadcast(Search(pieces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers()
        for b in batches:
            with np.errstate(over="ignore"):
                yield pd.DataFrame(list(shared.value.hits(b["doc_id"].to_numpy(), b["text"].tolist(), numbers)), columns=[c.split()[0] for c in HIT.split(", ")])

    hits = documents.select("doc_id", "text").filter(F.length("text") > 0).mapInPandas(run, HIT)
    asked = pieces.filter(F.col("kind") != TEMPLATE).withColumnRenamed("at", "place")
    met = hits.select("doc_id", "at", "around", F.explode("hs").alias("h")).join(asked, "h")
    return met.filter(stand_there("doc_id", "item_id", "first", "second", "place", "at", "around")).select("doc_id", "item_id").distinct()
