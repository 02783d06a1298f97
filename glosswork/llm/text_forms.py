"""One consistent form for visually identical text (problem 1).

A longest-match transducer over grapheme clusters. Its mapping (sequence of code points -> text) is
computed once from the Unicode character database by rule, plus a short list of look-alike letters,
and checked for conflicts: no sequence has two results, every result maps to itself, and plain ASCII
is never changed. Text is rewritten in one pass: runs that hold no special character are copied,
each cluster that does is walked through the compiled trie (and remembered).

Rules: full- and half-width forms to the ordinary one, compatibility ideographs and radicals to the
unified ideograph, letter ligatures to their letters, every blank to U+0020, hyphens to "-", base
letter and combining marks to the composed letter, look-alike Cyrillic and Greek letters to Latin,
invisible characters to nothing. Case, raised digits and any other digits stay different.

Edge cases: null stays null, empty stays empty, blanks at the ends are kept as blanks and don't count
in `same_look`; any length is read whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from glosswork.session import cut_lineage

# Letters of other scripts that are drawn like a Latin one, and that one.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "Ѕ": "S", "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "һ": "h",
    "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ӏ": "l", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "μ": "µ",
    # Latin
    "ɡ": "g", "ɑ": "a",
}
# Characters without any width of their own.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
# Hyphens drawn like the ASCII one.
HYPHENS = "‐‑﹣－"

# The blocks of combining diacritical marks, and the sound marks of kana.
BLOCKS = ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE20, 0xFE2F), (0xFF9E, 0xFF9F))
COMBINING = "".join(chr(c) for a, b in BLOCKS for c in range(a, b + 1))


def _changing() -> list[str]:
    """The code points that Unicode writes in another way too, and blanks; Hangul syllables are composed by NFC itself."""
    return [c for c in map(chr, range(0x80, 0x30000)) if not "가" <= c <= "힣" and (unicodedata.decomposition(c) or unicodedata.category(c) == "Zs")]


def _single_rules() -> dict[str, str]:
    """Code point -> text, for all code points that change by themselves."""
    rules = dict(LOOK_ALIKES) | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(HYPHENS, "-")
    for c in _changing():
        if c in rules:
            continue
        kind, name = unicodedata.decomposition(c), unicodedata.name(c, "")
        if unicodedata.category(c) == "Zs":
            rules[c] = " "
        elif kind.startswith(("<wide>", "<narrow>")):
            rules[c] = unicodedata.normalize("NFKC", c)
        elif kind.startswith("<compat>") and ("RADICAL" in name or "LATIN SMALL LIGATURE" in name or name.startswith("LATIN CAPITAL LIGATURE")):
            rules[c] = unicodedata.normalize("NFC", "".join(chr(int(x, 16)) for x in kind.split()[1:]))
        elif kind and not kind.startswith("<"):
            rules[c] = unicodedata.normalize("NFC", c)  # singletons, and letters composed of look-alikes below
    return rules


def build_rules() -> dict[str, str]:
    """Sequence -> text, conflict-checked."""
    single = _single_rules()

    def settle(text: str) -> str:
        for _ in range(4):
            new = unicodedata.normalize("NFC", "".join(single.get(c, c) for c in text))
            if new == text:
                break
            text = new
        return text

    rules: dict[str, str] = {}

    def add(source: str, result: str) -> None:
        if rules.setdefault(source, result) != result:
            raise ValueError(f"two results for {source!r}: {rules[source]!r} and {result!r}")

    twins: dict[str, list[str]] = {}
    for look, plain in LOOK_ALIKES.items():
        twins.setdefault(plain, []).append(look)
    for c in dict.fromkeys([*_changing(), *single]):
        result = settle(unicodedata.normalize("NFD", c) if unicodedata.decomposition(c)[:1] not in ("", "<") else c)
        if result != c:
            add(c, result)
        apart = unicodedata.normalize("NFD", c)
        if len(apart) > 1 and result == c:
            add(apart, c)
            for base in twins.get(apart[0], []):
                add(base + apart[1:], c)
    for base, marks in (("ｶ", range(0xFF76, 0xFF85)), ("ﾊ", range(0xFF8A, 0xFF8F))):
        for cp in marks:  # half-width kana with their sound marks
            for mark in "ﾞﾟ":
                whole = unicodedata.normalize("NFKC", chr(cp) + mark)
                if len(whole) == 1:
                    add(chr(cp) + mark, whole)
    for source, result in rules.items():
        if source.isascii():
            raise ValueError(f"{source!r} is plain")
        if any(rules.get(c, c) != c for c in result):
            raise ValueError(f"the result of {source!r} is not final")
    return rules


def ranges(characters: set[str]) -> str:
    """Character class body of a set of characters."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, characters)):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Transducer:
    """The compiled mapping."""

    def __init__(self, rules: dict[str, str]):
        self.trie: dict = {}
        for source, result in rules.items():
            node = self.trie
            for c in source:
                node = node.setdefault(c, {})
            node[""] = result
        starts, unseen = ranges({r for r in rules if len(r) == 1}), ranges(set(INVISIBLE))
        marks = ranges(set(COMBINING) - set(INVISIBLE))
        # A cluster is active if it starts with a character that changes, or joins marks to its base.
        self.active = re.compile(rf"[{starts}][{marks}{unseen}]*|[^\s{marks}{unseen}][{unseen}]*[{marks}][{marks}{unseen}]*")
        # Without a mark in the text clusters are single characters, and runs of them can be taken together.
        self.marked, self.runs = re.compile(f"[{marks}]"), re.compile(f"[{starts}]+")
        self.known: dict[str, str] = {}

    def cluster(self, text: str) -> str:
        done = self.known.get(text)
        if done is None:
            whole, out, i = "".join(c for c in text if c not in INVISIBLE), [], 0
            while i < len(whole):
                node, best, j = self.trie, None, i
                while j < len(whole) and whole[j] in node:
                    node = node[whole[j]]
                    j += 1
                    if "" in node:
                        best = (j, node[""])
                i, result = best or (i + 1, whole[i])
                out.append(result)
            done = unicodedata.normalize("NFC", "".join(out))
            if len(self.known) < 100_000:
                self.known[text] = done
        return done

    def apply(self, text: str) -> str:
        if text.isascii():
            return text
        pattern = self.active if self.marked.search(text) else self.runs
        return pattern.sub(lambda m: self.known.get(m[0]) or self.cluster(m[0]), text)


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer(build_rules())


@pandas_udf(T.StringType())
def one_form(texts: pd.Series) -> pd.Series:
    """Every text in its consistent form; null stays null."""
    apply = transducer().apply
    return texts.map(apply, na_action="ignore")


def one_to_one() -> tuple[str, str]:
    """The part of the mapping that replaces one code point by one, and what becomes of invisible ones (U+E000): for
    `translate`, where offsets must stay."""
    pairs = {s: r for s, r in build_rules().items() if len(s) == 1 and len(r) == 1} | dict.fromkeys(INVISIBLE, "")
    return "".join(pairs), "".join(pairs.values())


def fingerprint(text: Column) -> tuple[Column, Column]:
    """128 bits of a text, to compare by value without carrying it."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def consistent(segments: DataFrame, text: str = "text", out: str = "same_form") -> DataFrame:
    """`segments` with the consistent form of `text` in the column `out` (which must be new)."""
    return segments.withColumn(out, one_form(F.col(text)))


def _looks(segments: DataFrame) -> DataFrame:
    """seg_id, doc_id, look, look2, stored: hashes of the consistent and the stored form of every visible segment, once."""
    form = F.trim(F.col("same_form"))
    hashed = consistent(segments.select("seg_id", "doc_id", "text").filter(F.col("text").isNotNull())).filter(form != "")
    (a, b), (c, _) = fingerprint(form), fingerprint(F.col("text"))
    return hashed.select("seg_id", "doc_id", a.alias("look"), b.alias("look2"), c.alias("stored")).dropDuplicates(["seg_id"])


def look_classes(segments: DataFrame) -> DataFrame:
    """seg_id, class (the least seg_id of those of its document that look the same), members, links (members that are stored
    with other characters): one row a segment, no pairs."""
    rows = cut_lineage(_looks(segments))  # five numbers a row, read three times
    key = ["doc_id", "look", "look2"]
    forms = rows.groupBy(*key, "stored").agg(F.count("*").alias("same"), F.min("seg_id").alias("first"))
    classes = forms.groupBy(*key).agg(F.min("first").alias("class"), F.sum("same").alias("members"))
    return rows.join(forms.drop("first"), [*key, "stored"]).join(classes, key).select("seg_id", "class", "members", (F.col("members") - F.col("same")).alias("links"))


def same_look(segments: DataFrame) -> DataFrame:
    """Pairs seg_id_a < seg_id_b of one document that look the same and are stored differently.

    Rows without text or of nothing visible make no pair; a segment delivered twice counts once. The
    text goes no further than the first stage: joins carry hashes. Groups with only one stored form are
    dropped by an aggregate (combined before its shuffle) before any row meets another.
    """
    rows = cut_lineage(_looks(segments))  # five numbers a row; three branches read it
    key = ["doc_id", "look", "look2"]
    several = rows.groupBy(*key).agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).filter("lo <> hi").select(*key)
    rows = rows.join(several, key, "left_semi")
    left = rows.withColumnsRenamed({"seg_id": "seg_id_a", "stored": "stored_a"})
    right = rows.withColumnsRenamed({"seg_id": "seg_id_b", "stored": "stored_b"})
    return left.join(right, key).filter("seg_id_a < seg_id_b AND stored_a <> stored_b").select("seg_id_a", "seg_id_b")


if __name__ == "__main__":
    sys.stdout.write(f"{len(build_rules())} sequences\n")
