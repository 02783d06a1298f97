"""Splitting oversized texts at natural boundaries (problem 9).

A text over the limit is tokenized once and written as a string with one character a token that says what
ends with it: P a paragraph, L a line, S a sentence, C a clause, W a word, x nothing, b not even a character
(byte-level tokens may part one). One regular expression with bounded quantifiers then takes the pieces out of
that string: its alternatives, ordered by boundary strength, each consume as many tokens as fit and end at
their boundary, with any character as the last resort. Sizes are exact in tokens; lookback offsets give each
piece the last `overlap` tokens of the one before. Everything after tokenizing is SQL array functions.

Edge cases: null and empty texts have no pieces, texts up to the limit are one piece; a text of any length is
read whole; a single character of more tokens than fit is never parted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm import tokens

LIMIT, OVERLAP = 8192, 256
#: tokens kept free because a piece tokenized by itself may need some more at its ends
SLACK = 32
#: ids of documents delivered twice that are sent to the workers; if there are more, all texts are shuffled
MOST_REPEATED = 1_000_000

SENTENCE_ENDS, CLAUSE_ENDS = set(".!?。！？…"), set(",;:，；：、")


def _classes(text: str, enc) -> tuple[str, list[int], list[int], list[int]]:
    """One class a token; for each place between tokens its offset in characters and bytes, and the next place that parts none."""
    found = enc.encode_ordinary(text)
    parts = enc.decode_tokens_bytes(found)
    ends, classes, chars, open_ = [], [], 0, 0
    bytes_ = [0, *accumulate(map(len, parts))]
    for part in parts:
        for byte in part:  # count characters by their first bytes; open_: bytes still missing of the last one
            if byte < 0x80:
                chars, open_ = chars + 1, 0
            elif byte >= 0xC0:
                chars, open_ = chars + 1, (1 if byte < 0xE0 else 2 if byte < 0xF0 else 3)
            else:
                open_ -= 1
        ends.append(chars)
        classes.append("b" if open_ else "")
    for k, c in enumerate(classes):
        if c:
            continue
        at = ends[k]
        last, after = text[at - 1], text[at : at + 1]
        if not after or text[at - 2 : at] == "\n\n" or (last == "\n" and after == "\n"):
            classes[k] = "P" if not after or last == "\n" and after != "\n" else "x"
        elif last == "\n":
            classes[k] = "L"
        elif last in SENTENCE_ENDS and (after.isspace() or not last.isascii()):
            classes[k] = "S"
        elif last in CLAUSE_ENDS:
            classes[k] = "C"
        elif after.isspace() or last.isspace() or not (last.isascii() or after.isascii()):
            classes[k] = "W"
        else:
            classes[k] = "x"
    sound = list(range(len(classes) + 1))
    for k in range(len(classes) - 1, 0, -1):
        if classes[k - 1] == "b":
            sound[k] = sound[k + 1]
    return "".join(classes), [0, *ends], bytes_, sound


def pattern(limit: int) -> str:
    """Up to `limit` tokens, ending at the strongest boundary in their second half, else anywhere between characters."""
    least, most = max(limit // 2 - 1, 0), limit - 1
    strong = [f"[PLSCWxb]{{{least},{most}}}{c}" for c in ("P", "[PL]", "[PLS]", "[PLSC]", "[PLSCW]")]
    return "|".join([*strong, f"[PLSCWxb]{{0,{most}}}[PLSCWx]", "[PLSCWxb]+?[PLSCWx]"])


def _once(documents: DataFrame) -> DataFrame:
    """doc_id, text of documents with text, each once. Ids alone are counted; only texts delivered twice are shuffled."""
    rows = documents.select("doc_id", "text").filter(F.length("text") > 0)
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    n = twice.count()
    if not n:
        return rows
    if n > MOST_REPEATED:
        return rows.dropDuplicates(["doc_id"])
    few = F.broadcast(twice)  # at most MOST_REPEATED numbers
    return rows.join(few, "doc_id", "left_anti").unionByName(rows.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def pieces(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = tokens.TOKENIZER) -> DataFrame:
    """doc_id, piece, char_start, char_end (0-based, end exclusive, overlap included), own_start (where it goes on), tokens, text."""
    return _pieces(_once(documents), limit, overlap, path)


def _pieces(rows: DataFrame, limit: int, overlap: int, path: str) -> DataFrame:
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    own = limit - overlap - min(SLACK, limit // 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoding(path)
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):  # one document at a time: they may be long
                classes, ends, bytes_, sound = _classes(text, enc)
                yield pd.DataFrame({"doc_id": [doc], "body": [text.encode()], "classes": [classes], "ends": [ends], "bytes": [bytes_], "sound": [sound]})

    long = rows.filter(tokens.exceeds(F.col("text"), limit)).mapInPandas(run, "doc_id bigint, body binary, classes string, ends array<int>, bytes array<int>, sound array<int>")
    fits = F.length("classes") <= limit
    parts = F.when(fits, F.array("classes")).otherwise(F.expr(f"regexp_extract_all(classes, '{pattern(own)}', 0)"))
    sizes = F.transform(parts, lambda p: F.length(p))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("cuts"))
    cuts = F.aggregate(
        sizes, zero,
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["cuts"], F.array(F.struct(acc["at"].alias("a"), (acc["at"] + n).alias("b")))).alias("cuts")),
        lambda acc: acc["cuts"],
    )
    # the overlap starts after a token that ends a character; the arrays hold a value for each place between tokens
    begin = lambda c: F.least(F.get("sound", F.greatest(c["a"] - overlap, F.lit(0))), c["a"])

    def piece(c: Column, k: Column) -> Column:
        """One piece, cut out of the bytes at its place: no piece costs more than its own length."""
        start = begin(c)
        first, last = F.get("bytes", start), F.get("bytes", c["b"])
        text = F.decode(F.substring("body", first + 1, last - first), "UTF-8")
        return F.struct(
            k.alias("piece"), F.get("ends", start).alias("char_start"), F.get("ends", c["b"]).alias("char_end"), F.get("ends", c["a"]).alias("own_start"),
            (c["b"] - start).alias("tokens"), text.alias("text"),
        )

    placed = long.select("doc_id", F.explode(F.transform(cuts, piece)).alias("p")).select("doc_id", "p.*")
    short = rows.filter(~tokens.exceeds(F.col("text"), limit)).select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.lit(0).alias("own_start"),
        tokens.count(F.col("text"), path).cast("int").alias("tokens"), "text",
    )
    return placed.unionByName(short)


def oversized(documents: DataFrame, limit: int = LIMIT, path: str = tokens.TOKENIZER) -> DataFrame:
    """doc_id of the documents that come out in several pieces, which are those of more than `limit` tokens.

    Only texts of more than `limit` bytes can have as many tokens; the others are never tokenized.
    """
    long = documents.select("doc_id", "text").filter(tokens.exceeds(F.col("text"), limit))
    return _pieces(long, limit, OVERLAP, path).filter("piece = 1").select("doc_id").distinct()
