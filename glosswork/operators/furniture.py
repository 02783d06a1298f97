"""Text that repeats across a document's pages, and the document without it.

Null text is empty text; a document of fewer than `min_pages` pages has no furniture; rows without a page take no part in
finding it. Rows delivered twice stay twice: the caller decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions.text import bound, effective_length, line_key
from glosswork.session import cut_lineage

MIN_PAGES, LONGEST, SHORTEST_WORD, SHORTEST_PART = 3, 120, 4, 6


def furniture_lines(segments: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """doc_id, key, pages: normalised lines that stand on at least `min_pages` distinct pages of a document."""
    paged = segments.filter(F.col("page").isNotNull()).select("doc_id", "page", "text")
    keyed = paged.withColumn("key", F.when(effective_length(F.col("text")) <= LONGEST, line_key(F.col("text"))))
    long_enough = keyed.groupBy("doc_id").agg(F.count_distinct("page").alias("n")).filter(F.col("n") >= min_pages).select("doc_id")
    often = keyed.filter(F.col("key") != "").groupBy("doc_id", "key").agg(F.count_distinct("page").alias("pages"))
    return often.filter(F.col("pages") >= min_pages).join(long_enough, "doc_id", "left_semi")


def furniture_vocabulary(segments: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """doc_id, word: words of at least four letters in repeated lines, headers and footers."""
    return _vocabulary(segments, furniture_lines(segments, min_pages))


def _vocabulary(segments: DataFrame, found: DataFrame) -> DataFrame:
    stated = segments.filter(F.col("kind").isin("header", "footer")).select("doc_id", line_key(F.col("text")).alias("key"))
    lines = found.select("doc_id", "key").unionByName(stated)
    words = lines.select("doc_id", F.explode(F.split("key", " ")).alias("word"))
    return words.filter(F.length("word") >= SHORTEST_WORD).distinct()


def content_segments(segments: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Segments without furniture: repeated lines go whole, furniture words go from the rest, and what has no letter or
    digit left goes too. One vocabulary array a document; words are tested against it in place, never joined."""
    found = cut_lineage(furniture_lines(segments, min_pages))  # keys of short lines, read for the words and for the lines
    vocabulary = _vocabulary(segments, found).groupBy("doc_id").agg(F.sort_array(F.collect_set("word")).alias("vocabulary"))
    lines = found.select("doc_id", "key")
    rest = segments.filter(~F.coalesce(F.col("kind"), F.lit("")).isin("header", "footer")).withColumn("key", line_key(F.col("text")))
    rest = rest.join(lines, ["doc_id", "key"], "left_anti").join(vocabulary, "doc_id", "left")

    def is_furniture(word: Column) -> Column:
        def among(bare: Column) -> Column:
            part = lambda v: (F.length(bare) >= SHORTEST_PART) & (F.length(v) >= SHORTEST_PART) & (F.contains(v, bare) | F.contains(bare, v))
            return (bare != "") & F.exists(F.col("vocabulary"), lambda v: (v == bare) | part(v))

        return bound(F.lower(F.regexp_replace(word, r"[^\p{L}]", "")), among)

    kept = F.array_join(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: ~is_furniture(w)), " ")
    text = F.when(F.col("vocabulary").isNull(), F.col("text")).otherwise(kept)
    return rest.withColumn("text", text).filter(F.col("text").rlike(r"[\p{L}\p{N}]")).drop("key", "vocabulary")


def edge_lines(segments: DataFrame, lines: int = 2, share: float = 0.6) -> DataFrame:
    """doc_id, edge, key, times: lines among the first or last two of a page that come often enough to be a running
    header or footer: at least max(2, floor(share * pages)) times. Digits don't count."""
    paged = segments.filter(F.col("page").isNotNull()).select("doc_id", "page", "seg_index", "text")
    page = Window.partitionBy("doc_id", "page")
    top = F.row_number().over(page.orderBy("seg_index", "text"))
    bottom = F.row_number().over(page.orderBy(F.desc("seg_index"), F.desc("text")))
    ranked = paged.withColumns({"top": top, "bottom": bottom, "key": F.trim(F.regexp_replace("text", r"\d+", ""))})
    edges = ranked.select("doc_id", "page", "key", F.explode(F.array_compact(F.array(F.when(F.col("top") <= lines, F.lit("header")), F.when(F.col("bottom") <= lines, F.lit("footer"))))).alias("edge"))
    pages = paged.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    often = edges.filter(F.length("key") >= 8).groupBy("doc_id", "edge", "key").agg(F.count("*").alias("times"))
    least = F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(share)).cast("int"))
    return often.join(pages, "doc_id").filter(F.col("times") >= least).select("doc_id", "edge", "key", "times")
