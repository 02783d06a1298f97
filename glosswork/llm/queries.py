"""Queries of the llm operators over the library's tables, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glosswork.llm import bitext, language, leaks, mixing, pieces, scans, sentences, text_forms
from glosswork.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return text_forms.same_look(table(spark, root, "segments"))


def p1_same_form(spark: SparkSession, root: str) -> DataFrame:
    """Every segment with its one consistent text."""
    rows = table(spark, root, "segments").select("seg_id", "doc_id", "text").dropDuplicates(["seg_id"])
    return text_forms.consistent(rows).drop("text")


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    """Every visible segment with the class of those of its document that look the same, and its number of links."""
    return text_forms.look_classes(table(spark, root, "segments"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return bitext.translations(*(table(spark, root, n) for n in ("segments", "documents", "document_sections")))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, root, "segments"))


def _attributed(spark: SparkSession, root: str) -> DataFrame:
    return language.attribute(*(table(spark, root, n) for n in ("documents", "segments", "rule_findings")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return language.wrong_or_missing(_attributed(spark, root))


def p4_languages(spark: SparkSession, root: str) -> DataFrame:
    """The language of every document, finding and part of a mixed segment, with its confidence."""
    return _attributed(spark, root).drop("label")


def p4_tallies(spark: SparkSession, root: str) -> DataFrame:
    """The confidence of every language tally as the text bears it out."""
    return language.tally_confidence(*(table(spark, root, n) for n in ("documents", "segments", "language_tallies")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.defects(table(spark, root, "ocr_pages"), table(spark, root, "documents"))


def p6_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """The continuous paragraphs of every scanned document."""
    return scans.paragraphs(table(spark, root, "ocr_pages"), table(spark, root, "documents"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaked(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The chosen records with their repeats."""
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mixture_targets"))[0]


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mixture_targets"))[1]


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return pieces.oversized(table(spark, root, "documents"))


def p9_pieces(spark: SparkSession, root: str) -> DataFrame:
    """All pieces of all documents, without their text."""
    return pieces.pieces(table(spark, root, "documents")).drop("text").distinct()


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_same_form, p1_classes, p2_found, p3_found, p4_found, p4_languages, p4_tallies, p6_found, p6_paragraphs, p7_found, p8_mixture, p8_shares, p9_found, p9_pieces)
}
SQL: dict[str, str] = {}
