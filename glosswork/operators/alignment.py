"""Segments of a section side by side by language, up to a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions.text import letters
from glosswork.operators.attribution import language_of
from glosswork.operators.sections import numbered


def budgeted(segments: DataFrame, budget: int = 400_000) -> DataFrame:
    """Segments before which a document's budget is not used up; `truncated` says whether the document had more. A segment
    may overshoot. Null and blank texts cost and count nothing."""
    doc = Window.partitionBy("doc_id").orderBy("seg_index", "seg_id")
    cost = F.length(F.coalesce("text", F.lit("")))
    spent = F.coalesce(F.sum(cost).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = segments.withColumn("spent", spent)
    more = (F.col("spent") >= budget) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    over = F.max(more).over(Window.partitionBy("doc_id"))
    return rows.withColumn("truncated", over).filter(F.col("spent") < budget).drop("spent")


def aligned_blocks(segments: DataFrame, budget: int = 400_000, language=None) -> DataFrame:  # noqa: ANN001
    """doc_id, sequence, language (unassigned where none dominates), segments, characters, texts: whole segments in their order;
    truncated: whether the document had more than the budget."""
    lang = language if language is not None else language_of(segments)
    rows = numbered(budgeted(segments, budget)).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = rows.withColumn("language", F.coalesce(lang, F.lit("unassigned")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "seg_id", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "sequence", "language").agg(
        F.count("*").alias("segments"), F.sum(F.length(letters(F.col("text")))).alias("characters"), ordered.alias("texts"), F.max("truncated").alias("truncated")
    )


def compared_rows(blocks: DataFrame) -> DataFrame:
    """doc_id, sequence, rows: how many rows a section takes side by side, which is its longest language's."""
    return blocks.groupBy("doc_id", "sequence").agg(F.array_max(F.collect_list(F.size("texts"))).alias("rows"))
