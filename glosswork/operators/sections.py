"""Sections of a document from its stream of segments.

A section begins at a heading, or where the section label differs from the current name; the name is the label, else the
heading's text, else "(document body)". Documents without headings and labels have one section a page.
Null text counts as empty. Ties in seg_index are ordered by seg_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions.text import letters

BODY = "(document body)"


def once(segments: DataFrame) -> DataFrame:
    """Segments delivered twice once, all of a document together: the one exchange that operators by document need."""
    return segments.repartition("doc_id").dropDuplicates(["doc_id", "seg_id"])


def segments_of(report: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, sequence, seg_id: the segments of each section of a report (doc_id, sequence, name, page): those on its page if
    it has a page with any, else those under its name. Null names and labels count as empty."""
    own = segments.select("doc_id", F.col("page").alias("at"), F.coalesce("section", F.lit("")).alias("label"), "seg_id").distinct()
    asked = report.select("doc_id", "sequence", F.coalesce("name", F.lit("")).alias("name"), "page").distinct()
    by_page = asked.join(own, (asked["doc_id"] == own["doc_id"]) & (asked["page"] == own["at"])).select(asked["doc_id"], "sequence", "seg_id")
    rest = asked.join(by_page.select("doc_id", "sequence").distinct(), ["doc_id", "sequence"], "left_anti")
    by_name = rest.join(own.withColumnRenamed("label", "name"), ["doc_id", "name"]).select("doc_id", "sequence", "seg_id")
    return by_page.unionByName(by_name)


def in_page_order(segments: DataFrame) -> DataFrame:
    """Segments with `position` in their document: by page, pageless first, and on a page in their order."""
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("page", F.lit(0)), "seg_index", "seg_id")
    return segments.withColumn("position", F.row_number().over(order))


def numbered(segments: DataFrame) -> DataFrame:
    """Segments with `sequence` and `section_name`: gaps and islands in one partitioning by document."""
    doc = Window.partitionBy("doc_id").orderBy("seg_index", "seg_id")
    heading = F.coalesce(F.col("kind") == "heading", F.lit(False))
    own = F.coalesce(F.col("section"), F.when(heading, F.col("text")))
    before = F.last("own", ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.withColumns({"own": own, "rn": F.row_number().over(doc), "heading": heading})
    rows = rows.withColumn("current", F.when(F.col("rn") > 1, F.coalesce(before, F.lit(BODY))))
    begins = (F.col("rn") > 1) & (F.col("heading") | (F.col("section").isNotNull() & ~F.col("section").eqNullSafe(F.col("current"))))
    rows = rows.withColumn("sequence", 1 + F.sum(begins.cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id")
    by_page = rows.withColumn("structured", F.max(F.col("own").isNotNull()).over(whole)).withColumn("paged", F.max(F.col("page").isNotNull()).over(whole))
    paged = ~F.col("structured") & F.col("paged")
    first = F.first("own", ignorenulls=False).over(Window.partitionBy("doc_id", "sequence").orderBy("seg_index", "seg_id"))
    page = F.coalesce(F.col("page"), F.lit(0))
    return by_page.withColumns({
        "section_name": F.when(paged, F.concat(F.lit("Page "), page)).otherwise(F.coalesce(first, F.lit(BODY))),
        "sequence": F.when(paged, F.dense_rank().over(whole.orderBy(page))).otherwise(F.col("sequence")),
    }).drop("own", "rn", "heading", "current", "structured", "paged")


def sections(segments: DataFrame) -> DataFrame:
    """doc_id, sequence, name, page, segment_count, total_characters."""
    at = F.struct("seg_index", "seg_id")
    return numbered(segments).groupBy("doc_id", "sequence").agg(
        F.min_by("section_name", at).alias("name"), F.min_by("page", at).alias("page"), F.count("*").alias("segment_count"),
        F.sum(F.length(letters(F.coalesce("text", F.lit(""))))).alias("total_characters"),
    )


def origins(segments: DataFrame) -> DataFrame:
    """doc_id, origin: what a document's sections come from, heading, worksheet, page, label or document."""
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    flags = segments.groupBy("doc_id").agg(
        has(F.col("kind") == "heading").alias("h"), has(F.col("kind") == "sheet_cell").alias("s"),
        has(F.col("section").isNotNull()).alias("l"), has(F.col("page").isNotNull()).alias("p"),
    )
    kind = F.when(F.col("h"), "heading").when(F.col("s"), "worksheet").when(F.col("p") & ~F.col("l"), "page").when(F.col("l"), "heading").otherwise("document")
    return flags.select("doc_id", kind.alias("origin"))


def coverage(report: DataFrame) -> DataFrame:
    """doc_id, sequence, language, characters, share: a section report's characters by language and their share in percent."""
    long = report.select("doc_id", "sequence", F.explode("characters").alias("language", "characters"))
    whole = Window.partitionBy("doc_id", "sequence")
    return long.withColumn("share", F.round(100 * F.try_divide(F.col("characters"), F.sum("characters").over(whole)), 2))


def gaps(report: DataFrame, panel: tuple[str, ...], minimum: int = 120, short: float = 0.35, density: dict[str, float] | None = None) -> DataFrame:
    """doc_id, sequence, evaluated, missing, short: languages of the panel a section lacks, and those whose text, weighted by
    density, is under `short` of the longest (at least two must be present)."""
    density = density or {"zh": 3.0}
    amount = {c: F.coalesce(F.col("characters")[c], F.lit(0)) for c in panel}
    normal = {c: amount[c] * F.lit(density.get(c, 1.0)) for c in panel}
    longest = F.greatest(*normal.values())
    present = reduce(Column.__add__, [(amount[c] > 0).cast("int") for c in panel])
    evaluated = F.col("total_characters") >= minimum
    lacks = F.array_compact(F.array(*[F.when(evaluated & (amount[c] == 0), F.lit(c)) for c in panel]))
    brief = F.array_compact(F.array(*[F.when(evaluated & (present >= 2) & (amount[c] > 0) & (normal[c] < short * longest), F.lit(c)) for c in panel]))
    return report.select("doc_id", "sequence", evaluated.alias("evaluated"), lacks.alias("missing"), brief.alias("short"))
