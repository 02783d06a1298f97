"""Document rules. Each gives one row a document: doc_id, rule, applicable, passed (null where not applicable), findings.

Rules read the raw segments, each once (see `sections.once`). Segments that carry `language` (en, id or zh, see
`attribution.with_language`) are judged by it, others by their script. `facts` (doc_id, is_docx, scanned) says which
documents state headers, footers and colours, and whose text was recognised from images; without it a document counts as
stating what it has. Null texts are skipped. The registry fixes the rules' order; only those asked for run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosswork.functions.text import CODE, REVISION, colour, document_code, revision
from glosswork.operators.attribution import language_of
from glosswork.operators.furniture import content_segments, edge_lines
from glosswork.operators.measurements import measurements, unmatched
from glosswork.operators.sections import numbered, origins
from glosswork.session import cut_lineage

ORDER = ("en", "id", "zh")
OPENING, HEAD, LEAST_TEXT = 15, 40, 25


def _outcome(rows: DataFrame, rule: str, applicable: Column, findings: Column) -> DataFrame:
    return rows.select(
        "doc_id", F.lit(rule).alias("rule"), applicable.alias("applicable"), F.when(applicable, findings == 0).alias("passed"),
        F.when(applicable, findings).otherwise(0).cast("bigint").alias("findings"),
    )


def languages_by_first_appearance(segments: DataFrame, language: Column) -> DataFrame:
    """doc_id, section, languages in the order of their first segment of at least LEAST_TEXT characters."""
    rows = segments.filter((F.coalesce(F.col("kind"), F.lit("")) != "heading") & (F.length("text") >= LEAST_TEXT)).withColumn("language", language)
    first = rows.filter(F.col("language").isNotNull()).groupBy("doc_id", "section", "language").agg(F.min(F.struct("seg_index", "seg_id")).alias("at"))
    return first.groupBy("doc_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "language"))), lambda x: x["language"]).alias("languages"))


def _facts(rows: DataFrame, facts: DataFrame | None) -> DataFrame:
    """rows (one a document) with is_docx and scanned; null where nothing is known."""
    if facts is None:
        return rows.withColumns({"is_docx": F.lit(None).cast("boolean"), "scanned": F.lit(None).cast("boolean")})
    return rows.join(facts.select("doc_id", "is_docx", "scanned").dropDuplicates(["doc_id"]), "doc_id", "left")


def language_order(segments: DataFrame, facts: DataFrame | None = None, order: tuple[str, ...] = (*ORDER[:2], "latin", "zh")) -> DataFrame:
    seen = languages_by_first_appearance(segments, language_of(segments))
    expected = F.filter(F.array(*[F.lit(x) for x in order]), lambda x: F.array_contains("languages", x))
    known = F.filter("languages", lambda x: x.isin(*order))
    wrong = seen.filter(F.col("section").isNotNull() & (F.size(known) >= 2) & (known != expected)).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = origins(segments).join(wrong, "doc_id", "left")
    return _outcome(rows, "language_order", ~F.col("origin").isin("page", "document"), F.coalesce("n", F.lit(0)))


def code_and_revision(segments: DataFrame) -> DataFrame:
    """doc_id, document_code, revision: the first of each in the header, footer, first page and pageless text, else in the
    first HEAD segments."""
    doc = Window.partitionBy("doc_id").orderBy("seg_index", "seg_id")
    near = F.col("kind").isin("header", "footer") | (F.col("page") == 1) | F.col("page").isNull()
    rows = segments.filter(F.col("text").isNotNull()).withColumn("rn", F.row_number().over(doc)).withColumn("near", F.coalesce(near, F.lit(False)))
    rows = rows.withColumn("any", F.max("near").over(Window.partitionBy("doc_id")))
    rows = rows.filter(F.col("near") | (~F.col("any") & (F.col("rn") <= HEAD))).filter(F.col("text").rlike(CODE) | F.col("text").rlike(REVISION))
    at = F.struct("seg_index", "seg_id")
    code, rev = document_code(F.col("text")), revision(F.col("text"))
    return rows.groupBy("doc_id").agg(
        F.min_by(code, F.when(code.isNotNull(), at)).alias("document_code"), F.min_by(rev, F.when(rev.isNotNull(), at)).alias("revision")
    )


def document_code_rule(segments: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    rows = segments.select("doc_id").distinct().join(code_and_revision(segments), "doc_id", "left")
    return _outcome(rows, "document_code", F.lit(True), F.col("document_code").isNull().cast("int") + F.col("revision").isNull().cast("int"))


def header_footer(segments: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """A format that states headers and footers is judged by them; else repeated edge lines may show them, and a document of
    fewer than three pages, or without such lines, is not judged."""
    stated = segments.groupBy("doc_id").agg(
        F.max((F.col("kind") == "header").cast("int")).alias("h"), F.max((F.col("kind") == "footer").cast("int")).alias("f"),
        F.count_distinct("page").alias("pages"),
    )
    edges = edge_lines(segments).groupBy("doc_id").agg(F.count_distinct("edge").alias("edges"))
    rows = _facts(stated.join(edges, "doc_id", "left").na.fill({"edges": 0, "h": 0, "f": 0}), facts)
    states = F.coalesce("is_docx", F.col("h") + F.col("f") > 0)
    return _outcome(rows, "header_footer", states | ((F.col("pages") >= 3) & (F.col("edges") == 2)), F.when(states, 2 - F.col("h") - F.col("f")).otherwise(0))


def cover_page(segments: DataFrame, facts: DataFrame | None = None, shortest_title: int = 10) -> DataFrame:
    doc = Window.partitionBy("doc_id").orderBy("seg_index", "seg_id")
    first_page = segments.filter((F.col("page") == 1) & F.col("text").isNotNull())
    pageless = segments.filter(F.col("page").isNull() & F.col("text").isNotNull()).withColumn("rn", F.row_number().over(doc)).filter(F.col("rn") <= OPENING)
    opening = first_page.select("doc_id", "text", F.lit(1).alias("p")).unionByName(pageless.select("doc_id", "text", F.lit(0).alias("p")))
    opening = opening.withColumn("best", F.max("p").over(Window.partitionBy("doc_id"))).filter("p = best")
    rows = opening.groupBy("doc_id").agg(F.max(F.col("text").rlike(CODE)).alias("code"), F.max(F.length("text") >= shortest_title).alias("title"))
    every = segments.select("doc_id").distinct().join(rows, "doc_id", "left")
    return _outcome(every, "cover_page", F.col("code").isNotNull(), (~F.col("code")).cast("int") + (~F.col("title")).cast("int"))


def colour_offenders(segments: DataFrame, allowed: tuple[str, ...] = ("000000",)) -> DataFrame:
    """doc_id, colour, times, example: explicit colours that are not allowed, with their first text."""
    rows = segments.select("doc_id", "seg_index", "seg_id", "text", F.explode("font_colors").alias("c")).withColumn("colour", colour(F.col("c")))
    bad = rows.filter(~F.col("colour").isin(*allowed)).dropDuplicates(["seg_id", "colour"])
    return bad.groupBy("doc_id", "colour").agg(F.count("*").alias("times"), F.substring(F.min_by("text", F.struct("seg_index", "seg_id")), 1, 60).alias("example"))


def font_color(segments: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    explicit = segments.groupBy("doc_id").agg(F.max(F.size(F.coalesce("font_colors", F.array().cast("array<string>"))) > 0).alias("any"))
    n = colour_offenders(segments).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = _facts(explicit.join(n, "doc_id", "left"), facts)
    return _outcome(rows, "font_color", F.col("any") & F.coalesce("is_docx", F.lit(True)), F.coalesce("n", F.lit(0)))


def measured_languages(segments: DataFrame, language: Column) -> DataFrame:
    """doc_id, sequence, language, found: the measurements of each language of each section, in text order."""
    rows = numbered(content_segments(segments)).withColumn("language", language).filter(F.col("language").isNotNull())
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seg_index", "seg_id", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "sequence", "language").agg(texts.alias("texts")).select(
        "doc_id", "sequence", "language", measurements(F.array_join("texts", " ")).alias("found")
    )


def numeric_mismatches(segments: DataFrame) -> DataFrame:
    """doc_id, sequence, reference, language, missing: measurements of the language that has most of them (the first on
    ties) that another language of the section lacks."""
    # numbers only, read twice below
    found = cut_lineage(measured_languages(segments, language_of(segments)))
    panel = F.array_position(F.array(*[F.lit(x) for x in ("en", "id", "latin", "zh")]), F.col("language"))
    first = -F.when(panel > 0, panel).otherwise(99)
    best = F.max_by(F.struct("language", "found"), F.struct(F.size("found"), first)).alias("r")
    reference = found.groupBy("doc_id", "sequence").agg(best).filter(F.size("r.found") > 0)
    pairs = found.join(reference, ["doc_id", "sequence"]).filter(F.col("language") != F.col("r.language"))
    lacks = pairs.withColumn("missing", unmatched(F.col("r.found"), F.col("found"))).filter(F.size("missing") > 0)
    return lacks.select("doc_id", "sequence", F.col("r.language").alias("reference"), "language", F.transform("missing", lambda m: m["raw"]).alias("missing"))


def numeric_consistency(segments: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Documents whose text was recognised from images are not judged: a misread digit is no mistranslation."""
    n = numeric_mismatches(segments).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = _facts(segments.select("doc_id").distinct().join(n, "doc_id", "left"), facts)
    return _outcome(rows, "numeric_consistency", ~F.coalesce("scanned", F.lit(False)), F.coalesce("n", F.lit(0)))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "language_order": language_order, "document_code": document_code_rule, "header_footer": header_footer,
    "cover_page": cover_page, "font_color": font_color, "numeric_consistency": numeric_consistency,
}


def run(segments: DataFrame, rules: list[str] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Outcomes of the rules asked for (all by default), in the registry's order."""
    return reduce(DataFrame.unionByName, [REGISTRY[r](segments, facts) for r in REGISTRY if rules is None or r in rules])
