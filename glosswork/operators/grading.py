"""Scores of a document from its language tallies, against thresholds that are a table of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PANEL = {"en": 100, "id": 100, "zh": 50}
DENSITY = {"zh": 3.0}


def amounts(tallies: DataFrame, panel: dict[str, int] = PANEL) -> DataFrame:
    """doc_id and the characters of each language of the panel, 0 where it has none."""
    return tallies.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("language") == c, F.col("characters"))), F.lit(0)).alias(c) for c in panel])


def threshold_results(tallies: DataFrame, panel: dict[str, int] = PANEL) -> DataFrame:
    """doc_id, language, characters, threshold, meets: one row for every document and language of the panel."""
    wide = amounts(tallies, panel)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("language"), F.col(c).alias("characters"), F.lit(t).alias("threshold")) for c, t in panel.items()]))
    return wide.select("doc_id", each.alias("x")).select("doc_id", "x.*").withColumn("meets", (F.col("characters") > 0) & (F.col("characters") >= F.col("threshold")))


def score(panel: dict[str, int] = PANEL, density: dict[str, float] = DENSITY) -> Column:
    """Mean over the panel of the lesser of adequacy (against the threshold) and balance (against half the mean), in percent."""
    normal = {c: F.col(c) * F.lit(density.get(c, 1.0)) for c in panel}
    mean = reduce(Column.__add__, normal.values()) / len(panel)
    parts = [F.least(F.least(F.col(c) / max(t, 1), F.lit(1.0)), F.when(mean > 0, F.least(normal[c] / (mean * 0.5), F.lit(1.0))).otherwise(0.0)) for c, t in panel.items()]
    return F.round(reduce(Column.__add__, parts) * 100 / len(panel), 2)


def verdicts(tallies: DataFrame, panel: dict[str, int] = PANEL, least: float = 80.0) -> DataFrame:
    """doc_id, score, status, issues: REVIEW_REQUIRED without any text of the panel, FAIL if a language is missing, PARTIAL
    if one is under its threshold or the score under `least`, else PASS; issues name what the status rests on."""
    wide = amounts(tallies, panel).withColumn("score", score(panel))
    none = reduce(Column.__and__, [F.col(c) == 0 for c in panel])
    missing = reduce(Column.__or__, [F.col(c) == 0 for c in panel])
    below = reduce(Column.__or__, [F.col(c) < t for c, t in panel.items()])
    status = F.when(none, "REVIEW_REQUIRED").when(missing, "FAIL").when(below | (F.col("score") < least), "PARTIAL").otherwise("PASS")
    issues = [F.when(F.col(c) == 0, f"LANGUAGE_MISSING:{c}").when(F.col(c) < t, f"LOW_LANGUAGE_COVERAGE:{c}") for c, t in panel.items()]
    unbalanced = F.when((status == "PARTIAL") & ~below, "UNBALANCED_LANGUAGES")
    return wide.select("doc_id", "score", status.alias("status"), F.array_compact(F.array(*issues, unbalanced)).alias("issues"))


def fill(old: Column, new: Column) -> Column:
    """A newly found value where the old one is blank."""
    return F.coalesce(F.nullif(F.trim(old), F.lit("")), new)
