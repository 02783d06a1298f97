"""Findings as rows: doc_id, issue_type, severity, language, section, page, description.

They follow from counts only, so nothing here reads text. Counts that are null are taken as zero; a document without any count
has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.text import language_name
from glosswork.operators.grading import PANEL, amounts, score, verdicts
from glosswork.operators.sections import gaps

MIN_CHARACTERS = 20
# What findings of each type say, and how much they weigh.
OCR = "Almost no readable text could be extracted. This is most likely a scanned document and needs to be reviewed by hand, or re-processed once OCR is enabled."
OTHER_SCRIPT = "%d segment(s) contained Japanese or Korean script; their Han characters were not counted as Chinese."
NO_SECTION = "Section '%s' has no %s text, although other languages are present in it."
SHORT_SECTION = (
    "Section '%s' has %d characters of %s against %d of %s. Allowing for script density, %s is comparable to %.0f characters of Latin text "
    "against %.0f for %s. The translation may be incomplete."
)
NOT_DETECTED = "%s was not detected in this document."
TOO_LITTLE = "%s is present but has only %d of the required %d characters."
UNBALANCED = "Every language clears its minimum, but the document scores %s against the required %s. One language carries most of the content."
SEVERITY = {
    "OCR_REQUIRED": "WARNING", "PARSER_ERROR": "INFO", "MISSING_SECTION_TRANSLATION": "WARNING", "SHORT_TRANSLATION": "INFO", "LANGUAGE_MISSING": "CRITICAL",
    "LOW_LANGUAGE_COVERAGE": "WARNING", "UNBALANCED_LANGUAGES": "WARNING",
}


def _issue(kind: str, description: Column, language: Column | None = None, section: Column | None = None, page: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("issue_type"), F.lit(SEVERITY[kind]).alias("severity"), (language if language is not None else none.cast("string")).alias("language"),
        (section if section is not None else none.cast("string")).alias("section"), (page if page is not None else none.cast("int")).alias("page"), description.alias("description"),
    )


def _rows(df: DataFrame, key: list[str], *issues: Column) -> DataFrame:
    found = F.explode(F.array_compact(F.array(*issues)))
    return df.select(*key, found.alias("i")).select(*key, "i.*")


def document_issues(totals: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Of whole documents: totals (doc_id, letters, rejected: segments in other East Asian scripts); notes (doc_id, note) of parsers."""
    few = F.coalesce("letters", F.lit(0)) < MIN_CHARACTERS
    found = _rows(
        totals, ["doc_id"], F.when(few, _issue("OCR_REQUIRED", F.lit(OCR))),
        F.when(F.col("rejected") > 0, _issue("PARSER_ERROR", F.format_string(OTHER_SCRIPT, F.col("rejected")))),
    )
    if notes is None:
        return found
    return found.unionByName(_rows(notes.filter(F.col("note").isNotNull()), ["doc_id"], _issue("PARSER_ERROR", F.col("note"))))


def section_issues(report: DataFrame, panel: tuple[str, ...] = ("en", "id", "zh"), density: dict[str, float] | None = None) -> DataFrame:
    """Of sections: languages that are missing (unless all are: such a section holds codes, not translations) or short. report:
    doc_id, sequence, name, page, total_characters, characters."""
    density = density or {"zh": 3.0}
    amount = {c: F.coalesce(F.col("characters")[c], F.lit(0)) for c in panel}
    normal = {c: amount[c] * F.lit(density.get(c, 1.0)) for c in panel}
    # the first of the panel among those of the greatest length
    longest = F.array_max(F.array(*[F.struct(normal[c].alias("normal"), F.lit(-k).alias("rank"), F.lit(c).alias("language"), amount[c].alias("n")) for k, c in enumerate(panel)]))
    rows = gaps(report, panel, density=density).drop("evaluated").join(report.select("doc_id", "sequence", "name", "page", "characters"), ["doc_id", "sequence"])
    rows = rows.filter(F.size("missing") < len(panel)).withColumn("longest", longest)
    issues = []
    for c in panel:
        name = language_name(F.lit(c))
        top = language_name(F.col("longest.language"))
        said = F.format_string(SHORT_SECTION, F.col("name"), amount[c], name, F.col("longest.n"), top, name, normal[c], F.col("longest.normal"), top)
        issues += [
            F.when(F.array_contains("missing", c), _issue("MISSING_SECTION_TRANSLATION", F.format_string(NO_SECTION, F.col("name"), name), F.lit(c), F.col("name"), F.col("page"))),
            F.when(F.array_contains("short", c), _issue("SHORT_TRANSLATION", said, F.lit(c), F.col("name"), F.col("page"))),
        ]
    return _rows(rows, ["doc_id", "sequence"], *issues)


def derived_issues(tallies: DataFrame, panel: dict[str, int] = PANEL, least: float = 80.0) -> DataFrame:
    """What follows from thresholds: languages missing or under theirs; unbalanced ones where none is."""
    wide = amounts(tallies, panel).withColumn("score", score(panel)).join(verdicts(tallies, panel, least).select("doc_id", "status"), "doc_id")
    issues, fine = [], F.lit(True)
    for c, threshold in panel.items():
        n, name = F.col(c), language_name(F.lit(c))
        low = (n > 0) & (n < threshold)
        fine = fine & (n > 0) & ~low
        issues += [
            F.when(n == 0, _issue("LANGUAGE_MISSING", F.format_string(NOT_DETECTED, name), F.lit(c))),
            F.when(low, _issue("LOW_LANGUAGE_COVERAGE", F.format_string(TOO_LITTLE, name, n.cast("bigint"), F.lit(threshold)), F.lit(c))),
        ]
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", "score"), "0+$", ""), r"\.$", "")
    issues.append(F.when((F.col("status") == "PARTIAL") & fine, _issue("UNBALANCED_LANGUAGES", F.format_string(UNBALANCED, plain, F.lit(f"{least:g}")))))
    return _rows(wide, ["doc_id"], *issues)


def advisory(tallies: DataFrame, panel: dict[str, int] = PANEL, least: int = MIN_CHARACTERS) -> DataFrame:
    """doc_id, status, score: a rough status from what is present at all: REVIEW_REQUIRED with too little text, PASS with every
    language of the panel, else FAIL; score: the part of the panel that is present, in percent, null without any text."""
    totals = tallies.groupBy("doc_id").agg(F.coalesce(F.sum("characters"), F.lit(0)).alias("total"))
    rows = amounts(tallies, panel).join(totals, "doc_id")
    present = sum(((F.col(c) > 0).cast("int") for c in panel), F.lit(0))
    status = F.when(F.col("total") < least, "REVIEW_REQUIRED").when(present == len(panel), "PASS").otherwise("FAIL")
    return rows.select("doc_id", status.alias("status"), F.when(F.col("total") > 0, F.round(present / len(panel) * 100, 2)).alias("score"))
