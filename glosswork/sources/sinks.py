"""What an analysis writes, and its payload as text.

One table a fact, each written in one job, so a failed write leaves the other tables whole and a repeated one of the same batch
replaces its own rows only (a partition a batch).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = (
    "struct<languages:array<struct<language:string,characters:bigint,words:bigint,confidence:double>>,"
    "sections:array<struct<name:string,sequence:int,missing:array<string>,short:array<string>>>,"
    "issues:array<struct<issue_type:string,severity:string,description:string>>>"
)


def write_facts(root: str, batch: str, **facts: DataFrame) -> None:
    """Each fact under root/<name>/batch=<batch>; writing a batch again replaces it."""
    for name, df in facts.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def read_facts(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")


def payload(tallies: DataFrame, sections: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, payload: languages, sections and issues of a document as one JSON text, each list in a fixed order. Rows
    delivered twice count once; a document with none of them has no row."""
    group = lambda df, order, *cols: df.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(*cols))).alias(order))
    language = group(tallies, "languages", "language", F.col("characters").cast("bigint").alias("characters"), F.col("words").cast("bigint").alias("words"), "confidence")
    section = group(sections, "sections", "name", "sequence", "missing", "short")
    issue = group(issues, "issues", "issue_type", "severity", "description")
    rows = language.join(section, "doc_id", "full_outer").join(issue, "doc_id", "full_outer")
    return rows.select("doc_id", F.to_json(F.struct("languages", "sections", "issues")).alias("payload"))


def decoded(text: Column) -> Column:
    """The payload's struct; fields that are missing are null, unknown ones are left out, text that is no JSON is null."""
    return F.from_json(text, PAYLOAD)


def languages_of(payloads: DataFrame) -> DataFrame:
    """doc_id, language, characters, words, confidence from payloads; counts that are missing or negative are 0, a confidence
    outside 0-1 is drawn to it."""
    rows = payloads.select("doc_id", F.explode(decoded(F.col("payload"))["languages"]).alias("x")).select("doc_id", "x.*")
    return rows.filter(F.col("language").isNotNull()).withColumns({
        "characters": F.greatest(F.coalesce("characters", F.lit(0)), F.lit(0)), "words": F.when(F.col("words") >= 0, F.col("words")),
        "confidence": F.when(F.col("confidence").isNotNull(), F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))),
    })
